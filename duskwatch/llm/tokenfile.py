"""Token ids of documents in flat binary files that are read by memory mapping.

Documents are range-partitioned by id and sorted; each task writes

* ``.ids``  ids of its documents one after the other, little-endian, 16 bits wide if the
  vocabulary allows it and 32 bits otherwise,
* ``.off``  where each document begins, as unsigned 64-bit numbers, and the end,
* ``.doc``  the documents' ids as signed 64-bit numbers; those with a null id come first.

What a task wrote is one row of a manifest. Names hold a random part and only files of
tasks that succeeded get into the manifest, so a task that runs again leaves no doubt
about which file counts. The position of a file's first id among all ids is a prefix sum
over the manifest, one row per file.

Files go to the shared folder, by the local path if it is mounted and through a file
system that pyarrow knows otherwise.

With ``added`` the added tokens of the vocabulary, such as the end of a text, are recognised in texts as the library does
by default; without it they are encoded as plain text.

Results for odd input: a null or empty text has the end id alone; null ids come first;
documents of equal id stand next to each other, ordered by a hash of their texts; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm import store
from duskwatch.llm.units import units
from duskwatch.llm.words import slices
from duskwatch.session import shared_dir

MANIFEST = "part int, path string, width int, n_docs long, n_null long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Encoded words that a Python worker remembers; beyond half of that it lets go of those not met lately.
REMEMBER = 1_000_000
#: Characters of the texts that are encoded at a time.
AT_ONCE = 4 << 20
# Letters of Latin scripts, which are letters in every version of Unicode that libraries use, and the marks of ASCII.
_LATIN, _MARK = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}", r"!-/:-@\[-`{-~"
_SPACE = r"\pZ\t-\r\x{85}"
_UNITS = pa.list_(pa.large_string())


def _cut(texts: list[str]) -> pa.ListArray:
    """Cut texts that hold no NUL where no match of the byte-level pre-token pattern reaches across, and none changes by the cut.

    That is before a space that a character other than white space follows, between a Latin letter and a mark, before a line
    feed that follows a letter or mark, and after it as well if one follows.
    """
    cut = pa.array(texts, pa.large_string())
    if pc.any(pc.match_substring_regex(cut, f" (?:[{_SPACE}]|\\z)")).as_py():
        cut = pc.replace_substring_regex(cut, f" ([^{_SPACE}])", "\0 \\1")
    else:
        cut = pc.replace_substring(cut, " ", "\0 ")
    cut = pc.replace_substring_regex(cut, f"([{_LATIN}])([{_MARK}])", "\\1\0\\2")
    cut = pc.replace_substring_regex(cut, f"([{_LATIN}{_MARK}])\n", "\\1\0\n")
    cut = pc.replace_substring_regex(cut, f"\0\n([{_LATIN}{_MARK}])", "\0\n\0\\1")
    return pc.split_pattern(cut, "\0")


class WordEncoder:
    """Encodes texts with a vocabulary file of the tokenizers library, each distinct word once as long as it is remembered.

    Many words that begin with their only space go into one call. With the byte-level pattern no token reaches across such a
    space, so a word's ids begin with the one whose token begins with a space.
    """

    def __init__(self, vocabulary: str, added: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = not added
        names = self.tokenizer.get_vocab()
        tokens = [t for t in self.tokenizer.get_added_tokens_decoder().values() if added or not t.special]
        # the longest of those that begin at one place comes first
        contents = sorted((t.content for t in tokens), key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, contents)) + ")") if contents else None
        # such tokens take in or ask for what stands beside them
        self.whole = any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in tokens)
        rules = json.loads(vocabulary)
        by = rules.get("pre_tokenizer") or {}
        byte_level = by.get("type") == "ByteLevel" and by.get("use_regex", True) and not by.get("add_prefix_space", True)
        self.fine = byte_level and rules.get("normalizer") is None
        # side by side, words could make up an added token that holds a space
        self.joins = self.fine and not self.whole and not any(" " in c for c in contents)
        self.begins = np.zeros(max(names.values(), default=0) + 1, bool)
        # a space stands as this character
        self.begins[[n for t, n in names.items() if t.startswith("Ġ")]] = True
        self.width = 2 if max(names.values(), default=0) < 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, words: list[str]) -> None:
        for word, got in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = np.array(got.ids, f"<u{self.width}").tobytes()

    def learn(self, words: list[str]) -> None:
        easy, rest = [], []
        for word in words:
            (easy if self.joins and word[:1] == " " and word[1:].split() == [word[1:]] else rest).append(word)
        groups = [easy[i : i + 500] for i in range(0, len(easy), 500)]
        texts = ["".join(g) for g in groups]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, f"<u{self.width}")
            cuts = (np.flatnonzero(self.begins[ids]) * self.width).tolist()
            if len(cuts) != len(group) or cuts[0]:
                rest += group
                continue
            data = ids.tobytes()
            self.known.update(zip(group, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)])), strict=True))
        if rest:
            self._plain(rest)

    def _units(self, text: str) -> list[str]:
        """Parts of a text that are encoded independently: added tokens, and the units of what stands between them."""
        if self.marks is None or self.marks.search(text) is None:
            return units(text)
        return [text] if self.whole else [u for i, x in enumerate(self.marks.split(text)) for u in ([x] if i % 2 else units(x))]

    def _parts(self, texts: list[str]) -> pa.ListArray:
        """The parts of each text that are encoded independently."""
        odd = [not self.fine or "\0" in t or (self.marks is not None and self.marks.search(t) is not None) for t in texts]
        if not any(odd):
            return _cut(texts)
        even = _cut([t for t, x in zip(texts, odd, strict=True) if not x])
        found = pa.concat_arrays([even, pa.array([self._units(t) for t, x in zip(texts, odd, strict=True) if x], _UNITS)])
        # even texts stand before odd ones
        return found.take(pa.array(np.argsort(np.argsort(odd, kind="stable"))))

    def _ids(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBER // 2:
            self.older, self.known, new = self.known, {}, words
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        self.learn([w for w in new if w not in self.older])
        return list(map(self.known.__getitem__, words))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        parts = self._parts(texts)
        coded = parts.flatten().dictionary_encode()
        found = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        data = np.frombuffer(b"".join(found), f"<u{self.width}")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.cumsum(n)
        # ids of each part after those of the part before
        ids = data[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends + n, n) + np.arange(n.sum())].tobytes()
        bounds = np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy()))] * self.width
        for a, b in itertools.pairwise(bounds.tolist()):
            yield ids[a:b]


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str, added: bool) -> WordEncoder:
    """The encoder of a Python worker, which keeps it, and the words it remembers, from one task to the next."""
    return WordEncoder(vocabulary, added)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(folder: str, vocabulary: Callable[[], str] | str, end: int, part_of: Callable[[], int], added: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(vocabulary, added)
        tail = np.array([end], f"<u{words.width}").tobytes()
        files, at = None, folder.rstrip("/") + f"/part-{part_of():05d}-{uuid.uuid4().hex}"
        offsets, n, nulls = 0, 0, 0
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["_text"].array]
            if files is None:
                system, base = _open(folder)
                system.create_dir(base, recursive=True)
                base = base.rstrip("/") + at[len(folder.rstrip("/")) :]
                files = [system.open_output_stream(base + kind) for kind in (".ids", ".off", ".doc")]
            for a, b in slices(texts, AT_ONCE):
                for data in words.encode(texts[a:b]):
                    files[0].write(data + tail)
                    files[1].write(np.array([offsets], "<u8").tobytes())
                    offsets += len(data) // words.width + 1
            files[2].write(batch["_id"].to_numpy("<i8").tobytes())
            n += len(batch)
            nulls += int(batch["_none"].sum())
        if files is not None:
            files[1].write(np.array([offsets], "<u8").tobytes())
            for f in files:
                f.close()
            yield pd.DataFrame([(part_of(), at, words.width, n, nulls, offsets)], columns=["part", "path", "width", "n_docs", "n_null", "n_tokens"])

    return run


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def write_tokens(docs: DataFrame, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Write the files and return their manifest, with ``base``: the ids in all files before.

    ``vocabulary`` is the content of a vocabulary file, ``end`` the id put after each document, ``added``
    tells whether added tokens in texts count as such.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    ranged = rows.repartitionByRange(store.splits(rows), F.col("_id")).sortWithinPartitions("_id", F.xxhash64("_text"))
    # pandas would turn ids beside a null into doubles
    ranged = ranged.select(F.coalesce("_id", F.lit(0)).alias("_id"), F.col("_id").isNull().alias("_none"), "_text")
    folder = f"{shared_dir(spark)}/llm/tokens-{uuid.uuid4().hex}"
    manifest = store.keep(ranged.mapInPandas(_write(folder, vocabulary, end, _part, added), MANIFEST), "token-manifest").df
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _map(system, path: str, kind: str) -> np.ndarray:
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    return np.frombuffer(system.open_input_file(path).read(), kind)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            system, path = _open(row.path)
            ids, offsets, docs = (_map(system, path + x, k) for x, k in ((".ids", f"<u{row.width}"), (".off", "<u8"), (".doc", "<i8")))
            for a in range(0, row.n_docs, 10_000):
                b = min(a + 10_000, row.n_docs)
                starts, ends = offsets[a:b].astype(np.int64), offsets[a + 1 : b + 1].astype(np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if i < row.n_null else int(docs[i]) for i in range(a, b)], "Int64"),
                        "start": starts + row.base,
                        "n_tokens": ends - starts,
                        "ids_crc32": [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts, ends, strict=True)],
                    }
                )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files: ``doc_id``, ``start``, ``n_tokens`` and a checksum of its ids."""
    files = manifest.repartition(store.splits(manifest) * 8, "part")
    return files.mapInPandas(_read, READ)
