"""Spelling variants: words at edit distance one, by search schemes over FM-indexes of the vocabulary.

Words are counted by partial aggregates; what follows works on the vocabulary of distinct words. If two words differ
by one inserted, deleted or replaced code point, one of them matches the first or the last half of the other exactly. The search
for a word therefore has two parts: match the first half and extend it to the right across the other half allowing
one error, and match the last half and extend it to the left. Extending to the left is a backward search in
an FM-index, and extending to the right is one in the index of the reversed words; the two make up the
bidirectional index. Both searches start at a word's end, which a delimiter marks, so each needs one direction only.

A state of a search is an interval of suffix ranks. It has at most as many children as the alphabet has letters,
however many words share the half, so the work for a word does not grow with the group it lies in.

The vocabulary is cut into blocks by ranges of the words (and of the reversed words), each small enough for an
index in one task. A word asks the blocks whose range holds words with its half: mostly one, more only
if the half fills more than one block. Words that ask one block are dealt over several copies of it if they are many.

Results for odd input: null and empty texts have no words; a null id counts as an empty text in the deletions;
repeated rows count again; the longest run is one word like others; ties go to the smaller word; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm import store

#: Words of a block, words that one copy of a block answers, words that a search handles at a time.
BLOCK, ASKING, STEP = 32768, 65536, 4096
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 18
_UPPER = {c: c + 32 for c in range(65, 91)}


def _count(letters: str, shortest: int, delete_every: int):
    """Counts of a task's words of at least ``shortest`` code points: (id, text) to (word, n)."""
    # a run can lose one code point
    runs = re.compile(f"{letters}{{{shortest},}}")

    def frame(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                begin = zlib.crc32(f"{key.as_py()}:".encode())
                for word, n in Counter(runs.findall(text.translate(_UPPER))).items():
                    h = zlib.crc32(word.encode(), begin)
                    if delete_every and h % delete_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield frame(held)
                    held.clear()
        yield frame(held)

    return run


def vocabulary(
    docs: DataFrame, shortest: int = 7, least: int = 2, delete_every: int = 0, letters: str = "[A-Za-zÀ-ÿ]", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n``: lower-cased (A-Z) maximal runs of letters with at least ``shortest`` code points and ``least`` occurrences.

    ``delete_every``: a run loses a code point where the crc32 of ``<id>:<run>`` is a multiple of it (0: never).
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(_count(letters, shortest, delete_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Index:
    """FM-index of words in ascending order, each ended by a delimiter (code 0)."""

    def __init__(self, words: list[str]):
        letters = sorted(set("".join(words)))
        self.codes = {c: i + 1 for i, c in enumerate(letters)}
        #: Code of letters that no word has.
        self.none = len(letters) + 1
        self.words = len(words)
        text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32)
        text = np.searchsorted(np.array([0, *map(ord, letters)], np.uint32), text).astype(np.int64)
        n = self.size = len(text)
        ends = np.flatnonzero(text == 0)
        end = np.repeat(ends, np.diff(np.concatenate(([-1], ends))))
        # rank of suffixes up to their delimiter, by doubling; equal ones keep the order of the words
        rank, h, longest = text, 1, int(np.diff(np.concatenate(([-1], ends))).max(initial=1))
        while h < longest:
            after = np.arange(n) + h
            inside = after <= end
            pair = rank * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)], 0)
            order = np.argsort(pair, kind="stable")
            new = np.concatenate(([0], (np.diff(pair[order]) != 0).cumsum()))
            rank = np.empty(n, np.int64)
            rank[order] = new
            h *= 2
        suffixes = np.argsort(rank, kind="stable")
        #: Letter before each suffix, in the order of the suffixes.
        self.before = text[suffixes - 1]
        rows = np.argsort(self.before, kind="stable")
        self.key = self.before[rows] * (n + 1) + rows

    def step(self, code, rank):
        """Rank of the first suffix that begins with ``code`` and goes on with a suffix of at least ``rank``."""
        return np.searchsorted(self.key, code * (self.size + 1) + rank)

    def _children(self, low, high):
        """(state, code) of all extensions of intervals by a letter."""
        wide = high - low > self.none
        state = np.flatnonzero(~wide)
        width = (high - low)[state]
        place = np.repeat(low[state] - np.cumsum(width) + width, width) + np.arange(width.sum())
        pairs = np.unique(np.repeat(state, width) * (self.none + 1) + self.before[place])
        all_ = (np.flatnonzero(wide)[:, None] * (self.none + 1) + np.arange(1, self.none)).ravel()
        pairs = np.concatenate((pairs, all_))
        state, code = pairs // (self.none + 1), pairs % (self.none + 1)
        return state[code > 0], code[code > 0]

    def near(self, asked: list[str], exact: np.ndarray):
        """Words at distance one that end like a word from its place ``exact`` on: number of the asked word, number of the word found."""
        length = np.array([len(w) for w in asked])
        begin = np.cumsum(length) - length
        flat = np.array([self.codes.get(c, self.none) for w in asked for c in w], np.int64)
        # states without an error: one per word, extended together from the right
        who, left = np.arange(len(asked)), length.copy()
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), self.words, np.int64)
        once = [np.zeros(0, np.int64)] * 4
        found = []
        while len(who) or len(once[0]):
            # states with an error go on exactly, those with nothing left to match end at a word's begin
            q, a, b, j = once
            done = j == 0
            found.append(np.stack((q[done], self.step(0, a[done]), self.step(0, b[done]))))
            q, a, b, j = (x[~done] for x in (q, a, b, j))
            code = flat[begin[q] + j - 1]
            once = self._kept(q, self.step(code, a), self.step(code, b), j - 1)
            # an error before the next letter, or in it
            open_ = np.flatnonzero(left <= exact[who])
            if len(open_):
                state, code = self._children(low[open_], high[open_])
                state = open_[state]
                a, b, q, j = self.step(code, low[state]), self.step(code, high[state]), who[state], left[state]
                more = [(q, a, b, j)]  # a letter that only the word found has
                changed = j > 0
                changed &= code != flat[np.minimum(begin[q] + np.maximum(j, 1) - 1, len(flat) - 1)]
                more.append((q[changed], a[changed], b[changed], j[changed] - 1))
                lost = open_[left[open_] > 0]  # a letter that only the word asked has
                more.append((who[lost], low[lost], high[lost], left[lost] - 1))
                once = [np.concatenate((x, *(m[i] for m in more))) for i, x in enumerate(once)]
            go = left > 0
            who, low, high, left = who[go], low[go], high[go], left[go]
            code = flat[begin[who] + left - 1]
            who, low, high, left = self._kept(who, self.step(code, low), self.step(code, high), left - 1)
        q, a, b = np.concatenate(found, 1)
        hit = a < b  # one word, as words are distinct
        pairs = np.unique(q[hit] * (self.words + 1) + a[hit])
        return pairs // (self.words + 1), pairs % (self.words + 1)

    @staticmethod
    def _kept(who, low, high, left):
        ok = low < high
        return [x[ok] for x in (who, low, high, left)]


def _search(backward: bool):
    """Near words of those that ask, within one block. ``backward``: blocks of words to be extended to the left, which are kept reversed otherwise."""

    def run(index: pa.Table, asking: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if index.num_rows and asking.num_rows:
            turned = sorted((w if backward else w[::-1], n) for w, n in zip(index.column("word").to_pylist(), index.column("n").to_pylist(), strict=True))
            words, counts = [w for w, _ in turned], [n for _, n in turned]
            fm = Index(words)
            asked = asking.column("word").to_pylist()
            for i in range(0, len(asked), STEP):
                part = asked[i : i + STEP]
                half = np.array([len(w) // 2 for w in part])
                # the reversed word's last letters are the word's first half
                exact = half if backward else np.array([len(w) - len(w) // 2 for w in part])
                for q, f in zip(*fm.near(part if backward else [w[::-1] for w in part], exact), strict=True):
                    word, near = part[q], words[f] if backward else words[f][::-1]
                    if backward and near.startswith(word[: half[q]]):
                        continue  # found by its first half
                    if near != word:
                        out[0].append(word)
                        out[1].append(near)
                        out[2].append(counts[f])
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])

    return run


def _route(bounds: list, backward: bool):
    """Blocks that a word asks: those whose range of keys holds keys that begin with its half."""
    firsts, lasts, numbers = [b[1] for b in bounds], [b[2] for b in bounds], [b[0] for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, rows = [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                half = len(word) // 2
                key = word[half:][::-1] if backward else word[:half]
                for at in range(bisect_left(lasts, key), bisect_right(firsts, key + "\U0010ffff")):
                    to.append(numbers[at])
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), batch.column("word").take(pa.array(rows, pa.int64()))], names=["block", "word"])

    return run


def _scheme(words: DataFrame, count: int, backward: bool) -> DataFrame:
    key = F.reverse("word") if backward else F.col("word")
    cut = words.select("word", "n", key.alias("key")).repartitionByRange(-(-count // BLOCK), "key").withColumn("block", F.spark_partition_id())
    blocks = store.keep(cut, "spelling-blocks").df
    # one row per block
    bounds = [tuple(r) for r in blocks.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("first").collect()]
    asking = store.keep(words.select("word").mapInArrow(_route(bounds, backward), "block int, word string"), "spelling-asking").df
    copies = asking.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("copies"))
    copies = store.keep(copies, "spelling-copies").sized()
    units = 2 * len(bounds) + count // ASKING
    left = blocks.join(copies, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    right = asking.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("word"), F.col("copies")).cast("int"))
    on = ["block", "copy"]
    left = left.select(*on, "word", "n").repartition(units, *on).groupBy(*on)
    right = right.select(*on, "word").repartition(units, *on).groupBy(*on)
    return left.cogroup(right).applyInArrow(_search(backward), "word string, near string, near_n long")


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every word of a vocabulary (``word, n``; stored, distinct) with each word at distance one and its count."""
    count = words.count()
    if not count:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    return _scheme(words, count, False).union(_scheme(words, count, True))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each word's chain of forms; ``forms`` has ``word, form``, without cycles."""
    now = store.keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = now.df.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = store.keep(longer, "spelling-roots")
        now.drop()
        if not after.df.where("moved").limit(1).count():
            return after.df.select("word", "root")
        now = store.keep(after.df.select("word", "root"), "spelling-roots")
        after.drop()


def variants(docs: DataFrame, ratio: int = 10, shortest: int = 7, least: int = 2, delete_every: int = 0, **columns: str) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of the documents' vocabulary.

    A word's form is the most frequent of its near words if it is at least ``ratio`` (above 1) times as frequent.
    """
    words = store.keep(vocabulary(docs, shortest, least, delete_every, **columns), "spelling-words").df
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    best_n = -F.col("best.col1")
    form = F.when(best_n >= ratio * F.col("n"), F.col("best.near"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), best_n).alias("form_n"))
    found = store.keep(found, "spelling-forms").df
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
