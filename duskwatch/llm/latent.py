"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of all words, in a hashed space, are counted over all documents.
2. A randomised SVD of the benchmark passages' TF-IDF matrix gives a latent space. The sketch, its
   orthogonalisation and the small factors are distributed sums over words or passages; the driver only solves
   problems of the size of the sketch's width.
3. Documents are read in overlapping windows of words; a window whose latent vector has a cosine of
   COSINE or more with a passage's is a candidate. Windows that lack the words of the answer that
   every match needs are passed over without computing their vectors; all others are compared. What a document
   holds word for word, a whole item of fewer than RUN words or RUN words of a longer one, is a candidate at any cosine.
4. Around a candidate, the longest common subsequence of words with the passage must reach LCS
   of its length, and ANSWER of its most informative third of words, its answer, must stand there; a run
   of RUN words in common needs RUN_ANSWER words of the answer only.

Texts never leave their task; what travels to the tasks is the latent space (bounded by the hashed space times
the rank) and a block of at most ITEMS benchmark passages. More of them are taken in blocks.

Results for odd input: null and empty texts and items match nothing, nor do items of fewer than SHORTEST words; null
ids are carried; repeated rows are judged each by itself; other columns pass through; with an empty benchmark nothing matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm import store
from duskwatch.llm.arrow import parts
from duskwatch.llm.packed import gather
from duskwatch.llm.words import Sequence, inside, slices, word_hashes

SPACE = 1 << 16
RANK, OVERSAMPLE = 128, 32
#: Words in half a window.
HALF = 32
#: Words in a benchmark passage; longer items are cut into passages that overlap by RUN - 1 words, so that no run of RUN
#: words is cut. Fewer than SHORTEST words that are left over join the passage before; the windows' regions allow for 2 * HALF.
PASSAGE = 60
SHORTEST = 5
ITEMS = 20_000
#: Bits of a hash by which words are marked that may begin an exact match.
MARKS = 24
COSINE, LCS, ANSWER, RUN, RUN_ANSWER = 0.35, 0.6, 0.5, 13, 3


def _number(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SPACE, np.int64)
    for batch in batches:
        for a, b in slices(batch["_text"].array):
            counts, (h,) = word_hashes(list(batch["_text"].array[a:b]), lower=True)
            number, begin = _number(h), 0
            for end in np.cumsum(counts).tolist():
                total[np.unique(number[begin:end])] += 1
                begin = end
    at = np.flatnonzero(total)
    yield pd.DataFrame({"feature": at, "n": total[at]})


def informativeness(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each number of the hashed space, over all documents."""
    counts = docs.mapInPandas(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # at most SPACE rows
    n = np.zeros(SPACE)
    n[counts["feature"]] = counts["n"]
    return np.log((docs.count() + 1) / (n + 1))


def _passages(idf: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, (h,) = word_hashes([t if isinstance(t, str) else "" for t in batch["_text"].array], lower=True)
            ends = np.cumsum(counts)
            rows = []
            for i, (item, a, b) in enumerate(zip(batch["item_id"], ends - counts, ends, strict=True)):
                step = PASSAGE - RUN + 1
                n = 1 + max(0, -(-(b - a - PASSAGE - SHORTEST + 1) // step))
                for k in range(n):
                    words = h[a:b][k * step : k * step + PASSAGE if k < n - 1 else b - a]
                    if len(words) >= SHORTEST:
                        rows.append((item, k, words.tobytes(), idf[_number(words)].tobytes()))
            yield pd.DataFrame(rows, columns=["item_id", "passage", "words", "weights"])

    return run


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [np.frombuffer(w, np.uint64) for w in batch["words"]]
        lengths = [len(w) for w in words]
        yield pd.DataFrame(
            {
                "row": np.repeat(batch["row"].to_numpy(), lengths), "feature": np.concatenate([_number(w) for w in words]).astype(np.int32),
                "w": np.concatenate([np.frombuffer(w) for w in batch["weights"]]),
            }
        )


def _normal(keys: np.ndarray, width: int) -> np.ndarray:
    """Reproducible normal numbers for each key."""
    single, place = np.unique(keys, return_inverse=True)
    return np.stack([np.random.default_rng([int(k) % (1 << 64), 29]).standard_normal(width) for k in single])[place]


def _sums(key: str, columns: list[str], make):
    """Per batch, sums of the vectors ``make`` gives the rows, by ``key``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys, place = np.unique(batch[key].to_numpy(), return_inverse=True)
                out = np.zeros((len(keys), len(columns)))
                np.add.at(out, place, make(batch) * batch["w"].to_numpy()[:, None])
                yield pd.DataFrame(out, columns=columns).assign(**{key: keys})[[key, *columns]]

    return run


def _product(entries: DataFrame, key: str, width: int, make, kind: str) -> DataFrame:
    columns = [f"v{i}" for i in range(width)]
    partial = entries.mapInPandas(_sums(key, columns, make), f"{key} {kind}, " + ", ".join(f"{c} double" for c in columns))
    return partial.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns])


def _gram(table: DataFrame, key: str, width: int) -> np.ndarray:
    """Sum over the rows of the outer product of a row with itself."""
    columns = [f"v{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch[columns].to_numpy()
            total += x.T @ x
        yield pd.DataFrame({"g": [total.tobytes()]})

    parts = table.drop(key).mapInPandas(run, "g binary").collect()  # one small matrix per task
    return sum((np.frombuffer(bytes(p[0])).reshape(width, width) for p in parts), np.zeros((width, width)))


def space(entries: DataFrame, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the matrix ``(row, feature, w)``, as one row per number of the hashed space."""
    n = entries.select("row").distinct().count()
    width = min(n, rank + OVERSAMPLE)
    # sketch of the row space, one row per feature
    sketch = store.keep(_product(entries, "feature", width, lambda b: _normal(b["row"].to_numpy(), width), "int"), "latent-sketch").df
    values, vectors = np.linalg.eigh(_gram(sketch, "feature", width))
    good = values > values.max() * 1e-10
    root = vectors[:, good] / np.sqrt(values[good])
    rows = sketch.toPandas()  # at most SPACE rows of the sketch's width
    basis = np.zeros((SPACE, root.shape[1]), np.float32)
    features = rows["feature"].to_numpy()
    basis[features] = rows.drop(columns="feature").to_numpy() @ root
    # tasks get the rows of the features there are, not the whole hashed space
    features = np.sort(features)
    held = basis[features]
    # rotate to singular vectors and cut to the rank
    coded = _product(entries, "row", basis.shape[1], lambda b: held[np.searchsorted(features, b["feature"].to_numpy())], "long")
    _, turn = np.linalg.eigh(_gram(coded, "row", basis.shape[1]))
    return basis @ turn[:, ::-1][:, :rank].astype(np.float32)


def common_length(passage: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine word operation per element of the region."""
    where: dict[int, int] = {}
    for i, w in enumerate(passage.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(passage)) - 1
    row = full
    for w in region.tolist():
        hit = where.get(w, 0) & row
        row = ((row + hit) | (row - hit)) & full
    return len(passage) - row.bit_count()


def common_run(passage: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest run of words in common."""
    best = np.zeros(len(region) + 1, np.int64)
    most = 0
    for w in passage:
        same = region == w
        best[1:] = np.where(same, best[:-1] + 1, 0)
        most = max(most, int(best.max()))
    return most


class Finder:
    """Looks for a block of passages in texts."""

    def __init__(self, passages: pd.DataFrame, idf: np.ndarray, vectors: np.ndarray):
        self.items = passages["item_id"].tolist()
        self.words = [np.frombuffer(w, np.uint64) for w in passages["words"]]
        self.idf = idf.astype(np.float32)
        self.known = np.abs(vectors).max(1) > 0
        # a finder travels with its tasks, so of the hashed space it holds the known rows only
        self.place, self.vectors = np.cumsum(self.known, dtype=np.int32) - 1, vectors[self.known]
        coded = np.stack([(vectors[_number(w)] * self.idf[_number(w)][:, None]).sum(0) for w in self.words])
        self.coded = coded / np.maximum(np.linalg.norm(coded, axis=1), 1e-12)[:, None]
        self.answers = []
        for w in self.words:
            distinct = np.unique(w)
            self.answers.append(distinct[np.argsort(-self.idf[_number(distinct)], kind="stable")[: -(-len(distinct) // 3)]])
        self.need = np.array([min(int(np.ceil(ANSWER * len(a))), RUN_ANSWER, len(a)) for a in self.answers])
        word = np.concatenate(self.answers)
        order = np.argsort(word, kind="stable")
        self._index_exact()
        self.answer_words, self.answer_of = word[order], np.repeat(np.arange(len(self.answers)), [len(a) for a in self.answers])[order]

    def __getstate__(self) -> dict:
        # marks travel as their positions
        return {**self.__dict__, "begins": np.flatnonzero(self.begins).astype(np.int32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.begins = np.zeros(1 << MARKS, bool)
        self.begins[state["begins"]] = True

    def _index_exact(self) -> None:
        """Hashes of whole short passages and of runs of RUN words, by length, and marks of the words they begin with."""
        self.begins = np.zeros(1 << MARKS, bool)
        self.exact = {}
        for length in range(SHORTEST, RUN + 1):
            which = [i for i, w in enumerate(self.words) if (len(w) >= RUN if length == RUN else len(w) == length)]
            if not which:
                continue
            counts = np.array([len(self.words[i]) for i in which])
            joined = np.concatenate([self.words[i] for i in which])
            at = inside(counts, length)
            hashes = Sequence(joined)
            self.begins[hashes.span(at, at + SHORTEST) >> np.uint64(64 - MARKS)] = True
            found = hashes.span(at, at + length)
            order = np.argsort(found, kind="stable")
            self.exact[length] = found[order], np.repeat(which, counts)[at][order]

    def _exact(self, h: np.ndarray, counts: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Windows and passages, as one number, that have a short passage or a run of RUN words in common."""
        at = inside(counts, SHORTEST)
        if not len(at):
            return at
        hashes = Sequence(h)
        at = at[self.begins[hashes.span(at, at + SHORTEST) >> np.uint64(64 - MARKS)]]
        left = np.repeat(np.cumsum(counts), counts)[at] - at
        out = [np.zeros(0, np.int64)]
        for length, (known, passage) in self.exact.items():
            mine = at[left >= length]
            found = hashes.span(mine, mine + length)
            low, high = np.searchsorted(known, found, "left"), np.searchsorted(known, found, "right")
            window = np.repeat(half[mine], high - low)
            # the windows around which it stands
            near = (window[:, None] + np.arange(-3, 3)) * len(self.words) + passage[gather(low, high - low)][:, None]
            out.append(np.unique(near))
        return np.unique(np.concatenate(out))

    def _answers_at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of answer words among all words, and which entries of the answers stand there."""
        low, high = np.searchsorted(self.answer_words, h, "left"), np.searchsorted(self.answer_words, h, "right")
        at = np.flatnonzero(high > low)
        entry = gather(low[at], high[at] - low[at])
        return np.repeat(at, high[at] - low[at]), entry

    def _open(self, h: np.ndarray, half: np.ndarray, owner_half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and passages with enough words of the passage's answer around the window."""
        place, entry = self._answers_at(h)
        at = half[place]
        # a region reaches two halves before its window and two behind
        near = (at[:, None] + np.arange(-3, 3)).ravel()
        inside = (near >= 0) & (near < len(owner_half))
        near = np.clip(near, 0, max(0, len(owner_half) - 1))
        inside &= owner_half[near] == np.repeat(owner_half[at], 6)
        met = np.unique(near[inside] * len(self.answer_words) + np.repeat(entry, 6)[inside])
        window, which = np.divmod(met, len(self.answer_words))
        pair, n = np.unique(window * len(self.words) + self.answer_of[which], return_counts=True)
        window, passage = np.divmod(pair, len(self.words))
        good = n >= self.need[passage]
        return window[good], passage[good]

    def _latent(self, number: np.ndarray, half: np.ndarray, owner_half: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Latent vectors of the wanted windows."""
        halves = np.union1d(wanted, np.minimum(wanted + 1, len(owner_half) - 1))
        row = np.full(len(owner_half), -1)
        row[halves] = np.arange(len(halves))
        use = np.flatnonzero((row[half] >= 0) & self.known[number])
        held = np.zeros((len(halves), self.vectors.shape[1]), np.float32)
        for a in range(0, len(use), 1 << 16):
            mine = use[a : a + (1 << 16)]
            starts = np.flatnonzero(np.concatenate(([True], half[mine][1:] != half[mine][:-1])))
            held[row[half[mine][starts]]] += np.add.reduceat(self.vectors[self.place[number[mine]]] * self.idf[number[mine]][:, None], starts, axis=0)
        after = np.minimum(wanted + 1, len(owner_half) - 1)
        own = (after > wanted) & (owner_half[after] == owner_half[wanted])
        return held[row[wanted]] + np.where(own[:, None], held[row[after]], 0)

    def __call__(self, texts: list) -> list[tuple]:
        """(text number, passage number, cosine, common share, answer share, longest run) of every match, best cosine per pair."""
        counts, (h,) = word_hashes(texts, lower=True)
        begins = np.cumsum(counts) - counts
        halves = -(-counts // HALF)
        first = np.cumsum(halves) - halves
        owner = np.repeat(np.arange(len(texts)), counts)
        half = first[owner] + (np.arange(len(h)) - begins[owner]) // HALF
        owner_half = np.repeat(np.arange(len(texts)), halves)
        found: dict[tuple[int, int], tuple] = {}
        windows, passages = self._open(h, half, owner_half)
        if not len(windows):
            return []
        wanted, which = np.unique(windows, return_inverse=True)
        vectors = self._latent(_number(h), half, owner_half, wanted)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
        cosine = np.einsum("ij,ij->i", vectors[which], self.coded[passages])
        near = (cosine >= COSINE) | np.isin(windows * len(self.words) + passages, self._exact(h, counts, half))
        for w, p, c in zip(windows[near].tolist(), passages[near].tolist(), cosine[near].tolist(), strict=True):
            text, passage = int(owner_half[w]), self.words[p]
            at = begins[text] + (w - first[text]) * HALF
            region = h[max(begins[text], at - len(passage)) : min(begins[text] + counts[text], at + 2 * HALF + len(passage))]
            met = int(np.isin(self.answers[p], region).sum())
            if met < self.need[p]:
                continue
            answer = met / len(self.answers[p])
            share = common_length(passage, region) / len(passage)
            run = common_run(passage, region)
            if (share >= LCS and answer >= ANSWER) or (run >= RUN and met >= min(RUN_ANSWER, len(self.answers[p]))):
                value = (c, share, answer, run)
                if value > found.get((text, p), (-1.0,)):
                    found[text, p] = value
        return [(t, p, *v) for (t, p), v in sorted(found.items())]


def _match(finder: Finder):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].array
            for a, b in slices(texts):
                rows = [(batch["_id"].iat[a + t], finder.items[p], *v) for t, p, *v in finder(list(texts[a:b]))]
                frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "longest_run"])
                yield frame.astype({"longest_run": "int64"})

    return run


def _clean(finder: Finder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch):
                keep = np.ones(len(texts), bool)
                keep[[m[0] for m in finder(texts)]] = False
                yield part.filter(pa.array(keep))

    return run


def finders(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> Iterator[Finder]:
    """One finder per block of benchmark passages; ``benchmark`` has ``item_id`` and ``text``."""
    rows = docs.select(F.col(text_col).alias("_text"))
    items = benchmark.select(F.col("item_id"), F.col("text").alias("_text"))
    if items.where("_text IS NOT NULL").isEmpty():
        return
    idf = informativeness(rows)
    kind = f"item_id {items.schema['item_id'].dataType.simpleString()}, passage int, words binary, weights binary"
    passages = items.mapInPandas(_passages(idf), kind)
    passages = store.keep(passages.withColumn("row", F.xxhash64("item_id", "passage", "words")), "latent-passages").df
    n = passages.count()
    blocks = -(-n // ITEMS)
    vectors = space(passages.mapInPandas(_entries, "row long, feature int, w double")) if n else None
    for block in range(blocks):
        mine = passages.where(F.pmod("row", F.lit(blocks)) == block).toPandas()  # about ITEMS rows
        if len(mine):
            yield Finder(mine.sort_values(["item_id", "passage"]), idf, vectors)


MATCHES = "doc_id string, item_id string, cosine double, lcs_share double, answer_share double, longest_run long"


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item that it gives away, with the figures that show it."""
    # the numbers of both tables cross pandas as text: beside a null it would turn them into rounded doubles
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("_id"), F.col(text_col).alias("_text"))
    item = benchmark.schema["item_id"].dataType
    benchmark = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for finder in finders(docs, benchmark, text_col):
        out = out.union(rows.mapInPandas(_match(finder), MATCHES))
    out = out.withColumns({"doc_id": F.col("doc_id").cast("long"), "item_id": F.col("item_id").cast(item)})
    # an item of several passages is given once, with its best
    best = F.max(F.struct("cosine", "lcs_share", "answer_share", "longest_run"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with their columns, that give away no benchmark item."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias("_text" if c == text_col else f"_c{i}") for i, c in enumerate(names)])
    for finder in finders(docs, benchmark, text_col):
        rows = rows.mapInArrow(_clean(finder), rows.schema)
    return rows.toDF(*names)
