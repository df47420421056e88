"""Importance resampling of documents toward a target distribution, over deduplicated lines.

Features are runs of 1 to ``max_n`` words, hashed into buckets. The gain of a bucket is the log ratio of its smoothed
share in the target to its share in the documents, a document's weight the sum over its features, and
a fixed Gumbel draw per document added to the weight makes the highest scores a sample without
replacement in proportion to the weights.

Newlines separate words, so they cut a text into lines that share no feature but those that run
across a cut. Equal lines are gathered first; the features of each distinct line are found and
hashed once and stored, its counts enter the corpus counts times its occurrences, and once the gains are known
its weight is summed once and handed to all documents that hold it. Runs of words across cuts are counted by
document and added to both (with ``max_n`` of 1 there are none).

Lines are told apart by themselves, and joined by 128 bits of SHA-256. A line that a large share of all lines equals
is counted by partial aggregates and joined by a broadcast of bounded size. Corpus counts reach the driver as one
number per bucket.

Results for odd input: null and empty texts have no features and weight 0; a null id counts as an empty text in
the draw and ranks after others of its score; repeated rows are scored and drawn one by one; ties go to the smaller id, then in any order; documents under
``min_words`` are never drawn; other columns are ignored; an empty table gives no rows, an empty target
gains as smoothing has it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm import store
from duskwatch.llm.classes import join_classes
from duskwatch.operators.running import row_numbers

#: Grams whose bucket a task remembers at a time.
MEMO = 1 << 18
_HAS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_CODED = "key binary, size long, n_words long, n_features long, buckets binary"


def _letters() -> bytes:
    """Lower-cases A-Z and turns every other byte that stands between words into a space."""
    plain = bytearray(range(256)).lower()
    for b in range(128):
        if not chr(plain[b]).isalnum():
            plain[b] = 32
    return bytes(plain)


class _Buckets(dict):
    def __init__(self, number: int):
        super().__init__()
        self.number = number

    def __missing__(self, gram: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[gram] = zlib.crc32(gram) % self.number
        return found


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _coder(max_n: int, buckets: int):
    """Features of distinct lines: (key, size, line) to (key, size, words, features, buckets of the features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo, kind = _letters(), _Buckets(buckets), _kind(buckets)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                n_words, n_features, coded = [], [], []
                for line in part.column("line").cast(pa.binary()):
                    words = line.as_py().translate(table).split()
                    found = [memo[w] for w in words]
                    for n in range(2, max_n + 1):
                        found += [memo[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
                    n_words.append(len(words))
                    n_features.append(len(found))
                    coded.append(np.array(found, kind).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("size"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(coded, pa.binary())],
                    names=["key", "size", "n_words", "n_features", "buckets"],
                )

    return run


def _crossing(max_n: int, buckets: int):
    """Features of a text that run across a newline: (row, text) to (row, features, buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo, kind = _letters(), _Buckets(buckets), _kind(buckets)
        for batch in batches:
            rows, n_features, coded = [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words, line = [], []
                for i, piece in enumerate(text.as_py().split(b"\n")):
                    more = piece.translate(table).split()
                    words += more
                    line += [i] * len(more)
                found = [
                    memo[b" ".join(words[i : i + n])]
                    for n in range(2, max_n + 1)
                    for i in range(len(words) - n + 1)
                    if line[i] != line[i + n - 1]
                ]
                if found:
                    rows.append(row)
                    n_features.append(len(found))
                    coded.append(np.array(found, kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(n_features, pa.int64()), pa.array(coded, pa.binary())], names=["row", "n_features", "buckets"]
            )

    return run


def _totals(buckets: int):
    """Count of each bucket over a task's rows (size, buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(buckets, np.int64), _kind(buckets)
        for batch in batches:
            for size, coded in zip(batch.column("size").to_pylist(), batch.column("buckets"), strict=True):
                found = np.frombuffer(coded.as_py(), kind)
                if len(found) * 8 > buckets:
                    total += size * np.bincount(found, minlength=buckets)
                else:
                    np.add.at(total, found, size)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "count"])

    return run


def _weigh(gains: np.ndarray, names: list[str]):
    """Replaces the buckets of a row by the sum of their gains, in ``weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(len(gains))
        for batch in batches:
            weight = [int(gains[np.frombuffer(coded.as_py(), kind)].sum()) for coded in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(weight, pa.int64())], names=[*names, "weight"])

    return run


class Counted:
    """A corpus cut into lines: its rows, distinct lines and crossing runs with their buckets, and the count of each bucket."""

    def __init__(self, texts: DataFrame, max_n: int, buckets: int):
        """``texts`` has ``text`` and may have ``doc_id``."""
        self.rows = store.keep(texts.select(F.monotonically_increasing_id().alias("row"), *texts.columns), "resample-rows")
        filled = self.rows.df.where("text IS NOT NULL")
        lines = filled.select("row", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(_HAS_WORD))
        key = F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("key")
        distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("size")).select(key, "size", "line")
        self.lines = lines.select("row", key)
        self.coded = store.keep(distinct.mapInArrow(_coder(max_n, buckets), _CODED), "resample-lines")
        parts = [self.coded.df.select("size", "buckets")]
        self.crossing = None
        if max_n > 1:
            crossing = filled.select("row", "text").mapInArrow(_crossing(max_n, buckets), "row long, n_features long, buckets binary")
            self.crossing = store.keep(crossing, "resample-crossing")
            parts.append(self.crossing.df.select(F.lit(1).cast("long").alias("size"), "buckets"))
        self.counts = np.zeros(buckets, np.int64)
        for part in parts:
            summed = part.mapInArrow(_totals(buckets), "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))
            for bucket, count in summed.collect():  # at most one row per bucket
                self.counts[bucket] += count


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Floor of 1000 times the log ratio of each bucket's smoothed shares."""
    k, big_t, big_s = len(source), float(target.sum()), float(source.sum())
    ratio = [(t + 1.0) * (big_s + k) / ((s + 1.0) * (big_t + k)) for t, s in zip(target.tolist(), source.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _with_weights(found: Counted, gain: np.ndarray) -> DataFrame:
    """``row, n_words, n_features, weight`` of the rows that have a feature."""
    names = ["key", "size", "n_words", "n_features"]
    weighed = store.keep(found.coded.df.mapInArrow(_weigh(gain, names), "key binary, size long, n_words long, n_features long, weight long"), "resample-weights").df
    total = weighed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = join_classes(found.lines, weighed, "key", "size", total).select("row", "n_words", "n_features", "weight")
    if found.crossing is not None:
        more = found.crossing.df.mapInArrow(_weigh(gain, ["row", "n_features"]), "row long, n_features long, weight long")
        parts = parts.union(more.select("row", F.lit(0).cast("long"), "n_features", "weight"))
    return parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_n: int = 2,
    buckets: int = 10000,
    min_words: int = 20,
    percent: int = 10,
    seed: str = "2024",
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank``; ``rank`` is null for those not drawn.

    Of the documents with at least ``min_words`` words, ``percent`` percent (rounded down) are drawn.
    """
    source = Counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), max_n, buckets)
    aim = Counted(target.select(F.col(target_col).alias("text")), max_n, buckets)
    weights = _with_weights(source, gains(aim.counts, source.counts))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    draw = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    weight = F.coalesce("weight", F.lit(0))
    scored = source.rows.df.select("row", "doc_id").join(weights, "row", "left").select(
        "row",
        "doc_id",
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.coalesce("n_features", F.lit(0)).alias("n_features"),
        weight.alias("weight"),
        (weight + draw).cast("long").alias("score"),
    )
    scored = store.keep(scored, "resample-scores").df
    open_ = scored.where(F.col("n_words") >= min_words).select("row", "doc_id", "score")
    number = open_.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    drawn = row_numbers(open_, order, "rank").where(F.col("rank") <= number).select("row", "rank")
    return scored.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
