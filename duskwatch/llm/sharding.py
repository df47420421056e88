"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

How many rows of each input partition go to each shard follows a multivariate
hypergeometric law, given the partitions' counts and the shards' sizes. Drawing these
counts first makes the shuffle exact: every partition permutes its rows and cuts them by
its row of the matrix, rows are exchanged, and each receiver permutes what it got.

A shard is cut into blocks of bounded size by the same law, drawn per shard in a task of
its own, so no task holds a whole shard. The driver sees one count per partition and draws a
partitions-by-shards matrix, metadata that doesn't grow with the rows.

The random numbers are stored with the rows before anything depends on them, so a task
that runs again gives the same result. Shard sizes differ by one row at most; the law is ``rows``.

Results for odd input: null and repeated rows are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm import store

#: Rows in a block of a shard.
BLOCK_ROWS = 250_000


def matrix(row_counts: list[int], column_sizes: list[int], rng: np.random.Generator) -> np.ndarray:
    """Counts with the given row and column sums, drawn as a uniform shuffle would give them."""
    left = np.array(column_sizes, np.int64)
    out = np.zeros((len(row_counts), len(left)), np.int64)
    for i, n in enumerate(row_counts):
        # a chain of univariate draws has no limit on the population
        take, open_rows = n, int(left.sum())
        for j, size in enumerate(left.tolist()):
            if take == 0:
                break
            others = open_rows - size
            got = _draw(rng, size, others, take)
            out[i, j] = got
            take -= got
            open_rows = others
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric number; beyond the library's limit of 1e9 the normal law stands in for it."""
    if good == 0 or sample == 0:
        return 0
    if bad == 0:
        return sample
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    mean = sample * good / total
    deviation = (mean * (bad / total) * ((total - sample) / max(1, total - 1))) ** 0.5
    return int(min(max(round(rng.normal(mean, deviation)), max(0, sample - bad)), min(good, sample)))


def sizes(n: int, parts: int) -> list[int]:
    return [n // parts + (i < n % parts) for i in range(parts)]


def _blocks(seed: int, block_rows: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        shard, counts = int(pdf["shard"].iloc[0]), pdf["_count"].tolist()
        total = sum(counts)
        blocks = sizes(total, max(1, -(-total // block_rows)))
        drawn = matrix(counts, blocks, np.random.default_rng([seed, shard]))
        base = np.cumsum([0, *blocks[:-1]])
        rows = []
        for part, skip, line in zip(pdf["_part"], pdf["_skip"], drawn, strict=True):
            begin = int(skip)
            for block, n in enumerate(line.tolist()):
                if n:
                    rows.append((int(part), begin, begin + n, shard, block, int(base[block])))
                    begin += n
        return pd.DataFrame(rows, columns=["_part", "_from", "_to", "shard", "_block", "_base"])

    return run


def shard(rows: DataFrame, shards: int, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard) by a uniform random shuffle."""
    spark = rows.sparkSession
    names = rows.columns
    dealt = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.spark_partition_id().alias("_part"),
        F.rand(seed).alias("_first"),
        F.rand(seed + 1).alias("_second"),
    )
    dealt = store.keep(dealt, "shard-rows").df
    counts = [(r["_part"], r["count"]) for r in dealt.groupBy("_part").count().orderBy("_part").collect()]
    drawn = matrix([n for _, n in counts], sizes(sum(n for _, n in counts), shards), np.random.default_rng(seed))
    lines = []
    for (part, _), line in zip(counts, drawn, strict=True):
        skip = np.cumsum([0, *line[:-1]])
        lines += [(part, s, int(n), int(skip[s])) for s, n in enumerate(line.tolist()) if n]
    plan = spark.createDataFrame(lines, "_part int, shard int, _count long, _skip long")
    cuts = plan.groupBy("shard").applyInPandas(_blocks(seed, block_rows), "_part int, _from long, _to long, shard int, _block int, _base long")
    # one sorted list of cuts per partition
    cuts = cuts.groupBy("_part").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "shard", "_block", "_base"))).alias("_cuts"))
    local = Window.partitionBy("_part").orderBy("_first", "_second")
    ranked = dealt.withColumn("_at", F.row_number().over(local) - 1).join(cuts, "_part")
    cut = F.element_at(F.filter("_cuts", lambda c: (c["_from"] <= F.col("_at")) & (F.col("_at") < c["_to"])), 1)
    sent = ranked.select("_row", "_second", cut.alias("_cut")).select("_row", "_second", "_cut.shard", "_cut._block", "_cut._base")
    again = Window.partitionBy("shard", "_block").orderBy("_second")
    slot = (F.col("_base") + F.row_number().over(again) - 1).cast("long")
    return sent.select(*[F.col("_row")[c].alias(c) for c in names], F.col("shard"), slot.alias("slot"))
