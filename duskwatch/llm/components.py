"""Connected components of a graph given as an edge table, by alternating star steps.

Each step links every node's neighbours to the smallest one near it; steps are joins and
partial aggregates, written to the shared folder so lineage stays short. No node's
neighbourhood is gathered in a task. The number of steps is logarithmic in practice.
Of a small edge table, the smallest neighbours are broadcast, so its edges are not
dealt out for the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm import store


#: Stored bytes of edges up to which the smallest neighbours of their nodes are broadcast.
SMALL_BYTES = 2 << 20


def _star(edges: DataFrame, large: bool, small: bool) -> DataFrame:
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(F.broadcast(least) if small else least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node reachable, for all nodes of edges ``(a, b)``; both bigint."""
    now = store.keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        small = now.bytes() <= SMALL_BYTES
        after = store.keep(_star(_star(now.df, True, small), False, small), "edges")
        now.drop()
        now = after
        state = now.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40)))).first()
        if state == seen:
            break
        seen = state
    found = now.df.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return found.union(found.select("label", "label")).distinct()
