"""Running totals that no hot key can pin to one task.

A window over a key sends all of the key's rows to one task. Here rows are cut
into ranges of (key, order) instead, so that a key with a third of all rows is
spread over a third of the ranges. Each range sums up its own rows, and what a
range must add for the key it continues comes from a table with one row per
range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.session import stage


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list,
    value: Column,
    out: str,
    staged: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's rows up to and including this one.

    ``order`` must give the rows of a key a total order. ``staged`` tells that
    ``df`` is a stored table, cheap to read once more for choosing the ranges.
    """
    rows = df.withColumn("_value", value.cast("bigint"))
    if not staged:
        rows = stage(rows, "running-in")
    ranges = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    # stored, since both uses below must see the same ranges
    ranges = stage(ranges, "running-ranges")

    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0))
    local = Window.partitionBy("_range", *keys).orderBy(*order)
    summed = ranges.withColumn(
        "_local", F.sum("_value").over(local.rowsBetween(Window.unboundedPreceding, 0))
    )
    totals = ranges.groupBy("_range", key.alias("_key")).agg(F.sum("_value").alias("_total"))
    edges = totals.groupBy("_range").agg(
        F.min("_key").alias("_first"),
        F.max("_key").alias("_last"),
        F.max_by("_total", "_key").alias("_last_total"),
    )
    # each range asks for the key it starts with and hands on the key it ends with
    ask = F.struct(F.col("_first").alias("_k"), F.lit(0).alias("_step"), F.lit(0).cast("bigint").alias("_sum"))
    give = F.struct(F.col("_last").alias("_k"), F.lit(1).alias("_step"), F.col("_last_total").alias("_sum"))
    steps = edges.select(F.col("_range").alias("_r"), F.inline(F.array(ask, give)))
    before = Window.partitionBy("_k").orderBy("_r", "_step").rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        steps.withColumn("_carry", F.sum("_sum").over(before))
        .where("_step = 0 AND _carry <> 0")
        .select("_r", "_k", "_carry")
    )
    # at most one row per shuffle partition
    joined = summed.join(
        F.broadcast(carried), (F.col("_range") == F.col("_r")) & key.eqNullSafe(F.col("_k")), "left"
    )
    return joined.withColumn(out, F.col("_local") + F.coalesce("_carry", F.lit(0))).drop(
        "_value", "_range", "_local", "_r", "_k", "_carry"
    )


def row_numbers(df: DataFrame, order: list, out: str) -> DataFrame:
    """Number all rows from 1 along ``order`` without gathering them in one task."""
    return running_sum(df, [], order, F.lit(1), out)
