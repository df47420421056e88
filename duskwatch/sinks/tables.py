"""Alert, live-feed and registry tables in Parquet.

Tables are partitioned by day (``dt``) and by the batch that wrote the rows
(``batch``). A batch replaces its own partitions only, so one that is
run again after a failure leaves every row once. ``store.Store`` keeps the tables of a live run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch import schemas
from duskwatch.functions import text
from duskwatch.plans import alerts as queries
from duskwatch.session import stage


def alert_rows(alerts: DataFrame, created_at: Column | None = None, identity: list[str] | None = None) -> DataFrame:
    """Detected alerts as rows of the alert table, with id and creation time.

    The id is a hash of what identifies the line (all given columns), so that
    detecting a line twice gives the same id; alerts that have an ``id`` keep it. Newest-first order is by creation
    time and id.
    """
    created = F.current_timestamp() if created_at is None else created_at
    return alerts.select(
        _id(alerts, identity or [c for c in ("source", "file", "line_id", "event_ts", "raw_log") if c in alerts.columns]),
        "timestamp",
        "event_type",
        "severity",
        "source_ip",
        "description",
        "raw_log",
        *schemas.JSON_COLUMNS,
        "sigma_rule_id",
        "sigma_rule_title",
        created.alias("created_at"),
        *[c for c in alerts.columns if c == "amends"],
    )


def _id(rows: DataFrame, identity: list[str] | None) -> Column:
    return F.col("id") if "id" in rows.columns else F.xxhash64(*identity).alias("id")


def live_rows(settled: DataFrame, identity: list[str] | None, created_at: Column | None = None) -> DataFrame:
    """One live-feed row per line of ``detect(..., keep_benign=True)``.

    Messages are whole lines; ``shown`` cuts them for display. Alert fields, the
    source address among them, stay null for benign lines.
    """
    created = F.current_timestamp() if created_at is None else created_at
    is_alert = F.col("event_type").isNotNull()
    return settled.select(
        _id(settled, identity),
        F.col("ingest_ts").alias("timestamp"),
        "source",
        F.col("line").alias("message"),
        is_alert.alias("is_alert"),
        "severity",
        "event_type",
        "description",
        F.when(is_alert, F.col("source_ip")).alias("source_ip"),
        created.alias("created_at"),
        *[c for c in settled.columns if c == "amends"],
    )


def agent_rows(settled: DataFrame, identity: list[str] | None = None) -> DataFrame:
    """One live-feed row per entry that an agent sent, benign ones included; alert fields are null for these."""
    return settled.select(
        _id(settled, identity),
        F.col("logged").alias("timestamp"),
        "hostname",
        "source",
        F.col("line").alias("message"),
        "agent_id",
        F.col("event_type").isNotNull().alias("is_alert"),
        "severity",
        "event_type",
        "description",
        F.col("ingest_ts").alias("created_at"),
        *[c for c in settled.columns if c == "amends"],
    )


def shown(feed: DataFrame) -> DataFrame:
    """Live-feed rows with messages cut to the length that a feed shows."""
    return feed.withColumn("message", text.cap_message(F.col("message")))


def append(rows: DataFrame, path: str, batch: int | str | None = None, cluster_by: tuple[str, ...] = ()) -> None:
    """Add rows below ``path``.

    A named ``batch`` replaces what it wrote before, so that it can run again; without a name the rows are a batch
    of their own and nothing is replaced. Names must differ between writers, so they should contain the run's.
    Spark evens out the files of each day, cutting large days and joining small
    ones. Rows sorted by ``cluster_by`` let readers skip row groups by their
    minimum and maximum.
    """
    dated = rows.withColumns({"dt": F.to_date("created_at"), "batch": F.lit(uuid.uuid4().hex if batch is None else str(batch))})
    dated = dated.hint("rebalance", "dt")
    if cluster_by:
        dated = dated.sortWithinPartitions("dt", *cluster_by)
    _overwrite_partitions(dated, path)


def append_alerts(rows: DataFrame, path: str, batch: int | str | None = None) -> None:
    """Append alerts, clustered by the columns that filters use."""
    append(rows, path, batch, ("severity", "event_type", "source_ip"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a table; ``dt`` stays, so that filters on it skip whole days."""
    return spark.read.parquet(path).drop("batch")


def delete_old_alerts(spark: SparkSession, path: str, days: int, asof: Column | None = None) -> int:
    """Delete alerts older than ``days`` and return their number.

    Days that are wholly expired go as directories, only the day of the cutoff is
    written anew.
    """
    table = spark.read.parquet(path)
    cutoff = queries.cutoff(days, asof)
    last_day = F.to_date(cutoff)
    # one row per stored day, and one per batch of the day of the cutoff
    gone_days = table.where(F.col("dt") < last_day).groupBy("dt").agg(F.count(F.lit(1)).alias("gone")).collect()
    batches = (
        table.where(F.col("dt") == last_day)
        .groupBy("dt", "batch")
        .agg(F.count_if(F.col("created_at") < cutoff).alias("gone"), F.count(F.lit(1)).alias("stored"))
        .where("gone > 0")
        .collect()
    )
    cut = [b.batch for b in batches if b.gone < b.stored]
    if cut:
        rest = table.where((F.col("dt") == last_day) & F.col("batch").isin(cut) & (F.col("created_at") >= cutoff))
        _overwrite_partitions(stage(rest, "retention"), path)
    for b in (b for b in batches if b.gone == b.stored):
        _delete(spark, f"{path}/dt={b.dt}/batch={b.batch}")
    for day in gone_days:
        _delete(spark, f"{path}/dt={day.dt}")
    return sum(r.gone for r in [*gone_days, *batches])


def _overwrite_partitions(rows: DataFrame, path: str) -> None:
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt", "batch")
        .parquet(path)
    )


def prune_live_logs(spark: SparkSession, path: str, keep: int = 500) -> None:
    """Rewrite a feed that nobody writes to with its newest rows only; ``Store.prune`` works beside running writers."""
    kept = stage(queries.newest_kept(spark.read.parquet(path), keep), "prune")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("dt", "batch").parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
