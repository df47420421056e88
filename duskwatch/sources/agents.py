"""Batches of log entries sent by endpoint agents, and agent registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch import schemas


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Agent batches from files with one JSON batch per line."""
    return spark.read.schema(schemas.AGENT_BATCH).json(path)


def stream_batches(spark: SparkSession, path: str, max_files: int | None = None, others: str = "") -> DataFrame:
    """Stream of agent batches from a directory of JSON files; ``others`` are further columns, as a schema."""
    reader = spark.readStream.schema(", ".join(filter(None, [schemas.AGENT_BATCH, others])))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.json(path)


def parse_batches(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Agent batches from a column of JSON text."""
    others = [c for c in payloads.columns if c != column]
    return payloads.select(*others, F.from_json(column, schemas.AGENT_BATCH).alias("_b")).select(*others, "_b.*")


def explode_logs(batches: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per log entry, numbered within its batch. Empty batches give no row."""
    others = keep if keep is not None else [c for c in batches.columns if c not in ("logs", "hostname", "timestamp")]
    entries = batches.select(*others, F.posexplode_outer("logs").alias("log_no", "_log"))
    return entries.where("log_no IS NOT NULL").select(
        *others,
        F.col("log_no").cast("bigint").alias("log_no"),
        F.col("_log.timestamp").alias("timestamp"),
        F.col("_log.hostname").alias("hostname"),
        F.col("_log.source").alias("source"),
        F.col("_log.message").alias("message"),
        F.col("_log.priority").alias("priority"),
        F.col("_log.unit").alias("unit"),
        F.col("_log.raw").alias("raw"),
    )


def batch_sizes(batches: DataFrame) -> Column:
    """Number of log entries in a batch; 0 when there are none."""
    return F.coalesce(F.size("logs"), F.lit(0)).cast("bigint")
