"""System journal exports: one JSON record per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch import schemas
from duskwatch.functions import text

# What a record's missing fields stand for.
DEFAULT_PRIORITY = "6"
DEFAULT_UNIT = "unknown"


def journal_entries(lines: DataFrame, hostname: str = "localhost", column: str = "value") -> DataFrame:
    """Agent log entries from journal lines.

    A line that is no JSON object becomes the message itself, with null priority
    and unit; it is never dropped.
    """
    raw = text.strip(F.col(column))
    record = F.from_json(
        raw, schemas.JOURNAL + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}
    )
    parsed = lines.select("*", raw.alias("_raw"), record.alias("_j"))
    is_record = F.col("_j._bad").isNull()

    def of(name: str, default: str) -> Column:
        return F.coalesce(F.col(f"_j.{name}"), F.lit(default))

    micros = F.col("_j.__REALTIME_TIMESTAMP").try_cast("bigint")
    return parsed.where(F.length("_raw") > 0).select(
        *(c for c in lines.columns if c != column),
        F.when(is_record, F.timestamp_micros(micros)).alias("event_ts"),
        F.lit(hostname).alias("hostname"),
        F.lit("journalctl").alias("source"),
        F.when(is_record, of("MESSAGE", "")).otherwise(F.col("_raw")).alias("message"),
        F.when(is_record, of("PRIORITY", DEFAULT_PRIORITY)).alias("priority"),
        F.when(is_record, of("_SYSTEMD_UNIT", DEFAULT_UNIT)).alias("unit"),
        F.col("_raw").alias("raw"),
    )


def read_journal(spark: SparkSession, path: str, hostname: str = "localhost") -> DataFrame:
    """Journal export files as one batch of entries."""
    return journal_entries(spark.read.text(path), hostname)


def stream_journal(
    spark: SparkSession,
    path: str,
    unit: str | None = None,
    since: Column | None = None,
    hostname: str = "localhost",
    max_files: int | None = None,
) -> DataFrame:
    """Stream of journal lines for one unit, or all, from ``since`` on."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    raw = reader.load(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("ingest_ts"),
    )
    entries = journal_entries(raw, hostname)
    if unit:
        entries = entries.where(F.col("unit") == unit)
    if since is not None:
        entries = entries.where(F.coalesce("event_ts", "ingest_ts") >= since)
    return entries.select("source", "file", F.col("message").alias("line"), "ingest_ts", "event_ts", "unit")
