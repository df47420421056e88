"""Log files, in batch and as streams of new files."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch import schemas
from duskwatch.functions import text


def _lines(raw: DataFrame, source: Column) -> DataFrame:
    """Stripped, non-empty lines of a text scan in the log-line schema."""
    # the scan has cut at CR and LF, and splits large files among tasks; the
    # rarer line boundaries are cut here, row by row
    pieces = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.explode_outer(text.split_lines(text.drop_invalid_utf8(F.col("value")))).alias("_raw"),
    )
    return pieces.select(
        # ascends with the position in a file, also over its splits
        F.monotonically_increasing_id().alias("line_id"),
        source.alias("source"),
        "file",
        text.strip(F.col("_raw")).alias("line"),
        F.current_timestamp().alias("ingest_ts"),
    ).where(F.length("line") > 0)


def read_log_files(spark: SparkSession, path: str | list[str], source: str = "file") -> DataFrame:
    """Lines of text files as one batch; undecodable bytes are dropped."""
    return _lines(spark.read.text(path), F.lit(source))


def read_agent_files(spark: SparkSession, path: str | list[str], hostname: str) -> DataFrame:
    """Lines of text files as agent log entries, with ``file:<path>`` as source."""
    return _agent_entries(read_log_files(spark, path), hostname)


def _agent_entries(lines: DataFrame, hostname: str) -> DataFrame:
    plain = F.regexp_replace("file", "^file:/+", "/")
    return lines.select(
        "line_id",
        F.date_format("ingest_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit(hostname).alias("hostname"),
        F.concat(F.lit("file:"), plain).alias("source"),
        F.col("line").alias("message"),
        F.lit(None).cast("string").alias("priority"),
        F.lit(None).cast("string").alias("unit"),
        F.col("line").alias("raw"),
    )


def stream_log_files(
    spark: SparkSession,
    path: str,
    source: str = "application",
    since: datetime | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Stream of the lines of new files in a directory of rolled logs.

    Files are the unit: a file is read once, when it appears, and not followed as
    it grows. ``since`` skips files modified before it, so that a stream can
    start at the end of the history. The checkpoint remembers what was read.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    lines = _stream_lines(reader.load(path), F.lit(source))
    return lines.where(F.col("ingest_ts") >= F.lit(since)) if since else lines


def _stream_lines(raw: DataFrame, source: Column) -> DataFrame:
    # a stream numbers nothing: positions are given per micro-batch, where they are needed
    pieces = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("ingest_ts"),
        F.explode_outer(text.split_lines(text.drop_invalid_utf8(F.col("value")))).alias("_raw"),
    )
    return pieces.select(
        source.alias("source"), "file", text.strip(F.col("_raw")).alias("line"), "ingest_ts"
    ).where(F.length("line") > 0)


def stream_syslog(spark: SparkSession, path: str, facility: str | None = None, **options) -> DataFrame:
    """Stream of syslog lines, restricted to those that contain ``facility`` as written."""
    lines = stream_log_files(spark, path, "syslog", **options)
    return of_facility(lines, facility)


def of_facility(lines: DataFrame, facility: str | None) -> DataFrame:
    """Lines that contain ``facility`` as written; all lines without one."""
    return lines.where(F.col("line").contains(facility)) if facility else lines


def union_sources(spark: SparkSession, sources: list[DataFrame | None]) -> DataFrame:
    """All available sources as one; without any, an empty table of lines."""
    present = [s for s in sources if s is not None]
    if not present:
        return spark.createDataFrame([], schemas.LOG_LINES)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)
