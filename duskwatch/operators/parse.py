"""Raw lines to log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import text


def explode_lines(df: DataFrame, column: str, keep: list[str], line_no: str = "line_no") -> DataFrame:
    """Non-blank, stripped lines of a text column, numbered within their text.

    Each text is cut where it lies, so nothing is shuffled.
    """
    # outer, as an inner explode makes Spark split a second time to find empty texts
    pieces = df.select(*keep, F.posexplode_outer(text.split_lines(F.col(column))).alias(line_no, "_raw"))
    stripped = pieces.select(*keep, (F.col(line_no) + 1).cast("bigint").alias(line_no), text.strip(F.col("_raw")).alias("line"))
    return stripped.where(F.length("line") > 0)


def parse_events(lines: DataFrame, line: str = "line", ingest_ts: str | None = "ingest_ts") -> DataFrame:
    """Add address, syslog time, event time and user of every line."""
    at = F.col(ingest_ts) if ingest_ts else F.current_timestamp()
    return lines.withColumns(
        {
            "source_ip": text.source_ip(F.col(line)),
            "log_time": text.syslog_time(F.col(line), at),
            "event_ts": text.event_time(F.col(line), at),
            "user": text.user(F.col(line)),
        }
    )


def tagged(lines: DataFrame, source: str = "source", line: str = "line", out: str = "raw_log") -> DataFrame:
    """Add the line with its source tag, the text that live detection works on."""
    return lines.withColumn(out, text.tag_source(F.col(source), F.col(line)))

