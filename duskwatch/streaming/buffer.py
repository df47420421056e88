"""Forwarding rules of agent buffers as stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Age after which entries are dropped, entries and pace of a batch.
MAX_AGE_SECONDS = 300
BATCH_INTERVAL = "10 seconds"


def drop_stale(
    df: DataFrame, event_ts: str = "event_ts", now: str = "ingest_ts", max_age: int = MAX_AGE_SECONDS
) -> DataFrame:
    """Rows that were at most ``max_age`` seconds old on arrival."""
    return df.where(_age(event_ts, now) <= max_age * 1_000_000)


def stale_counts(
    df: DataFrame, event_ts: str = "event_ts", now: str = "ingest_ts", max_age: int = MAX_AGE_SECONDS
) -> DataFrame:
    """Numbers of fresh and stale rows."""
    stale = _age(event_ts, now) > max_age * 1_000_000
    return df.agg(F.count_if(~stale).alias("fresh"), F.count_if(stale).alias("stale"))


def _age(event_ts: str, now: str):
    return F.unix_micros(F.col(now).cast("timestamp")) - F.unix_micros(F.col(event_ts).cast("timestamp"))


def drop_resent(
    df: DataFrame, keys: list[str], event_ts: str = "event_ts", within: str | None = None
) -> DataFrame:
    """Rows without the repeats that re-sending a batch brings.

    No row is lost however late it comes; a stream's state then holds every key
    seen. ``within`` bounds that state, at the price that rows older than the
    watermark are dropped even if new.
    """
    if df.isStreaming and within:
        return df.withWatermark(event_ts, within).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)
