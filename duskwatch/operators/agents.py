"""Agent batches: detection, receipts and the registry of agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import text
from duskwatch.operators.detect import DetectConfig, detect
from duskwatch.operators.rules import CompiledPack


def with_fallbacks(alerts: DataFrame) -> DataFrame:
    """Hostname for an unknown source, and the raw entry for an empty raw log."""
    return alerts.withColumns(
        {
            "source_ip": F.when(F.col("source_ip") == text.UNKNOWN, F.col("hostname")).otherwise(F.col("source_ip")),
            "raw_log": F.when(F.coalesce(F.length("raw_log"), F.lit(0)) == 0, F.col("raw")).otherwise(F.col("raw_log")),
        }
    )


def agent_alerts(logs: DataFrame, pack: CompiledPack, config: DetectConfig | None = None) -> DataFrame:
    """Alerts of exploded agent logs, matched on their messages."""
    return with_fallbacks(detect(logs.withColumn("line", F.col("message")), pack, config))


def receipts(batches: DataFrame, alerts: DataFrame, batch_key: list[str]) -> DataFrame:
    """Per batch: entries processed and alerts created.

    Alerts are counted per batch before the join, which then has one row per
    batch on both sides.
    """
    sizes = batches.groupBy(*batch_key).agg(
        F.sum(F.coalesce(F.size("logs"), F.lit(0)).cast("bigint")).alias("logs_processed")
    )
    created = alerts.groupBy(*batch_key).agg(F.count(F.lit(1)).alias("alerts_created"))
    return sizes.join(created, batch_key, "left").withColumn(
        "alerts_created", F.coalesce("alerts_created", F.lit(0).cast("bigint"))
    )


def registry_events(registrations: DataFrame | None, batches: DataFrame | None) -> DataFrame:
    """Registrations (agent_id, hostname, ts, metadata) and batches (agent_id, hostname, ts, n) as one log."""
    parts = []
    if registrations is not None:
        parts.append(
            registrations.select(
                "agent_id", "hostname", "ts", F.lit(True).alias("registered"),
                F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.lit(0).cast("bigint").alias("n"),
            )
        )
    if batches is not None:
        parts.append(
            batches.select(
                "agent_id", "hostname", "ts", F.lit(False).alias("registered"),
                F.lit(None).cast("string").alias("metadata"), F.col("n").cast("bigint").alias("n"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def registry(events: DataFrame) -> DataFrame:
    """State of every agent after its events.

    A registration sets hostname and metadata; a batch only adds its entries, and
    names the agent if it came before any registration.
    """
    registration = F.when(F.col("registered"), F.struct("ts", "hostname", "metadata"))
    return _named(
        events.groupBy("agent_id").agg(
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.sum("n").alias("logs_received"),
            F.max(registration).alias("registration"),
            F.min(F.struct("ts", "hostname")).alias("first_event"),
        )
    )


def _named(state: DataFrame) -> DataFrame:
    """Hostname and metadata beside the newest registration and the first event that they come from."""
    return state.select(
        "agent_id",
        F.coalesce("registration.hostname", "first_event.hostname").alias("hostname"),
        "first_seen",
        "last_seen",
        "logs_received",
        F.col("registration.metadata").alias("metadata"),
        "registration",
        "first_event",
    )


def merge_registry(current: DataFrame, events: DataFrame) -> DataFrame:
    """Registry after new events, whatever order they arrive in: both sides have one row per agent.

    The newest registration by its own time names the agent, so one that arrives late overwrites nothing.
    """
    joined = current.alias("c").join(registry(events).alias("f"), "agent_id", "full_outer")
    none = F.lit(0).cast("bigint")
    return _named(
        joined.select(
            "agent_id",
            F.least("c.first_seen", "f.first_seen").alias("first_seen"),
            F.greatest("c.last_seen", "f.last_seen").alias("last_seen"),
            (F.coalesce("c.logs_received", none) + F.coalesce("f.logs_received", none)).alias("logs_received"),
            F.greatest("c.registration", "f.registration").alias("registration"),
            F.least("c.first_event", "f.first_event").alias("first_event"),
        )
    )


def agent_list(agents: DataFrame) -> DataFrame:
    """Agents by time last seen, with metadata as a map; unreadable metadata is an empty map."""
    decoded = F.from_json("metadata", "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return agents.withColumn(
        "metadata", F.when(F.col("metadata").isNotNull(), F.coalesce(decoded, empty))
    ).orderBy(F.desc("last_seen"), "agent_id")
