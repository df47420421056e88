"""Counts, rankings and timelines over alerts.

Rankings break ties by name, so that a limit always keeps the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _now(asof: Column | None) -> Column:
    return F.current_timestamp() if asof is None else asof


def _ranked(df: DataFrame, key: str) -> DataFrame:
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), F.asc_nulls_first(key))


def total_alerts(alerts: DataFrame) -> DataFrame:
    """Number of alerts."""
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts"))


def by_severity(alerts: DataFrame) -> DataFrame:
    """Alerts per severity, most first."""
    return _ranked(alerts, "severity")


def by_type(alerts: DataFrame) -> DataFrame:
    """Alerts per event type, most first."""
    return _ranked(alerts, "event_type")


def top_sources(alerts: DataFrame, n: int = 10, keep_null: bool = False) -> DataFrame:
    """Sources with the most alerts. Alerts without a source count only if ``keep_null``."""
    known = alerts if keep_null else alerts.where(F.col("source_ip").isNotNull())
    return _ranked(known, "source_ip").limit(n)


def last_hour(alerts: DataFrame, asof: Column | None = None) -> DataFrame:
    """Number of alerts created within the last hour."""
    since = _now(asof) - F.expr("INTERVAL 1 HOUR")
    return alerts.where(F.col("created_at") >= since).agg(F.count(F.lit(1)).alias("alerts_last_hour"))


def timeline(alerts: DataFrame, asof: Column | None = None, hours: int = 24) -> DataFrame:
    """Alerts per hour over the last hours; hours without alerts have no row."""
    since = _now(asof) - F.make_interval(hours=F.lit(hours))
    recent = alerts.where(F.col("timestamp") >= since)
    hour = F.date_trunc("hour", F.col("timestamp")).alias("hour")
    return recent.groupBy(hour).agg(F.count(F.lit(1)).alias("count")).orderBy("hour")


def latest_alert(alerts: DataFrame) -> DataFrame:
    """Time of the newest alert; null without alerts."""
    newest = F.max_by("timestamp", F.struct("created_at", "id"))
    return alerts.agg(newest.alias("last_alert"))


def overview(alerts: DataFrame, asof: Column | None = None) -> DataFrame:
    """Total, last-hour count and newest alert in one pass."""
    since = _now(asof) - F.expr("INTERVAL 1 HOUR")
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("created_at") >= since).alias("alerts_last_hour"),
        F.max_by("timestamp", F.struct("created_at", "id")).alias("last_alert"),
    )


def stats_maps(alerts: DataFrame) -> DataFrame:
    """One row: total and the maps severity, type and top-source to count."""

    def as_map(ranked: DataFrame, key: str, name: str) -> DataFrame:
        # one entry per severity or rule, or ten sources
        entries = F.collect_list(F.struct(F.coalesce(F.col(key), F.lit("")), "count"))
        return ranked.agg(F.map_from_entries(entries).alias(name))

    return (
        total_alerts(alerts)
        .crossJoin(as_map(by_severity(alerts), "severity", "by_severity"))
        .crossJoin(as_map(by_type(alerts), "event_type", "by_type"))
        .crossJoin(as_map(top_sources(alerts, 10), "source_ip", "top_10_ips"))
    )


def stat_cards(alerts: DataFrame) -> DataFrame:
    """Critical count and the most frequent event type ('—' without alerts)."""
    counted = alerts.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("severity") == "CRITICAL").alias("critical")
    )
    # ascending names under a maximum: the smallest of the most frequent
    top = F.min_by("event_type", F.struct(-F.col("count"), F.col("event_type")))
    return counted.agg(
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"),
        F.coalesce(top, F.lit("—")).alias("top_type"),
    )


def top_types(alerts: DataFrame, n: int = 8) -> DataFrame:
    """Most frequent event types."""
    return by_type(alerts).limit(n)


def share_of_max(ranked: DataFrame) -> DataFrame:
    """Add each count's percentage of the largest; for rankings of bounded length."""
    return ranked.withColumn(
        "percent", F.col("count") / F.max("count").over(Window.partitionBy()) * 100
    )


def stats_report(alerts: DataFrame) -> DataFrame:
    """Severities by name, five types and five sources, as (section, name, count)."""
    parts = [
        ("severity", by_severity(alerts), "severity"),
        ("event_type", by_type(alerts).limit(5), "event_type"),
        ("source_ip", top_sources(alerts, 5), "source_ip"),
    ]
    rows = [
        df.select(F.lit(section).alias("section"), F.col(key).alias("name"), "count")
        for section, df, key in parts
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def type_facets(alerts: DataFrame) -> DataFrame:
    """Event types that occur, sorted."""
    return _facet(alerts.select(F.col("event_type").alias("value")))


def tactic_facets(alerts: DataFrame) -> DataFrame:
    """Tactics that occur, sorted."""
    return _facet(alerts.select(F.explode_outer("mitre_tactics").alias("value")))


def _facet(values: DataFrame) -> DataFrame:
    return values.where("value IS NOT NULL AND value <> ''").distinct().orderBy("value")


def by_tactic(alerts: DataFrame) -> DataFrame:
    """Alerts per tactic; an alert counts for each of its tactics."""
    return _ranked(_elements(alerts, "mitre_tactics", "tactic"), "tactic")


def by_technique(alerts: DataFrame) -> DataFrame:
    """Alerts per technique; an alert counts for each of its techniques."""
    return _ranked(_elements(alerts, "mitre_techniques", "technique"), "technique")


def _elements(alerts: DataFrame, column: str, name: str) -> DataFrame:
    # outer, as an inner explode computes the list a second time for a filter
    return alerts.select(F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


AD_HOC = {
    "recent_critical": (
        "SELECT timestamp, source_ip, event_type, description FROM {alerts} "
        "WHERE severity = 'CRITICAL' ORDER BY timestamp DESC, id DESC LIMIT 20"
    ),
    "top_attackers": (
        "SELECT source_ip, count(*) AS hits FROM {alerts} "
        "GROUP BY source_ip ORDER BY hits DESC, source_ip NULLS FIRST LIMIT 10"
    ),
    "attacks_by_type": (
        "SELECT event_type, count(*) AS count FROM {alerts} "
        "GROUP BY event_type ORDER BY count DESC, event_type"
    ),
    "last_hour_rows": "SELECT * FROM {alerts} WHERE timestamp > :asof - INTERVAL 1 HOUR",
}


def ad_hoc(alerts: DataFrame, name: str, asof: datetime | None = None) -> DataFrame:
    """One of the documented queries in SQL over the alerts."""
    text = AD_HOC[name]
    if asof is None:
        text = text.replace(":asof", "current_timestamp()")
    args = {"asof": asof} if ":asof" in text else None
    return alerts.sparkSession.sql(text, args=args, alerts=alerts)
