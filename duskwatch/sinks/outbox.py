"""Notifications as rows of an outbox table, for a sender outside of Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import display


def enabled(config: dict) -> bool:
    """True when notifications are on and the webhook is not the sample one."""
    url = config.get("webhook_url") or ""
    return bool(config.get("enabled")) and bool(url) and display.PLACEHOLDER_WEBHOOK not in url


def outbox_rows(alerts: DataFrame, config: dict) -> DataFrame:
    """Payload per alert; no rows while notifications are off."""
    score = F.col("abuse_confidence_score") if "abuse_confidence_score" in alerts.columns else F.lit(0)
    payload = display.notification_payload(
        F.col("event_type"),
        F.col("description"),
        F.col("severity"),
        F.col("source_ip"),
        F.col("timestamp"),
        F.col("raw_log"),
        score,
        config.get("footer", "duskwatch"),
        config.get("icon_url"),
    )
    rows = alerts.select("id", F.lit(config.get("webhook_url")).alias("url"), payload.alias("payload"), "created_at")
    return rows if enabled(config) else rows.limit(0)
