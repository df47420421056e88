"""Shaping of alert fields for reports, feeds and notifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.functions.metadata import lookup
from duskwatch.functions.text import UNKNOWN

# Notification colours, layout and link base.
EMBED_COLORS = {"INFO": 0x00FF00, "WARNING": 0xFFFF00, "CRITICAL": 0xFF0000}
EMBED_DEFAULT_COLOR = 0x808080
EMBED_TITLE_MARK = "\U0001f6a8 "
EMBED_RAW_CHARS = 256
TECHNIQUE_URL = "https://attack.mitre.org/techniques/"
PLACEHOLDER_WEBHOOK = "YOUR_WEBHOOK_ID"


def event_label(event_type: Column) -> Column:
    """Event type with blanks for underscores."""
    return F.replace(event_type, F.lit("_"), F.lit(" "))


def technique_url(technique: Column) -> Column:
    """Catalogue link of a technique; a sub-technique's first dot becomes a slash."""
    return F.concat(F.lit(TECHNIQUE_URL), F.regexp_replace(technique, r"^([^.]*)\.", "$1/"))


def keyword_preview(keywords: Column, shown: int) -> Column:
    """The first keywords of a match (eight in file reports, six in tables)."""
    return F.slice(keywords, 1, shown)


def hour_label(hour: Column) -> Column:
    """HH:mm of a timeline bucket."""
    return F.date_format(hour, "HH:mm")


def feed_text(is_alert: Column, description: Column, message: Column) -> Column:
    """Text of a feed row: the alert's description, or the message when benign."""
    return F.when(is_alert, description).otherwise(message)


def feed_time(timestamp: Column) -> Column:
    """ISO time of a feed row down to seconds."""
    return F.substring(iso_time(timestamp), 1, 19)


def iso_time(timestamp: Column) -> Column:
    """ISO 8601 text without zone; microseconds only when there are any."""
    whole = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(micros.endswith(".000000"), whole).otherwise(micros)


def alert_fields() -> Column:
    """A detected alert as one struct of all its fields, as it goes to storage and over the wire."""
    names = (
        "event_type", "source_ip", "description", "severity", "raw_log", "abuse_confidence_score", "sigma_rule_id", "sigma_rule_title",
        "matched_keywords", "false_positives", "mitre_tactics", "mitre_techniques",
    )
    return F.struct(iso_time(F.col("timestamp")).alias("timestamp"), *names)


def _field(name: str, value: Column, inline: bool) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))


def notification_payload(
    event_type: Column,
    description: Column,
    severity: Column,
    source_ip: Column,
    timestamp: Column,
    raw_log: Column,
    score: Column,
    footer: str = "duskwatch",
    icon_url: str | None = None,
) -> Column:
    """JSON text of one webhook message with an embed for the alert; a missing source is shown as UNKNOWN."""
    raw_log = F.coalesce(raw_log, F.lit(""))
    fence = F.lit("```")
    raw = F.when(
        F.char_length(raw_log) > EMBED_RAW_CHARS,
        F.concat(fence, F.substring(raw_log, 1, EMBED_RAW_CHARS), F.lit("..."), fence),
    ).otherwise(F.concat(fence, raw_log, fence))
    fields = [
        _field("Source IP", F.concat(F.lit("`"), F.coalesce(source_ip, F.lit(UNKNOWN)), F.lit("`")), True),
        _field("Severity", severity, True),
        _field("Timestamp", F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss 'UTC'"), False),
        _field("Raw Log", raw, False),
    ]
    rated = _field("Abuse Confidence Score", F.concat(score.cast("string"), F.lit("/100")), True)
    foot = [F.lit(footer).alias("text")]
    if icon_url:
        foot.append(F.lit(icon_url).alias("icon_url"))
    embed = F.struct(
        F.concat(F.lit(EMBED_TITLE_MARK), event_type).alias("title"),
        description.alias("description"),
        F.coalesce(lookup(EMBED_COLORS, severity), F.lit(EMBED_DEFAULT_COLOR)).alias("color"),
        F.when(score > 0, F.array(*fields[:3], rated, fields[3])).otherwise(F.array(*fields)).alias("fields"),
        F.struct(*foot).alias("footer"),
        iso_time(timestamp).alias("timestamp"),
    )
    return F.to_json(F.struct(F.array(embed).alias("embeds")))
