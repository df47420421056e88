"""From log lines to alerts: brute force first, then the best rule, minus allowed sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import text
from duskwatch.operators import bruteforce, rules
from duskwatch.operators.allowlist import is_allowed
from duskwatch.operators.rules import CompiledPack

@dataclass
class DetectConfig:
    """Thresholds and allow list of a detection run."""

    max_failed_logins: int = bruteforce.THRESHOLD
    failed_login_window: float = bruteforce.WINDOW_SECONDS
    allowed: list[str] = field(default_factory=list)
    # "prefix" ignores mask lengths and so covers more than the networks listed
    allow_mode: str = "cidr"
    # "event" counts within the window of event time, "arrival" takes a whole
    # input as arriving at once, the way an uploaded file does
    time_mode: str = "event"
    # columns that put lines of the same key and time in order
    seq: tuple[str, ...] = ("line_id",)


def parsed_lines(lines: DataFrame, config: DetectConfig, line: str = "line") -> DataFrame:
    """Lines with address, event time, failed-login and allow-list flags; blank lines vanish."""
    if "raw_log" not in lines.columns:
        lines = lines.withColumn("raw_log", F.col(line))
    marks = F.struct(
        text.is_present(F.col(line)).alias("_present"),
        text.is_failed_login(F.col("raw_log")).alias("_failed"),
    )
    # told apart first, so that whoever wants failed logins only has no other line parsed
    present = _with_fields(lines, marks).where("_present").drop("_present")
    at = text.event_time(F.col(line), F.col("ingest_ts"))
    if "event_ts" in present.columns:  # a source that knows the time need not say it in the line
        present = present.withColumnRenamed("event_ts", "_given_ts")
        at = F.coalesce("_given_ts", at)
    parsed = _with_fields(present, F.struct(text.source_ip(F.col(line)).alias("source_ip"), at.alias("event_ts")))
    kept = [c for c in present.columns if c not in ("_given_ts", "_failed")]
    allowed = is_allowed(F.col("source_ip"), config.allowed, config.allow_mode)
    return parsed.select(*kept, "source_ip", "event_ts", "_failed").withColumn("_allowed", allowed)


def _with_fields(df: DataFrame, fields: Column) -> DataFrame:
    """Add the fields of a struct, computed once per row.

    A projection shares the steps that several fields have in common, which a
    generator does not; filters on what a generator gives are not pushed below
    it, where they would compute the fields once more.
    """
    computed = df.select("*", fields.alias("_fields"))
    return computed.select(*df.columns, F.inline_outer(F.array("_fields")))


def detect(
    lines: DataFrame,
    pack: CompiledPack,
    config: DetectConfig | None = None,
    line: str = "line",
    keep_benign: bool = False,
) -> DataFrame:
    """Alerts for ``lines`` (columns line_id, line, ingest_ts and any others, which are kept).

    Each line gives at most one alert. A failed login that reaches the threshold
    is a brute-force alert, whatever rules it matches; all other lines report
    their best rule. Only failed logins go through the window count and its
    shuffle, everything else is decided where it is read. ``keep_benign`` keeps
    lines without an alert, with null alert fields.
    """
    config = config or DetectConfig()
    parsed = parsed_lines(lines, config, line)
    counted = count_failures(parsed.where(is_counted()), config)
    return decide(counted.unionByName(uncounted(parsed.where(~is_counted()))), pack, config, keep_benign)


def is_counted() -> Column:
    """True for the parsed lines that the brute-force counter takes in."""
    return F.col("_failed") & ~F.col("_allowed")


def count_failures(failures: DataFrame, config: DetectConfig) -> DataFrame:
    """Failed logins with the number of ``attempts`` up to each of them."""
    if config.time_mode == "arrival":
        return bruteforce.arrival_counts(failures, seq=list(config.seq))
    return bruteforce.window_counts(
        failures, seq=list(config.seq), window_seconds=config.failed_login_window
    )


def uncounted(parsed: DataFrame) -> DataFrame:
    """Lines that the counter does not take in, with null ``attempts``."""
    return parsed.withColumn("attempts", F.lit(None).cast("bigint"))


def decide(
    counted: DataFrame, pack: CompiledPack, config: DetectConfig, keep_benign: bool = False
) -> DataFrame:
    """Alert of each parsed line: brute force at the threshold, else its best rule.

    Only lines that need the rules are matched: brute force takes precedence, and
    lines of allowed sources report nothing, unless their address is unknown.
    """
    brute = F.coalesce(F.col("attempts") >= config.max_failed_logins, F.lit(False))
    is_open = ~F.col("_allowed") | (F.col("source_ip") == text.UNKNOWN)
    matchable = counted.withColumn("_text", F.when(is_open & ~brute, F.col("raw_log")).otherwise(F.lit("")))
    best = rules.match_best(matchable, pack, "_text", keep_unmatched=True)
    window = config.failed_login_window
    of_brute = {
        "event_type": F.lit(bruteforce.EVENT_TYPE),
        "description": bruteforce.description(F.col("attempts"), F.col("source_ip"), window),
        "severity": F.lit(bruteforce.SEVERITY),
        "rule_id": F.lit(""),
        "rule_title": F.lit(bruteforce.TITLE),
        "matched_keywords": F.array().cast("array<string>"),
        "false_positives": F.array().cast("array<string>"),
        "mitre_tactics": F.array(*map(F.lit, bruteforce.TACTICS)),
        "mitre_techniques": F.array(*map(F.lit, bruteforce.TECHNIQUES)),
    }
    renamed = {"rule_id": "sigma_rule_id", "rule_title": "sigma_rule_title"}
    kept = [c for c in counted.columns if c not in ("attempts", "_failed", "_allowed")]
    alerts = best.select(
        *kept,
        *(F.when(brute, value).otherwise(F.col(c)).alias(renamed.get(c, c)) for c, value in of_brute.items()),
        F.col("event_ts").alias("timestamp"),
        F.lit(0).alias("abuse_confidence_score"),
    )
    return alerts if keep_benign else alerts.where(F.col("event_type").isNotNull())


def with_reputation(alerts: DataFrame, reputation: DataFrame, ip: str = "source_ip") -> DataFrame:
    """Set the abuse score from a table of (source_ip, score); 0 for unknown addresses.

    One row per address is kept on the reputation side, so no alert is multiplied.
    Spark broadcasts the table when its size allows, and splits hot addresses otherwise.
    """
    scores = reputation.groupBy(F.col(ip).alias("_ip")).agg(F.max("score").alias("_score"))
    joined = alerts.drop("abuse_confidence_score").join(scores, F.col(ip) == F.col("_ip"), "left")
    return joined.withColumn("abuse_confidence_score", F.coalesce("_score", F.lit(0))).drop("_ip", "_score")
