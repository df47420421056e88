"""Filtering, searching and paging of alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.running import row_numbers

NEWEST_FIRST = ("created_at", "id")


def _newest(order: tuple[str, ...]) -> list[Column]:
    return [F.desc(c) for c in order]


def _contains_like(column: str, value: str) -> Column:
    # the caller's % and _ stay wildcards, a backslash is an ordinary character
    return F.col(column).ilike("%" + value.replace("\\", "\\\\") + "%")


def filter_alerts(
    alerts: DataFrame,
    severity: str | None = None,
    event_type: str | None = None,
    source_ip: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Alerts that meet every given filter; empty filters do not count."""
    tests = []
    if severity:
        tests.append(F.col("severity") == severity.upper())
    if event_type:
        tests.append(F.col("event_type") == event_type.upper())
    if source_ip:
        tests.append(_contains_like("source_ip", source_ip))
    if search:
        anywhere = (_contains_like(c, search) for c in ("description", "raw_log", "source_ip"))
        tests.append(reduce(lambda a, b: a | b, anywhere))
    return alerts.where(reduce(lambda a, b: a & b, tests)) if tests else alerts


def filter_report(
    alerts: DataFrame,
    query: str = "",
    severity: str = "",
    event_type: str = "",
    tactic: str = "",
) -> DataFrame:
    """Alerts of a file report: exact facets and a search over all their text."""
    kept = alerts
    if severity:
        kept = kept.where(F.col("severity") == severity)
    if event_type:
        kept = kept.where(F.col("event_type") == event_type)
    if tactic:
        kept = kept.where(F.array_contains("mitre_tactics", tactic))
    wanted = query.lower().strip()
    if wanted:
        kept = kept.where(F.lower(haystack()).contains(wanted))
    return kept


def haystack() -> Column:
    """All searchable text of an alert, blank-separated, without empty parts."""
    plain = F.array("description", "source_ip", "event_type", "sigma_rule_title", "raw_log")
    lists = ("matched_keywords", "mitre_tactics", "mitre_techniques")
    texts = F.concat(plain, *(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists))
    return F.array_join(F.filter(texts, lambda t: F.coalesce(F.length(t) > 0, F.lit(False))), " ")


def page(
    alerts: DataFrame, number: int = 1, size: int = 20, order: tuple[str, ...] = NEWEST_FIRST
) -> DataFrame:
    """One page, newest first.

    Spark keeps at most ``number * size`` rows per task for it; use
    ``numbered_pages`` to walk far into a large result.
    """
    _check("page", number, 1, None)
    _check("limit", size, 1, 100)
    return alerts.orderBy(*_newest(order)).offset((number - 1) * size).limit(size)


def page_info(alerts: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """Total, page, limit and number of pages of a filtered result."""
    _check("page", number, 1, None)
    _check("limit", size, 1, 100)
    return alerts.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(number).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("limit"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / size)).alias("pages"),
    )


def numbered_pages(alerts: DataFrame, size: int = 25, order: list | None = None) -> DataFrame:
    """All rows with their page number and row number, for any depth of paging."""
    numbered = row_numbers(alerts, order or _newest(NEWEST_FIRST), "row_no")
    return numbered.withColumn("page", F.ceil(F.col("row_no") / size))


def newest(df: DataFrame, n: int, most: int, order: tuple[str, ...] = NEWEST_FIRST) -> DataFrame:
    """The newest ``n`` rows, ``n`` being between 1 and ``most``."""
    _check("n", n, 1, most)
    return df.orderBy(*_newest(order)).limit(n)


def recent_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    """Newest alerts for a dashboard."""
    return newest(alerts, n, 50)


def recent_live_logs(live_logs: DataFrame, n: int = 50) -> DataFrame:
    """Newest rows of the live feed."""
    return newest(live_logs, n, 200)


def recent_agent_logs(agent_logs: DataFrame, n: int = 50, order: tuple[str, ...] = NEWEST_FIRST) -> DataFrame:
    """Newest rows received from agents."""
    return newest(agent_logs, n, 200, order)


def newest_kept(live_logs: DataFrame, keep: int = 500, order: tuple[str, ...] = NEWEST_FIRST) -> DataFrame:
    """What pruning leaves of the live feed."""
    return live_logs.orderBy(*_newest(order)).limit(keep)


def unexpired(alerts: DataFrame, days: int, asof: Column | None = None) -> DataFrame:
    """Alerts that retention keeps."""
    return alerts.where(F.col("created_at") >= cutoff(days, asof))


def expired_count(alerts: DataFrame, days: int, asof: Column | None = None) -> DataFrame:
    """Number of alerts that retention would delete."""
    return alerts.where(F.col("created_at") < cutoff(days, asof)).agg(F.count(F.lit(1)).alias("deleted"))


def cutoff(days: int, asof: Column | None) -> Column:
    """Creation time from which on alerts are kept."""
    now = F.current_timestamp() if asof is None else asof
    return now - F.make_interval(days=F.lit(days))


def _check(name: str, value: int, low: int, high: int | None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be between {low} and {high or 'any'}, not {value}")
