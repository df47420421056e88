"""Analysis of log files as a whole: alerts and their breakdowns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.detect import DetectConfig, detect
from duskwatch.operators.rules import CompiledPack
from duskwatch.plans import stats
from duskwatch.session import stage


@dataclass
class FileReport:
    """Alerts of a file and the tables of its summary."""

    alerts: DataFrame
    summary: DataFrame
    by_type: DataFrame
    by_severity: DataFrame
    by_tactic: DataFrame
    by_technique: DataFrame


def analyze_file(lines: DataFrame, pack: CompiledPack, config: DetectConfig | None = None) -> FileReport:
    """Run detection over ``lines`` and break the alerts down.

    The alerts are stored once, so that the five tables read them instead of
    matching the file again.
    """
    alerts = stage(detect(lines, pack, config), "report")
    return FileReport(
        alerts=alerts,
        summary=summarize(lines, alerts),
        by_type=stats.by_type(alerts),
        by_severity=stats.by_severity(alerts),
        by_tactic=stats.by_tactic(alerts),
        by_technique=stats.by_technique(alerts),
    )


def summarize(lines: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: lines processed and alerts found."""
    processed = lines.agg(F.count(F.lit(1)).alias("lines_processed"))
    found = alerts.agg(F.count(F.lit(1)).alias("alerts_found"))
    return processed.crossJoin(found)
