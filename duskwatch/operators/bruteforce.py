"""Sliding-window count of failed logins per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.running import running_sum

# How brute-force alerts name themselves.
EVENT_TYPE = "BRUTE_FORCE"
TITLE = "SSH Brute Force Authentication Failure"
SEVERITY = "CRITICAL"
TACTICS = ["Credential Access"]
TECHNIQUES = ["T1110.001"]

THRESHOLD = 5
WINDOW_SECONDS = 60


def window_counts(
    failures: DataFrame,
    key: str = "source_ip",
    time: str = "event_ts",
    seq: list[str] | str = "line_id",
    window_seconds: float = WINDOW_SECONDS,
    out: str = "attempts",
    staged: bool = False,
) -> DataFrame:
    """Add the number of failures of the same key in the window ending at each row.

    The window is open at its start: a failure exactly ``window_seconds`` old no
    longer counts. Rows of equal time count in the order of ``seq``.

    Every failure enters the window once and leaves it once, so the count is a
    running total of entries minus exits, which splits hot keys. ``staged`` tells
    that ``failures`` is read from a stored table.
    """
    seq = [seq] if isinstance(seq, str) else list(seq)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    exit_at = micros + int(window_seconds * 1_000_000)
    # exits come first among rows of one time: the window excludes its start
    enter = F.struct(micros.alias("_at"), F.lit(1).alias("_step"))
    leave = F.struct(exit_at.alias("_at"), F.lit(0).alias("_step"))
    steps = failures.select("*", F.inline_outer(F.array(enter, leave)))
    # only what orders an exit travels with it
    payload = [c for c in failures.columns if c not in {key, *seq}]
    steps = steps.withColumns({c: F.when(F.col("_step") == 1, F.col(c)) for c in payload})
    change = F.when(F.col("_step") == 1, 1).otherwise(-1)
    counted = running_sum(steps, [key], ["_at", "_step", *seq], change, out, staged)
    return counted.where("_step = 1").drop("_at", "_step")


def arrival_counts(
    failures: DataFrame, key: str = "source_ip", seq: list[str] | str = "line_id", out: str = "attempts"
) -> DataFrame:
    """Add the number of failures of the key so far, as if all arrived within one window."""
    seq = [seq] if isinstance(seq, str) else list(seq)
    return running_sum(failures, [key], seq, F.lit(1), out)


def description(attempts: Column, source: Column, window_seconds: float) -> Column:
    """Text of a brute-force alert."""
    seconds = int(window_seconds) if float(window_seconds).is_integer() else window_seconds
    return F.concat(
        attempts.cast("string"), F.lit(" failed login attempts from "), source, F.lit(f" within {seconds}s")
    )
