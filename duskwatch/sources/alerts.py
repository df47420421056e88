"""Stored alerts and live-feed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch import schemas


def decode_list(value: Column) -> Column:
    """List from its JSON text; an empty list for text that is not one."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def decode_alerts(rows: DataFrame) -> DataFrame:
    """Alert rows whose list columns hold JSON text, or are missing, with real lists."""
    types = dict(rows.dtypes)
    lists = {
        c: decode_list(F.col(c))
        if types.get(c) == "string"
        else (F.col(c) if c in types else F.array().cast("array<string>"))
        for c in schemas.JSON_COLUMNS
    }
    return rows.withColumns(lists)


def encode_alerts(alerts: DataFrame) -> DataFrame:
    """Alert rows with list columns as JSON text, for stores without lists."""
    return alerts.withColumns({c: F.to_json(c) for c in schemas.JSON_COLUMNS})


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts stored as Parquet."""
    return decode_alerts(spark.read.parquet(path))


def read_alerts_jdbc(spark: SparkSession, url: str, table: str = "alerts", **options) -> DataFrame:
    """Alerts from a database table whose list columns are JSON text."""
    return decode_alerts(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())
