"""A table that each micro-batch reads and replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchState:
    """State after every micro-batch, kept in two alternating folders.

    Batch N reads what batch N-1 left and writes the other folder, so that
    running batch N again after a failure starts from the same state. ``path``
    belongs to one query, next to its checkpoint.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/slot={batch_id % 2}"

    def before(self, batch_id: int) -> DataFrame:
        """State that batch ``batch_id`` starts from; empty for the first batch."""
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(self.schema + ", _batch bigint").parquet(self._folder(batch_id - 1))
        return stored.where(F.col("_batch") == batch_id - 1).drop("_batch")

    def replace(self, df: DataFrame, batch_id: int) -> None:
        """Store the state that batch ``batch_id`` leaves."""
        df.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            self._folder(batch_id)
        )
