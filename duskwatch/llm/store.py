"""Intermediate tables in the shared folder, and joins that broadcast by checked size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.session import shared_dir

#: Stored bytes up to which a table may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes of an Arrow batch. A count of rows alone does not bound what a task holds of long texts.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session by bytes; a smaller bound that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Kept:
    """A table written to the shared folder: cuts lineage and survives lost executors.

    ``df`` reads it. ``drop`` deletes it; call that only when nothing lazy reads it any more.
    """

    def __init__(self, df: DataFrame, label: str, compression: str = "zstd"):
        self.spark = df.sparkSession
        bounded_batches(self.spark)
        self.path = f"{shared_dir(self.spark)}/llm/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", compression).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def bytes(self) -> int:
        fs, path = self._fs()
        return fs.getContentSummary(path).getLength()

    def sized(self) -> DataFrame:
        """The table, marked for broadcast only if its stored size is within BROADCAST_BYTES."""
        return F.broadcast(self.df) if self.bytes() <= BROADCAST_BYTES else self.df

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path, True)


def keep(df: DataFrame, label: str, compression: str = "zstd") -> Kept:
    return Kept(df, label, compression)


def bucketed(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder in buckets by ``column`` and read it back.

    Work by that column then needs no shuffle of the table.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/llm/{name}"
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(name)
    return spark.table(name)


def splits(df: DataFrame) -> int:
    """Number of input splits, the measure from which bucket counts are taken."""
    return max(1, df.rdd.getNumPartitions())


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Columns that identify a row even if ids are null or repeated."""
    return [F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
