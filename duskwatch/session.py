"""Session settings and the shared staging area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # splits of 128 MB keep a task's text, its matches and its sort runs in memory
    "spark.sql.files.maxPartitionBytes": str(128 << 20),
}


def build_session(app_name: str = "duskwatch", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULT_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local master, where driver and tasks share one machine, may fall back
    to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="duskwatch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage(df: DataFrame, label: str, reader: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, so a lost executor never recomputes what came before, and fixes
    values that a re-run could assign differently (such as partition numbers).
    ``reader`` is the session that reads it, by default that of ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (reader or spark).read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores when the scan behind ``df`` has fewer splits than that.

    Only small or badly cut inputs are shuffled by this; a large input has more
    splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
