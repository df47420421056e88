"""Tables of a live run in one folder, with batches that become visible together.

Writers put rows into folders named by day and batch, and then add a record to the folder's log that names the
batch's part in every table. Readers take the batches that the log names, so a batch is
seen in all tables or in none, whatever fails between two writes. Batch names are unique to a run, so
runs that write side by side, or on one day, keep each other's rows.

A record can also retire batches (compaction names what it replaces in the same record), or move a table's horizon,
below which rows are no longer shown (retention, pruning of the feed). Both are one small file, written beside
running writers; no row is written again until its day is compacted. ``vacuum`` deletes what is retired.

A row may be written again under the same id, with ``amends`` set, when what it says has changed; readers
see its newest version. Tables without such rows are read as they stand.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch import schemas
from duskwatch.plans import alerts as queries
from duskwatch.session import stage

SCHEMAS = {
    "alerts": schemas.ALERTS,
    "feed": schemas.LIVE_LOGS,
    "outbox": "id bigint, url string, payload string, created_at timestamp",
    "agent_feed": schemas.AGENT_FEED,
    "receipts": schemas.RECEIPTS,
    "registry_events": schemas.REGISTRY_EVENTS,
}
CLUSTERED = {"alerts": ("severity", "event_type", "source_ip")}
_LEAST = -(1 << 63)
_HIDDEN = "version bigint, amends boolean, dt date, batch string"


class Store:
    """Tables below ``root``; ``SCHEMAS`` names them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- log ---------------------------------------------------------------

    def committed(self, name: str) -> bool:
        """Whether the log has a record of this name."""
        return self._fs.exists(self._path(f"{self.root}/_log/{name}.json"))

    def commit(self, name: str, add: dict | None = None, remove: dict | None = None, horizon: dict | None = None, amended: list | None = None) -> None:
        """Add a record; it is there as a whole or not at all."""
        record = {"add": add or {}, "remove": remove or {}, "horizon": horizon or {}, "amended": amended or []}
        made, final = self._path(f"{self.root}/_log/.{name}.{uuid.uuid4().hex}"), self._path(f"{self.root}/_log/{name}.json")
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        if not self._fs.rename(made, final):
            raise FileExistsError(final.toString())

    def _records(self) -> list[dict]:
        """The log, one small record per batch since the last compaction of it."""
        folder = self._path(f"{self.root}/_log")
        if not self._fs.exists(folder):
            return []
        rows = self.spark.read.option("pathGlobFilter", "*.json").text(folder.toString(), wholetext=True).collect()
        return [json.loads(r.value) for r in rows]

    def live(self, table: str) -> tuple[list[str], tuple | None, bool]:
        """Batches of a table that readers see, its horizon (micros, id) and whether rows of it may be amended."""
        records = self._records()
        gone = {b for r in records for b in r["remove"].get(table, [])}
        batches = sorted({b for r in records for b in r["add"].get(table, [])} - gone)
        horizons = [tuple(r["horizon"][table]) for r in records if table in r["horizon"]]
        amended = any(table in r["amended"] and set(r["add"].get(table, [])) - gone for r in records)
        return batches, max(horizons, default=None), amended

    # --- rows --------------------------------------------------------------

    def write(self, table: str, rows: DataFrame, batch: str, version: int | Column = 0) -> None:
        """Write a batch's rows, replacing those of an earlier attempt; the log makes them visible."""
        version = version if isinstance(version, Column) else F.lit(version)
        hidden = {"version": version.cast("bigint"), "dt": F.to_date("created_at"), "batch": F.lit(batch)}
        if "amends" not in rows.columns:
            hidden["amends"] = F.lit(False)
        dated = rows.withColumns(hidden).hint("rebalance", "dt")
        if table in CLUSTERED:
            dated = dated.sortWithinPartitions("dt", *CLUSTERED[table])
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(f"{self.root}/{table}")

    def _rows(self, table: str, batches: list[str]) -> DataFrame:
        """Rows of batches with their hidden columns. A batch without rows has no folder."""
        schema = f"{SCHEMAS[table]}, {_HIDDEN}"
        if not batches or not self._fs.exists(self._path(f"{self.root}/{table}")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}").where(F.col("batch").isin(batches))

    def _visible(self, table: str) -> DataFrame:
        batches, horizon, amended = self.live(table)
        rows = self._rows(table, batches)
        if horizon:
            at, row_id = horizon
            micros = F.unix_micros("created_at")
            rows = rows.where(F.col("dt") >= F.to_date(F.timestamp_micros(F.lit(at))))
            rows = rows.where((micros > at) | ((micros == at) & (F.col("id") >= row_id)))
        if amended:
            # only ids that were written again are compared
            again = rows.where("amends")
            newest = again.groupBy("id").agg(F.max("version").alias("newest"))
            plain = rows.join(newest, "id", "left_anti")
            rows = plain.unionByName(again.join(newest, "id").where("version = newest").drop("newest"))
        return rows

    def read(self, table: str) -> DataFrame:
        """Rows that are visible; ``dt`` stays, so that filters on it skip whole days."""
        return self._visible(table).drop("version", "amends", "batch")

    # --- upkeep ------------------------------------------------------------

    def expire(self, days: int, table: str = "alerts", asof: Column | None = None) -> int:
        """Hide rows older than ``days`` and return their number."""
        cutoff = queries.cutoff(days, asof)
        gone = self.read(table).where(F.col("created_at") < cutoff).count()
        at = self.spark.range(1).select(F.unix_micros(cutoff)).first()[0]
        self.commit(f"expire-{uuid.uuid4().hex}", horizon={table: [at, _LEAST]})
        return gone

    def prune(self, keep: int = 500, table: str = "feed") -> None:
        """Hide all rows but the newest ``keep``. Rows that arrive meanwhile are newer and stay."""
        oldest = self.read(table).orderBy(F.desc("created_at"), F.desc("id")).select(F.unix_micros("created_at").alias("at"), "id").offset(keep - 1).limit(1).first()
        if oldest:
            self.commit(f"prune-{uuid.uuid4().hex}", horizon={table: [oldest.at, oldest.id]})

    def compact(self, table: str, before: datetime | None = None) -> int:
        """Write the batches there are as one per day, as readers see them, and return how many it replaces.

        ``before`` leaves days from that time on alone. Run one compaction at a time.
        """
        batches, _, amended = self.live(table)
        every = len(batches)
        if before is not None:
            recent = self._rows(table, batches).where(F.col("dt") >= F.to_date(F.lit(before))).select("batch").distinct().collect()
            batches = sorted(set(batches) - {r.batch for r in recent})
        if len(batches) < 2:
            return 0
        name = f"compact-{uuid.uuid4().hex}"
        merged = self._visible(table).where(F.col("batch").isin(batches)).drop("dt", "batch")
        # what a row amends may lie in a batch that stays
        settled = len(batches) == every or not amended
        if settled:
            merged = merged.withColumn("amends", F.lit(False))
        self.write(table, stage(merged, "compact"), name, F.col("version"))
        self.commit(name, add={table: [name]}, remove={table: batches}, amended=[] if settled else [table])
        return len(batches)

    def vacuum(self, older_seconds: float = 3600) -> int:
        """Delete folders of batches that were retired, and of attempts never committed, ``older_seconds`` ago or earlier."""
        records, deleted, limit = self._records(), 0, (time.time() - older_seconds) * 1000
        for table in SCHEMAS:
            folders = self._fs.globStatus(self._path(f"{self.root}/{table}/dt=*/batch=*"))
            added = {b for r in records for b in r["add"].get(table, [])}
            removed = {b for r in records for b in r["remove"].get(table, [])}
            for status in folders or []:
                name = status.getPath().getName().removeprefix("batch=")
                if status.getModificationTime() <= limit and (name in removed or name not in added):
                    deleted += bool(self._fs.delete(status.getPath(), True))
        return deleted


def union(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null in it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
