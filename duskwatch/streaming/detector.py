"""Live detection: streams of lines, or of agent batches, to alerts, feeds, receipts, registry and outbox."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duskwatch import schemas
from duskwatch.operators import agents
from duskwatch.operators.agents import merge_registry
from duskwatch.operators.detect import DetectConfig, decide, is_counted, parsed_lines
from duskwatch.operators.parse import tagged
from duskwatch.operators.rules import CompiledPack
from duskwatch.session import stage
from duskwatch.sinks import outbox, tables
from duskwatch.sinks.store import Store, union
from duskwatch.streaming import windows
from duskwatch.streaming.state import BatchState


@dataclass
class Outputs:
    """Where a live run writes: tables of a ``Store`` below ``root``."""

    root: str
    feed: bool = True
    outbox: bool = False

    def store(self, spark: SparkSession) -> Store:
        """The tables."""
        return Store(spark, self.root)


def run_id(spark: SparkSession, path: str) -> str:
    """Name of the run whose state is at ``path``: given once, kept over restarts, different for every run."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.parquet(f"{path}/run")
    return spark.read.schema("run string").parquet(f"{path}/run").first().run


def counted_stream(lines: DataFrame, config: DetectConfig, keep: float | None) -> DataFrame:
    """Parsed lines of a stream; failed logins come with ``attempts``, and again when their count changes.

    Only failed logins are dealt by source and time, all other lines stay where they are read.
    """
    parsed = parsed_lines(lines, config)
    order = [c for c in config.seq if c in parsed.columns]
    failures = windows.live_counts(parsed.where(is_counted()), order, config.failed_login_window, keep=keep)
    return union([failures, parsed.where(~is_counted())])


class LiveDetector:
    """Detection over a stream of lines (columns source, file, line, ingest_ts and any others).

    What a micro-batch adds to the tables becomes visible at once. A failed login that comes late raises
    the counts of later ones; their alerts are then written again under their ids. ``counters`` hold the lines taken in and the alerts
    raised since the start of this run.
    """

    def __init__(
        self,
        spark: SparkSession,
        pack: CompiledPack,
        outputs: Outputs,
        state_path: str,
        config: DetectConfig | None = None,
        notify: dict | None = None,
    ):
        self.spark, self.pack, self.outputs = spark, pack, outputs
        self.config = config or DetectConfig()
        self.notify = notify or {}
        self.counters = {"lines_processed": 0, "alerts_triggered": 0}
        self.store = outputs.store(spark)
        self.run = run_id(spark, state_path)

    def start(self, lines: DataFrame, checkpoint: str, interval: str | None = None, keep: float | None = windows.KEEP_SECONDS) -> StreamingQuery:
        """Run over the stream; without ``interval`` take in what is there and stop.

        ``keep`` bounds the state of a run with an ``interval``.
        """
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return (
            counted_stream(self.prepared(lines), self.config, keep if interval else None)
            .writeStream.foreachBatch(self.process)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

    def prepared(self, lines: DataFrame) -> DataFrame:
        """Lines as detection takes them, with the text that it works on."""
        return tagged(lines)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Write what a micro-batch of counted lines adds to the tables."""
        name = f"{self.run}-{batch_id}"
        if self.store.committed(name):
            return  # the run stopped between this and its checkpoint
        new = F.col("line").isNotNull() & ~F.col("amends")
        watch = Observation()
        settled = self.settled(batch, batch_id).observe(
            watch,
            F.count_if(new).alias("lines"),
            F.count_if(new & F.col("event_type").isNotNull()).alias("alerts"),
            F.count_if("amends").alias("amended"),
        )
        # read back by the run's own session: that of a micro-batch has adaptive execution off, without which rows are not
        # dealt by day and every task writes a file for every day
        settled = stage(settled, "live-settled", self.spark)
        done = watch.get
        writes = self.writes(settled)
        # a channel that fails does not keep the others from their rows, but no reader sees any before all are there;
        # the error then fails the batch, which is safe to run again
        # tables are written side by side: most of a write is the commit of one folder per day, which the driver does one by one
        with ThreadPoolExecutor(len(writes)) as pool:
            # each thread with properties of its own, as writes put their numbers into them
            own = lambda: inheritable_thread_target(self.spark)(self.store.write)
            written = [pool.submit(own(), table, rows, name, batch_id) for table, rows in writes.items()]
        errors = [w.exception() for w in written if w.exception()]
        if errors:
            raise errors[0]
        amended = [t for t, rows in writes.items() if done["amended"] and "amends" in rows.columns]
        self.store.commit(name, add={table: [name] for table in writes}, amended=amended)
        self.counters["lines_processed"] += done["lines"]
        self.counters["alerts_triggered"] += done["alerts"]

    def settled(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Alert of each line, with its id and whether it was reported before; ``raised``: it is an alert only now."""
        # text literals are no part of generated code, so that of the first batch serves all
        place = F.monotonically_increasing_id()
        counted = F.col("stretch").isNotNull()
        identity = F.when(counted, F.xxhash64(F.lit(self.run), "source_ip", *windows.IDENTITY)).otherwise(F.xxhash64(F.lit(f"{self.run}-{batch_id}"), place))
        least = self.config.max_failed_logins
        raised = (F.col("attempts") >= least) & (F.col("before") < least)
        named = batch.withColumns({"id": identity, "amends": F.col("before").isNotNull(), "raised": F.coalesce(raised, F.lit(False))})
        return decide(named.drop(*windows.IDENTITY, "before"), self.pack, self.config, keep_benign=True)

    def writes(self, settled: DataFrame) -> dict[str, DataFrame]:
        """Rows of each table."""
        found = settled.where(F.col("event_type").isNotNull())
        out = {"alerts": self._alerts(found)}
        if self.outputs.feed:
            out["feed"] = tables.live_rows(settled, None, F.col("ingest_ts"))
        if self.outputs.outbox:
            told = found.where(~F.col("amends") | F.col("raised"))
            out["outbox"] = outbox.outbox_rows(self._alerts(told).drop("amends"), self.notify)
        return out

    def _alerts(self, found: DataFrame) -> DataFrame:
        return tables.alert_rows(found, F.col("ingest_ts"))


class AgentIngest(LiveDetector):
    """Detection over a stream of agent batches, with everything that comes of a batch in one pass.

    Batches have agent_id, hostname, timestamp and logs, ``ingest_ts`` (arrival), and any other columns. Equal batches that
    arrive together share their receipt's number of alerts. Of each batch come alerts (the host stands for an unknown address), a feed of all its entries, a receipt, and an event of the agents' registry, all
    visible together.
    """

    def prepared(self, lines: DataFrame) -> DataFrame:
        """One row per entry, and one per batch, without a line, that carries the batch's size.

        Entries remember their batch by a number drawn from it, not by an agent's id, which may hold a third of all entries.
        """
        others = [c for c in lines.columns if c not in ("logs", "timestamp", "hostname")]
        head = F.struct(F.lit(-1).alias("log_no"), F.lit(None).cast(lines.schema["logs"].dataType.elementType).alias("log"))
        logs = F.coalesce("logs", F.array().cast(lines.schema["logs"].dataType))
        entries = F.transform(logs, lambda e, i: F.struct(i.alias("log_no"), e.alias("log")))
        size = F.size(logs).cast("bigint").alias("batch_size")
        sent = F.xxhash64(F.to_json(F.struct(*[c for c in lines.columns if c != "logs"])), logs).alias("batch_key")
        rows = lines.select(*others, F.col("hostname").alias("sender"), F.col("timestamp").alias("sent"), size, sent, F.inline(F.concat(F.array(head), entries)))
        message = F.col("log.message")
        # the row of the batch passes through parsing like a line
        is_head = F.col("log_no") < 0
        return rows.select(
            *others, "sender", "sent", "batch_size", "batch_key", F.col("log_no").cast("bigint").alias("log_no"),
            *(F.col(f"log.{c}").alias(c) for c in ("hostname", "source", "raw", "priority", "unit")),
            F.col("log.timestamp").alias("logged"),
            F.when(is_head, F.lit("-")).otherwise(message).alias("line"),
            F.when(is_head, F.lit("-")).otherwise(message).alias("raw_log"),
        )

    def settled(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Alerts with the host in place of an unknown address; rows of batches have no line."""
        found = agents.with_fallbacks(super().settled(batch, batch_id))
        is_head = F.col("log_no") < 0
        return found.withColumns({"line": F.when(~is_head, F.col("line")), "event_type": F.when(~is_head, F.col("event_type"))})

    def writes(self, settled: DataFrame) -> dict[str, DataFrame]:
        """Alerts and outbox as for lines; feed, receipts and registry of agents."""
        entries = settled.where("line IS NOT NULL")
        out = super().writes(entries)
        out.pop("feed", None)
        if self.outputs.feed:
            out["agent_feed"] = tables.agent_rows(entries)
        heads = settled.where("line IS NULL")
        created = entries.where("event_type IS NOT NULL AND NOT amends").groupBy("batch_key").agg(F.count(F.lit(1)).alias("alerts"))
        received = heads.select("id", "agent_id", "sender", "sent", "batch_size", "batch_key", "ingest_ts").join(created, "batch_key", "left")
        out["receipts"] = received.select(
            "id", "agent_id", "sent", F.col("batch_size").alias("logs_processed"), F.coalesce("alerts", F.lit(0)).alias("alerts_created"), F.col("ingest_ts").alias("created_at")
        )
        out["registry_events"] = heads.select(
            "id", "agent_id", F.col("sender").alias("hostname"), F.col("ingest_ts").alias("ts"), F.lit(False).alias("registered"),
            F.lit(None).cast("string").alias("metadata"), F.col("batch_size").alias("n"), F.col("ingest_ts").alias("created_at"),
        )
        return out


class RegistryUpdater:
    """Registry of agents, brought up to date by micro-batches of agent events."""

    def __init__(self, spark: SparkSession, path: str):
        self.state = BatchState(spark, path, schemas.AGENTS)
        self.last_batch = -1

    def process(self, events: DataFrame, batch_id: int) -> None:
        """Merge a micro-batch of ``registry_events`` rows."""
        merged = merge_registry(self.state.before(batch_id), events)
        self.state.replace(merged, batch_id)
        self.last_batch = batch_id

    def current(self) -> DataFrame:
        """Registry after the last batch of this run."""
        return self.state.before(self.last_batch + 1)
