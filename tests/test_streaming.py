import json
import random
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from duskwatch.operators import agents
from duskwatch.operators.detect import DetectConfig, detect
from duskwatch.operators.parse import tagged
from duskwatch.sinks.store import Store
from duskwatch.sources import agents as agent_source
from duskwatch.sources import logfiles
from duskwatch.streaming import buffer, windows
from duskwatch.streaming.detector import AgentIngest, LiveDetector, Outputs, RegistryUpdater

START = datetime(2026, 6, 1)
SCHEMA = "source string, file string, line string, ingest_ts timestamp"


def event_lines(n=120, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = START + timedelta(seconds=i)
        kind = rng.choice(["Failed password for root from {}", "GET /q=1 UNION SELECT x from {}", "all is well at {}"])
        line = f"{at:%b %d %H:%M:%S} host x: " + kind.format(rng.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2"]))
        out.append(("app", "f", line, at))
    return out


def run_live(spark, pack, tmp_path, batches, config):
    """Tables after feeding ``batches`` one micro-batch each, with a restart in between."""
    source = str(tmp_path / "in")
    half = len(batches) // 2
    for part in (batches[:half], batches[half:]):
        done = len(list(Path(source).glob("*")))
        for n, rows in enumerate(part):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{source}/{done + n:03}")
        live = LiveDetector(spark, pack, Outputs(str(tmp_path / "out"), outbox=True), str(tmp_path / "state"), config, {"enabled": True, "webhook_url": "https://h"})
        lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").json(source)
        live.start(lines, str(tmp_path / "checkpoint")).awaitTermination()
        assert live.counters["lines_processed"] == sum(len(rows) for rows in part)
    return live.store


def alert_set(df):
    return sorted((r.raw_log, r.event_type, r.description) for r in df.collect())


def batch_alerts(spark, pack, rows, config):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line_id bigint, " + SCHEMA)
    return alert_set(detect(tagged(df), pack, config))


def test_stream_equals_batch_over_micro_batches_and_a_restart(spark, pack, tmp_path):
    config = DetectConfig(max_failed_logins=3, failed_login_window=10)
    rows = event_lines()
    store = run_live(spark, pack, tmp_path, [rows[i : i + 30] for i in range(0, 120, 30)], config)
    assert alert_set(store.read("alerts")) == batch_alerts(spark, pack, rows, config)
    feed = store.read("feed")
    assert feed.count() == len(rows) == feed.select("id").distinct().count()
    assert feed.where("is_alert").count() == store.read("alerts").count()
    assert store.read("outbox").select("id").distinct().count() == feed.where("is_alert").count()


def test_rows_in_any_order_are_counted_in_event_order(spark, pack, tmp_path):
    config = DetectConfig(max_failed_logins=3, failed_login_window=10)
    rows = event_lines()
    mixed = list(rows)
    random.Random(4).shuffle(mixed)
    store = run_live(spark, pack, tmp_path, [mixed[:40], mixed[40:80], mixed[80:]], config)
    assert alert_set(store.read("alerts")) == batch_alerts(spark, pack, rows, config)
    # an alert that a late failure changed stands once in each table
    assert store.read("alerts").count() == store.read("alerts").select("id").distinct().count()
    assert store.read("feed").count() == len(rows)


def failed(s, ip="10.0.0.1"):
    at = START + timedelta(seconds=s)
    return ("app", "f", f"{at:%b %d %H:%M:%S} host sshd: Failed password for root from {ip}", at)


def test_a_late_failure_raises_the_counts_after_it(spark, pack, tmp_path):
    config = DetectConfig(max_failed_logins=2, failed_login_window=10)
    store = run_live(spark, pack, tmp_path, [[failed(100), failed(111)], [failed(95)]], config)
    assert alert_set(store.read("alerts")) == batch_alerts(spark, pack, [failed(100), failed(111), failed(95)], config)
    assert [r.event_type for r in store.read("alerts").orderBy("timestamp").collect()][1] == "BRUTE_FORCE"
    # the first report of the alert and the one with its new meaning
    assert store.read("outbox").count() == 4


def test_a_source_that_lags_and_one_ahead_lose_nothing(spark, pack, tmp_path):
    config = DetectConfig(max_failed_logins=3, failed_login_window=60)
    first, second = [failed(i, "10.0.0.1") for i in range(5)], [failed(i, "10.0.0.2") for i in range(5)]
    ahead = START + timedelta(hours=20)
    clock = ("app", "f", f"{ahead:%b %d %H:%M:%S} other x: hello", START)
    later = [failed(600 + i, "10.0.0.1") for i in range(3)]
    batches = [[clock, *first], later, second[:2], second[2:]]
    store = run_live(spark, pack, tmp_path, batches, config)
    found = alert_set(store.read("alerts"))
    assert found == batch_alerts(spark, pack, [r for b in batches for r in b], config)
    assert sum(kind == "BRUTE_FORCE" for _, kind, _ in found) == 3 + 1 + 3


def test_counts_over_stretches_equal_a_count_one_by_one():
    rng = random.Random(2)
    rows = [(rng.randrange(400), rng.random() < 0.8, rng.randrange(9), 0, i) for i in range(300)]
    for n, (at, _, seq, *_, number) in enumerate(rows):
        want = sum(1 for r in rows if r[0] > at - 60 and (r[0], r[2], r[4]) <= (at, seq, number))
        assert windows.attempts(rows, 60, 1)[n] == want


def wait_for(done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)


def test_state_is_forgotten_after_its_time(spark, tmp_path):
    schema = "source_ip string, event_ts timestamp"
    spark.createDataFrame([("a", START), ("a", START)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    lines = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    counted = windows.live_counts(lines, window_seconds=10, keep=0.001)
    found = []
    query = counted.writeStream.foreachBatch(lambda batch, _: found.extend(batch.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    # such a run has always another batch to do, so it is watched from outside
    try:
        wait_for(lambda: len(found) >= 2)
        spark.createDataFrame([("a", START)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        wait_for(lambda: len(found) >= 3)
    finally:
        query.stop()
    assert sorted(r.attempts for r in found) == [1, 1, 2]
    assert len({(r.stretch, r.arrived, r.number) for r in found}) == 3


def test_a_batch_that_fails_between_two_tables_shows_nothing_and_runs_again(spark, pack, tmp_path, monkeypatch):
    config = DetectConfig(max_failed_logins=3, failed_login_window=10)
    rows = event_lines(40)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    write, broken = Store.write, [True]

    def fail(self, table, *args):
        if table == "feed" and broken:
            raise RuntimeError("no room")
        return write(self, table, *args)

    monkeypatch.setattr(Store, "write", fail)
    lines = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    live = LiveDetector(spark, pack, Outputs(str(tmp_path / "out")), str(tmp_path / "state"), config)
    with pytest.raises(Exception, match="no room"):
        live.start(lines, str(tmp_path / "checkpoint")).awaitTermination()
    assert list((tmp_path / "out" / "alerts").glob("dt=*")) and live.store.read("alerts").count() == 0
    broken.clear()
    live.start(lines, str(tmp_path / "checkpoint")).awaitTermination()
    assert alert_set(live.store.read("alerts")) == batch_alerts(spark, pack, rows, config)
    # a micro-batch that was committed but not checkpointed does not run again
    assert live.store.committed(f"{live.run}-0")
    live.process(spark.createDataFrame([], SCHEMA), 0)
    assert live.store.read("feed").count() == 40


def test_two_runs_into_one_store_keep_each_others_rows(spark, pack, tmp_path):
    config = DetectConfig(max_failed_logins=3, failed_login_window=10)
    rows = event_lines(30)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    for n in range(2):
        lines = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        live = LiveDetector(spark, pack, Outputs(str(tmp_path / "out")), str(tmp_path / f"state{n}"), config)
        live.start(lines, str(tmp_path / f"checkpoint{n}")).awaitTermination()
    assert live.store.read("feed").count() == 60 == live.store.read("feed").select("id").distinct().count()
    assert alert_set(live.store.read("alerts")) == sorted(2 * batch_alerts(spark, pack, rows, config))


def entry(message, raw=None):
    return {"timestamp": "t", "hostname": "h1", "source": "auth", "message": message, "priority": None, "unit": None, "raw": raw or message}


def test_agent_batches_give_alerts_feed_receipts_and_registry_together(spark, pack, tmp_path):
    fails = [f"Failed password for root from 10.0.0.{i}" for i in (1, 1, 1)]
    batches = [
        ("a1", "h1", "s1", [entry("all is well"), entry(fails[0]), entry("GET /x?q=1 UNION SELECT 1")], START),
        ("a1", "h1", "s2", [entry(fails[1])], START + timedelta(seconds=5)),
        ("a2", "h2", "s3", [], START),
        ("a2", "h2", "s4", None, START + timedelta(seconds=1)),
        ("a1", "h1", "s5", [entry(fails[2])], START + timedelta(seconds=3)),
    ]
    for n, (agent, host, sent, logs, at) in enumerate(batches):
        body = {"agent_id": agent, "hostname": host, "timestamp": sent, "logs": logs, "ingest_ts": at.isoformat() + "Z"}
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(body))
    stream = agent_source.stream_batches(spark, str(tmp_path / "in"), 1, "ingest_ts timestamp")
    live = AgentIngest(spark, pack, Outputs(str(tmp_path / "out")), str(tmp_path / "state"), DetectConfig(max_failed_logins=3, seq=()))
    live.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    store = live.store
    feed = store.read("agent_feed")
    assert feed.count() == 5 and feed.where("NOT is_alert").count() == 1
    assert {r.hostname for r in feed.collect()} == {"h1"}
    kinds = [r.event_type for r in store.read("alerts").collect()]
    assert len(kinds) == 4 and kinds.count("BRUTE_FORCE") == 1
    # the address of a line without one is the host that sent it
    assert "h1" in {r.source_ip for r in store.read("alerts").collect()}
    assert {(r.sent, r.logs_processed, r.alerts_created) for r in store.read("receipts").collect()} == {("s1", 3, 2), ("s2", 1, 1), ("s3", 0, 0), ("s4", 0, 0), ("s5", 1, 1)}
    assert {(r.agent_id, r.logs_received) for r in agents.registry(store.read("registry_events")).collect()} == {("a1", 5), ("a2", 0)}
    assert live.counters["lines_processed"] == 5


def test_text_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(" auth: one\nkern: two\x0bauth: three\n\n")
    lines = logfiles.stream_syslog(spark, str(tmp_path / "in"), "auth")
    query = lines.writeStream.format("memory").queryName("syslog_lines").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("syslog_lines").collect()
    assert sorted(r.line for r in got) == ["auth: one", "auth: three"]
    assert {r.source for r in got} == {"syslog"}
    later = logfiles.stream_log_files(spark, str(tmp_path / "in"), since=datetime(2100, 1, 1))
    query = later.writeStream.format("memory").queryName("later_lines").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("later_lines").count() == 0


def test_stale_rows_are_dropped(spark):
    rows = [(START, START + timedelta(seconds=s)) for s in (0, 300, 301)]
    df = spark.createDataFrame(rows, "event_ts timestamp, ingest_ts timestamp")
    assert buffer.drop_stale(df).count() == 2
    assert tuple(buffer.stale_counts(df).first()) == (2, 1)
    assert buffer.drop_resent(df.unionByName(df), ["event_ts", "ingest_ts"]).count() == 3


def test_registry_over_micro_batches(spark, tmp_path):
    rows = [("a", "h1", START, True, "{}", 0), ("a", "h2", START + timedelta(1), False, None, 4), ("b", "h3", START + timedelta(2), False, None, 1), ("b", "h4", START + timedelta(3), True, '{"x":1}', 0),
            ("b", "old", START + timedelta(1), True, '{"x":0}', 0), ("a", "h0", START - timedelta(1), False, None, 2)]
    schema = "agent_id string, hostname string, ts timestamp, registered boolean, metadata string, n bigint"
    updater = RegistryUpdater(spark, str(tmp_path / "state"))
    for batch_id, row in enumerate(rows):
        updater.process(spark.createDataFrame([row], schema), batch_id)
        updater.process(spark.createDataFrame([row], schema), batch_id)
    names = ["agent_id", "hostname", "logs_received", "metadata", "last_seen"]
    got = sorted(tuple(r) for r in updater.current().select(*names).collect())
    assert got == sorted(tuple(r) for r in agents.registry(spark.createDataFrame(rows, schema)).select(*names).collect())


def test_a_burst_cut_by_a_batch_border_is_counted_whole(spark, pack, tmp_path):
    config = DetectConfig(max_failed_logins=3, failed_login_window=10)
    burst = [("app", "f", f"{START:%b %d %H:%M:%S} host x: Failed password for u{i} from 10.0.0.9", START) for i in range(4)]
    found = alert_set(run_live(spark, pack, tmp_path, [burst[:2], burst[2:]], config).read("alerts"))
    assert [kind for _, kind, _ in found].count("BRUTE_FORCE") == 2
    assert sorted(kind for _, kind, _ in found) == sorted(kind for _, kind, _ in batch_alerts(spark, pack, burst, config))


def test_stream_counts_equal_a_count_one_by_one_however_rows_are_dealt(spark, tmp_path):
    rng = random.Random(5)
    schema = "source_ip string, event_ts timestamp, seq bigint, tags map<string,string>"
    rows = [(rng.choice(["a", "a", "b", None]), START + timedelta(seconds=rng.randrange(200)), rng.choice([None, 1, 2]), {"n": str(i % 3)}) for i in range(150)]
    parts = [rows[:50], rows[50:100], rows[100:]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = {}

    def take(batch, batch_id):
        got = batch.collect()
        for r in got:
            at = (r.source_ip, r.stretch, r.arrived, r.number)
            # a count is told once, and again with the one it had when it changes
            assert r.before == (found[at].attempts if at in found else None) and r.before != r.attempts
            found[at] = r
        assert len({(r.source_ip, r.stretch, r.arrived, r.number) for r in got}) == len(got)

    query = windows.live_counts(lines, ["seq"], 10).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) == 3
    # state is read for many keys at once, by no processor that asks for them one by one
    assert {s.operatorName for p in query.recentProgress for s in p.stateOperators} == {"stateStoreSave"}
    key = lambda r: (str(r[0]), r[1], r[2] or 0, sorted(r[3].items()))
    assert sorted(map(key, rows)) == sorted(key((r.source_ip, r.event_ts, r.seq, r.tags)) for r in found.values())
    for source in ("a", "b", None):
        times = sorted((r[1], r[2] or 0) for r in rows if r[0] == source)
        want = [n + 1 - sum(t <= at - timedelta(seconds=10) for t, _ in times) for n, (at, _) in enumerate(times)]
        got = sorted((r.event_ts, r.seq or 0, r.attempts) for r in found.values() if r.source_ip == source)
        assert got == [(*t, n) for t, n in sorted(zip(times, want, strict=True))]
