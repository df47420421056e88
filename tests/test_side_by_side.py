"""The tables of a micro-batch are written side by side."""

import threading

from duskwatch.operators.detect import DetectConfig
from duskwatch.sinks.store import Store
from duskwatch.sources import agents as agent_source
from duskwatch.streaming.detector import AgentIngest, Outputs


def test_tables_of_a_batch_are_written_at_the_same_time(spark, pack, tmp_path, monkeypatch):
    entry = '{"hostname": "h", "source": "auth", "message": "Failed password for root from 10.0.0.1", "raw": "r"}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(f'{{"agent_id": "a{i}", "hostname": "h", "timestamp": "t{i}", "ingest_ts": "2024-01-0{i + 1}T00:00:00Z", "logs": [{entry}]}}\n' for i in range(3)))
    # each write waits for the three others
    met, write = threading.Barrier(4, timeout=20), Store.write

    def waiting(self, *args):
        met.wait()
        return write(self, *args)

    monkeypatch.setattr(Store, "write", waiting)
    stream = agent_source.stream_batches(spark, str(tmp_path / "in"), 1, "ingest_ts timestamp")
    live = AgentIngest(spark, pack, Outputs(str(tmp_path / "out")), str(tmp_path / "state"), DetectConfig(seq=("log_no",)))
    live.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    counts = {t: live.store.read(t).count() for t in ("agent_feed", "receipts", "registry_events")}
    assert counts == {"agent_feed": 3, "receipts": 3, "registry_events": 3}


def test_a_batch_has_one_file_per_day_however_many_tasks_made_it(spark, pack, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"agent_id": "a", "hostname": "h", "timestamp": "t%d", "ingest_ts": "2024-01-0%dT00:00:00Z", "logs": [{"hostname": "h", "source": "s", "message": "m %d", "raw": "r"}]}\n'
    for f in range(6):
        (tmp_path / "in" / f"{f}.json").write_text("".join(line % (i, i % 5 + 1, i) for i in range(20 * f, 20 * f + 20)))
    stream = agent_source.stream_batches(spark, str(tmp_path / "in"), None, "ingest_ts timestamp").repartition(6)
    live = AgentIngest(spark, pack, Outputs(str(tmp_path / "out")), str(tmp_path / "state"), DetectConfig(seq=("log_no",)))
    live.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert live.store.read("agent_feed").count() == 120
    folders = list((tmp_path / "out" / "agent_feed").glob("dt=*/batch=*"))
    assert len(folders) == 5 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
