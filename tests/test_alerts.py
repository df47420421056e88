import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duskwatch import schemas
from duskwatch.operators import agents
from duskwatch.operators.detect import DetectConfig
from duskwatch.plans import alerts as listing
from duskwatch.plans import report, stats
from duskwatch.sinks import outbox, tables
from duskwatch.sources import agents as agent_source
from duskwatch.sources import alerts as alert_source
from duskwatch.sources import journal, logfiles

NOW = datetime(2026, 6, 1, 12, 30)


def alert(i, severity="CRITICAL", kind="SQL_INJECTION_ATTEMPT", ip="10.0.0.1", age=timedelta(), **more):
    row = {
        "id": i, "timestamp": NOW - age, "event_type": kind, "severity": severity, "source_ip": ip, "description": f"about {kind}",
        "raw_log": "GET /search?q=1 UNION SELECT * FROM users--", "matched_keywords": ["union select"], "false_positives": [],
        "mitre_tactics": ["Initial Access"], "mitre_techniques": ["T1190"], "sigma_rule_id": "r", "sigma_rule_title": "SQL", "created_at": NOW - age,
    }
    return {**row, **more}


@pytest.fixture
def alerts(spark):
    rows = [alert(1), alert(2, "WARNING", "PORT_SCAN", "10.0.0.2", timedelta(hours=2)), alert(3, "INFO", "DOWNLOAD", None, timedelta(days=31)), alert(4, ip="10.0.0.2")]
    return spark.createDataFrame(rows, schemas.ALERTS)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(alerts):
    assert ids(listing.filter_alerts(alerts)) == [1, 2, 3, 4]
    assert ids(listing.filter_alerts(alerts, severity="critical", source_ip="0.2")) == [4]
    assert ids(listing.filter_alerts(alerts, event_type="port_scan")) == [2]
    assert ids(listing.filter_alerts(alerts, search="ABOUT port")) == [2]
    assert ids(listing.filter_alerts(alerts, search="about%scan")) == [2]
    assert ids(listing.filter_alerts(alerts, search="a\\b")) == []
    assert ids(listing.filter_report(alerts, query=" Union SELECT ", tactic="Initial Access", severity="INFO")) == [3]
    assert ids(listing.filter_report(alerts, query="t1190 nothing")) == []


def test_pages(alerts):
    first, second = listing.page(alerts, 1, 2), listing.page(alerts, 2, 2)
    assert [r.id for r in first.collect()] == [4, 1] and [r.id for r in second.collect()] == [2, 3]
    assert tuple(listing.page_info(alerts, 1, 3).first()) == (4, 1, 3, 2)
    assert listing.page_info(alerts.limit(0)).first().pages == 1
    numbered = listing.numbered_pages(alerts, 3)
    assert {r.id: r.page for r in numbered.collect()} == {4: 1, 1: 1, 2: 1, 3: 2}
    for bad in ({"number": 0}, {"size": 101}):
        with pytest.raises(ValueError):
            listing.page(alerts, **bad)
    with pytest.raises(ValueError):
        listing.recent_alerts(alerts, 51)


def test_statistics(alerts):
    asof = F.lit(NOW)
    assert [tuple(r) for r in stats.by_severity(alerts).collect()] == [("CRITICAL", 2), ("INFO", 1), ("WARNING", 1)]
    assert [tuple(r) for r in stats.top_sources(alerts).collect()] == [("10.0.0.2", 2), ("10.0.0.1", 1)]
    assert [r.source_ip for r in stats.top_sources(alerts, 5, keep_null=True).collect()] == ["10.0.0.2", None, "10.0.0.1"]
    assert tuple(stats.overview(alerts, asof).first()) == (4, 2, NOW)
    assert [r["count"] for r in stats.timeline(alerts, asof).collect()] == [1, 2]
    assert tuple(stats.stat_cards(alerts).first()) == (2, "SQL_INJECTION_ATTEMPT")
    assert tuple(stats.stat_cards(alerts.limit(0)).first()) == (0, "—")
    maps = stats.stats_maps(alerts).first()
    assert maps.by_severity == {"CRITICAL": 2, "INFO": 1, "WARNING": 1} and maps.top_10_ips == {"10.0.0.2": 2, "10.0.0.1": 1}
    assert stats.ad_hoc(alerts, "last_hour_rows", NOW).count() == 2
    assert [r.value for r in stats.tactic_facets(alerts).collect()] == ["Initial Access"]


def test_lists_as_json(spark, alerts):
    rows = alert_source.encode_alerts(alerts).withColumn("matched_keywords", F.when(F.col("id") == 1, "{no list").otherwise(F.col("matched_keywords")))
    back = {r.id: r for r in alert_source.decode_alerts(rows.drop("mitre_techniques")).collect()}
    assert back[1].matched_keywords == [] and back[2].matched_keywords == ["union select"] and back[2].mitre_techniques == []


def test_store_and_retention(spark, alerts, tmp_path):
    path = str(tmp_path / "alerts")
    tables.append_alerts(alerts, path, 1)
    tables.append_alerts(alerts, path, 1)
    assert ids(alert_source.read_alerts(spark, path)) == [1, 2, 3, 4]
    same_day = spark.createDataFrame([alert(9, age=timedelta(days=30, hours=1)), alert(10, age=timedelta(days=30) - timedelta(hours=1))], schemas.ALERTS)
    tables.append_alerts(same_day, path, 2)
    assert tables.delete_old_alerts(spark, path, 30, F.lit(NOW)) == 2
    assert ids(tables.read_table(spark, path)) == [1, 2, 4, 10]
    tables.prune_live_logs(spark, path, 2)
    assert ids(tables.read_table(spark, path)) == [1, 4]


def test_outbox(spark, alerts):
    config = {"enabled": True, "webhook_url": "https://hooks.example.org/x"}
    scored = alerts.withColumn("abuse_confidence_score", F.when(F.col("id") == 1, 80).otherwise(0)).withColumn("raw_log", F.repeat(F.lit("x"), 300))
    rows = {r.id: json.loads(r.payload)["embeds"][0] for r in outbox.outbox_rows(scored, config).collect() if r.id != 3}
    assert [f["name"] for f in rows[1]["fields"]] == ["Source IP", "Severity", "Timestamp", "Abuse Confidence Score", "Raw Log"]
    assert [f["name"] for f in rows[2]["fields"]] == ["Source IP", "Severity", "Timestamp", "Raw Log"]
    assert rows[2]["color"] == 0xFFFF00 and rows[2]["fields"][3]["value"] == "```" + "x" * 256 + "...```"
    assert rows[1]["timestamp"] == NOW.isoformat() and rows[1]["title"].endswith("SQL_INJECTION_ATTEMPT")
    for off in ({}, {"enabled": True, "webhook_url": "https://x/YOUR_WEBHOOK_ID/y"}, {"webhook_url": "https://x"}):
        assert outbox.outbox_rows(scored, off).count() == 0


def test_journal_lines(spark):
    lines = ['{"MESSAGE":"m","PRIORITY":"3","_SYSTEMD_UNIT":"ssh.service","__REALTIME_TIMESTAMP":"1767225600000000"}', "{}", "not json", '{"MESSAGE": ', "  "]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    rows = journal.journal_entries(df).orderBy("i").collect()
    assert [(r.message, r.priority, r.unit) for r in rows] == [("m", "3", "ssh.service"), ("", "6", "unknown"), ("not json", None, None), ('{"MESSAGE":', None, None)]
    assert str(rows[0].event_ts) == "2026-01-01 00:00:00"


def test_no_source_available(spark):
    empty = logfiles.union_sources(spark, [None])
    assert empty.count() == 0 and "line" in empty.columns


def test_agent_batches(spark, pack):
    entry = {"timestamp": "t", "hostname": "h1", "source": "s", "message": "bash: history -c", "raw": "r"}
    bodies = [{"agent_id": "a", "hostname": "h", "timestamp": "2026-06-01T00:00:00", "logs": [entry, {**entry, "message": "fine"}]}, {"agent_id": "b", "hostname": "h", "timestamp": "t", "logs": []}]
    payloads = spark.createDataFrame([(json.dumps(b),) for b in bodies], "value string")
    batches = agent_source.parse_batches(payloads)
    logs = agent_source.explode_logs(batches).withColumn("ingest_ts", F.lit(NOW))
    found = agents.agent_alerts(logs, pack, DetectConfig(seq=("agent_id", "log_no")))
    assert [(r.source_ip, r.event_type, r.raw_log) for r in found.collect()] == [("h1", "LOG_TAMPERING_OR_EVASION", "bash: history -c")]
    done = {r.agent_id: (r.logs_processed, r.alerts_created) for r in agents.receipts(batches, found, ["agent_id"]).collect()}
    assert done == {"a": (2, 1), "b": (0, 0)}


def test_registry(spark):
    def at(m):
        return NOW + timedelta(minutes=m)

    regs = spark.createDataFrame([("a", "new", at(5), '{"os":"x"}'), ("a", "old", at(1), None), ("c", "c1", at(2), "{bad")], "agent_id string, hostname string, ts timestamp, metadata string")
    sent = spark.createDataFrame([("a", "z", at(0), 3), ("b", "first", at(1), 2), ("b", "second", at(9), 4)], "agent_id string, hostname string, ts timestamp, n bigint")
    whole = agents.registry(agents.registry_events(regs, sent))
    got = {r.agent_id: (r.hostname, r.first_seen, r.last_seen, r.logs_received) for r in whole.collect()}
    assert got == {"a": ("new", at(0), at(5), 3), "b": ("first", at(1), at(9), 6), "c": ("c1", at(2), at(2), 0)}
    merged = agents.merge_registry(agents.registry(agents.registry_events(regs, None)), agents.registry_events(None, sent))
    later = {r.agent_id: (r.hostname, r.first_seen, r.last_seen, r.logs_received) for r in merged.collect()}
    assert later == got
    listed = agents.agent_list(whole).collect()
    assert [r.agent_id for r in listed] == ["b", "a", "c"]
    assert [r.metadata for r in listed] == [None, {"os": "x"}, {}]


def test_file_report(spark, pack, tmp_path):
    (tmp_path / "up.log").write_text("\nok\nGET /q=1 UNION SELECT a FROM b\nbash: history -c\n\nGET /?x=<script>\n")
    lines = logfiles.read_log_files(spark, str(tmp_path))
    out = report.analyze_file(lines, pack)
    assert tuple(out.summary.first()) == (4, 3)
    assert {r.tactic: r["count"] for r in out.by_tactic.collect()} == {"Initial Access": 1, "Defense Evasion": 1, "Execution": 1}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.log").write_text("")
    assert tuple(report.analyze_file(logfiles.read_log_files(spark, str(tmp_path / "none")), pack).summary.first()) == (0, 0)
