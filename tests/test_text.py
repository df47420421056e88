import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskwatch.functions import display, metadata, text
from duskwatch.operators import parse


def test_parsing_cases(spark):
    cases = [
        ("Apr 23 10:00:00 host sshd: Failed password for root from 192.168.1.100 port 22", "192.168.1.100", "root"),
        ("some log line with no IP address", "UNKNOWN", None),
        ("sshd: Failed password for alice from 10.0.0.1", "10.0.0.1", "alice"),
        ("sshd: Invalid user bob from 10.0.0.1", "10.0.0.1", "bob"),
        ("for invalid user bob", "UNKNOWN", "invalid"),
        ("connection from 10.0.0.1 to 10.0.0.2 port 22", "10.0.0.1", None),
        ("value=1234567890 no real ip here", "UNKNOWN", None),
        ("300.1.1.1 then 1.2.3.4", "1.2.3.4", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, line string")
    df = df.withColumn("ingest_ts", F.lit("2026-04-24 01:02:03").cast("timestamp"))
    rows = parse.parse_events(df).orderBy("i").collect()
    assert [(r.source_ip, r.user) for r in rows] == [c[1:] for c in cases]
    assert rows[0].log_time == "Apr 23 10:00:00"
    assert str(rows[0].event_ts) == "2026-04-23 10:00:00"
    assert rows[1].log_time == "Apr 24 01:02:03"
    assert rows[1].event_ts == rows[1].ingest_ts


def test_year_is_that_of_arrival_or_the_one_before(spark):
    df = spark.createDataFrame(
        [("Dec 31 23:59:59 x", "2026-01-01 00:00:05"), ("Apr  3 01:00:00 x", "2026-04-03 01:00:09"), ("Jan  1 00:00:01 x", "2025-12-31 23:59:58")],
        "line string, at string",
    )
    got = df.select(text.event_time(F.col("line"), F.col("at").cast("timestamp")).cast("string").alias("t")).collect()
    assert [r.t for r in got] == ["2025-12-31 23:59:59", "2026-04-03 01:00:00", "2025-01-01 00:00:01"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\r\n\x0b\x0c\x1c\x1e\x1f\x85   　é", max_size=30), min_size=20, max_size=20))
def test_lines_are_those_of_splitlines_and_strip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [(r.i, r.line) for r in parse.explode_lines(df, "text", ["i"]).orderBy("i", "line_no").collect()]
    want = [(i, line.strip()) for i, t in enumerate(texts) for line in t.splitlines() if line.strip()]
    assert got == want


def test_undecodable_bytes_are_dropped(spark):
    raw = [b"plain", b"a\xffb", "é�".encode() + b"\xc3", b"\xe2\x82", "ok é".encode()]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    got = df.select("i", text.drop_invalid_utf8(F.col("b").cast("string")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [b.decode("utf-8", errors="ignore") for b in raw]


def test_log_file_scan(spark, tmp_path):
    from duskwatch.sources.logfiles import read_agent_files, read_log_files

    (tmp_path / "a.log").write_bytes(b"\n  one \r\ntwo\x0bthree\n\n \t \nfo\xffur")
    rows = read_log_files(spark, str(tmp_path)).orderBy("line_id").collect()
    assert [r.line for r in rows] == ["one", "two", "three", "four"]
    assert len({r.line_id for r in rows}) == 4
    entry = read_agent_files(spark, str(tmp_path), "h1").orderBy("line_id").first()
    assert entry.source == f"file:{tmp_path}/a.log"
    assert (entry.message, entry.raw, entry.hostname) == ("one", "one", "h1")
    assert read_log_files(spark, str(tmp_path / "a.log")).count() == 4


def test_failed_login_in_any_case(spark):
    lines = ["FAILED PASSWORD for x", "invalid user", "sshd[3]: Connection Failed", "failed\nssh", "nothing", "failed over ssh"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    want = [bool(re.search(text.FAILED_LOGIN, line, re.I)) for line in lines]
    assert [r.f for r in df.select(text.is_failed_login(F.col("line")).alias("f")).collect()] == want


def test_agent_id_and_cap(spark):
    row = spark.range(1).select(text.agent_id(F.lit("h"), F.lit("aa:bb")).alias("a"), text.cap_message(F.lit("x" * 3000)).alias("m")).first()
    import hashlib

    assert row.a == hashlib.sha256(b"h:aa:bb").hexdigest()[:16]
    assert len(row.m) == 2000


def test_metadata(spark):
    df = spark.createDataFrame([(["attack.Credential_Access", "attack.t1110.001", "T1059", "attack.reconnaissance", "attack.t12"],), (None,)], "tags array<string>")
    got = df.select(metadata.tactics_of(F.col("tags")).alias("a"), metadata.tactics_of(F.col("tags"), True).alias("x"), metadata.techniques_of(F.col("tags")).alias("t")).collect()
    assert got[0].a == ["Credential Access"] and got[0].x == ["Credential Access", "Reconnaissance"]
    assert got[0].t == ["T1110.001", "T1059"]
    assert (got[1].a, got[1].t) == ([], [])


def test_display(spark):
    row = spark.range(1).select(
        display.technique_url(F.lit("T1110.001")).alias("u"),
        display.event_label(F.lit("A_B_C")).alias("e"),
        display.keyword_preview(F.array(*map(F.lit, "abcdefgh")), 6).alias("k"),
        display.iso_time(F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("i"),
    ).first()
    assert row.u.endswith("/T1110/001") and row.e == "A B C" and row.k == list("abcdef") and row.i == "2026-01-02T03:04:05"
