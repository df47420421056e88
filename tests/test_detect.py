import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import allowlist, bruteforce, running
from duskwatch.operators.detect import DetectConfig, detect, is_counted, parsed_lines, with_reputation

FAIL = "sshd: Failed password for root from {} port 22"


def log(spark, rows, start="2026-06-01 00:00:00"):
    """Lines that arrive at given seconds."""
    df = spark.createDataFrame([(i, float(t), line) for i, (t, line) in enumerate(rows)], "line_id bigint, t double, line string")
    at = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + (F.col("t") * 1_000_000).cast("bigint"))
    return df.select("line_id", "line", at.alias("ingest_ts"))


def sequential(rows, window_us):
    """Counts of a program that keeps a list of times per key."""
    seen, counts = defaultdict(list), {}
    for us, seq, key in sorted(rows):
        seen[key] = [t for t in seen[key] if t > us - window_us] + [us]
        counts[seq] = len(seen[key])
    return counts


def brute(alerts):
    return sorted(r.line_id for r in alerts.where("event_type = 'BRUTE_FORCE'").collect())


@pytest.mark.parametrize("parts", ["1", "7"])
def test_window_counts_like_a_sequential_count(spark, parts):
    rng = random.Random(5)
    # one key has most rows, and many rows share a time
    rows = [(rng.randrange(0, 40) * 500_000, seq, rng.choice(["hot"] * 6 + ["a", "b", "c"])) for seq in range(600)]
    df = spark.createDataFrame(rows, "us bigint, seq bigint, key string").withColumn("t", F.timestamp_micros("us"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.seq: r.attempts for r in bruteforce.window_counts(df, "key", "t", "seq", 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sequential(rows, 3_000_000)


def test_hot_key_is_spread_over_ranges(spark):
    df = spark.range(4000).select(F.lit("hot").alias("key"), F.col("id").alias("seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    real = running.stage
    running.stage = lambda frame, label: seen.append(real(frame, label)) or seen[-1]
    try:
        out = running.running_sum(df, ["key"], ["seq"], F.lit(1), "n").collect()
    finally:
        running.stage = real
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(r.n == r.seq + 1 for r in out)
    assert seen[-1].groupBy("_range").count().agg(F.max("count")).first()[0] < 2000


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    rows = running.row_numbers(df, [F.desc("v")], "n").collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.n)] == sorted((r.v for r in rows), reverse=True)
    assert sorted(r.n for r in rows) == list(range(1, 1001))


def test_brute_force_sequences(spark, pack):
    three = DetectConfig(max_failed_logins=3)
    assert brute(detect(log(spark, [(i, FAIL.format("10.1.1.1")) for i in range(3)]), pack, three)) == [2]
    both = [(i, FAIL.format(ip)) for i, ip in enumerate(["10.1.1.1", "10.1.1.2", "10.1.1.1", "10.1.1.2", "10.1.1.1"])]
    assert brute(detect(log(spark, both), pack, three)) == [4]
    short = DetectConfig(max_failed_logins=3, failed_login_window=1)
    gap = [(0, FAIL.format("1.1.1.1")), (0, FAIL.format("1.1.1.1")), (1.1, FAIL.format("1.1.1.1"))]
    assert brute(detect(log(spark, gap), pack, short)) == []
    edge = [(0, FAIL.format("1.1.1.1")), (30, FAIL.format("1.1.1.1")), (60, FAIL.format("1.1.1.1"))]
    assert brute(detect(log(spark, edge), pack, three)) == []


def test_brute_force_fields(spark, pack):
    config = DetectConfig(max_failed_logins=2)
    rows = detect(log(spark, [(i, FAIL.format("10.0.0.9")) for i in range(3)]), pack, config).orderBy("line_id").collect()
    assert [r.event_type for r in rows] == ["SSH_BRUTE_FORCE_AUTHENTICATION_FAILURE", "BRUTE_FORCE", "BRUTE_FORCE"]
    last = rows[2]
    assert last.description == "3 failed login attempts from 10.0.0.9 within 60s"
    assert (last.severity, last.mitre_tactics, last.mitre_techniques) == ("CRITICAL", ["Credential Access"], ["T1110.001"])
    assert (last.sigma_rule_id, last.matched_keywords, last.abuse_confidence_score) == ("", [], 0)


def test_suppression(spark, pack):
    config = DetectConfig(max_failed_logins=3, allowed=["192.168.1.100", "10.0.0.0/24"], allow_mode="prefix")
    attack = "GET /q=1 UNION SELECT a FROM users"
    lines = [(0, f"192.168.1.100 {attack}"), (0, f"172.16.0.1 {attack}"), (0, attack), (0, f"10.0.0.77 {attack}"), (0, "   ")]
    lines += [(1, FAIL.format("192.168.1.100"))] * 10
    found = detect(log(spark, lines), pack, config)
    assert sorted(r.line_id for r in found.collect()) == [1, 2]
    kept = detect(log(spark, lines), pack, config, keep_benign=True)
    assert kept.count() == 14 and kept.where("event_type IS NOT NULL").count() == 2


def test_arrival_mode_takes_the_file_as_one_window(spark, pack):
    lines = log(spark, [(i * 1000, FAIL.format("10.1.1.1")) for i in range(4)])
    assert brute(detect(lines, pack, DetectConfig(max_failed_logins=3, time_mode="arrival"))) == [2, 3]
    assert brute(detect(lines, pack, DetectConfig(max_failed_logins=3))) == []


def test_allow_list_modes(spark):
    ips = ["10.0.1.5", "10.0.10.5", "10.0.2.5", "UNKNOWN", "1.2.3"]
    df = spark.createDataFrame([(i,) for i in ips], "source_ip string")
    ip = F.col("source_ip")

    def allowed(entries, mode):
        return [r.source_ip for r in df.where(allowlist.is_allowed(ip, entries, mode)).collect()]

    assert allowed(["10.0.1.0/24"], "prefix") == ["10.0.1.5", "10.0.10.5"]
    assert allowed(["10.0.1.0/24"], "cidr") == ["10.0.1.5"]
    assert allowed([], "prefix") == []
    nets = spark.createDataFrame([("10.0.1.0/24",), ("10.0.2.5/32",)], "cidr string")
    assert sorted(r.source_ip for r in allowlist.drop_networks(df, nets).collect()) == ["1.2.3", "10.0.10.5", "UNKNOWN"]
    everything = spark.createDataFrame([("0.0.0.0/0",)], "cidr string")
    assert sorted(r.source_ip for r in allowlist.drop_networks(df, everything).collect()) == ["1.2.3", "UNKNOWN"]


def test_reputation_does_not_multiply_alerts(spark):
    alerts = spark.createDataFrame([("a",), ("b",), ("a",)], "source_ip string")
    scores = spark.createDataFrame([("a", 10), ("a", 90)], "source_ip string, score int")
    got = with_reputation(alerts, scores).groupBy("source_ip", "abuse_confidence_score").count().collect()
    assert {tuple(r) for r in got} == {("a", 90, 2), ("b", 0, 1)}


def test_empty_input(spark, pack):
    assert detect(log(spark, []), pack).count() == 0


def test_detection_plan_matches_each_line_once(spark, pack):
    plan = detect(log(spark, [(0, "x")]), pack)._jdf.queryExecution().optimizedPlan().toString()
    # once in each part of the union of counted and other lines, and in no filter
    assert plan.count("regexp_extract_all") == 2
    assert not any("regexp_extract_all" in row for row in plan.splitlines() if "Filter" in row)


def test_network_tables_take_plain_addresses_and_report_bad_rows(spark):
    rows = spark.createDataFrame([("10.0.0.1",), ("10.0.0.2",), ("10.0.1.9",)], "source_ip string")
    nets = spark.createDataFrame([("10.0.0.2",), ("10.0.1.0/24",), ("10.0.0.0/99",), ("nonsense",), (None,)], "cidr string")
    assert [r.source_ip for r in allowlist.drop_networks(rows, nets).collect()] == ["10.0.0.1"]
    assert {r.cidr for r in allowlist.bad_networks(nets).collect()} == {"10.0.0.0/99", "nonsense", None}


def test_a_given_event_time_is_used(spark, pack):
    at = [f"2024-05-01 0{h}:00:00" for h in range(4)]
    rows = [(i, "Failed password for root from 10.0.0.9", "2024-05-01 09:00:00", t) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "line_id bigint, line string, ingest_ts string, event_ts string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("ingest_ts", "event_ts")})
    found = detect(df, pack, DetectConfig(max_failed_logins=3, failed_login_window=60))
    assert found.where("event_type = 'BRUTE_FORCE'").count() == 0


def test_lines_are_parsed_once_and_only_if_wanted(spark):
    rows = [(0, FAIL.format("10.0.0.1")), (1, "nothing"), (2, " \u2003\t"), (3, FAIL.format("10.0.0.2"))]
    parsed = parsed_lines(log(spark, rows), DetectConfig(allowed=["10.0.0.2"]))
    got = {r.line_id: (r.source_ip, r._failed, r._allowed) for r in parsed.collect()}
    assert got == {0: ("10.0.0.1", True, False), 1: ("UNKNOWN", False, False), 3: ("10.0.0.2", True, True)}
    counted = parsed.where(is_counted())
    assert [r.line_id for r in counted.collect()] == [0]
    plan = counted._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # fields come of projections, whose common steps are shared
    assert not [x for x in plan if "Generate" in x and ("regexp_extract" in x or "lower(" in x)]
    # lines that are no failed login are gone, further down in the plan, before any is parsed
    address = next(i for i, x in enumerate(plan) if "regexp_extract" in x)
    told = next(i for i, x in enumerate(plan) if "Filter" in x and "_failed" in x)
    assert address < told
