
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from duskwatch import schemas  # noqa: E402
from duskwatch.functions import display, metadata, text  # noqa: E402
from duskwatch.operators import agents, allowlist, bruteforce, parse, rules, running  # noqa: E402
from duskwatch.operators.detect import DetectConfig, detect, with_reputation  # noqa: E402
from duskwatch.plans import alerts as listing  # noqa: E402
from duskwatch.plans import report, stats  # noqa: E402
from duskwatch.session import shared_dir, spread, stage  # noqa: E402
from duskwatch.sinks import outbox, tables  # noqa: E402
from duskwatch.sources import agents as agent_source  # noqa: E402
from duskwatch.sources import alerts as alert_source  # noqa: E402
from duskwatch.sources import journal, logfiles, rulepack  # noqa: E402
from duskwatch.streaming import buffer  # noqa: E402
from duskwatch.sinks.store import Store  # noqa: E402
from duskwatch.streaming import windows  # noqa: E402
from duskwatch.streaming.detector import AgentIngest, LiveDetector, Outputs, RegistryUpdater  # noqa: E402

ENTRY_DATA = "/root/testdata/sf0.001"
TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TS = "%Y-%m-%d %H:%M:%S.%f"
ALLOWED = ["10.0.0.8", "10.0.2.0/24"]
WINDOW_HOURS = 6
THRESHOLD = 3

# --------------------------------------------------------------------------
# Inputs derived from the given tables
# --------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; times without zone are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents."""
    return parse.explode_lines(spread(table(spark, sf_dir, "documents")), "text", ["doc_id"])


def event_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored alerts."""
    return as_alerts(table(spark, sf_dir, "events"))


def as_alerts(events: DataFrame) -> DataFrame:
    """Columns of an alert from those of an event."""
    kind = F.col("event_type")
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("id"),
        at.alias("timestamp"),
        F.upper(kind).alias("event_type"),
        F.when(kind == "error", "CRITICAL")
        .when(kind.isin("purchase", "signup"), "WARNING")
        .otherwise("INFO")
        .alias("severity"),
        F.when(F.col("user_id") % 50 != 0, user_ip()).alias("source_ip"),
        F.concat(kind, F.lit(" event of user "), F.col("user_id")).alias("description"),
        F.col("props").alias("raw_log"),
        at.alias("created_at"),
    )


def user_ip() -> Column:
    """Address standing for a user."""
    user = F.col("user_id")

    def byte(shift: int) -> Column:
        return F.pmod(F.floor(user / shift), F.lit(256)).cast("string")

    return F.concat_ws(".", F.lit("10"), byte(65536), byte(256), byte(1))


def newest(alerts: DataFrame):
    """The newest creation time of a table."""
    return alerts.agg(F.max("created_at")).first()[0]


def asof(alerts: DataFrame) -> Column:
    """The newest creation time of a table, for queries relative to now."""
    return F.lit(newest(alerts))


def event_log(events: DataFrame) -> DataFrame:
    """Events as syslog lines of their users' hosts."""
    user = F.col("user_id").cast("string")
    ip = user_ip()
    kind = F.col("event_type")
    message = (
        F.when(kind == "error", F.concat(F.lit("sshd[1]: Failed password for user"), user, F.lit(" from "), ip, F.lit(" port 22")))
        .when(kind == "click", F.concat(F.lit("GET /search?q=1 UNION SELECT "), F.col("props"), F.lit(" from "), ip))
        .when(kind == "signup", F.concat(F.lit("bash: useradd -m user"), user))
        .when(kind == "purchase", F.concat(F.lit("GET /cart from "), ip, F.lit(" User-Agent: nikto")))
        .otherwise(F.concat(F.lit("GET /index.html 200 from "), ip))
    )
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("line_id"),
        F.lit("events").alias("source"),
        F.lit("events.parquet").alias("file"),
        F.concat(F.date_format(at, "MMM dd HH:mm:ss"), F.lit(" host "), message).alias("line"),
        at.alias("ingest_ts"),
    )


def event_config(**changes) -> DetectConfig:
    """Detection settings under which event lines give all kinds of alerts."""
    base = {"max_failed_logins": THRESHOLD, "failed_login_window": WINDOW_HOURS * 3600, "allowed": ALLOWED, "allow_mode": "prefix"}
    return DetectConfig(**{**base, **changes})


_PACKS: dict = {}


def builtin_pack(spark: SparkSession) -> rules.CompiledPack:
    """The shipped rules, compiled once per session."""
    key = spark.sparkContext.applicationId
    if key not in _PACKS:
        _PACKS[key] = rules.compile_pack(rulepack.scan_rules(spark))
    return _PACKS[key]


def detected(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    """Alerts of the event lines."""
    lines = event_log(spread(table(spark, sf_dir, "events")))
    return detect(lines, builtin_pack(spark), event_config(**changes))


def document_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best rule of every matching document line, in alert columns."""
    best = rules.match_best(doc_lines(spark, sf_dir), builtin_pack(spark))
    return best.select(
        "doc_id", "line_no", "event_type", "severity", "description", "mitre_tactics", "mitre_techniques",
        "matched_keywords", F.col("rule_title").alias("sigma_rule_title"), F.col("line").alias("raw_log"),
        text.source_ip(F.col("line")).alias("source_ip"),
    )


def joined(column: str) -> Column:
    """A list as text, the form in which results are compared."""
    return F.array_join(column, "|").alias(column)


def stamp(column: str) -> Column:
    """A time as text."""
    return F.date_format(column, TS).alias(column)


CONDITIONS = {
    "rule_condition_all": "words | all",
    "rule_condition_one_of": "1 of sel*",
    "rule_condition_all_of": "all of them",
    "rule_condition_one_of_them": "1 of them",
    "rule_condition_and": "words and sel_b",
    "rule_condition_or": "sel_a or sel_b | all",
    "rule_condition_all_of_named": "all of sel*",
    # no group has this name, so the first one that begins with it counts
    "rule_condition_group_prefix": "sel_ | all",
}
CONDITION_GROUPS = {"words": ["the", "tion"], "sel_a": ["euxp", "onan"], "sel_b": ["ción", "und", "que", "ent"]}


def condition_query(condition: str) -> Callable[[SparkSession, str], DataFrame]:
    """Document lines that meet one condition, with their keywords."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = {"title": "Condition", "detection": {**CONDITION_GROUPS, "condition": condition}}
        pack = rules.compile_pack(rulepack.rules_from_text(spark, {"c.yml": yaml.safe_dump(body, sort_keys=False)}))
        found = rules.match_all(doc_lines(spark, sf_dir), pack)
        return found.select("doc_id", "line_no", joined("matched_keywords"))

    return run


def written_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule file per document, of all levels, some broken or without terms."""
    n = F.col("doc_id").cast("string")
    level = F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low", "informational", "odd"])), (F.col("doc_id") % 6 + 1).cast("int"))
    body = F.concat(
        F.lit("title: 'Rule ("), F.col("source"), F.lit(") no. "), n, F.lit("'\nid: r"), n, F.lit("\nlevel: "), level,
        F.lit("\ntags: [attack.Execution, attack.t"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"),
        F.lit(", attack.reconnaissance]\nfalsepositives: none\ndetection:\n  keywords: [alpha, 'beta.*"), n, F.lit("', alpha]\n  condition: keywords\n"),
    )
    content = F.when(F.col("doc_id") % 10 == 3, F.lit("title: [")).when(F.col("doc_id") % 10 == 7, F.lit("title: x")).otherwise(body)
    files = table(spark, sf_dir, "documents").select(
        F.lit(0).alias("root_idx"), F.concat(F.lit("rules/"), F.col("lang")).alias("root"),
        F.concat(F.lit("r"), n, F.lit(".yml")).alias("path"), content.cast("binary").alias("content"),
    )
    return rulepack.parse_rule_files(spread(files))


def agent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn as a batch of log entries, one per line."""
    host = F.concat(F.lit("host-"), F.col("conv_id") % 7)
    lines = F.filter(F.transform(text.split_lines(F.col("text")), text.strip), lambda t: F.length(t) > 0)
    entry = lambda t: F.struct(
        F.lit("").alias("timestamp"), host.alias("hostname"), F.col("role").alias("source"), t.alias("message"),
        F.lit(None).cast("string").alias("priority"), F.lit(None).cast("string").alias("unit"), t.alias("raw"),
    )
    return spread(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", F.concat(F.lit("agent-"), F.col("conv_id") % 50).alias("agent_id"), host.alias("hostname"),
        F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), "role", F.transform(lines, entry).alias("logs"),
    )


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations (system turns) and batches (other turns) of agents."""
    batches = agent_batches(spark, sf_dir)
    registered = batches.where("role = 'system'").select(
        "agent_id", "hostname", "ts", F.concat(F.lit('{"turn":"'), F.col("turn"), F.lit('"}')).alias("metadata")
    )
    sent = batches.where("role <> 'system'").select("agent_id", "hostname", "ts", agent_source.batch_sizes(batches).alias("n"))
    return agents.registry_events(registered, sent)


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one streaming run."""
    return f"{shared_dir(spark)}/runs/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of 40 files, taken in sixteen at a time.

    There are eight files of each of five stretches of time, in which the events of every third user lag by a stretch and some of all
    others lie in the first or the last. Files come in no order, so rows are late by days.
    """
    events = table(spark, sf_dir, "events")
    day = F.dayofyear(F.col("ts").cast("timestamp"))
    place = F.least(F.floor(day / 8), F.lit(3)) + F.when(F.col("user_id") % 3 == 0, 1).otherwise(0)
    file = F.when(F.col("event_id") % 17 == 0, 4).when(F.col("event_id") % 19 == 0, 0).otherwise(place)
    path = run_dir(spark, "events")
    events.withColumn("part", file).repartition(8).write.partitionBy("part").parquet(path)
    reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "16").option("recursiveFileLookup", "true")
    return reader.parquet(path)


# --------------------------------------------------------------------------
# Queries
# --------------------------------------------------------------------------

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function's name."""
    _QUERIES[run.__name__] = run
    return run


@query
def log_line_split(spark, sf_dir):
    return doc_lines(spark, sf_dir)


@query
def extract_source_ip(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", text.source_ip(F.col("line")).alias("source_ip"))


@query
def extract_user(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", text.user(F.col("line")).alias("user"))


@query
def parse_events(spark, sf_dir):
    lines = spread(event_log(table(spark, sf_dir, "events")))
    return parse.parse_events(lines).select("line_id", "source_ip", "log_time", "user", stamp("event_ts"))


@query
def tag_source_line(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tagged = text.tag_source(F.col("source"), F.col("text"))
    return docs.select("doc_id", tagged.alias("raw_log"), text.cap_message(tagged).alias("message"))


@query
def journal_json(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    record = F.to_json(F.struct(
        F.when(F.col("user_id") % 4 != 0, F.col("props")).alias("MESSAGE"),
        F.when(F.col("user_id") % 3 == 0, F.lit("3")).alias("PRIORITY"),
        F.when(F.col("user_id") % 5 == 0, F.col("event_type")).alias("_SYSTEMD_UNIT"),
    ))
    line = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("not json "), F.col("props"))).otherwise(record)
    entries = journal.journal_entries(events.select("event_id", line.alias("value")))
    return entries.select("event_id", "source", "message", "priority", "unit")


@query
def multi_source_union(spark, sf_dir):
    def lines(name, key, column):
        return table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(key).alias("line_id"), F.col(column).alias("line"))

    parts = [lines("documents", "doc_id", "text"), lines("benchmark", "item_id", "text"), lines("pages", "page_id", "html")]
    return logfiles.union_sources(spark, [*parts, None])


@query
def syslog_facility(spark, sf_dir):
    return logfiles.of_facility(event_log(table(spark, sf_dir, "events")), "sshd").select("line_id", "line")


@query
def stream_syslog(spark, sf_dir):
    path = run_dir(spark, "syslog")
    event_log(table(spark, sf_dir, "events")).select("line").repartition(12).write.text(f"{path}/in")
    lines = logfiles.stream_syslog(spark, f"{path}/in", "sshd", max_files=4)
    return _drain(spark, lines.select("source", "line"), "syslog")


@query
def stream_journal_detect(spark, sf_dir):
    path = run_dir(spark, "journal")
    at = F.unix_micros(F.date_trunc("second", F.col("ingest_ts"))).cast("string")
    record = F.to_json(F.struct(F.col("line").alias("MESSAGE"), F.lit("3").alias("PRIORITY"), F.lit("sshd.service").alias("_SYSTEMD_UNIT"), at.alias("__REALTIME_TIMESTAMP")))
    event_log(table(spark, sf_dir, "events")).select(record).repartition(24).write.text(f"{path}/in")
    # entries in no order, of which each file holds some of every day
    stream = journal.stream_journal(spark, f"{path}/in", "sshd.service", max_files=8)
    live = LiveDetector(spark, builtin_pack(spark), Outputs(f"{path}/out", feed=False), f"{path}/state", event_config())
    live.start(stream, f"{path}/checkpoint").awaitTermination()
    return live.store.read("alerts").select("event_type", "severity", "source_ip", "description", "raw_log")


@query
def rule_match_all(spark, sf_dir):
    found = rules.match_all(doc_lines(spark, sf_dir), builtin_pack(spark))
    return found.select("doc_id", "line_no", "rule_title", "severity", joined("matched_keywords"))


@query
def rule_match_best(spark, sf_dir):
    best = rules.match_best(doc_lines(spark, sf_dir), builtin_pack(spark))
    return best.select(
        "doc_id", "line_no", "rule_title", "severity", "event_type", joined("matched_keywords"),
        joined("mitre_tactics"), joined("mitre_techniques"),
    )


@query
def rule_match_pages(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    found = rules.match_all(pages, builtin_pack(spark), "html")
    return found.groupBy("rule_title", "severity").agg(F.count(F.lit(1)).alias("pages"))


for _name, _condition in CONDITIONS.items():
    _QUERIES[_name] = condition_query(_condition)


@query
def matched_keywords(spark, sf_dir):
    body = {"title": "Words", "detection": {"keywords": ["que", "The", r"th\w+tion", "ich", r"ou.*eau"]}}
    pack = rules.compile_pack(rulepack.rules_from_text(spark, {"w.yml": yaml.safe_dump(body)}))
    found = rules.match_all(doc_lines(spark, sf_dir), pack)
    shown = display.keyword_preview(F.col("matched_keywords"), 2)
    return found.select("doc_id", "line_no", joined("matched_keywords"), F.array_join(shown, "|").alias("preview"))


@query
def failed_login_filter(spark, sf_dir):
    lines = event_log(table(spark, sf_dir, "events"))
    return lines.where(text.is_failed_login(F.col("line"))).select("line_id", "line")


@query
def brute_force_window(spark, sf_dir):
    failures = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    counted = bruteforce.window_counts(failures, "user_id", "ts", "event_id", WINDOW_HOURS * 3600)
    return counted.select("event_id", "user_id", "attempts")


@query
def brute_force_alerts(spark, sf_dir):
    failures = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", user_ip().alias("source_ip"), "ts")
    counted = bruteforce.window_counts(failures, "source_ip", "ts", "event_id", WINDOW_HOURS * 3600)
    alerting = counted.where(F.col("attempts") >= THRESHOLD)
    described = bruteforce.description(F.col("attempts"), F.col("source_ip"), WINDOW_HOURS * 3600)
    return alerting.select("event_id", F.lit(bruteforce.EVENT_TYPE).alias("event_type"), described.alias("description"))


@query
def brute_force_arrival(spark, sf_dir):
    failures = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id")
    return bruteforce.arrival_counts(failures, "user_id", "event_id")


@query
def allowlist_exact(spark, sf_dir):
    listed = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    kept = allowlist.drop_listed(table(spark, sf_dir, "events").select("event_id", "user_id"), listed, "user_id")
    return kept.select("event_id", "user_id")


@query
def allowlist_prefix(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", user_ip().alias("source_ip"))
    return events.where(~allowlist.is_allowed(F.col("source_ip"), ALLOWED, "prefix"))


@query
def allowlist_cidr(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", user_ip().alias("source_ip"))
    return events.where(~allowlist.is_allowed(F.col("source_ip"), ["10.0.0.8", "10.0.1.0/25"], "cidr"))


@query
def allowlist_networks(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("user_id"), "c_nationkey")
    bits = F.when(F.col("c_nationkey") < 2, F.lit("/30")).when(F.col("c_nationkey") < 4, F.lit("/32"))
    networks = users.where("c_nationkey < 4").select(F.concat(user_ip(), bits).alias("cidr"))
    events = table(spark, sf_dir, "events").select("event_id", user_ip().alias("source_ip"))
    return allowlist.drop_networks(events, networks)


@query
def detect_events(spark, sf_dir):
    return detected(spark, sf_dir).select(
        "line_id", "event_type", "severity", "source_ip", "description", "sigma_rule_title",
        joined("matched_keywords"), joined("mitre_tactics"), joined("mitre_techniques"),
    )


@query
def analyze_precedence(spark, sf_dir):
    return detected(spark, sf_dir).groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("count"))


@query
def reputation_enrich(spark, sf_dir):
    scores = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 101).cast("int").alias("score")
    )
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    rated = with_reputation(events, scores, "user_id")
    return rated.select("event_id", "user_id", F.col("abuse_confidence_score").cast("bigint").alias("abuse_confidence_score"))


@query
def alerts_total(spark, sf_dir):
    return stats.total_alerts(event_alerts(spark, sf_dir))


@query
def alerts_by_severity(spark, sf_dir):
    return stats.by_severity(event_alerts(spark, sf_dir))


@query
def alerts_by_type(spark, sf_dir):
    return stats.by_type(event_alerts(spark, sf_dir))


@query
def top_sources_10(spark, sf_dir):
    return stats.top_sources(event_alerts(spark, sf_dir), 10)


@query
def top_sources_5(spark, sf_dir):
    return stats.top_sources(event_alerts(spark, sf_dir), 5, keep_null=True)


@query
def last_hour(spark, sf_dir):
    alerts = event_alerts(spark, sf_dir)
    return stats.last_hour(alerts, asof(alerts))


@query
def timeline_24h(spark, sf_dir):
    alerts = event_alerts(spark, sf_dir)
    hours = stats.timeline(alerts, asof(alerts))
    return hours.select(stamp("hour"), display.hour_label(F.col("hour")).alias("label"), "count")


@query
def latest_alert(spark, sf_dir):
    return stats.latest_alert(event_alerts(spark, sf_dir)).select(stamp("last_alert"))


@query
def alerts_overview(spark, sf_dir):
    alerts = event_alerts(spark, sf_dir)
    return stats.overview(alerts, asof(alerts)).select("total_alerts", "alerts_last_hour", stamp("last_alert"))


@query
def stats_maps(spark, sf_dir):
    maps = stats.stats_maps(event_alerts(spark, sf_dir))

    def shown(name):
        pairs = F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        return F.array_join(F.array_sort(pairs), ",").alias(name)

    return maps.select("total_alerts", shown("by_severity"), shown("by_type"), shown("top_10_ips"))


@query
def stat_cards(spark, sf_dir):
    return stats.stat_cards(event_alerts(spark, sf_dir))


@query
def top_types_8(spark, sf_dir):
    top = stats.top_types(document_alerts(spark, sf_dir))
    return top.select(display.event_label(F.col("event_type")).alias("label"), "count")


@query
def share_of_max(spark, sf_dir):
    shared = stats.share_of_max(stats.top_sources(event_alerts(spark, sf_dir), 10))
    return shared.select("source_ip", "count", F.round("percent", 6).alias("percent"))


@query
def stats_report(spark, sf_dir):
    return stats.stats_report(event_alerts(spark, sf_dir))


@query
def alerts_filter(spark, sf_dir):
    kept = listing.filter_alerts(event_alerts(spark, sf_dir), severity="critical", event_type="Error", source_ip="10.0.0.1")
    return kept.select("id", "severity", "event_type", "source_ip")


@query
def alerts_search(spark, sf_dir):
    kept = listing.filter_alerts(event_alerts(spark, sf_dir), search="USER 1%3")
    return kept.select("id", "description")


@query
def alerts_page(spark, sf_dir):
    page = listing.page(event_alerts(spark, sf_dir), number=3, size=20)
    return page.select("id", stamp("created_at"), "description")


@query
def page_count(spark, sf_dir):
    critical = listing.filter_alerts(event_alerts(spark, sf_dir), severity="CRITICAL")
    return listing.page_info(critical, number=2, size=30)


@query
def numbered_pages(spark, sf_dir):
    order = [F.desc("created_at"), F.desc("id")]
    return listing.numbered_pages(event_alerts(spark, sf_dir).select("id", "created_at"), 25, order).select("id", "row_no", "page")


@query
def recent_alerts(spark, sf_dir):
    return listing.recent_alerts(event_alerts(spark, sf_dir), 10).select("id", "event_type", "description")


@query
def recent_live_rows(spark, sf_dir):
    lines = event_log(table(spark, sf_dir, "events")).select(F.col("line_id").alias("id"), F.col("ingest_ts").alias("created_at"), "line")
    return listing.recent_live_logs(lines, 50).select("id", "line")


@query
def recent_agent_rows(spark, sf_dir):
    logs = agent_source.explode_logs(agent_batches(spark, sf_dir), ["conv_id", "turn", "agent_id"])
    return listing.recent_agent_logs(logs, 40, ("conv_id", "turn", "log_no")).select("conv_id", "turn", "log_no", "agent_id", "message")


@query
def multi_field_search(spark, sf_dir):
    kept = listing.filter_report(document_alerts(spark, sf_dir), query="  TION ", severity="CRITICAL")
    return kept.select("doc_id", "line_no", "event_type")


@query
def tactic_filter(spark, sf_dir):
    kept = listing.filter_report(document_alerts(spark, sf_dir), tactic="Execution")
    return kept.select("doc_id", "line_no", "event_type")


@query
def facets_type(spark, sf_dir):
    return stats.type_facets(document_alerts(spark, sf_dir))


@query
def facets_tactic(spark, sf_dir):
    return stats.tactic_facets(document_alerts(spark, sf_dir))


@query
def tactic_breakdown(spark, sf_dir):
    return stats.by_tactic(detected(spark, sf_dir))


@query
def technique_breakdown(spark, sf_dir):
    by_technique = stats.by_technique(detected(spark, sf_dir))
    return by_technique.select("technique", display.technique_url(F.col("technique")).alias("url"), "count")


@query
def file_summary(spark, sf_dir):
    lines = event_log(spread(table(spark, sf_dir, "events")))
    return report.analyze_file(lines, builtin_pack(spark), event_config(time_mode="arrival")).summary


@query
def retention(spark, sf_dir):
    alerts = event_alerts(spark, sf_dir)
    return listing.unexpired(alerts, 10, asof(alerts)).select("id", stamp("created_at"))


@query
def retention_count(spark, sf_dir):
    alerts = event_alerts(spark, sf_dir)
    return listing.expired_count(alerts, 10, asof(alerts))


@query
def live_feed_prune(spark, sf_dir):
    return listing.newest_kept(event_alerts(spark, sf_dir), 500).select("id", "description")


@query
def live_feed(spark, sf_dir):
    lines = spread(event_log(table(spark, sf_dir, "events")))
    settled = detect(lines, builtin_pack(spark), event_config(), keep_benign=True)
    rows = tables.shown(tables.live_rows(settled, ["line_id"], F.col("ingest_ts")))
    shown = display.feed_text(F.col("is_alert"), F.col("description"), F.col("message"))
    return rows.select(display.feed_time(F.col("timestamp")).alias("time"), "source", "is_alert", "severity", "event_type", "source_ip", shown.alias("text"))


@query
def recent_critical(spark, sf_dir):
    return stats.ad_hoc(event_alerts(spark, sf_dir), "recent_critical").select(stamp("timestamp"), "source_ip", "event_type", "description")


@query
def top_attackers(spark, sf_dir):
    return stats.ad_hoc(event_alerts(spark, sf_dir), "top_attackers")


@query
def attacks_by_type(spark, sf_dir):
    return stats.ad_hoc(event_alerts(spark, sf_dir), "attacks_by_type")


@query
def last_hour_rows(spark, sf_dir):
    alerts = event_alerts(spark, sf_dir)
    return stats.ad_hoc(alerts, "last_hour_rows", newest(alerts)).select("id", "event_type", "source_ip", stamp("timestamp"))


@query
def agent_ingest(spark, sf_dir):
    logs = agent_source.explode_logs(agent_batches(spark, sf_dir), ["conv_id", "turn", "agent_id", "ts"])
    logs = logs.withColumnsRenamed({"timestamp": "sent", "ts": "ingest_ts"})
    config = DetectConfig(seq=("conv_id", "turn", "log_no"))
    found = agents.agent_alerts(logs, builtin_pack(spark), config)
    return found.select("agent_id", "conv_id", "turn", "log_no", "event_type", "severity", "source_ip", "raw_log")


@query
def agent_receipt(spark, sf_dir):
    batches = agent_batches(spark, sf_dir)
    logs = agent_source.explode_logs(batches, ["conv_id", "turn"]).withColumn("line", F.col("message"))
    found = rules.match_best(logs, builtin_pack(spark))
    return agents.receipts(batches, found, ["conv_id", "turn"])


@query
def agent_registry(spark, sf_dir):
    state = agents.registry(agent_events(spark, sf_dir))
    return state.select("agent_id", "hostname", stamp("first_seen"), stamp("last_seen"), "logs_received", "metadata")


@query
def agent_list(spark, sf_dir):
    listed = agents.agent_list(agents.registry(agent_events(spark, sf_dir)))
    return listed.select("agent_id", stamp("last_seen"), F.col("metadata")["turn"].alias("turn"))


@query
def agent_id(spark, sf_dir):
    users = table(spark, sf_dir, "customer")
    return users.select("c_custkey", text.agent_id(F.col("c_name"), F.col("c_mktsegment")).alias("agent_id"))


@query
def rule_catalogue(spark, sf_dir):
    return rules.catalogue(written_rules(spark, sf_dir)).select(
        "id", "title", "description", "level", "severity", "event_type", joined("mitre_tactics"), joined("mitre_techniques"),
        joined("false_positives"), F.col("keyword_count").cast("bigint").alias("keyword_count"), "condition",
    )


@query
def rule_load_stats(spark, sf_dir):
    return rules.load_stats(written_rules(spark, sf_dir))


@query
def slug(spark, sf_dir):
    title = F.concat(F.lit("("), F.col("c_name"), F.lit(") / "), F.col("c_mktsegment"), F.lit("!"))
    return table(spark, sf_dir, "customer").select("c_custkey", metadata.event_type_slug(title).alias("slug"))


@query
def level_severity(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    level = F.element_at(F.array(*map(F.lit, ["Critical", "HIGH", "medium", "low", "informational", "other"])), (F.col("user_id") % 6 + 1).cast("int"))
    severity = metadata.severity_of_level(F.when(F.col("user_id") % 7 != 0, level))
    return events.select("event_id", severity.alias("severity"), metadata.severity_rank(severity).cast("bigint").alias("rank"))


@query
def mitre_tags(spark, sf_dir):
    n = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    tags = F.array(F.concat(F.lit("attack.T"), n), F.lit("Attack.Initial_Access"), F.concat(F.lit("attack.t"), n, F.lit(".001")), F.concat(F.lit("cve."), n), F.lit("impact"), F.lit("attack.reconnaissance"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(metadata.tactics_of(tags), "|").alias("tactics"),
        F.array_join(metadata.tactics_of(tags, extended=True), "|").alias("extended_tactics"),
        F.array_join(metadata.techniques_of(tags), "|").alias("techniques"),
    )


@query
def json_lists(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    good = F.to_json(F.array(F.col("event_type"), F.lit("x\"y")))
    stored = F.when(F.col("event_id") % 5 == 0, F.lit("[broken")).when(F.col("event_id") % 5 == 1, F.lit("[]")).otherwise(good)
    rows = alert_source.decode_alerts(events.select("event_id", stored.alias("matched_keywords")))
    written = alert_source.encode_alerts(rows)
    return written.select("event_id", F.col("matched_keywords").alias("stored"), F.col("mitre_tactics").alias("missing")).join(
        rows.select("event_id", joined("matched_keywords")), "event_id"
    )


@query
def alert_dict(spark, sf_dir):
    found = detected(spark, sf_dir)
    return found.select("line_id", F.to_json(display.alert_fields()).alias("body"))


@query
def notification_payload(spark, sf_dir):
    scored = event_alerts(spark, sf_dir).withColumns({
        "abuse_confidence_score": (F.col("id") % 3 * 40).cast("int"),
        "raw_log": F.repeat("raw_log", ((F.col("id") % 4) * 20 + 1).cast("int")),
    })
    rows = outbox.outbox_rows(scored, {"enabled": True, "webhook_url": "https://hooks.example.org/1"})
    return rows.select("id", "payload")


@query
def stale_drop(spark, sf_dir):
    return buffer.drop_stale(late_events(table(spark, sf_dir, "events"))).select("event_id")


def late_events(events: DataFrame) -> DataFrame:
    """Events with an arrival up to some ten minutes after them."""
    lag = F.col("event_id") % 601 * 1_000_000
    return events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("event_ts"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + lag).alias("ingest_ts"))


@query
def stream_stale_drop(spark, sf_dir):
    fresh = buffer.drop_stale(late_events(event_stream(spark, sf_dir)).withWatermark("event_ts", "300 seconds"))
    return _drain(spark, fresh.select("event_id"), "stale")


@query
def stream_dedupe(spark, sf_dir):
    events = late_events(event_stream(spark, sf_dir)).select("user_id", "event_type", "event_ts")
    # every row arrives twice, as after a batch that was sent again
    resent = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    unique = buffer.drop_resent(resent, ["user_id", "event_type", "event_ts"])
    return _drain(spark, unique.select("user_id", "event_type", stamp("event_ts")), "dedupe")


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for the data that is there."""
    path = run_dir(spark, name)
    run = (
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query
def stream_brute_force(spark, sf_dir):
    path = run_dir(spark, "brute")
    failures = event_stream(spark, sf_dir).where("event_type = 'error'").select("event_id", user_ip().alias("source_ip"), F.col("ts").cast("timestamp").alias("event_ts"))
    counts = windows.live_counts(failures, ["event_id"], event_config().failed_login_window)

    def write(batch, batch_id):
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    # a count that a late failure has raised is written again
    found = spark.read.parquet(f"{path}/out")
    return found.groupBy("event_id", "source_ip").agg(F.max_by("attempts", "version").alias("attempts"))


@query
def stream_detect(spark, sf_dir):
    path = run_dir(spark, "detect")
    live = LiveDetector(spark, builtin_pack(spark), Outputs(f"{path}/out", feed=False), f"{path}/state", event_config())
    live.start(event_log(event_stream(spark, sf_dir)), f"{path}/checkpoint").awaitTermination()
    return live.store.read("alerts").select("event_type", "severity", "source_ip", "description", "raw_log")


def _ingested(spark: SparkSession, sf_dir: str):
    """Tables after the agent batches came in as a stream of five files, whose order is not that of the batches."""
    path = run_dir(spark, "agents")
    batches = agent_batches(spark, sf_dir).select(
        "conv_id", "turn", "agent_id", "hostname", F.concat_ws(":", "conv_id", "turn").alias("timestamp"), "logs", F.col("ts").alias("ingest_ts")
    )
    batches.repartition(5, F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5))).write.json(f"{path}/in")
    stream = agent_source.stream_batches(spark, f"{path}/in", 1, "conv_id bigint, turn int, ingest_ts timestamp")
    live = AgentIngest(spark, builtin_pack(spark), Outputs(f"{path}/out"), f"{path}/state", DetectConfig(seq=("conv_id", "turn", "log_no")))
    live.start(stream, f"{path}/checkpoint").awaitTermination()
    return live.store


@query
def stream_agent_ingest(spark, sf_dir):
    return _ingested(spark, sf_dir).read("alerts").select("event_type", "severity", "source_ip", "raw_log")


@query
def agent_live_feed(spark, sf_dir):
    feed = _ingested(spark, sf_dir).read("agent_feed")
    return feed.select("agent_id", "hostname", "source", "message", "is_alert", "severity", "event_type", "description")


@query
def stream_agent_receipts(spark, sf_dir):
    store = _ingested(spark, sf_dir)
    sizes = store.read("receipts").select(F.col("sent").alias("batch"), "agent_id", "logs_processed", "alerts_created")
    state = agents.registry(store.read("registry_events")).select("agent_id", F.col("logs_received").alias("agent_logs"), stamp("last_seen"))
    return sizes.join(state, "agent_id")


@query
def live_table(spark, sf_dir):
    path = run_dir(spark, "live-table")
    store = Store(spark, path)
    settled = detect(event_log(table(spark, sf_dir, "events")), builtin_pack(spark), event_config(), keep_benign=True)
    rows = stage(tables.live_rows(settled.withColumn("id", F.col("line_id")), None, F.col("ingest_ts")), "live-rows")
    # two batches that share all days
    for n in range(2):
        store.write("feed", rows.where(F.col("id") % 2 == n), f"b{n}")
        store.commit(f"b{n}", add={"feed": [f"b{n}"]})
    store.prune(500)
    return store.read("feed").select("id", "message", "is_alert", "severity", "event_type")


@query
def store_compacted(spark, sf_dir):
    path = run_dir(spark, "compacted")
    store, alerts = Store(spark, path), event_alerts(spark, sf_dir)
    none = F.array().cast("array<string>")
    lists = {c: none for c in schemas.JSON_COLUMNS}
    full = stage(alerts.withColumns({**lists, "sigma_rule_id": F.lit(""), "sigma_rule_title": F.lit("")}), "compact-in")
    for n in range(4):
        store.write("alerts", full.where(F.col("id") % 4 == n), f"b{n}", n)
        store.commit(f"b{n}", add={"alerts": [f"b{n}"]})
    # every hundredth alert is written again with another severity
    again = full.where(F.col("id") % 100 == 0).withColumns({"severity": F.lit("EMERGENCY"), "amends": F.lit(True)})
    store.write("alerts", again, "b4", 4)
    store.commit("b4", add={"alerts": ["b4"]}, amended=["alerts"])
    store.expire(10, asof=asof(alerts))
    store.compact("alerts")
    store.vacuum(0)
    return store.read("alerts").select("id", "severity", "source_ip", F.col("dt").cast("string").alias("dt"))


@query
def stream_registry(spark, sf_dir):
    path = run_dir(spark, "registry")
    stage_path = f"{path}/in"
    # files of agent events, taken in over several micro-batches; newer events may come before older ones
    agent_events(spark, sf_dir).repartitionByRange(4, F.xxhash64("agent_id", "ts")).write.parquet(stage_path)
    updater = RegistryUpdater(spark, f"{path}/state")
    stream = spark.readStream.schema(spark.read.parquet(stage_path).schema).option("maxFilesPerTrigger", "1").parquet(stage_path)
    stream.writeStream.foreachBatch(updater.process).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return updater.current().select("agent_id", "hostname", stamp("first_seen"), stamp("last_seen"), "logs_received", "metadata")


@query
def alert_store(spark, sf_dir):
    path = f"{run_dir(spark, 'store')}/alerts"
    found = detected(spark, sf_dir)
    tables.append_alerts(tables.alert_rows(found, F.col("ingest_ts"), ["line_id"]), path)
    stored = alert_source.read_alerts(spark, path)
    return stored.groupBy(F.col("dt").cast("string").alias("dt"), "severity").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("id").alias("ids"))


@query
def store_retention(spark, sf_dir):
    path = f"{run_dir(spark, 'retained')}/alerts"
    alerts = event_alerts(spark, sf_dir)
    tables.append(alerts, path, cluster_by=("severity", "event_type"))
    tables.delete_old_alerts(spark, path, 10, asof(alerts))
    return tables.read_table(spark, path).select("id")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: full detection over the event lines, alerts counted by type."""
    return stats.by_type(detected(spark, ENTRY_DATA))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries; each takes (spark, sf_dir)."""
    return {**_QUERIES, **_corpus()[0]}


def _corpus() -> tuple[dict, dict]:
    """Queries and SQL of the corpus operators and their pipeline, where those are installed."""
    try:
        import corpus_pipeline
        from duskwatch.llm import queries as corpus
    except ImportError:
        # without the subpackage, or a library that it needs, all other queries work
        return {}, {}
    return {**corpus.QUERIES, "pipeline": corpus_pipeline.run}, dict(corpus.SQL)


def oracle_sql() -> dict[str, str]:
    """SQL for the registered queries."""
    from oracle import statements

    return {**statements(), **_corpus()[1]}
