"""The registered queries once more, in SQL for a database without any of the engine's code."""

from __future__ import annotations

import re
from pathlib import Path

import yaml

# the settings the queries use
THRESHOLD, WINDOW_US = 3, 6 * 3600 * 1_000_000
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
# Patterns of addresses and failed logins, what makes a term a regular expression, tactic names, levels.
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
FAILED = r"Failed password|Invalid user|Authentication failure|sshd.*Failed|denied by pam|failed.*ssh|Too many authentication failures"
REGEX_HINT = re.compile(r"\.\*|\\d|\\w|\\s|\[\^|\(\?|\(\.\)")
UNCOMPILABLE = {"php.*exec("}
TACTICS = {
    "initial_access": "Initial Access",
    "execution": "Execution",
    "persistence": "Persistence",
    "privilege_escalation": "Privilege Escalation",
    "defense_evasion": "Defense Evasion",
    "credential_access": "Credential Access",
    "discovery": "Discovery",
    "lateral_movement": "Lateral Movement",
    "collection": "Collection",
    "command_and_control": "Command and Control",
    "exfiltration": "Exfiltration",
    "impact": "Impact",
}
LEVELS = {"critical": ("CRITICAL", 3), "high": ("CRITICAL", 3), "medium": ("WARNING", 2), "low": ("INFO", 1)}


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def trimmed(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _lines(source: str, keys: str, column: str) -> str:
    pieces = rf"string_split_regex({column}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return (
        f"(SELECT {keys}, line_no, line FROM (SELECT {keys}, line_no, {trimmed('raw')} AS line FROM "
        f"(SELECT {keys}, unnest({pieces}) AS raw, generate_subscripts({pieces}, 1) AS line_no FROM {source})) WHERE line <> '')"
    )


LINES = _lines("documents", "doc_id", "text")
IP = "'10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256)"
ALERTS = (
    "(SELECT event_id AS id, ts AS timestamp, ts AS created_at, upper(event_type) AS event_type, "
    "CASE WHEN event_type = 'error' THEN 'CRITICAL' WHEN event_type IN ('purchase', 'signup') THEN 'WARNING' ELSE 'INFO' END AS severity, "
    f"CASE WHEN user_id % 50 <> 0 THEN {IP} END AS source_ip, "
    "event_type || ' event of user ' || user_id AS description, props AS raw_log FROM events)"
)
EVENT_LOG = (
    "(SELECT event_id AS line_id, user_id, ts, event_type, "
    f"{IP} AS ip, date_trunc('second', ts) AS event_ts, strftime(ts, '%b %d %H:%M:%S') || ' host ' || CASE event_type "
    f"WHEN 'error' THEN 'sshd[1]: Failed password for user' || user_id || ' from ' || {IP} || ' port 22' "
    f"WHEN 'click' THEN 'GET /search?q=1 UNION SELECT ' || props || ' from ' || {IP} "
    "WHEN 'signup' THEN 'bash: useradd -m user' || user_id "
    f"WHEN 'purchase' THEN 'GET /cart from ' || {IP} || ' User-Agent: nikto' "
    f"ELSE 'GET /index.html 200 from ' || {IP} END AS line FROM events)"
)
BY_COUNT = "ORDER BY count DESC"


class Pack:
    """The shipped rules as SQL: a table of rules and one of hits."""

    def __init__(self) -> None:
        self.rules, self.literals, self.regexes, self.notes = [], [], [], []
        for idx, path in enumerate(sorted((Path(__file__).parent / "duskwatch" / "rules").glob("*.yml"))):
            rule = yaml.safe_load(path.read_text())
            severity, rank = LEVELS[rule["level"]]
            names = [t.split(".", 1)[1] for t in rule["tags"]]
            tactics = [TACTICS[n] for n in names if n in TACTICS]
            techniques = [n.upper() for n in names if n[0] == "t" and n[1].isdigit()]
            slug = "".join(c if c.isascii() and c.isalnum() else " " for c in rule["title"].upper())
            self.rules.append((idx, rule["title"], rule["description"], severity, rank, "_".join(slug.split()), "|".join(tactics), "|".join(techniques)))
            self.notes.append((rule["title"], rule["id"], "|".join(rule["falsepositives"])))
            for ord_, term in enumerate(rule["detection"]["keywords"]):
                term = term.strip()
                regex = bool(REGEX_HINT.search(term)) and term not in UNCOMPILABLE
                (self.regexes if regex else self.literals).append((idx, ord_, term))

    def rule_table(self) -> str:
        rows = ", ".join(f"({i}, {quote(t)}, {quote(d)}, '{s}', {r}, '{e}', '{ta}', '{te}')" for i, t, d, s, r, e, ta, te in self.rules)
        return f"(SELECT * FROM (VALUES {rows}) AS v(rule_idx, rule_title, rule_description, severity, rank, event_type, mitre_tactics, mitre_techniques))"

    def hits(self, source: str, keys: str, column: str = "line") -> str:
        """(keys, rule_idx, matched_keywords) for rows of ``source``."""
        values = ", ".join(f"({i}, {o}, {quote(t)})" for i, o, t in self.literals)
        parts = [
            f"SELECT {keys}, rule_idx, ord, kw FROM {source} JOIN (VALUES {values}) AS v(rule_idx, ord, kw) ON contains(lower({column}), lower(kw))"
        ]
        parts += [
            f"SELECT {keys}, {i}, {o}, {quote(t)} FROM {source} WHERE regexp_matches({column}, {quote(t)}, 'i')" for i, o, t in self.regexes
        ]
        union = " UNION ALL ".join(parts)
        return f"(SELECT {keys}, rule_idx, string_agg(kw, '|' ORDER BY ord) AS matched_keywords FROM ({union}) GROUP BY {keys}, rule_idx)"

    def matches(self, source: str, keys: str, column: str = "line") -> str:
        return f"(SELECT * FROM {self.hits(source, keys, column)} JOIN {self.rule_table()} USING (rule_idx))"

    def best(self, source: str, keys: str, column: str = "line") -> str:
        order = f"row_number() OVER (PARTITION BY {keys} ORDER BY rank DESC, rule_idx)"
        return f"(SELECT * FROM (SELECT *, {order} AS place FROM {self.matches(source, keys, column)}) WHERE place = 1)"


def stamp(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {name or column}"


def window_count(key: str, us: str, seq: str) -> str:
    """Failures of the key in the window that ends with the row."""
    return (
        f"count(*) OVER (PARTITION BY {key} ORDER BY {us} RANGE BETWEEN {WINDOW_US - 1} PRECEDING AND CURRENT ROW) "
        f"- count(*) OVER (PARTITION BY {key}, {us}) + row_number() OVER (PARTITION BY {key}, {us} ORDER BY {seq})"
    )


def detected(pack: Pack, line: str = "line", arrival: bool = False) -> str:
    """Alerts of the event lines: brute force, else the best rule, without allowed sources."""
    found_ip = f"regexp_extract(line, '{IPV4}')"
    base = (
        f"base AS (SELECT *, CASE WHEN {found_ip} = '' THEN 'UNKNOWN' ELSE {found_ip} END AS source_ip, {line} AS raw, "
        f"regexp_matches(line, '{FAILED}', 'i') AS failed FROM {EVENT_LOG}), "
        "log AS (SELECT *, source_ip = '10.0.0.8' OR starts_with(source_ip, '10.0.2') AS allowed FROM base)"
    )
    count = "row_number() OVER (PARTITION BY source_ip ORDER BY line_id)" if arrival else window_count("source_ip", "epoch_us(event_ts)", "line_id")
    brute = f"brute AS (SELECT * FROM (SELECT *, {count} AS attempts FROM log WHERE failed AND NOT allowed) WHERE attempts >= {THRESHOLD})"
    rest = "rest AS (SELECT * FROM log WHERE NOT allowed AND line_id NOT IN (SELECT line_id FROM brute))"
    return (
        f"(WITH {base}, {brute}, {rest} "
        "SELECT line_id, event_ts, ts, raw, 'BRUTE_FORCE' AS event_type, 'CRITICAL' AS severity, source_ip, "
        f"attempts || ' failed login attempts from ' || source_ip || ' within {WINDOW_US // 1_000_000}s' AS description, "
        "'SSH Brute Force Authentication Failure' AS sigma_rule_title, '' AS matched_keywords, "
        "'Credential Access' AS mitre_tactics, 'T1110.001' AS mitre_techniques FROM brute "
        "UNION ALL SELECT line_id, event_ts, ts, raw, b.event_type, b.severity, source_ip, rule_description, rule_title, matched_keywords, "
        f"mitre_tactics, mitre_techniques FROM {pack.best('rest', 'line_id', 'raw')} b "
        "JOIN (SELECT line_id, event_ts, ts, raw, source_ip FROM rest) USING (line_id))"
    )


def ranked(key: str, source: str, where: str = "TRUE") -> str:
    return f"SELECT {key}, count(*) AS count FROM {source} WHERE {where} GROUP BY {key} {BY_COUNT}, {key} NULLS FIRST"


def condition(required: str, lists: list[str]) -> str:
    """Lines meeting a condition over word lists; keywords are those of ``lists``."""
    return f"SELECT doc_id, line_no, {' || '.join(lists)} AS matched_keywords FROM {WORDS} WHERE {required}"


def _word_list(words: list[str]) -> str:
    items = ", ".join(f"CASE WHEN contains(lower(line), {quote(w)}) THEN {quote(w)} END" for w in words)
    return f"list_filter([{items}], lambda w: w IS NOT NULL)"


GROUPS = {"words": ["the", "tion"], "sel_a": ["euxp", "onan"], "sel_b": ["ción", "und", "que", "ent"]}
WORDS = (
    "(SELECT doc_id, line_no, "
    + ", ".join(f"array_to_string({_word_list(w)}, '|') AS {g}, len({_word_list(w)}) AS {g}_n" for g, w in GROUPS.items())
    + f" FROM {LINES})"
)
NOW = f"(SELECT max(created_at) FROM {ALERTS})"
TURNS = (
    "(SELECT conv_id, turn, role, 'agent-' || (conv_id % 50) AS agent_id, 'host-' || (conv_id % 7) AS hostname, "
    "to_timestamp(conv_id * 1000 + turn) AT TIME ZONE 'UTC' AS ts, text FROM conversations)"
)
TURN_LINES = (
    "(SELECT conv_id, turn, role, agent_id, hostname, ts, row_number() OVER (PARTITION BY conv_id, turn ORDER BY line_no) - 1 AS log_no, "
    f"line AS message FROM {_lines(TURNS, 'conv_id, turn, role, agent_id, hostname, ts', 'text')})"
)


def statements() -> dict[str, str]:
    pack = Pack()
    found = detected(pack)
    events = "event_id, user_id, ts, epoch_us(ts) AS us"
    failures = f"(SELECT {events}, {IP} AS ip FROM events WHERE event_type = 'error')"
    doc_best = pack.best(LINES, "doc_id, line_no")
    doc_alerts = f"(SELECT * FROM {doc_best} JOIN {LINES} USING (doc_id, line_no))"
    page = "ORDER BY created_at DESC, id DESC LIMIT"
    live_prefix = "'[events] ' || line"
    journal_prefix = "'[journalctl] ' || line"
    turn_best = pack.best(TURN_LINES, "conv_id, turn, log_no", "message")
    sql = {
        "log_line_split": f"SELECT * FROM {LINES}",
        "extract_source_ip": f"SELECT doc_id, line_no, CASE WHEN regexp_extract(line, '{IPV4}') = '' THEN 'UNKNOWN' ELSE regexp_extract(line, '{IPV4}') END AS source_ip FROM {LINES}",
        "extract_user": rf"SELECT doc_id, line_no, nullif(regexp_extract(line, '(?:for|user)\s+([A-Za-z0-9_]+)', 1), '') AS user FROM {LINES}",
        "parse_events": (
            f"SELECT line_id, CASE WHEN event_type = 'signup' THEN 'UNKNOWN' ELSE ip END AS source_ip, strftime(ts, '%b %d %H:%M:%S') AS log_time, "
            f"CASE WHEN event_type = 'error' THEN 'user' || user_id END AS user, {stamp('event_ts')} FROM {EVENT_LOG}"
        ),
        "tag_source_line": "SELECT doc_id, '[' || source || '] ' || text AS raw_log, left('[' || source || '] ' || text, 2000) AS message FROM documents",
        "journal_json": (
            "SELECT event_id, 'journalctl' AS source, CASE WHEN event_id % 11 = 0 THEN 'not json ' || props WHEN user_id % 4 <> 0 THEN props ELSE '' END AS message, "
            "CASE WHEN event_id % 11 = 0 THEN NULL WHEN user_id % 3 = 0 THEN '3' ELSE '6' END AS priority, "
            "CASE WHEN event_id % 11 = 0 THEN NULL WHEN user_id % 5 = 0 THEN event_type ELSE 'unknown' END AS unit FROM events"
        ),
        "multi_source_union": (
            "SELECT 'documents' AS source, doc_id AS line_id, text AS line FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark "
            "UNION ALL SELECT 'pages', page_id, html FROM pages"
        ),
        "syslog_facility": f"SELECT line_id, line FROM {EVENT_LOG} WHERE contains(line, 'sshd')",
        "rule_match_all": f"SELECT doc_id, line_no, rule_title, severity, matched_keywords FROM {pack.matches(LINES, 'doc_id, line_no')}",
        "rule_match_best": f"SELECT doc_id, line_no, rule_title, severity, event_type, matched_keywords, mitre_tactics, mitre_techniques FROM {doc_best}",
        "rule_match_pages": f"SELECT rule_title, severity, count(*) AS pages FROM {pack.matches('pages', 'page_id', 'html')} GROUP BY ALL",
        "rule_condition_all": condition("words_n = 2", ["words"]),
        "rule_condition_one_of": f"SELECT doc_id, line_no, CASE WHEN sel_a_n > 0 THEN sel_a ELSE sel_b END AS matched_keywords FROM {WORDS} WHERE sel_a_n > 0 OR sel_b_n > 0",
        "rule_condition_all_of": condition("words_n > 0 AND sel_a_n > 0 AND sel_b_n > 0", ["words", "'|'", "sel_a", "'|'", "sel_b"]),
        "rule_condition_one_of_them": (
            "SELECT doc_id, line_no, CASE WHEN words_n > 0 THEN words WHEN sel_a_n > 0 THEN sel_a ELSE sel_b END AS matched_keywords "
            f"FROM {WORDS} WHERE words_n > 0 OR sel_a_n > 0 OR sel_b_n > 0"
        ),
        "rule_condition_all_of_named": condition("sel_a_n > 0 AND sel_b_n > 0", ["sel_a", "'|'", "sel_b"]),
        "rule_condition_group_prefix": condition("sel_a_n = 2", ["sel_a"]),
        "rule_condition_and": condition("words_n > 0 AND sel_b_n > 0", ["words", "'|'", "sel_b"]),
        "rule_condition_or": f"SELECT doc_id, line_no, CASE WHEN sel_a_n > 0 THEN sel_a ELSE sel_b END AS matched_keywords FROM {WORDS} WHERE sel_a_n > 0 OR sel_b_n = 4",
        "matched_keywords": _matched_keywords(),
        "failed_login_filter": f"SELECT line_id, line FROM {EVENT_LOG} WHERE regexp_matches(line, '{FAILED}', 'i')",
        "brute_force_window": f"SELECT event_id, user_id, {window_count('user_id', 'us', 'event_id')} AS attempts FROM {failures}",
        "brute_force_alerts": (
            f"SELECT event_id, 'BRUTE_FORCE' AS event_type, attempts || ' failed login attempts from ' || ip || ' within {WINDOW_US // 1_000_000}s' AS description "
            f"FROM (SELECT event_id, ip, {window_count('ip', 'us', 'event_id')} AS attempts FROM {failures}) WHERE attempts >= {THRESHOLD}"
        ),
        "brute_force_arrival": f"SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempts FROM {failures}",
        "allowlist_exact": "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)",
        "allowlist_prefix": f"SELECT event_id, ip AS source_ip FROM (SELECT event_id, {IP} AS ip FROM events) WHERE ip <> '10.0.0.8' AND NOT starts_with(ip, '10.0.2')",
        "allowlist_cidr": f"SELECT event_id, {IP} AS source_ip FROM events WHERE user_id <> 8 AND user_id NOT BETWEEN 256 AND 383",
        "allowlist_networks": (
            f"SELECT event_id, {IP} AS source_ip FROM events WHERE user_id NOT IN (SELECT c_custkey * 7 FROM customer WHERE c_nationkey IN (2, 3)) "
            "AND user_id // 4 NOT IN (SELECT c_custkey * 7 // 4 FROM customer WHERE c_nationkey < 2)"
        ),
        "detect_events": f"SELECT line_id, event_type, severity, source_ip, description, sigma_rule_title, matched_keywords, mitre_tactics, mitre_techniques FROM {found}",
        "analyze_precedence": f"SELECT event_type, severity, count(*) AS count FROM {found} GROUP BY ALL",
        "reputation_enrich": (
            "SELECT event_id, user_id, coalesce(c_custkey % 101, 0) AS abuse_confidence_score FROM events "
            "LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON user_id = c_custkey"
        ),
        "alerts_total": "SELECT count(*) AS total_alerts FROM events",
        "alerts_by_severity": ranked("severity", ALERTS),
        "alerts_by_type": ranked("event_type", ALERTS),
        "top_sources_10": ranked("source_ip", ALERTS, "source_ip IS NOT NULL") + " LIMIT 10",
        "top_sources_5": ranked("source_ip", ALERTS) + " LIMIT 5",
        "last_hour": f"SELECT count(*) AS alerts_last_hour FROM {ALERTS} WHERE created_at >= {NOW} - INTERVAL 1 HOUR",
        "timeline_24h": (
            f"SELECT {stamp('h', 'hour')}, strftime(h, '%H:%M') AS label, count FROM (SELECT date_trunc('hour', timestamp) AS h, count(*) AS count "
            f"FROM {ALERTS} WHERE timestamp >= {NOW} - INTERVAL 24 HOUR GROUP BY h)"
        ),
        "latest_alert": f"SELECT {stamp('max(ts)', 'last_alert')} FROM events",
        "alerts_overview": f"SELECT count(*) AS total_alerts, count(*) FILTER (created_at >= {NOW} - INTERVAL 1 HOUR) AS alerts_last_hour, {stamp('max(timestamp)', 'last_alert')} FROM {ALERTS}",
        "stats_maps": _stats_maps(),
        "stat_cards": (
            f"SELECT (SELECT count(*) FROM {ALERTS} WHERE severity = 'CRITICAL') AS critical, "
            f"(SELECT event_type FROM ({ranked('event_type', ALERTS)} LIMIT 1)) AS top_type"
        ),
        "top_types_8": f"SELECT replace(event_type, '_', ' ') AS label, count FROM ({ranked('event_type', doc_best)} LIMIT 8)",
        "share_of_max": (
            f"SELECT source_ip, count, round(count / max(count) OVER () * 100, 6) AS percent FROM ({ranked('source_ip', ALERTS, 'source_ip IS NOT NULL')} LIMIT 10)"
        ),
        "stats_report": (
            f"SELECT 'severity' AS section, severity AS name, count FROM ({ranked('severity', ALERTS)}) "
            f"UNION ALL SELECT 'event_type', event_type, count FROM ({ranked('event_type', ALERTS)} LIMIT 5) "
            f"UNION ALL SELECT 'source_ip', source_ip, count FROM ({ranked('source_ip', ALERTS, 'source_ip IS NOT NULL')} LIMIT 5)"
        ),
        "alerts_filter": f"SELECT id, severity, event_type, source_ip FROM {ALERTS} WHERE severity = 'CRITICAL' AND event_type = 'ERROR' AND source_ip ILIKE '%10.0.0.1%'",
        "alerts_search": f"SELECT id, description FROM {ALERTS} WHERE description ILIKE '%USER 1%3%' OR raw_log ILIKE '%USER 1%3%' OR source_ip ILIKE '%USER 1%3%'",
        "alerts_page": f"SELECT id, {stamp('created_at')}, description FROM (SELECT * FROM {ALERTS} {page} 20 OFFSET 40)",
        "page_count": f"SELECT total, 2::BIGINT AS page, 30::BIGINT AS limit, greatest(1, (total + 29) // 30) AS pages FROM (SELECT count(*) AS total FROM {ALERTS} WHERE severity = 'CRITICAL')",
        "numbered_pages": f"SELECT id, row_no, (row_no + 24) // 25 AS page FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS row_no FROM {ALERTS})",
        "recent_alerts": f"SELECT id, event_type, description FROM (SELECT * FROM {ALERTS} {page} 10)",
        "recent_live_rows": f"SELECT id, line FROM (SELECT line_id AS id, line, ts AS created_at FROM {EVENT_LOG} {page} 50)",
        "recent_agent_rows": f"SELECT conv_id, turn, log_no, agent_id, message FROM {TURN_LINES} ORDER BY conv_id DESC, turn DESC, log_no DESC LIMIT 40",
        "multi_field_search": (
            f"SELECT doc_id, line_no, event_type FROM {doc_alerts} WHERE severity = 'CRITICAL' AND contains(lower(concat_ws(' ', rule_description, "
            f"CASE WHEN regexp_extract(line, '{IPV4}') = '' THEN 'UNKNOWN' ELSE regexp_extract(line, '{IPV4}') END, event_type, rule_title, line, "
            "replace(matched_keywords, '|', ' '), replace(mitre_tactics, '|', ' '), replace(mitre_techniques, '|', ' '))), 'tion')"
        ),
        "tactic_filter": f"SELECT doc_id, line_no, event_type FROM {doc_best} WHERE list_contains(string_split(mitre_tactics, '|'), 'Execution')",
        "facets_type": f"SELECT DISTINCT event_type AS value FROM {doc_best}",
        "facets_tactic": f"SELECT DISTINCT value FROM (SELECT unnest(string_split(mitre_tactics, '|')) AS value FROM {doc_best}) WHERE value <> ''",
        "tactic_breakdown": f"SELECT tactic, count(*) AS count FROM (SELECT unnest(string_split(mitre_tactics, '|')) AS tactic FROM {found}) WHERE tactic <> '' GROUP BY tactic",
        "technique_breakdown": (
            "SELECT technique, 'https://attack.mitre.org/techniques/' || replace(technique, '.', '/') AS url, count(*) AS count "
            f"FROM (SELECT unnest(string_split(mitre_techniques, '|')) AS technique FROM {found}) GROUP BY technique"
        ),
        "file_summary": f"SELECT (SELECT count(*) FROM events) AS lines_processed, count(*) AS alerts_found FROM {detected(pack, arrival=True)}",
        "retention": f"SELECT id, {stamp('created_at')} FROM {ALERTS} WHERE created_at >= {NOW} - INTERVAL 10 DAY",
        "retention_count": f"SELECT count(*) AS deleted FROM {ALERTS} WHERE created_at < {NOW} - INTERVAL 10 DAY",
        "live_feed_prune": f"SELECT id, description FROM (SELECT * FROM {ALERTS} {page} 500)",
        "live_feed": (
            "SELECT left(strftime(l.ts, '%Y-%m-%dT%H:%M:%S'), 19) AS time, 'events' AS source, f.line_id IS NOT NULL AS is_alert, f.severity, f.event_type, f.source_ip, "
            f"coalesce(f.description, l.line) AS text FROM {EVENT_LOG} l LEFT JOIN {found} f USING (line_id)"
        ),
        "recent_critical": f"SELECT {stamp('timestamp')}, source_ip, event_type, description FROM (SELECT * FROM {ALERTS} WHERE severity = 'CRITICAL' ORDER BY timestamp DESC, id DESC LIMIT 20)",
        "top_attackers": f"SELECT source_ip, count(*) AS hits FROM {ALERTS} GROUP BY source_ip ORDER BY hits DESC, source_ip NULLS FIRST LIMIT 10",
        "attacks_by_type": ranked("event_type", ALERTS),
        "last_hour_rows": f"SELECT id, event_type, source_ip, {stamp('timestamp')} FROM {ALERTS} WHERE timestamp > {NOW} - INTERVAL 1 HOUR",
        "agent_ingest": (
            "SELECT agent_id, conv_id, turn, log_no, event_type, severity, "
            f"CASE WHEN regexp_extract(message, '{IPV4}') = '' THEN hostname ELSE regexp_extract(message, '{IPV4}') END AS source_ip, message AS raw_log "
            f"FROM {pack.best(TURN_LINES, 'conv_id, turn, log_no', 'message')} JOIN {TURN_LINES} USING (conv_id, turn, log_no)"
        ),
        "agent_receipt": (
            f"SELECT conv_id, turn, coalesce(n, 0) AS logs_processed, coalesce(a, 0) AS alerts_created FROM conversations "
            f"LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM {TURN_LINES} GROUP BY ALL) USING (conv_id, turn) "
            f"LEFT JOIN (SELECT conv_id, turn, count(*) AS a FROM {pack.best(TURN_LINES, 'conv_id, turn, log_no', 'message')} GROUP BY ALL) USING (conv_id, turn)"
        ),
        "agent_registry": _registry(),
        "agent_list": f"SELECT agent_id, last_seen, json_extract_string(metadata, '$.turn') AS turn FROM ({_registry()})",
        "agent_id": "SELECT c_custkey, left(sha256(c_name || ':' || c_mktsegment), 16) AS agent_id FROM customer",
        "rule_catalogue": _catalogue(),
        "rule_load_stats": (
            "SELECT root, count(*) FILTER (k NOT IN (3, 7)) AS loaded, count(*) FILTER (k = 7) AS skipped, count(*) FILTER (k = 3) AS errors "
            "FROM (SELECT 'rules/' || lang AS root, doc_id % 10 AS k FROM documents) GROUP BY ROLLUP (root)"
        ),
        "slug": "SELECT c_custkey, trim(regexp_replace(upper('(' || c_name || ') / ' || c_mktsegment || '!'), '[^A-Z0-9]+', '_', 'g'), '_') AS slug FROM customer",
        "level_severity": (
            "SELECT event_id, severity, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END::BIGINT AS rank FROM (SELECT event_id, "
            "CASE WHEN user_id % 7 = 0 OR user_id % 6 IN (2, 5) THEN 'WARNING' WHEN user_id % 6 < 2 THEN 'CRITICAL' ELSE 'INFO' END AS severity FROM events)"
        ),
        "mitre_tags": (
            "SELECT doc_id, 'Initial Access|Impact' AS tactics, 'Initial Access|Impact|Reconnaissance' AS extended_tactics, "
            "'T' || n || '|T' || n || '.001' AS techniques FROM (SELECT doc_id, lpad((doc_id % 10000)::VARCHAR, 4, '0') AS n FROM documents)"
        ),
        "json_lists": (
            "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN '[]' ELSE '[\"' || event_type || '\",\"x\\\"y\"]' END AS stored, '[]' AS missing, "
            "CASE WHEN event_id % 5 < 2 THEN '' ELSE event_type || '|x\"y' END AS matched_keywords FROM events"
        ),
        "alert_dict": _alert_dict(pack, found),
        "notification_payload": _payload(),
        "stale_drop": "SELECT event_id FROM events WHERE event_id % 601 <= 300",
        "stream_syslog": f"SELECT 'syslog' AS source, line FROM {EVENT_LOG} WHERE contains(line, 'sshd')",
        "stream_journal_detect": f"SELECT event_type, severity, source_ip, description, raw AS raw_log FROM {detected(pack, journal_prefix)}",
        "stream_stale_drop": "SELECT event_id FROM events WHERE event_id % 601 <= 300",
        "stream_dedupe": f"SELECT DISTINCT user_id, event_type, {stamp('ts', 'event_ts')} FROM events",
        "stream_brute_force": f"SELECT event_id, ip AS source_ip, {window_count('ip', 'us', 'event_id')} AS attempts FROM {failures}",
        "stream_detect": f"SELECT event_type, severity, source_ip, description, raw AS raw_log FROM {detected(pack, live_prefix)}",
        "stream_registry": _registry(),
        "stream_agent_ingest": (
            "SELECT event_type, severity, "
            f"CASE WHEN regexp_extract(message, '{IPV4}') = '' THEN hostname ELSE regexp_extract(message, '{IPV4}') END AS source_ip, message AS raw_log "
            f"FROM {turn_best} JOIN {TURN_LINES} USING (conv_id, turn, log_no)"
        ),
        "agent_live_feed": (
            "SELECT agent_id, hostname, role AS source, l.message, b.event_type IS NOT NULL AS is_alert, b.severity, b.event_type, b.rule_description AS description "
            f"FROM {TURN_LINES} l LEFT JOIN {turn_best} b USING (conv_id, turn, log_no)"
        ),
        "stream_agent_receipts": (
            f"WITH s AS (SELECT t.*, coalesce(n, 0) AS logs_processed, coalesce(a, 0) AS alerts_created FROM {TURNS} t "
            f"LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM {TURN_LINES} GROUP BY ALL) USING (conv_id, turn) "
            f"LEFT JOIN (SELECT conv_id, turn, count(*) AS a FROM {turn_best} GROUP BY ALL) USING (conv_id, turn)) "
            "SELECT conv_id || ':' || turn AS batch, agent_id, logs_processed, alerts_created, "
            f"CAST(sum(logs_processed) OVER a AS BIGINT) AS agent_logs, {stamp('max(ts) OVER a', 'last_seen')} FROM s WINDOW a AS (PARTITION BY agent_id)"
        ),
        "live_table": (
            "SELECT l.line_id AS id, l.line AS message, f.line_id IS NOT NULL AS is_alert, f.severity, f.event_type "
            f"FROM (SELECT * FROM {EVENT_LOG} ORDER BY ts DESC, line_id DESC LIMIT 500) l LEFT JOIN {found} f USING (line_id)"
        ),
        "store_compacted": (
            "SELECT id, CASE WHEN id % 100 = 0 THEN 'EMERGENCY' ELSE severity END AS severity, source_ip, strftime(created_at, '%Y-%m-%d') AS dt "
            f"FROM {ALERTS} WHERE created_at >= {NOW} - INTERVAL 10 DAY"
        ),
        "alert_store": f"SELECT strftime(ts, '%Y-%m-%d') AS dt, severity, count(*) AS count, count(*) AS ids FROM {found} GROUP BY ALL",
        "store_retention": f"SELECT id FROM {ALERTS} WHERE created_at >= {NOW} - INTERVAL 10 DAY",
    }
    return sql


def _matched_keywords() -> str:
    tests = {"que": "contains(lower(line), 'que')", "The": "contains(lower(line), 'the')", r"th\w+tion": r"regexp_matches(line, 'th\w+tion', 'i')", "ich": "contains(lower(line), 'ich')", "ou.*eau": "regexp_matches(line, 'ou.*eau', 'i')"}
    # letters beyond ASCII count as word characters
    tests[r"th\w+tion"] = r"regexp_matches(line, 'th[\pL\pN_]+tion', 'i')"
    items = ", ".join(f"CASE WHEN {t} THEN {quote(w)} END" for w, t in tests.items())
    return (
        "SELECT doc_id, line_no, array_to_string(w, '|') AS matched_keywords, array_to_string(w[1:2], '|') AS preview "
        f"FROM (SELECT doc_id, line_no, list_filter([{items}], lambda x: x IS NOT NULL) AS w FROM {LINES}) WHERE len(w) > 0"
    )


def _stats_maps() -> str:
    def shown(key: str, body: str) -> str:
        return f"(SELECT string_agg(coalesce({key}, '') || '=' || count, ',' ORDER BY coalesce({key}, '') || '=' || count) FROM ({body}))"

    return (
        f"SELECT (SELECT count(*) FROM events) AS total_alerts, {shown('severity', ranked('severity', ALERTS))} AS by_severity, "
        f"{shown('event_type', ranked('event_type', ALERTS))} AS by_type, "
        f"{shown('source_ip', ranked('source_ip', ALERTS, 'source_ip IS NOT NULL') + ' LIMIT 10')} AS top_10_ips"
    )


def _registry() -> str:
    sizes = f"(SELECT t.*, coalesce(n, 0) AS n FROM {TURNS} t LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM {TURN_LINES} GROUP BY ALL) USING (conv_id, turn))"
    reg = "role = 'system'"
    return (
        f"SELECT agent_id, coalesce(arg_max(hostname, (ts, hostname)) FILTER ({reg}), arg_min(hostname, (ts, hostname))) AS hostname, "
        f"{stamp('min(ts)', 'first_seen')}, {stamp('max(ts)', 'last_seen')}, "
        f"coalesce(sum(n) FILTER (NOT ({reg})), 0)::BIGINT AS logs_received, "
        f"arg_max('{{\"turn\":\"' || turn || '\"}}', (ts, hostname)) FILTER ({reg}) AS metadata FROM {sizes} GROUP BY agent_id"
    )


def _catalogue() -> str:
    return (
        "SELECT 'r' || doc_id AS id, title, title AS description, CASE severity WHEN 'CRITICAL' THEN 'critical' WHEN 'WARNING' THEN 'medium' ELSE 'low' END AS level, severity, "
        "trim(regexp_replace(upper(title), '[^A-Z0-9]+', '_', 'g'), '_') AS event_type, 'Execution' AS mitre_tactics, "
        "'T' || lpad((doc_id % 10000)::VARCHAR, 4, '0') AS mitre_techniques, 'none' AS false_positives, 2::BIGINT AS keyword_count, 'keywords' AS condition "
        "FROM (SELECT doc_id, 'Rule (' || source || ') no. ' || doc_id AS title, CASE WHEN doc_id % 6 < 2 THEN 'CRITICAL' WHEN doc_id % 6 IN (2, 5) THEN 'WARNING' ELSE 'INFO' END AS severity "
        "FROM documents WHERE doc_id % 10 NOT IN (3, 7))"
    )


def _json_list(column: str) -> str:
    escaped = f"replace({column}, '\"', '\\\"')"
    return f"CASE WHEN {column} = '' THEN '[]' ELSE '[\"' || replace({escaped}, '|', '\",\"') || '\"]' END"


def _alert_dict(pack: Pack, found: str) -> str:
    notes = ", ".join(f"({quote(title)}, {quote(rule_id)}, {quote(cases)})" for title, rule_id, cases in pack.notes)
    texts = {
        "event_type": "event_type", "source_ip": "source_ip", "description": "description", "severity": "severity", "raw_log": "raw",
    }
    lists = ("matched_keywords", "false_positives", "mitre_tactics", "mitre_techniques")
    body = [f"'\"{name}\":' || to_json({column})::VARCHAR" for name, column in texts.items()]
    body.append("'\"abuse_confidence_score\":0,\"sigma_rule_id\":' || to_json(coalesce(rule_id, ''))::VARCHAR || ',\"sigma_rule_title\":' || to_json(sigma_rule_title)::VARCHAR")
    body += [f"'\"{name}\":' || {_json_list(name)}" for name in lists]
    joined = " || ',' || ".join(body)
    return (
        f"SELECT line_id, '{{\"timestamp\":\"' || strftime(event_ts, '%Y-%m-%dT%H:%M:%S') || '\",' || {joined} || '}}' AS body "
        f"FROM (SELECT f.*, rule_id, coalesce(cases, '') AS false_positives FROM {found} f LEFT JOIN (VALUES {notes}) AS v(title, rule_id, cases) ON title = sigma_rule_title AND event_type <> 'BRUTE_FORCE')"
    )


def _payload() -> str:
    raw = "repeat(raw_log, ((id % 4) * 20 + 1)::INT)"
    shown = f"CASE WHEN length({raw}) > 256 THEN left({raw}, 256) || '...' ELSE {raw} END"
    shown = f"replace({shown}, '\"', '\\\"')"
    score = (
        "CASE WHEN id % 3 > 0 THEN '{\"name\":\"Abuse Confidence Score\",\"value\":\"' || (id % 3 * 40) || '/100\",\"inline\":true},' ELSE '' END"
    )
    iso = "CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END"
    return (
        "SELECT id, '{\"embeds\":[{\"title\":\"🚨 ' || event_type || '\",\"description\":\"' || description || '\",\"color\":' "
        "|| CASE severity WHEN 'INFO' THEN 65280 WHEN 'WARNING' THEN 16776960 ELSE 16711680 END "
        "|| ',\"fields\":[{\"name\":\"Source IP\",\"value\":\"`' || coalesce(source_ip, 'UNKNOWN') || '`\",\"inline\":true},{\"name\":\"Severity\",\"value\":\"' || severity "
        "|| '\",\"inline\":true},{\"name\":\"Timestamp\",\"value\":\"' || strftime(timestamp, '%Y-%m-%d %H:%M:%S UTC') || '\",\"inline\":false},' "
        f"|| {score} || '{{\"name\":\"Raw Log\",\"value\":\"```' || {shown} || '```\",\"inline\":false}}],\"footer\":{{\"text\":\"duskwatch\"}},\"timestamp\":\"' "
        f"|| {iso} || '\"}}]}}' AS payload FROM {ALERTS}"
    )
