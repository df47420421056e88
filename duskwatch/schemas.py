"""Schemas of the engine's tables."""

LOG_LINES = "line_id bigint, source string, file string, line string, ingest_ts timestamp"

AGENT_BATCH = (
    "agent_id string, hostname string, timestamp string, "
    "logs array<struct<timestamp: string, hostname: string, source: string, message: string, "
    "priority: string, unit: string, raw: string>>"
)

AGENTS = (
    "agent_id string, hostname string, first_seen timestamp, last_seen timestamp, "
    "logs_received bigint, metadata string, "
    "registration struct<ts: timestamp, hostname: string, metadata: string>, "
    "first_event struct<ts: timestamp, hostname: string>"
)

JOURNAL = "MESSAGE string, PRIORITY string, _SYSTEMD_UNIT string, __REALTIME_TIMESTAMP string"

# the fields of a rule file as they stand there
RULE_FIELDS = (
    "error string, is_mapping boolean, id string, title string, description string, level string, "
    "tags array<string>, falsepositives array<string>, condition string, "
    "groups array<struct<name: string, terms: array<struct<text: string, is_regex: boolean>>>>"
)

ALERTS = (
    "id bigint, timestamp timestamp, event_type string, severity string, source_ip string, "
    "description string, raw_log string, matched_keywords array<string>, "
    "false_positives array<string>, mitre_tactics array<string>, mitre_techniques array<string>, "
    "sigma_rule_id string, sigma_rule_title string, created_at timestamp"
)
JSON_COLUMNS = ["matched_keywords", "false_positives", "mitre_tactics", "mitre_techniques"]

LIVE_LOGS = (
    "id bigint, timestamp timestamp, source string, message string, is_alert boolean, "
    "severity string, event_type string, description string, source_ip string, created_at timestamp"
)

AGENT_FEED = (
    "id bigint, timestamp string, hostname string, source string, message string, agent_id string, is_alert boolean, "
    "severity string, event_type string, description string, created_at timestamp"
)
RECEIPTS = "id bigint, agent_id string, sent string, logs_processed bigint, alerts_created bigint, created_at timestamp"
REGISTRY_EVENTS = (
    "id bigint, agent_id string, hostname string, ts timestamp, registered boolean, metadata string, n bigint, created_at timestamp"
)
