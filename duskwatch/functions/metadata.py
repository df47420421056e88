"""Severity, event-type and ATT&CK metadata as Column functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule level to severity, severity order, level shown per severity.
LEVEL_TO_SEVERITY = {
    "critical": "CRITICAL",
    "high": "CRITICAL",
    "medium": "WARNING",
    "low": "INFO",
    "informational": "INFO",
}
SEVERITY_RANK = {"CRITICAL": 3, "WARNING": 2, "INFO": 1}
SEVERITY_TO_LEVEL = {"CRITICAL": "critical", "WARNING": "medium", "INFO": "low"}

# ATT&CK tactic slugs and their display names.
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
EXTENDED_TACTICS = {
    **TACTICS,
    "reconnaissance": "Reconnaissance",
    "resource_development": "Resource Development",
}


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a small fixed table; null when absent."""
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.element_at(pairs, key)


def event_type_slug(title: Column) -> Column:
    """Upper-case title with every run of other characters as one underscore."""
    return F.regexp_replace(
        F.regexp_replace(F.upper(title), "[^A-Z0-9]+", "_"), "^_+|_+$", ""
    )


def severity_of_level(level: Column) -> Column:
    """Severity for a rule level; WARNING for levels that are unknown or missing."""
    return F.coalesce(lookup(LEVEL_TO_SEVERITY, F.lower(level)), F.lit("WARNING"))


def severity_rank(severity: Column) -> Column:
    """CRITICAL 3, WARNING 2, INFO 1, anything else 0."""
    return F.coalesce(lookup(SEVERITY_RANK, severity), F.lit(0))


def _tag_names(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.regexp_replace(F.lower(t), r"^[^.]*\.", ""))


def tactics_of(tags: Column, extended: bool = False) -> Column:
    """Display names of the tactic tags, in tag order; unknown tags vanish."""
    table = EXTENDED_TACTICS if extended else TACTICS
    names = F.transform(_tag_names(tags), lambda n: lookup(table, n))
    return F.coalesce(F.filter(names, lambda n: n.isNotNull()), F.array().cast("array<string>"))


def techniques_of(tags: Column) -> Column:
    """Upper-case technique numbers among the tags, in tag order."""
    numbers = F.filter(_tag_names(tags), lambda n: n.rlike(r"^t\d{4}(\.\d{3})?$"))
    return F.coalesce(F.transform(numbers, F.upper), F.array().cast("array<string>"))
