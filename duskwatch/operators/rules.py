"""Evaluation of a rule pack over log lines with built-in expressions.

A pack is compiled once on the driver into numbered terms. For every line one
array of term numbers is computed (see ``termscan``); rules, groups and
conditions are then decided on those few numbers, so that neither the plan nor
the work per line grows with the number of rules. Nothing is shuffled and no
row is multiplied before its matches are known.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.metadata import SEVERITY_RANK, SEVERITY_TO_LEVEL, lookup
from duskwatch.functions.text import fold
from duskwatch.operators import termscan

MATCH = "struct<rule_idx: int, rank: int, matched_keywords: array<string>>"
RULE_FIELDS = (
    "struct<rule_id: string, rule_title: string, description: string, severity: string, "
    "event_type: string, mitre_tactics: array<string>, mitre_techniques: array<string>, "
    "false_positives: array<string>>"
)
_META = [
    "rule_id",
    "rule_title",
    "description",
    "severity",
    "event_type",
    "mitre_tactics",
    "mitre_techniques",
    "false_positives",
]


def condition_alternatives(condition: str, groups: list[str]) -> list[list[tuple[int, bool]]]:
    """Alternatives in order; each lists the groups that must hit, and whether wholly.

    The first alternative whose groups all hit decides the match, and its groups'
    hits, one after the other, are the matched keywords. An empty result means
    that the condition can never be met.
    """
    everything = range(len(groups))
    if re.match(r"^1\s+of\s+them$", condition):
        return [[(g, False)] for g in everything]
    if re.match(r"^all\s+of\s+them$", condition):
        return [[(g, False) for g in everything]]
    if wild := re.match(r"^(1|all)\s+of\s+(\w+)\*?$", condition):
        chosen = [(g, False) for g in everything if groups[g].startswith(wild[2])]
        if wild[1] == "1":
            return [[c] for c in chosen]
        return [chosen] if chosen else []
    if " and " in condition:
        needed = [_named_group(part, groups) for part in condition.split(" and ")]
        return [needed] if all(needed) else []
    options = [_named_group(part, groups) for part in condition.split(" or ")]
    return [[o] for o in options if o]


def _named_group(part: str, groups: list[str]) -> tuple[int, bool] | None:
    name, *modifiers = (p.strip() for p in part.strip().split("|"))
    if name in groups:
        found = groups.index(name)
    else:
        found = next((g for g, known in enumerate(groups) if known.startswith(name)), None)
    return None if found is None else (found, modifiers[:1] == ["all"])


@dataclass
class CompiledPack:
    """Numbered terms and decided conditions of a rule pack."""

    rules: list[dict] = field(default_factory=list)
    unsupported: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    rule_of: list[int] = field(default_factory=list)
    regexes: dict[int, str] = field(default_factory=dict)
    anchors: dict[str, dict] = field(default_factory=dict)
    unanchored: list[int] = field(default_factory=list)
    # expressions of this pack, built once and used by every query or micro-batch
    columns: dict = field(default_factory=dict, repr=False)


def compile_pack(rules: DataFrame) -> CompiledPack:
    """Compile the loaded rows of a rule scan. Runs on the driver, on configuration."""
    rows = rules.where("status = 'loaded'").orderBy("load_idx").collect()
    compiles = _java_compiles(rules.sparkSession)
    pack = CompiledPack()
    keys: dict[str, dict] = {}
    for row in rows:
        rule = row.asDict(recursive=True)
        spans = []
        for group in rule["groups"]:
            start = len(pack.texts)
            for term in group["terms"]:
                _add_term(pack, keys, term, compiles)
                pack.rule_of.append(len(pack.rules))
            spans.append((start, len(pack.texts)))
        alternatives = condition_alternatives(rule["condition"], [g["name"] for g in rule["groups"]])
        if not alternatives:
            pack.unsupported.append(rule["title"])
        pack.rules.append(
            {
                "rule_id": rule["rule_id"],
                "rule_title": rule["title"],
                **{k: rule[k] for k in _META[2:]},
                "rank": SEVERITY_RANK.get(rule["severity"], 0),
                "alts": [
                    [{"lo": spans[g][0], "hi": spans[g][1], "whole": whole} for g, whole in alt]
                    for alt in alternatives
                ],
            }
        )
    _close_over_prefixes(keys)
    pack.anchors = keys
    return pack


def _add_term(pack: CompiledPack, keys: dict[str, dict], term: dict, compiles) -> None:
    number = len(pack.texts)
    text = term["text"]
    pack.texts.append(text)
    folded = termscan.fold_term(text)
    if term["is_regex"] and compiles(termscan.search_pattern(text)):
        pack.regexes[number] = termscan.search_pattern(text)
        factors = termscan.required_factors(text)
        for factor in factors or []:
            keys.setdefault(factor, {"lit": [], "rx": []})["rx"].append(number)
        if not factors:
            pack.unanchored.append(number)
    elif folded is not None:
        keys.setdefault(folded, {"lit": [], "rx": []})["lit"].append(number)
    else:
        pack.regexes[number] = "(?iu)" + r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"
        pack.unanchored.append(number)


def _close_over_prefixes(keys: dict[str, dict]) -> None:
    own = {k: {kind: list(v[kind]) for kind in v} for k, v in keys.items()}
    for key, value in keys.items():
        for size in range(1, len(key)):
            if shorter := own.get(key[:size]):
                value["lit"] += shorter["lit"]
                value["rx"] += shorter["rx"]


def _java_compiles(spark):
    def check(pattern: str) -> bool:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception:
            return False
        return True

    return check


def _constant(value, ddl: str) -> Column:
    """A literal of a nested type; the optimizer folds it into one value."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {ddl}")["v"]


def with_matches(df: DataFrame, pack: CompiledPack, line: str = "line", out: str = "matches") -> DataFrame:
    """Add the matching rules of ``line`` in load order, with their keywords."""
    if not pack.texts:
        return df.withColumn(out, F.array().cast(f"array<{MATCH}>"))
    if line not in pack.columns:
        pack.columns[line] = _matching(F.col(line), pack)
    entries, likely, hits, decided = pack.columns[line]
    staged = df.withColumn("_entries", entries).withColumn("_likely", likely).withColumn("_hits", hits)
    return staged.select(*df.columns, decided.alias(out))


def _matching(text: Column, pack: CompiledPack) -> tuple[Column, Column, Column, Column]:
    """The steps of matching; each is used several times by the next and so is a column."""
    found = F.array().cast("array<string>")
    if pack.anchors:
        pattern = termscan.tree_pattern(sorted(pack.anchors))
        found = F.array_distinct(F.regexp_extract_all(fold(text), F.lit(pattern), F.lit(1)))
    return (
        _entries(found, pack),
        _likely(F.col("_entries")),
        _hits(text, F.col("_entries"), F.col("_likely"), pack),
        _decide(F.col("_hits"), pack),
    )


def _entries(found: Column, pack: CompiledPack) -> Column:
    """Term numbers behind every found text: sure ones, and regexes to try."""
    # two levels of lookup, because map access reads its keys one after the other
    table: dict[str, dict] = {}
    for key, value in pack.anchors.items():
        table.setdefault(key[:2], {})[key] = value
    lookup = _constant(table, "map<string, map<string, struct<lit: array<int>, rx: array<int>>>>")
    return F.transform(found, lambda t: F.element_at(F.element_at(lookup, F.substring(t, 1, 2)), t))


def _likely(entries: Column) -> Column:
    """Numbers of regex terms one of whose required literals occurs in the line."""
    return F.flatten(F.transform(entries, lambda e: e["rx"]))


def _hits(line: Column, entries: Column, likely: Column, pack: CompiledPack) -> Column:
    """Sorted numbers of all terms that occur in the line."""
    parts = [F.flatten(F.transform(entries, lambda e: e["lit"]))]
    always = set(pack.unanchored)
    guarded = [n for n in pack.regexes if n not in always]
    if guarded:
        tried = [F.when(F.array_contains(likely, n) & line.rlike(pack.regexes[n]), n) for n in guarded]
        none = F.array().cast("array<int>")
        parts.append(F.when(F.size(likely) > 0, F.array_compact(F.array(*tried))).otherwise(none))
    if always:
        tried = [F.when(line.rlike(pack.regexes[n]), n) for n in pack.unanchored]
        parts.append(F.array_compact(F.array(*tried)))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _decide(hits: Column, pack: CompiledPack) -> Column:
    """Rules whose condition the hits meet. Only rules with a hit are looked at."""
    rule_of = _constant(pack.rule_of, "array<int>")
    texts = _constant(pack.texts, "array<string>")
    plans = _constant(
        [{"rank": r["rank"], "alts": r["alts"]} for r in pack.rules],
        "array<struct<rank: int, alts: array<array<struct<lo: int, hi: int, whole: boolean>>>>>",
    )

    def within(group: Column) -> Column:
        return F.filter(hits, lambda n: (n >= group["lo"]) & (n < group["hi"]))

    def met(group: Column) -> Column:
        count = F.size(within(group))
        return F.when(group["whole"], count == group["hi"] - group["lo"]).otherwise(count > 0)

    def judge(rule: Column) -> Column:
        alternatives = F.filter(plans[rule]["alts"], lambda alt: F.forall(alt, met))
        return F.struct(
            rule.alias("rule_idx"), plans[rule]["rank"].alias("rank"), F.get(alternatives, F.lit(0)).alias("alt")
        )

    touched = F.array_distinct(F.transform(hits, lambda n: rule_of[n]))
    matched = F.filter(F.transform(touched, judge), lambda m: m["alt"].isNotNull())
    return F.transform(
        matched,
        lambda m: F.struct(
            m["rule_idx"].alias("rule_idx"),
            m["rank"].alias("rank"),
            F.flatten(
                F.transform(m["alt"], lambda g: F.transform(within(g), lambda n: texts[n]))
            ).alias("matched_keywords"),
        ),
    )


def best_of(matches: Column) -> Column:
    """Match of the highest severity; the rule loaded first wins a tie."""
    return F.aggregate(
        matches,
        F.lit(None).cast(MATCH),
        lambda best, m: F.when(best.isNull() | (m["rank"] > best["rank"]), m).otherwise(best),
    )


def rule_fields(rule_idx: Column, pack: CompiledPack) -> Column:
    """Struct of a rule's metadata, carried in the plan like the pack itself."""
    return _constant([{k: r[k] for k in _META} for r in pack.rules], f"array<{RULE_FIELDS}>")[rule_idx]


def _flat(df: DataFrame, match: str, pack: CompiledPack) -> DataFrame:
    described = df.withColumn("_rule", rule_fields(F.col(match)["rule_idx"], pack))
    return described.select(
        *(c for c in df.columns if c != match),
        F.col(match)["rule_idx"].alias("rule_idx"),
        *(F.col("_rule")[k].alias(k) for k in _META),
        F.col(match)["matched_keywords"].alias("matched_keywords"),
    )


def match_all(df: DataFrame, pack: CompiledPack, line: str = "line") -> DataFrame:
    """One row per line and matching rule. Lines without a match vanish."""
    matched = with_matches(df, pack, line, "_matches")
    return _flat(_exploded(matched, F.col("_matches")), "_match", pack)


def match_best(df: DataFrame, pack: CompiledPack, line: str = "line", keep_unmatched: bool = False) -> DataFrame:
    """One row per line with its best rule; others vanish or keep null rule fields."""
    matched = with_matches(df, pack, line, "_matches")
    return _flat(_exploded(matched, F.array(best_of(F.col("_matches"))), keep_unmatched), "_match", pack)


def _exploded(matched: DataFrame, matches: Column, keep_unmatched: bool = False) -> DataFrame:
    # an inner explode, or a filter on a column, would be turned into a filter
    # below the matching that does all of it once more
    kept = (c for c in matched.columns if c != "_matches")
    rows = matched.select(*kept, F.explode_outer(matches).alias("_match"))
    return rows if keep_unmatched else rows.where(F.col("_match").isNotNull())


def catalogue(rules: DataFrame) -> DataFrame:
    """Metadata of the loaded rules, with the level shown for their severity."""
    return rules.where("status = 'loaded'").select(
        F.col("rule_id").alias("id"),
        "title",
        "description",
        F.coalesce(lookup(SEVERITY_TO_LEVEL, F.col("severity")), F.lit("medium")).alias("level"),
        "severity",
        "event_type",
        "mitre_tactics",
        "mitre_techniques",
        "false_positives",
        "keyword_count",
        "condition",
    )


def load_stats(rules: DataFrame) -> DataFrame:
    """Loaded, skipped and failed files per scanned path, and their total (null path)."""
    counted = {"loaded": "loaded", "skipped": "skipped", "errors": "error"}
    return rules.rollup("root").agg(
        *(F.count_if(F.col("status") == status).alias(name) for name, status in counted.items())
    )
