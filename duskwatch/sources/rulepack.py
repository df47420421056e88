"""Scan of rule directories into a DataFrame with one row per rule file."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
import yaml
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch import schemas
from duskwatch.functions import metadata

BUILTIN_RULES = Path(__file__).resolve().parent.parent / "rules"

# Fixed value: what makes a detection term count as a regular expression.
REGEX_HINT = re.compile(r"\.\*|\\d|\\w|\\s|\[\^|\(\?|\(\.\)")


def _terms(value) -> list[dict]:
    """Detection terms below a YAML value in reading order, without repeats."""
    found: dict[str, bool] = {}
    todo = [value]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            todo.extend(reversed(node.values()))
        elif isinstance(node, list):
            todo.extend(reversed(node))
        elif isinstance(node, str) and (text := node.strip()) and text not in found:
            found[text] = bool(REGEX_HINT.search(text)) and _compiles(text)
    return [{"text": text, "is_regex": is_regex} for text, is_regex in found.items()]


def _compiles(text: str) -> bool:
    try:
        re.compile(text, re.IGNORECASE)
    except re.error:
        return False
    return True


def _words(value) -> list[str] | None:
    return None if value in (None, "") else [str(v) for v in ([value] if isinstance(value, str) else value)]


def _text(value) -> str | None:
    return None if value is None else str(value)


_FILES = "root_idx int, root string, path string, content binary"
_FIELDS = "error is_mapping id title description level tags falsepositives condition groups".split()


def _yaml_fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands in each rule file, as it stands there; an absent field is null."""
    for files in batches:
        out = []
        for content in files["content"]:
            found = dict.fromkeys(_FIELDS)
            try:
                doc = yaml.safe_load(bytes(content).decode("utf-8"))
                found["is_mapping"] = isinstance(doc, dict)
                if found["is_mapping"]:
                    found |= {name: _text(doc.get(name)) for name in ("id", "title", "description", "level")}
                    found |= {"tags": [str(t) for t in doc.get("tags") or ()], "falsepositives": _words(doc.get("falsepositives"))}
                    if doc.get("detection"):
                        parts = dict(doc["detection"])
                        found["condition"] = _text(parts.pop("condition", None))
                        found["groups"] = [{"name": str(name), "terms": _terms(below)} for name, below in parts.items()]
            except Exception as exc:  # one unreadable file must not stop the scan
                found = dict.fromkeys(_FIELDS) | {"error": f"{type(exc).__name__}: {exc}"}
            out.append(found)
        read = pd.DataFrame(out, columns=_FIELDS, dtype=object)
        yield pd.concat([files[["root_idx", "root", "path"]].reset_index(drop=True), read], axis=1)


def scan_rules(spark: SparkSession, paths: list[str] | None = None, extended_tactics: bool = False) -> DataFrame:
    """One row per rule file below ``paths``, in load order (``load_idx``).

    A path is a directory, searched at any depth for ``*.yml`` and ``*.yaml``, or
    one file; without paths the rules shipped with the package are read. Paths
    that do not exist contribute nothing. Files that cannot be read as rules stay
    in the result with their ``status`` and ``reason``.
    """
    found = [_builtin_files(spark)] if paths is None else [_rule_files(spark, str(p), i) for i, p in enumerate(paths)]
    present = [f for f in found if f is not None] or [spark.createDataFrame([], _FILES)]
    files = reduce(DataFrame.unionByName, present)
    return in_load_order(parse_rule_files(files, extended_tactics))


def rules_from_text(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Rules given as YAML text by name."""
    rows = [(0, "", name, bytearray(text.encode())) for name, text in texts.items()]
    return in_load_order(parse_rule_files(spark.createDataFrame(rows, _FILES).coalesce(1)))


def in_load_order(rules: DataFrame) -> DataFrame:
    """Number the rules of a pack by path; a pack has thousands of rules at the most."""
    order = Window.orderBy("root_idx", F.split("path", "/"))
    return rules.withColumn("load_idx", F.row_number().over(order) - 1)


def parse_rule_files(files: DataFrame, extended_tactics: bool = False) -> DataFrame:
    """Rules from any table of files (root_idx, root, path, content)."""
    schema = f"root_idx int, root string, path string, {schemas.RULE_FIELDS}"
    read = files.select("root_idx", "root", "path", "content").mapInPandas(_yaml_fields, schema)
    groups = F.filter("groups", lambda g: F.size(g.terms) > 0)
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("is_mapping"), "not a mapping")
        .when(F.col("groups").isNull(), "no detection")
        .when(F.size(groups) == 0, "no terms")
    )
    status = F.when(F.col("error").isNotNull(), "error").when(reason.isNotNull(), "skipped").otherwise("loaded")
    is_rule = F.col("status") == "loaded"
    file_name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]+$", "")
    condition = F.regexp_replace(F.coalesce("condition", F.lit("keywords")), r"^\s+|\s+$", "")
    title = F.coalesce("title", file_name)
    level = F.lower(F.coalesce("level", F.lit("medium")))
    fields = {
        "rule_id": F.coalesce("id", F.lit("")),
        "title": title,
        "description": F.coalesce("description", title),
        "level": level,
        "tags": F.col("tags"),
        "false_positives": F.coalesce("falsepositives", F.array().cast("array<string>")),
        "condition": F.lower(condition),
        "groups": groups,
    }
    judged = read.withColumns({"status": status, "reason": reason})
    rules = judged.select("root_idx", "root", "path", "status", "reason", *(F.when(is_rule, c).alias(name) for name, c in fields.items()))
    severity = metadata.severity_of_level(F.col("level"))
    return rules.select(
        "root_idx",
        "root",
        "path",
        "status",
        "reason",
        "rule_id",
        "title",
        "description",
        "level",
        F.when(is_rule, severity).alias("severity"),
        F.when(is_rule, metadata.severity_rank(severity)).alias("severity_rank"),
        F.when(is_rule, metadata.event_type_slug(F.col("title"))).alias("event_type"),
        metadata.tactics_of(F.col("tags"), extended_tactics).alias("mitre_tactics"),
        metadata.techniques_of(F.col("tags")).alias("mitre_techniques"),
        "false_positives",
        "condition",
        F.aggregate("groups", F.lit(0), lambda n, g: n + F.size(g.terms)).alias("keyword_count"),
        "groups",
    )


def _rule_files(spark: SparkSession, root: str, position: int) -> DataFrame | None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return None
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if fs.getFileStatus(hadoop_path).isDirectory():
        reader = reader.option("pathGlobFilter", "*.{yml,yaml}")
    plain = F.regexp_replace("path", "^file:/+", "/")
    return reader.load(root).select(
        F.lit(position).alias("root_idx"), F.lit(root).alias("root"), plain.alias("path"), "content"
    )


def _builtin_files(spark: SparkSession) -> DataFrame:
    # read beside the package, which executors of a cluster may not see as a path
    rows = [
        (0, str(BUILTIN_RULES), str(p), bytearray(p.read_bytes()))
        for p in sorted(BUILTIN_RULES.glob("**/*.yml"))
    ]
    return spark.createDataFrame(rows, _FILES).coalesce(1)


# the parsing functions travel with the task instead of needing the package there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
