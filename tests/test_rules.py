import random
import re

import pytest
from pyspark.sql import functions as F

from duskwatch.functions import text
from duskwatch.operators import rules, termscan
from duskwatch.sources.rulepack import REGEX_HINT, rules_from_text, scan_rules


def rule(condition="keywords", level="high", **groups):
    import yaml

    body = {"title": "T", "level": level, "detection": {**groups, "condition": condition}}
    return yaml.safe_dump(body, sort_keys=False)


def lines_df(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "i int, line string")


def test_golden_lines(spark, golden, pack):
    df = lines_df(spark, [line for line, _ in golden])
    best = {r.i: r for r in rules.match_best(df, pack).collect()}
    wrong = [(line, want, best.get(i) and best[i].rule_title) for i, (line, want) in enumerate(golden) if i not in best or want.lower() not in best[i].rule_title.lower()]
    assert not wrong


def test_benign_lines(spark, pack):
    lines = ["CRON[1234]: (root) CMD (/usr/bin/backup.sh)", "apt-get: Updating package lists from http://archive.ubuntu.com", "", "   \t  "]
    assert rules.match_all(lines_df(spark, lines), pack).count() == 0


@pytest.mark.parametrize(
    "condition, groups, line, want",
    [
        ("keywords", {"keywords": ["alpha_unique", "beta_unique"]}, "log line with beta_unique", ["beta_unique"]),
        ("keywords | all", {"keywords": ["alpha_unique", "beta_unique"]}, "alpha_unique and beta_unique present", ["alpha_unique", "beta_unique"]),
        ("keywords | all", {"keywords": ["alpha_unique", "beta_unique"]}, "only alpha_unique present", None),
        ("keywords", {"keywords": ["select.*from.*where"]}, "GET /api?q=select id from users where 1=1", ["select.*from.*where"]),
        ("1 of them", {"g1": ["x"], "g2": ["y"]}, "x y", ["x"]),
        ("all of them", {"g1": ["x"], "g2": ["y"]}, "x", None),
        ("all of them", {"g1": ["x"], "g2": ["y"]}, "x y", ["x", "y"]),
        ("1 of sel*", {"sel_a": ["x"], "sel_b": ["y"]}, "y", ["y"]),
        ("1 of sel", {"sel_a": ["x"], "sel_b": ["y"]}, "y", ["y"]),
        ("all of sel*", {"sel_a": ["x"], "sel_b": ["y"], "o": ["z"]}, "y x", ["x", "y"]),
        ("all of nope*", {"g1": ["x"]}, "x", None),
        ("g1 and g2", {"g1": ["x"], "g2": ["y"]}, "x y", ["x", "y"]),
        ("g1 and g1", {"g1": ["x"], "g2": ["y"]}, "x y", ["x", "x"]),
        ("g1 and g2", {"g1": ["x"], "g2": ["y"]}, "y", None),
        ("g1 or g2", {"g1": ["x"], "g2": ["y"]}, "x y", ["x"]),
        ("g1 or g2", {"g1": ["x"], "g2": ["y"]}, "y", ["y"]),
        ("g1 or nope", {"g1": ["x"], "g2": ["y"]}, "y", None),
        ("g1 and g2 or g3", {"g1": ["x"], "g2": ["y"], "g3": ["z"]}, "x y z", None),
        ("g1 and not g2", {"g1": ["x"], "g2": ["y"]}, "x", None),
        ("sel", {"sel_a": ["x"], "sel_b": ["y"]}, "x y", ["x"]),
        ("G1", {"G1": ["x"]}, "x", None),
        ("", {"g1": ["x"], "g2": ["y"]}, "x y", ["x"]),
        ("g1|all or g2", {"g1": ["x", "q"], "g2": ["y"]}, "x y", ["y"]),
    ],
)
def test_conditions(spark, condition, groups, line, want):
    compiled = rules.compile_pack(rules_from_text(spark, {"r.yml": rule(condition, **groups)}))
    found = rules.match_all(lines_df(spark, [line]), compiled).collect()
    assert [r.matched_keywords for r in found] == ([] if want is None else [want])


def test_best_is_highest_severity_then_first_loaded(spark):
    texts = {
        "a.yml": rule(level="medium", keywords=["x"]),
        "b.yml": rule(level="high", keywords=["x", "x", " x "]),
        "c.yml": rule(level="critical", keywords=["x"]),
    }
    compiled = rules.compile_pack(rules_from_text(spark, texts))
    df = lines_df(spark, ["x", "n"])
    assert [r.rule_idx for r in rules.match_best(df, compiled).collect()] == [1]
    assert [r.rule_idx for r in rules.match_all(df, compiled).collect()] == [0, 1, 2]
    kept = rules.match_best(df, compiled, keep_unmatched=True).orderBy("i").collect()
    assert [r.rule_idx for r in kept] == [1, None]


def test_terms_like_a_sequential_search(spark):
    """Random overlapping terms and lines, against one regex search per term."""
    rng = random.Random(7)
    letters = "abcsikAB .-_/é|$("
    literals = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(150)]
    patterns = ["a.*b", r"\d+a", r"s\.*k", "ab.*|.*ba", r"[^a]b\w", "(?:ab|cd).*e", r"k.*\.s", "a.*(", r"\bki\b.*", r"c.*$", r"b.*\|"]
    terms = [t for t in dict.fromkeys(t.strip() for t in literals + patterns) if t]
    lines = ["".join(rng.choice(letters + "İıſKK0\n") for _ in range(rng.randint(0, 25))) for _ in range(400)]

    def python_hits(line):
        hits = []
        for t in terms:
            try:
                p = re.compile(t if REGEX_HINT.search(t) else re.escape(t), re.I)
            except re.error:
                p = re.compile(re.escape(t), re.I)
            if p.search(line):
                hits.append(t)
        return hits

    compiled = rules.compile_pack(rules_from_text(spark, {"r.yml": rule(keywords=terms)}))
    got = {r.i: r.matched_keywords for r in rules.match_all(lines_df(spark, lines), compiled).collect()}
    for i, line in enumerate(lines):
        assert got.get(i, []) == python_hits(line), (line,)


def test_plan_searches_once_and_does_not_grow_with_rules(spark, pack):
    df = lines_df(spark, ["x"])
    plan = rules.match_best(df, pack)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    plan = rules.match_all(df, pack)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_large_pack(spark):
    rng = random.Random(3)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for _ in range(3000)})
    texts = {f"{i:03}.yml": rule(keywords=words[i::60]) for i in range(60)}
    compiled = rules.compile_pack(rules_from_text(spark, texts))
    lines = [" ".join(rng.sample(words, 3)) for _ in range(200)]
    got = {}
    for r in rules.match_all(lines_df(spark, lines), compiled).collect():
        got.setdefault(r.i, set()).update(r.matched_keywords)
    for i, line in enumerate(lines):
        assert got[i] == {w for w in words if w in line}


def test_rule_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.yml").write_text("title: B b!\nlevel: LOW\ndetection: {keywords: [x, {f: [y, 3]}, 'z.*(']}\nfalsepositives: one\n")
    (tmp_path / "a.yaml").write_text("detection: {s: {field: v}, condition: S }\n")
    (tmp_path / "sub" / "c.yml").write_text("title: [")
    (tmp_path / "d.yml").write_text("title: no detection")
    (tmp_path / "e.yml").write_text("- a list")
    (tmp_path / "f.txt").write_text("title: ignored")
    scanned = scan_rules(spark, [str(tmp_path), str(tmp_path / "missing"), str(tmp_path / "b.yml")])
    rows = scanned.orderBy("load_idx").collect()
    assert [(r.path.rsplit("/", 1)[1], r.status) for r in rows] == [
        ("a.yaml", "loaded"), ("b.yml", "loaded"), ("d.yml", "skipped"), ("e.yml", "skipped"), ("c.yml", "error"), ("b.yml", "loaded"),
    ]
    a, b = rows[0], rows[1]
    assert (a.title, a.description, a.severity, a.condition, a.rule_id) == ("a", "a", "WARNING", "s", "")
    assert (b.event_type, b.severity, b.false_positives, b.keyword_count) == ("B_B", "INFO", ["one"], 3)
    assert [(t.text, t.is_regex) for t in b.groups[0].terms] == [("x", False), ("y", False), ("z.*(", False)]
    totals = {r.root: (r.loaded, r.skipped, r.errors) for r in rules.load_stats(scanned).collect()}
    assert totals == {str(tmp_path): (2, 2, 1), str(tmp_path / "b.yml"): (1, 0, 0), None: (3, 2, 1)}
    assert {r.title: r.level for r in rules.catalogue(scanned).collect()} == {"a": "medium", "B b!": "low"}


def test_required_factors_hold():
    for pattern, text in [("python.*socket", "PYTHON a socket"), ("(ab|cd)+x", "cdx"), ("a?bcd", "bcd"), (r"x{2,}yz", "xxxyz"), ("(?i:ab)q", "ABq")]:
        factors = termscan.required_factors(pattern)
        assert factors is None or any(f in text.lower() for f in factors)


def test_builtin_pack(spark, pack):
    assert len(pack.rules) == 60 and not pack.unsupported
    assert all(r["event_type"] for r in pack.rules)
    scanned = scan_rules(spark)
    assert scanned.where("status <> 'loaded'").count() == 0
    assert scanned.where(F.size("mitre_techniques") == 0).count() == 0


def test_tree_pattern_finds_the_longest_term_and_gives_up_early():
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(3)
    terms = sorted({"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 6]))) for _ in range(60)} | {"$(x", "a.b", "[]", "zz", "zzz"})
    pattern = re.compile(termscan.tree_pattern(terms))
    for _ in range(300):
        line = "".join(rng.choices(letters + "$(.[] ", k=40)) + rng.choice(terms)
        want = [max(t for t in terms if line.startswith(t, i)) for i in range(len(line)) if any(line.startswith(t, i) for t in terms)]
        assert [m.group(1) for m in pattern.finditer(line)] == want
    # terms of common first letters are ruled out by the letters after them
    pairs = termscan.tree_pattern([c + "qx" for c in letters])
    assert "][q][x])" in pairs


def test_present_text_is_what_stripping_leaves(spark):
    lines = ["", " ", "\t\u2003\x1f\u3000", "a", "  b ", "\x00", "\u200b", None]
    rows = lines_df(spark, lines).select(text.is_present(F.col("line")).alias("a"), (F.length(text.strip(F.col("line"))) > 0).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [False, False, False, True, True, True, True, None]
