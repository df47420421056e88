"""Spelling variants, line resampling and cell links against brute force, over odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.llm import cells, classes, resample, spelling

BIG = 1 << 60
SCHEMA = "doc_id long, text string, word string, row long, n long, line string, key string, rank long"


def odd_docs(seed=5):
    rng = random.Random(seed)
    words = ["Reading", "readinG", "raeding", "readng", "élégance", "elegance", "straßen", "naïvely", "x×÷zzzzz", "it's", "42nd", "日本語", "a", "zzzzzzz"] + [
        "".join(rng.choice("abe") for _ in range(rng.randint(6, 9))) for _ in range(40)
    ]
    page = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(n))
    docs = [(i, page(rng.randint(1, 12))) for i in range(60)] + [(i, "same line of reading\nand another, elegance\n\n same line of reading") for i in range(60, 90)]
    docs += [(None, page(9)), (None, None), (BIG + 1, page(9)), (BIG + 3, page(9)), (91, None), (92, ""), (93, "\n\n \x00"), (94, "q" * 40000 + " " + "readings " * 3000), (60, docs[60][1])]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "w", 1, 2, "l", "k", 3) for i, t in odd_docs()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def spelled(rows, every):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if every and h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, form = set(), {}
    around = {w: [x for x in words if near(w, x)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("block", [4, 32768])
def test_spelling_variants_equal_comparison_one_by_one(docs, nothing, monkeypatch, block):
    # small blocks: halves that fill several of them, and blocks that many words ask
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "ASKING", 3 * block)
    got = spelling.variants(docs, delete_every=3).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == spelled(odd_docs(), 3)
    assert len(got) == len({r.word for r in got}) and any(r.form for r in got)
    assert spelling.variants(nothing).count() == 0


def test_roots_follow_forms_to_the_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("v", "w3")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {f"w{i}": "w11" for i in range(11)} | {"v": "w11"}


@pytest.mark.parametrize("letters", ["ab", "abcdé"])
def test_fm_index_finds_each_near_word_once(letters):
    rng = random.Random(letters)
    for _ in range(8):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(120)})
        asked = [*words, "zzz", letters[0] * 9]
        fm = spelling.Index(words)
        for exact in (lambda w: len(w) // 2, lambda w: len(w)):  # the second: an error anywhere
            q, f = fm.near(asked, np.array([exact(w) for w in asked]))
            got = [(asked[i], words[j]) for i, j in zip(q, f, strict=True) if asked[i] != words[j]]
            assert len(got) == len(set(got))
            want = {(a, b) for a in asked for b in words if near(a, b) and (b.endswith(a[exact(a) :]) and near(a[: exact(a)], b[: len(b) - len(a) + exact(a)]))}
            assert set(got) == want


def features(text, max_n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def resampled(rows, target, max_n, buckets, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, max_n)[1]))
    for text in target:
        t.update(map(bucket, features(text, max_n)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out, open_ = [], []
    for i, text in rows:
        words, found = features(text, max_n)
        weight = sum(gain(bucket(g)) for g in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if words >= 20:
            open_.append(out[-1])
    ranked = sorted(open_, key=lambda r: (-r[3], r[0] is None, r[0]))[: percent * len(open_) // 100]
    rank = Counter()
    drawn = Counter((*r, n + 1) for n, r in enumerate(ranked))
    rank.update(drawn)
    rank.update((*r, None) for r in (Counter(out) - Counter(ranked)).elements())
    return rank


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_equals_counting_text_by_text(spark, docs, nothing, max_n):
    target = ["same line of the élégance", None, "", "reading reading elegance\nreading"]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, row long")
    got = Counter(tuple(r) for r in resample.resample(docs, aim, max_n=max_n, buckets=97, percent=30).collect())
    assert got == resampled(odd_docs(), target, max_n, 97, 30)
    assert resample.resample(nothing, aim, max_n=max_n).count() == 0
    assert resample.resample(docs, nothing, max_n=max_n).count() == len(odd_docs())


def test_classes_of_a_large_share_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(classes, "SHARE", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 14}") for i in range(200)], "i long, key string")
    sizes = rows.where("key <> 'k2'").groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    joined = classes.join_classes(rows, sizes, "key", "size", 200)
    assert joined.count() == rows.where("key <> 'k2'").count() and {r.key for r in joined.collect()} >= {"hot", "k4"}


def vectors(seed=3, groups=40):
    rng = np.random.default_rng(seed)
    out, at = [], 0
    for _ in range(groups):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            out.append((at, (centre + rng.normal(size=16) * rng.choice([0.01, 0.12, 0.3])).tolist()))
            at += 1
    # chains of neighbours, a hot vector, copies of other lengths, what takes no part
    base, step = rng.normal(size=16), rng.normal(size=16) * 0.15
    out += [(1000 + i, (base + i * step).tolist()) for i in range(12)]
    out += [(2000 + i, [1.0] * 16) for i in range(60)] + [(2100, [2.0] * 16), (2101, [1e200] * 16), (2102, [-0.0] * 15 + [1.0]), (2103, [0.0] * 15 + [1.0])]
    out += [(3000, [1.0, 0.0]), (3001, [1.0, 0.1]), (3002, [1.0] * 3)]
    out += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [None] + [1.0] * 15), (4004, [math.nan] * 16), (4005, [math.inf] + [1.0] * 15)]
    out += [(None, [1.0] * 16), (None, None), (BIG + 1, base.tolist()), (BIG + 3, base.tolist()), (2000, [1.0] * 16)]
    return out


def linked(rows, threshold):
    def fine(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [np.array(v) / max(map(abs, v)) if fine(v) else None for _, v in rows]
    units = [u / np.sqrt((u * u).sum()) if u is not None else None for u in units]
    links = [[j for j, w in enumerate(units) if j != i and u is not None and w is not None and len(u) == len(w) and float(u @ w) >= threshold] for i, u in enumerate(units)]
    out = Counter()
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out[rows[i][0], len(links[i]), root, rows[i][0] is not None and rows[i][0] == root] += 1
    return out


@pytest.mark.parametrize(("cell", "block", "sure"), [(8, 16384, None), (8, 5, None), (10**6, 7, None), (8, 6, cells.SURE)])
def test_links_equal_comparison_of_all_vectors(spark, monkeypatch, cell, block, sure):
    monkeypatch.setattr(cells, "CELL", cell)
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "TILE", 4)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row long, n long").repartition(3)
    got = cells.link(df, 0.95, sure)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = Counter(tuple(r) for r in got.collect())
    want = linked(rows, 0.95)
    if sure is None:
        assert found == want
    else:  # cells of eight vectors; none are linked that should not be
        assert sum(n * r[1] for r, n in found.items()) >= 0.99 * sum(n * r[1] for r, n in want.items())
    assert cells.link(df.limit(0)).count() == 0
    assert {r.n_links for r in cells.link(df.where("vec_id >= 4000 AND vec_id < 5000")).collect()} == {0}


def test_recall_of_cells_on_near_copies(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 32)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(900, 64))
    noise = rng.normal(size=(3, 900, 64)) * np.array([0.05, 0.1, 0.2])[:, None, None]
    x = (centres[None] + noise).reshape(-1, 64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = int((u @ u.T >= 0.95).sum()) - len(x)
    found = cells.link(df).agg(F.sum("n_links")).first()[0]
    assert 0.99 * want <= found <= want
