"""Operators against brute force, over odd input: nulls, empty and long texts, ties, repeated rows, clashing names, empty tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duskwatch.llm import bpe, chat, cotrain, graphann, jaccard, katz, latent, sharding, substring, tokenfile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, _text string, tile long"


def odd_docs():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "É", "naïve,", "x y", "42"]
    base = [rng.choice(words) for _ in range(90)]
    docs = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:88] + ["new"])), (4, "\n".join(rng.choice(words) for _ in range(70)))]
    docs += [(5, None), (None, "  two  words \n"), (6, ""), (6, "short"), (7, "a b"), (7, "a b"), (8, " ".join(rng.choice(words) for _ in range(5000)))]
    docs += [(9, " ".join([rng.choice(words) for _ in range(30)] + base[:50])), (10, "it's  <|endoftext|> 's\t\n x" + "y" * 3000)]
    return [(i, t, None if i == 3 else "en", "s", None if t is None else len(t), "k", "clash", 1) for i, t in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(docs, nothing):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN).collect())
    want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in odd_docs())
    assert got == want
    assert bpe.encode_decode(nothing, ranks, public_tokenizers.PATTERN).count() == 0


def test_token_files_hold_all_ids_in_order(docs, nothing):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    library = Tokenizer.from_str(vocabulary)
    library.encode_special_tokens = True
    got = sorted(tokenfile.read_tokens(tokenfile.write_tokens(docs, vocabulary, 2)).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got] == [True] + [False] * (len(got) - 1)
    assert [r.doc_id for r in got[1:]] == sorted(i for i, *_ in odd_docs() if i is not None)
    coded = [library.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in odd_docs()]
    assert Counter((r.n_tokens, r.ids_crc32) for r in got) == Counter((len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for c in coded)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
    assert tokenfile.read_tokens(tokenfile.write_tokens(nothing, vocabulary, 2)).count() == 0


def test_shards_are_exact_and_gapless(spark, docs, nothing):
    rows = sharding.shard(spark.range(1003).repartition(7), 10, block_rows=20).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(len(s) for s in slots.values()) == [100] * 7 + [101] * 3
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r.id for r in rows) == list(range(1003))
    assert sharding.shard(docs, 4).count() == docs.count()
    assert sharding.shard(nothing, 4).count() == 0


def test_communication_matrix_keeps_its_sums():
    m = sharding.matrix([5, 0, 17, 8], [10, 10, 10], np.random.default_rng(1))
    assert m.sum(1).tolist() == [5, 0, 17, 8] and m.sum(0).tolist() == [10, 10, 10]


def test_perspectives_are_rendered_in_order(spark):
    turns = [(1, 0, "a", "hi"), (1, 1, "b", None), (1, 2000, "a", "bye"), (1, None, None, "first"), (None, 0, "a", "lost"), (2, 0, "a", "x"), (2, 0, "a", "x")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, segment string")
    out = defaultdict(list)
    for r in chat.rotate(df).orderBy("position").collect():
        assert r.start == sum(len(x.segment) for x in out[r.conv_id, r.perspective])
        out[r.conv_id, r.perspective].append(r)
    assert set(out) == {(1, "a"), (1, "b"), (1, "unknown"), (2, "a")}
    assert [r.speaker for r in out[1, "a"]] == ["unknown", "a", "b", "a"]
    whole = "".join(r.segment for r in out[1, "a"])
    assert [whole[r.mask_start : r.mask_end] for r in out[1, "a"] if r.mask] == ["hi<|im_end|>\n", "bye<|im_end|>\n"]
    assert "<|im_start|>user name=b\n" in whole
    assert chat.rotate(df.where("false")).count() == 0


def shingles(text, n):
    w = bytes(text or "", "utf-8").translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(3)
    texts = {}
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 20, 60, 300]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(1000)}"
            texts[len(texts)] = " ".join(copy)
    texts |= {200: None, 201: "", 202: "a b", 203: "A b", 204: " \n"}
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {i: x if v == y else v for i, v in label.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, 3, 90, 100).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_one_row_of_each_component_stays(docs, nothing):
    left = jaccard.distinct_rows(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 4, 5, 6, 6, 7, 8, 9, 10]
    assert jaccard.distinct_rows(nothing).count() == 0


def test_substring_dedup_equals_brute_force(docs, nothing):
    k = 12
    rows = [(i, (t or "").encode().split()) for i, t, *_ in odd_docs()]
    seen = Counter(tuple(w[j : j + k]) for _, w in rows for j in range(len(w) - k + 1))
    want = Counter()
    for i, w in rows:
        gone = {j + x for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for x in range(k)}
        want[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.dedup(docs, k).collect()) == want
    out = substring.without_repeats(docs, k)
    assert out.columns == docs.columns and out.where("doc_id = 8").first().text == next(t for i, t, *_ in odd_docs() if i == 8)
    assert substring.dedup(nothing, k).count() == 0


def test_katz_probabilities_sum_up_to_one(docs, nothing):
    model = katz.katz(docs)
    rows = model.scores.collect()
    assert len(rows) == len(odd_docs()) and all(np.isfinite(r.score) and r.score <= 0 for r in rows)
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [(katz.held_out(i), [*(t or "").encode().translate(low).split(), None]) for i, t, *_ in odd_docs()]
    uni, bi = Counter(), Counter()
    for held, t in tokens:
        if not held:
            uni.update(t)
            bi.update(zip([None, *t[:-1]], t, strict=True))
    d1, d2 = (katz.discounts(np.array([sum(v == r for v in c.values()) for r in range(1, 7)])) for c in (uni, bi))
    total = sum(uni.values())
    p1 = {w: float(katz.factor(d1, np.array([c]))[0]) * c / total for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    assert unknown > 0 and abs(model.facts.unknown - unknown) < 1e-9 and model.facts.tokens == total
    seen = defaultdict(dict)
    for (h, w), c in bi.items():
        seen[h][w] = float(katz.factor(d2, np.array([c]))[0]) * c / uni[h]
    weight = {h: (1 - sum(s.values())) / (1 - sum(p1[w] for w in s)) for h, s in seen.items()}
    for h, s in seen.items():
        assert abs(sum(s.values()) + weight[h] * (sum(p for w, p in p1.items() if w not in s) + unknown) - 1) < 1e-9
    want = Counter()
    for (held, t), (i, *_) in zip(tokens, odd_docs(), strict=True):
        p = [seen.get(h, {}).get(w) or weight.get(h, 1) * p1.get(w, unknown) for h, w in zip([None, *t[:-1]], t, strict=True)]
        want[i, held, len(t), round(float(np.log10(p).sum()), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, round(r.score, 6)) for r in rows) == want
    assert katz.katz(nothing).scores.count() == 0


def test_graph_search_reaches_its_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [None] + [1.0] * 15), (2080, [float("nan")] * 16), (None, [1.0] * 16), (2100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1)).repartition(4)
    got = defaultdict(list)
    for r in graphann.search(df, 20, 20, shard_rows=400).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        hits += len({i for i, _ in found} & set(best))
        assert len(found) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in found)
    assert hits >= 0.9 * 20 * len(got)
    assert graphann.search(df.where("vec_id >= 2000")).count() == 0
    assert graphann.search(df.where("false")).count() == 0


def test_classifier_keeps_clean_and_rejects_junk(spark, docs, nothing):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
        kind = i % 4
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 2:
            text += " awful"
        rows.append((i, text, "en", "s"))
        if i < 480:
            labels.append((i, int(kind != 1), int(kind == 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    model = cotrain.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    keep = {r.doc_id: r.keep for r in cotrain.score(df, model).where("doc_id >= 480").collect()}
    right = sum(keep[i] == (i % 4 in (0, 3)) for i in keep)
    assert len(keep) == 120 and right >= 0.95 * 120
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plain = cotrain.fit(docs, empty)
    assert cotrain.keep_rows(docs, plain).columns == docs.columns
    assert cotrain.keep_rows(docs, plain).count() == docs.count()
    assert cotrain.score(nothing, model).count() == 0


def test_benchmark_passages_and_paraphrases_are_found(spark, docs):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(30)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(5000)}" for _ in range(n)]

    items = [prose(rng.randrange(14, 55)) for _ in range(40)]
    rows = []
    for i in range(300):
        text = prose(rng.randrange(20, 400))
        if i < 40:
            at = rng.randrange(len(text))
            put = list(items[i])
            if i % 2:  # a word in six is another
                for j in range(0, len(put), 6):
                    put[j] = "other"
            text[at:at] = put
        elif i < 60:
            text[5:5] = items[i - 40][:6]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (90, None), (91, ""), (92, "c1")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in latent.matches(df, bench).collect()}
    assert {p for p in found if p[0] < 40} >= {(i, i) for i in range(0, 40, 2)}
    assert len({(i, i) for i in range(1, 40, 2)} & found) >= 18
    assert all(d == i for d, i in found)
    assert latent.clean_rows(df, bench).count() == 300 - len({d for d, _ in found})
    assert latent.matches(docs, bench.where("false")).count() == 0
    assert latent.clean_rows(docs, bench).columns == docs.columns
