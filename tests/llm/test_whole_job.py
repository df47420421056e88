"""Cases in which an operator once did less than its whole job."""

import json
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duskwatch.llm import cotrain, latent, queries, tokenfile

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, source string"


def _page(rng, i):
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))
    return text.upper() + "!!" if i % 2 else text


def test_every_unlabelled_document_takes_part_in_fitting(spark):
    rng = random.Random(3)
    rows = [(i, _page(rng, i), "en", "s") for i in range(24_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    model = cotrain.fit(df, spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], LABELS), rounds=1)
    # all but the part for calibration
    assert sum(model.rounds[-1]["junk", "content"]) > 23_500


def test_a_labelled_copy_wins_over_its_unlabelled_copies(spark):
    rng = random.Random(4)
    texts = [_page(rng, i) for i in range(200)]
    # the labelled copy of each text is neither the first nor the last
    rows = [(j * 200 + i, texts[i], "en", f"s{j}") for j in range(9) for i in range(200)]
    labels = spark.createDataFrame([(800 + i, 1 - i % 2, 0) for i in range(200)], LABELS)
    learned = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(cotrain.FOLD)) != 0).groupBy().agg(
        F.count(F.when(F.col("quality") == 0, 1)).alias("one"), F.count(F.when(F.col("quality") == 1, 1)).alias("none")).first()
    for parts in (1, 5):
        model = cotrain.fit(spark.createDataFrame(rows, DOCS).repartition(parts), labels, rounds=0)
        assert model.rounds[0]["junk", "content"] == tuple(learned)


ADDED = ["a <|endoftext|> b", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>", "x \n <|endoftext|>\n\n it's", "<|endoftext| >", " <|endoftext|>", "plain  text \x00 \x01", "p <s> q<s><s>t  r"]


def _same_as_library(got, vocabulary):
    library = Tokenizer.from_str(vocabulary)
    coded = [library.encode(t, add_special_tokens=False).ids + [2] for t in ADDED]
    assert [(r.n_tokens, r.ids_crc32) for r in sorted(got, key=lambda r: r.start)] == [(len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for c in coded]


def test_added_tokens_in_texts_are_encoded_as_the_library_does(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string").repartition(2)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        plain = f.read()
    _same_as_library(queries.op2_token_files(spark, str(tmp_path)).collect(), plain)
    for strip in (False, True):
        more = json.loads(plain)
        names = ["<s>", "<s><s>t"]
        more["added_tokens"] += [{**more["added_tokens"][0], "id": 50257 + i, "content": c, "lstrip": strip} for i, c in enumerate(names)]
        _same_as_library(tokenfile.read_tokens(tokenfile.write_tokens(df, json.dumps(more), 2, added=True)).collect(), json.dumps(more))


def _prose(rng, n):
    return [f"r{rng.randrange(5000)}" for _ in range(n)]


def test_verbatim_items_are_found_at_any_cosine(spark, monkeypatch):
    rng = random.Random(6)
    items = [_prose(rng, n) for n in [*range(5, 16), 13, 20, 40] * 3]
    rows, want = [], set()
    for i, words in enumerate(items):
        text = _prose(rng, 300)
        at = rng.randrange(300)
        # a long item's other words, which its answer needs, follow in reverse
        text[at:at] = words[:13] + words[:12:-1] if len(words) > 15 else words
        rows.append((i, " ".join(text)))
        want.add((i, i))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    # as in a benchmark so large that the latent space tells nothing
    monkeypatch.setattr(latent, "COSINE", 2.0)
    assert {(r.doc_id, r.item_id) for r in latent.matches(df, bench).collect()} == want


@pytest.mark.parametrize("n", [4, 5, 59, 60, 61, 64, 65, 108, 112, 113, 200, 333])
def test_passages_of_long_items_cut_no_run_and_lose_no_word(n):
    batch = pd.DataFrame({"item_id": [1], "_text": [" ".join(f"w{i}" for i in range(n))]})
    out = pd.concat(latent._passages(np.ones(latent.SPACE))(iter([batch])))
    passages = [p for p in out["words"].map(lambda w: np.frombuffer(w, np.uint64).tolist())]
    assert all(latent.SHORTEST <= len(p) <= 2 * latent.HALF for p in passages)
    assert bool(passages) == (n >= latent.SHORTEST)
    size = min(n, latent.RUN)
    runs = {tuple(p[i : i + size]) for p in passages for i in range(len(p) - size + 1)}
    assert len(runs) == (n - size + 1 if passages else 0)


def test_a_quote_across_a_cut_is_found(spark):
    rng = random.Random(8)
    item = [f"q{i}" for i in range(150)]
    quote = _prose(rng, 300) + item[48:72] + _prose(rng, 300)
    # the item's other words are more common, so that the quoted ones are its answer
    others = [w for w in item[:48] + item[72:] for _ in range(2)]
    rng.shuffle(others)
    rows = [(0, " ".join(quote))] + [(1 + i, w + " " + " ".join(_prose(rng, 20))) for i, w in enumerate(others)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in latent.matches(df, bench).collect()} == {0}
