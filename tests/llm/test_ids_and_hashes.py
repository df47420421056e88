"""Ids beside nulls keep every digit, and words that a polynomial cannot tell apart stay apart."""

import pytest
import public_tokenizers

from duskwatch.llm import bpe, cotrain, jaccard, katz, latent, store, substring, tokenfile
from duskwatch.llm.words import word_hashes

BIG = 1 << 60
COPY = " ".join(f"w{i}" for i in range(40))


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.fixture
def docs(spark):
    rows = [(None, COPY, None), (BIG + 1, COPY, BIG + 1), (BIG + 3, COPY, BIG + 3), (7, "other words", 11), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1)


def test_substring_dedup_keeps_large_ids_beside_nulls(docs):
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.dedup(docs).collect()), key=str)
    assert got == sorted([(None, 40, 40), (BIG + 1, 40, 40), (BIG + 3, 40, 40), (7, 2, 0), (None, 0, 0)], key=str)
    left = {(r.doc_id, r.n_chars) for r in substring.without_repeats(docs, 35, length_col="none").collect()}
    assert left == {(None, None), (BIG + 1, BIG + 1), (BIG + 3, BIG + 3), (7, 11)}


def test_token_files_keep_large_ids_beside_nulls(docs):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        got = tokenfile.read_tokens(tokenfile.write_tokens(docs, f.read(), 2)).collect()
    assert sorted(((r.doc_id) for r in got), key=str) == sorted([None, None, 7, BIG + 1, BIG + 3], key=str)


@pytest.mark.parametrize("length", [1024, 4096])
def test_words_of_one_polynomial_value_stay_apart(spark, length):
    word = thue_morse(length)
    turned = word.translate(str.maketrans("ab", "ba"))
    assert len(set(word_hashes([word, turned])[1][0].tolist())) == 2
    around = " ".join(f"w{i}" for i in range(35))
    df = spark.createDataFrame([(1, f"{around[:-3]} {word}"), (2, f"{around[:-3]} {turned}"), (3, word), (4, turned)], "doc_id long, text string")
    assert {r.n_removed for r in substring.dedup(df, k=35).collect()} == {0}
    assert {r.doc_id: r.component_id for r in jaccard.join(df, n=3, num=95, den=100).where("doc_id > 2").collect()} == {3: 3, 4: 4}


def _ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


ALL = sorted([None, None, 7, BIG + 1, BIG + 3], key=str)


def test_katz_and_bpe_keep_large_ids_beside_nulls(docs):
    assert _ids(katz.katz(docs).scores.collect()) == ALL
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in got if r.doc_id is not None} == {BIG + 1: COPY, BIG + 3: COPY, 7: "other words"}
    assert _ids(got) == ALL


def test_jaccard_joins_and_drops_copies_by_large_ids(docs):
    got = {(r.doc_id, r.component_id, r.first) for r in jaccard.join(docs, 3, 90, 100).where("n_shingles > 2").collect()}
    assert got == {(None, BIG + 1, False), (BIG + 1, BIG + 1, True), (BIG + 3, BIG + 1, False)}
    left = {(r.doc_id, r.n_chars) for r in jaccard.distinct_rows(docs).collect()}
    assert left == {(BIG + 1, BIG + 1), (7, 11), (None, None)}


def test_classifier_keeps_large_ids_beside_nulls(docs):
    rows = docs.selectExpr("*", "'en' AS lang", "'web' AS source")
    labels = docs.sparkSession.createDataFrame([(BIG + 1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    model = cotrain.fit(rows, labels)
    assert _ids(cotrain.score(rows, model).collect()) == ALL
    kept = cotrain.keep_rows(rows, cotrain.Classifier())
    assert kept.columns == rows.columns
    assert sorted(kept.collect(), key=str) == sorted(rows.collect(), key=str)


def test_decontamination_keeps_large_ids_beside_nulls(docs):
    items = docs.sparkSession.createDataFrame([(None, "nothing of the kind is said here"), (BIG + 5, COPY)], "item_id long, text string").coalesce(1)
    got = latent.matches(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(None, BIG + 5), (BIG + 1, BIG + 5), (BIG + 3, BIG + 5)}
    left = {(r.doc_id, r.n_chars) for r in latent.clean_rows(docs, items).collect()}
    assert left == {(7, 11), (None, None)}


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "64m")
    store.bounded_batches(spark)
    assert spark.conf.get(name) == str(store.BATCH_BYTES)
    spark.conf.set(name, "1000")
    store.bounded_batches(spark)
    assert spark.conf.get(name) == "1000"
    spark.conf.set(name, str(store.BATCH_BYTES))
