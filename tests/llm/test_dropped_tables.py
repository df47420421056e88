"""Operators take away the tables that nothing reads any more, and make what they ask for twice once."""

import os
import pickle

from duskwatch.llm import components, jaccard, latent, store
from duskwatch.session import shared_dir


def _texts(groups: int, copies: int) -> list[tuple[int, str]]:
    words = lambda g: [f"w{g}x{i}" for i in range(60)]
    near = [(g * copies + c, " ".join([*words(g)[:-1], f"end{c}"])) for g in range(groups) for c in range(copies)]
    return [*near, (None, "null id of some words"), (9_000, ""), (9_001, None)]


def _left(spark) -> set[str]:
    folder = f"{shared_dir(spark).removeprefix('file://')}/llm"
    return {x for x in os.listdir(folder) if x.startswith("jaccard-")} if os.path.isdir(folder) else set()


def test_near_duplicates_leave_only_what_their_result_reads(spark):
    docs = spark.createDataFrame(_texts(6, 5), "doc_id long, text string")
    before = _left(spark)
    out = jaccard.distinct_rows(docs)
    kinds = {x.rpartition("-")[0] if x.count("-") == 2 else "-".join(x.split("-")[:2]) for x in _left(spark) - before}
    assert kinds <= {"jaccard-out", "jaccard-twice", "jaccard-links"}
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, 0, 5, 10, 15, 20, 25, 9_000, 9_001]


def test_components_agree_with_and_without_a_broadcast(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40) if i % 9] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 139)]
    table = spark.createDataFrame(edges, "a long, b long")
    found = []
    for most in (components.SMALL_BYTES, -1):
        monkeypatch.setattr(components, "SMALL_BYTES", most)
        found.append(sorted(map(tuple, components.components(table).collect())))
    assert found[0] == found[1]
    label = dict(found[0])
    assert label[8] == 1 and label[200] == label[139] == 100 and 7 in label and label[27] == 19


def test_stars_are_made_once(spark, monkeypatch):
    labels, keep = [], store.keep
    monkeypatch.setattr(store, "keep", lambda df, label, *a: labels.append(label) or keep(df, label, *a))
    docs = spark.createDataFrame(_texts(3, 4), "doc_id long, text string")
    assert len({r.component_id for r in jaccard.join(docs).where("doc_id < 9000").collect()}) == 3
    assert labels.count("jaccard-stars") == labels.count("jaccard-open") == 1


def test_finders_hold_the_features_of_their_passages_only(spark):
    item = " ".join(f"item{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "something else " * 20), (3, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    (finder,) = latent.finders(docs, benchmark)
    assert len(pickle.dumps(finder)) < 8 << 20
    assert sorted(r.doc_id for r in latent.clean_rows(docs, benchmark).collect()) == [2, 3]
