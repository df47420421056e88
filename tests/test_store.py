"""Tables of a live run: visibility, amended rows, horizons, compaction, vacuum; and plain appended tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duskwatch import schemas
from duskwatch.sinks import tables
from duskwatch.sinks.store import Store

DAY = datetime(2026, 6, 10, 12)


def feed(spark, ids, day=DAY, text="m", amends=False):
    rows = [(i, day, "s", f"{text}{i}", False, None, None, None, None, day + timedelta(seconds=i)) for i in ids]
    return spark.createDataFrame(rows, schemas.LIVE_LOGS).withColumn("amends", F.lit(amends))


def put(store, table, rows, name, version=0, **kw):
    store.write(table, rows, name, version)
    store.commit(name, add={table: [name]}, **kw)


def shown(store):
    return sorted((r.id, r.message) for r in store.read("feed").collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "tables"))


def test_readers_see_committed_batches_only(spark, store):
    assert shown(store) == []
    put(store, "feed", feed(spark, [1, 2]), "a")
    store.write("feed", feed(spark, [3]), "b")
    assert shown(store) == [(1, "m1"), (2, "m2")]
    store.write("feed", feed(spark, [4]), "b")  # the attempt runs again
    store.commit("b", add={"feed": ["b"], "alerts": ["b"]})
    assert [i for i, _ in shown(store)] == [1, 2, 4]
    # a batch without rows leaves no folder
    assert store.read("alerts").count() == 0
    assert store.committed("b") and not store.committed("c")


def test_the_newest_version_of_an_amended_row_counts(spark, store):
    put(store, "feed", feed(spark, range(5)), "a", 0)
    put(store, "feed", feed(spark, [1, 2], text="x", amends=True), "b", 1, amended=["feed"])
    put(store, "feed", feed(spark, [2], text="y", amends=True), "c", 2, amended=["feed"])
    want = [(0, "m0"), (1, "x1"), (2, "y2"), (3, "m3"), (4, "m4")]
    assert shown(store) == want
    assert store.compact("feed") == 3
    assert shown(store) == want and store.live("feed")[0][0].startswith("compact-") and not store.live("feed")[2]


def test_pruning_and_expiry_hide_rows_beside_a_writer(spark, store):
    put(store, "feed", feed(spark, range(20)), "a")
    store.write("feed", feed(spark, [30, 31]), "b")
    store.prune(5)
    store.commit("b", add={"feed": ["b"]})  # a writer that was under way
    assert [i for i, _ in shown(store)] == [15, 16, 17, 18, 19, 30, 31]
    store.prune(3)
    assert [i for i, _ in shown(store)] == [19, 30, 31]
    store.prune(100)
    assert len(shown(store)) == 3
    put(store, "feed", feed(spark, [40], DAY + timedelta(days=5)), "c")
    assert store.expire(2, "feed", F.lit(DAY + timedelta(days=6))) == 3
    assert shown(store) == [(40, "m40")]


def test_compaction_replaces_batches_of_settled_days_and_vacuum_deletes_them(spark, store, tmp_path):
    for n in range(3):
        put(store, "feed", feed(spark, [n, 10 + n]), f"old{n}", n)
    put(store, "feed", feed(spark, [50], DAY + timedelta(days=3)), "new", 3)
    put(store, "feed", feed(spark, [1], text="x", amends=True), "late", 4, amended=["feed"])
    before = shown(store)
    assert store.compact("feed", DAY + timedelta(days=2)) == 4
    assert shown(store) == before and len(store.live("feed")[0]) == 2
    folders = lambda: {p.name for p in (tmp_path / "tables" / "feed").glob("dt=*/batch=*")}
    assert len(folders()) == 6
    assert store.vacuum(3600) == 0  # a reader may still be at them
    store.write("feed", feed(spark, [99]), "lost")  # an attempt that never ended
    assert store.vacuum(0) == 5
    assert len(folders()) == 2 and shown(store) == before
    put(store, "feed", feed(spark, [10], text="y", amends=True), "later", 5, amended=["feed"])
    assert (10, "y10") in shown(store) and len(shown(store)) == len(before)


def test_appending_twice_on_a_day_keeps_both(spark, tmp_path):
    path = str(tmp_path / "alerts")
    rows = feed(spark, [1]).drop("amends")
    tables.append(rows, path)
    tables.append(rows.withColumn("id", F.lit(2).cast("long")), path)
    tables.append(rows.withColumn("id", F.lit(3).cast("long")), path, batch="n")
    tables.append(rows.withColumn("id", F.lit(4).cast("long")), path, batch="n")  # the same batch once more
    assert sorted(r.id for r in tables.read_table(spark, path).collect()) == [1, 2, 4]
