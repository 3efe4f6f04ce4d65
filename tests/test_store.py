"""The keyed store: replays, dead writers, races, capacity, compaction."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.store import CapacityError, KeyedStore


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/store", "k string, n long, at long, size long", "k", buckets=4)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, n long, at long, size long, bucket string")


def test_put_keeps_what_is_there(spark, store):
    assert rows_of(store.read()) == [] and rows_of(store.get(frame(spark, []).select("k"))) == []
    store.put(frame(spark, [("a", 2, 2, 1, "x"), ("a", 1, 1, 1, "x"), ("b", 1, 5, 1, "x"), (None, 1, 1, 1, "x")]), ["n"], "s", 0)
    store.put(frame(spark, [("a", 9, 9, 9, "x"), ("c", 3, 3, 1, "x")]), ["n"], "s", 1)
    want = [("a", 1, 1, 1), ("b", 1, 5, 1), ("c", 3, 3, 1)]
    assert rows_of(store.read()) == want
    before = store.manifest()
    store.put(frame(spark, [("z", 1, 1, 1, "x")]), ["n"], "s", 1)  # a replay
    assert rows_of(store.read()) == want and store.manifest() == before
    assert rows_of(store.get(spark.createDataFrame([("a",), ("q",), (None,)], "k string"))) == want[:1]
    with pytest.raises(CapacityError):
        store.put(frame(spark, [("y", 1, 1, 98, "x")]), ["n"], "s", 2, size="size", capacity=100)
    assert rows_of(store.read()) == want
    store.put(frame(spark, [("y", 1, 1, 97, "x")]), ["n"], "s", 2, size="size", capacity=100)
    assert len(rows_of(store.read())) == 4


def test_upsert_merges_each_batch_once(spark, store):
    merge = {"n": F.sum("n"), "at": F.max("at"), "size": F.min("size")}
    for i in (0, 1, 0, 1, 2):
        store.upsert(frame(spark, [("a", 1, i, i, "x"), ("a", 1, 0, 7, "x"), (f"k{i}", 1, 0, 0, "x")]), merge, "s", i)
    assert rows_of(store.read()) == [("a", 6, 2, 0), ("k0", 1, 0, 0), ("k1", 1, 0, 0), ("k2", 1, 0, 0)]


def test_a_dead_writer_leaves_the_old_version(spark, store, monkeypatch):
    store.put(frame(spark, [("a", 1, 1, 1, "x")]), ["n"])
    monkeypatch.setattr(KeyedStore, "_commit", lambda self, m: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.put(frame(spark, [("b", 1, 1, 1, "x")]), ["n"])
    monkeypatch.undo()
    assert rows_of(store.read()) == [("a", 1, 1, 1)]
    store.put(frame(spark, [("c", 1, 1, 1, "x")]), ["n"])
    assert store.vacuum() > 0 and [r[0] for r in rows_of(store.read())] == ["a", "c"]


def test_of_two_writers_one_commits(spark, store):
    old = store.manifest()
    store.put(frame(spark, [("a", 1, 1, 1, "x")]), ["n"])
    with pytest.raises(Exception, match="(?i)exist"):
        store._write(frame(spark, [("b", 1, 1, 1, "x")]), old, [], None, None)
    assert [r[0] for r in rows_of(store.read())] == ["a"]


@pytest.mark.parametrize("capacity, kept", [(100, 6), (9, 4), (5, 2), (0, 0)])
def test_compaction_drops_the_oldest(spark, store, capacity, kept):
    store.put(frame(spark, [(f"k{i}", 1, at, 2, "x") for i, at in enumerate((10, 11, 12, 20, 20))] + [("null", 1, None, 2, "x")]), ["n"])
    store.compact(capacity, "size", "at", F.floor(F.col("at") / 10))
    order = ["k4", "k3", "k2", "k1", "k0", "null"]
    assert sorted(r[0] for r in rows_of(store.read())) == sorted(order[:kept])
