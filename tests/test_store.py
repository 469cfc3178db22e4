"""Stores: catalog, transactions, upkeep of indexes, streams into collections."""

import threading

import pytest
from pyspark.sql import functions as F

from keyloom import errors as E
from keyloom.sources.store import Store, StoreConfig

SCHEMA = "k string, v int"


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, str(tmp_path), "db", lock_timeout=30.0)


def values(c):
    return {r.k: r.v for r in c.now().df.collect()}


def test_catalog(store):
    c = store.collection_create("a", "k", SCHEMA)
    assert store.collections_available() == ["a"] and store.collection_exists("a") and c.exists() and c.size() == 0
    with pytest.raises(E.CollectionAlreadyExists):
        store.collection_create("a", "k", SCHEMA)
    assert store.collection_create("a", "k", SCHEMA, fail_if_exists=False).name == "a"
    with pytest.raises(E.CollectionNotFound):
        store.collection_get("b")
    with pytest.raises(E.CodecFailure):
        store.collection_get("a", "k string, v string")
    with pytest.raises(E.IndexAlreadyExists):
        store.index_create("a")  # one namespace
    store.collection_allocate("b", "k", SCHEMA)
    store.index_create("i")
    assert store.indexes() == ["i"] and store.index_exists("i") and not store.index_exists("a") and store.list_all() == ["a", "b", "i"]
    assert store.index_create("i", fail_if_exists=False).name == "i"
    store.index_drop("i")
    store.collection_drop("b")
    assert store.list_all() == ["a"]
    for missing, error in ((store.index_drop, E.IndexNotFound), (store.index_get, E.IndexNotFound), (store.collection_drop, E.CollectionNotFound), (store.collection_size, E.CollectionNotFound), (store.collection_clear, E.CollectionNotFound)):
        with pytest.raises(error):
            missing("nope")


def test_config(monkeypatch, spark, tmp_path):
    monkeypatch.setenv("KEYLOOM_NAME", "fromenv")
    assert StoreConfig.from_env().name == "fromenv" and StoreConfig.from_env(name="x").name == "x"
    store = Store.open(spark, str(tmp_path), "p")
    assert store.path == f"{tmp_path}/p"
    store.platform_check()


def test_single_writes(store):
    c = store.collection_create("a", "k", SCHEMA)
    c.upsert_overwrite(("x", 1))
    c.upsert_overwrite([("x", 2), ("y", 3)])
    assert values(c) == {"x": 2, "y": 3} and c.size() == 2 and store.collection_size("a") == 2
    assert c.fetch("x").v == 2 and c.fetch("z") is None and c.contains("y")
    assert [tuple(r) for r in c.upsert("x", lambda old, here: {"v": F.coalesce(old("v"), F.lit(0)) + 1})] == [("x", 3)]
    assert [tuple(r) for r in c.upsert("n", lambda old, here: {"v": F.coalesce(old("v"), F.lit(0)) + 1})] == [("n", 1)]
    assert c.update("gone", lambda old: {"v": old("v") + 1}) == []
    assert [tuple(r) for r in c.update("y", lambda old: {"v": old("v") * 2})] == [("y", 6)]
    assert [tuple(r) for r in c.delete("y")] == [("y", 6)] and c.delete("y") == []
    assert c.head().k == "n" and c.last().k == "x" and c.next("n").k == "x" and c.previous("n") is None and c.fetch_at(1).k == "x"
    assert [r.v for r in c.collect()] == [1, 3] and [r.v for r in c.stream()] == [1, 3] and [r.k for r in c.stream_with_keys(backward=True)] == ["x", "n"]
    c.clear()
    assert c.size() == 0 and c.exists()


def test_bad_keys(store):
    c = store.collection_create("a", "k", SCHEMA)
    c.upsert_overwrite(("k" * 511, 1))
    with pytest.raises(E.OverSizedKey):
        c.upsert_overwrite(("k" * 512, 1))
    with pytest.raises(E.CodecFailure):
        c.upsert_overwrite((None, 1))
    assert c.size() == 1


def test_rollback_over_several(store):
    a, b = store.collection_create("a", "k", SCHEMA), store.collection_create("b", "k", SCHEMA)
    store.index_create("i", "int", "string")
    a = a.with_index("i", F.array("v"))
    a.upsert_overwrite(("x", 1))
    with pytest.raises(KeyError), store.read_write() as txn:
        txn.lift(a).upsert_overwrite(("x", 2))
        txn.lift(b).upsert_overwrite(("y", 2))
        assert values(txn.lift(a)) == {"x": 2}  # its own writes
        raise KeyError
    assert values(a) == {"x": 1} and values(b) == {} and store.index_get("i").fetch(1) == "x" and not store.index_get("i").has_key(2)
    with store.read_write() as txn:
        txn.lift(a).upsert_overwrite(("x", 2))
        txn.lift(b).upsert_overwrite(("y", 2))
    assert values(a) == {"x": 2} and values(b) == {"y": 2} and store.index_get("i").fetch(2) == "x"


def test_nested_writes(store):
    c = store.collection_create("a", "k", SCHEMA)
    with store.read_write():
        with pytest.raises(E.NestedWriteTransaction), store.read_write():
            pass
        with pytest.raises(E.NestedWriteTransaction):
            c.upsert_overwrite(("x", 1))
    c.upsert_overwrite(("x", 1))
    with c.read_only() as r, pytest.raises(E.StorageError):
        r.upsert_overwrite(("x", 2))


def test_snapshot_readers(store):
    c = store.collection_create("a", "k", SCHEMA)
    c.upsert_overwrite(("x", 1))
    with store.read_only() as before:
        with store.read_write() as txn:
            txn.lift(c).upsert_overwrite(("x", 2))
            assert values(c) == {"x": 1}  # not committed yet
        assert values(c.lift(before)) == {"x": 1} and values(c) == {"x": 2}


def test_writers_take_turns(store):
    c = store.collection_create("a", "k", SCHEMA)
    c.upsert_overwrite(("n", 0))
    work = [threading.Thread(target=lambda: c.update("n", lambda old: {"v": old("v") + 1})) for _ in range(4)]
    [w.start() for w in work]
    [w.join() for w in work]
    assert values(c) == {"n": 4}


def test_two_handles_on_one_folder(spark, store, tmp_path):
    store.collection_create("a", "k", SCHEMA).upsert_overwrite(("x", 1))
    assert values(Store.open(spark, str(tmp_path), "db").collection_get("a")) == {"x": 1}


def test_index_upkeep(store):
    i = store.index_create("by_v", "int", "string")
    plain = store.collection_create("a", "k", SCHEMA)
    plain.upsert_overwrite([("x", 1), ("y", 1)])
    c = plain.with_index("by_v", F.array("v"))
    assert not i.has_key(1)
    c.rebuild_indexes()
    assert [r.tk for r in i.indexed(1)] == ["x", "y"]
    c.upsert_overwrite(("x", 2))
    assert [r.tk for r in i.indexed(1)] == ["y"] and i.fetch(2) == "x" and i.contains(2, "x")
    c.delete("y")
    assert not i.has_key(1) and tuple(i.head()) == (2, "x") == tuple(i.last())
    i.index([(2, "x"), (7, "q")])
    assert [r.tk for r in i.unindex([(7, "q"), (8, "r")])] == ["q"] and i.next(2) is None and i.previous(2) is None and tuple(i.fetch_at(0)) == (2, "x")
    assert i.query(2).to_list() == ["x"] and i.exists()
    with store.read_write() as txn:
        txn.lift(i).index((3, "t"))
        assert txn.lift(i).has_key(3)
    c.clear()
    assert not i.has_key(3)
    i.index((1, "z"))
    store.index_clear("by_v")
    assert not i.has_key(1)


def test_many_rows_in_one_transaction(spark, store):
    c = store.collection_create("a", "k", SCHEMA)
    c.upsert_overwrite(spark.range(10_000).selectExpr("cast(id AS string) AS k", "cast(id AS int) AS v"))
    assert c.size() == 10_000 and c.query().where_value(lambda v: v("v") < 10).limit(3).values_df().count() == 3


def test_stream_into_a_collection(spark, store, tmp_path):
    from keyloom.streaming.ingest import upsert_stream

    c = store.collection_create("a", "k", SCHEMA)
    source = str(tmp_path / "in")
    spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("y", 5, 1)], "k string, v int, seq int").coalesce(1).write.json(source)
    stream = spark.readStream.schema("k string, v int, seq int").json(source)
    upsert_stream(stream, c, str(tmp_path / "cp"), "seq").awaitTermination(120)
    assert values(c) == {"x": 2, "y": 5}


def test_the_last_row_of_a_key_wins(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}", "repeat")
    c = store.collection_create("c", "k", "k int, v string")
    c.upsert_overwrite([(1, "a"), (2, "x"), (1, "b")])
    assert c.size() == 2 and c.fetch(1).v == "b"
    with pytest.raises(Exception, match="repeats"):
        c.upsert_overwrite(spark.createDataFrame([(1, "p"), (1, "q")], "k int, v string"))
    assert c.fetch(1).v == "b"
    gone = c.delete(spark.createDataFrame([(1,)], "k int"))
    assert [tuple(r) for r in gone.collect()] == [(1, "b")] and c.size() == 1 and c.delete([2]) and not c.size()


def test_writers_that_died(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}", "died", lock_lease=0.5, lock_timeout=20.0)
    c = store.collection_create("c", "k", "k int, v string")
    store.files.put(f"{store.path}/_lock", "someone who died")
    store.files.put(f"{store.path}/_manifest/{store.version() + 1:012d}.json.claim", "someone who died")
    import time

    time.sleep(1.1)
    c.upsert_overwrite([(1, "a")])
    assert c.size() == 1 and not store.files.exists(f"{store.path}/_lock")


def test_vacuum_spares_what_is_named(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}", "vacuum")
    c = store.collection_create("c", "k", "k int, v string")
    for i in range(4):
        c.upsert_overwrite([(i, str(i))])
    with store.read_only() as txn:
        assert store.vacuum(keep=2) == 2
        assert txn.collection("c").size() == 4
    assert store.vacuum(keep=1) == 1 and c.size() == 4
