"""Writes to stores add what changed; readers see the latest row of a key, whatever was folded since."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keyloom.sources import store as S
from keyloom.sources.store import Store


@pytest.fixture(autouse=True)
def deltas_for_any_rows(monkeypatch):
    monkeypatch.setattr(S, "SMALL", 0)


def test_small_writes_write_little(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    store = Store.open(spark, f"file://{tmp_path}", "little")
    c = store.collection_create("orders", "o_orderkey", orders.schema)
    store.index_create("by_customer", "bigint", "bigint")
    c = c.with_index("by_customer", F.array(F.col("o_custkey").cast("long")))
    rows = orders.unionByName(orders.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)).unionByName(orders.withColumn("o_orderkey", F.col("o_orderkey") + 20_000_000))
    c.upsert_overwrite(rows)
    size = lambda: sum(f.stat().st_size for f in Path(tmp_path, "little", "data", "orders").rglob("*.parquet"))
    whole, n = size(), c.size()
    key = orders.agg(F.min("o_orderkey")).first()[0]
    was = c.fetch(key)
    c.update(key, lambda old: {"o_totalprice": old("o_totalprice") + 1})
    assert size() - whole < 0.05 * whole and c.size() == n == c.now().df.count()
    assert c.fetch(key).o_totalprice == was.o_totalprice + 1
    assert len(store.manifest(store.version())["orders"]["deltas"]) == 1


def test_any_sequence_of_writes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "DELTAS", deltas := 3)
    rng = random.Random(1)
    store = Store.open(spark, f"file://{tmp_path}", "random")
    i = store.index_create("by_v", "int", "int")
    c = store.collection_create("c", "k", "k int, v int").with_index("by_v", F.array("v"))
    held = {k: k % 5 for k in range(60)}
    c.upsert_overwrite(list(held.items()))
    for step in range(6):
        some = [rng.randrange(80) for _ in range(3)]
        if step % 3 == 1:
            gone = c.delete(some)
            assert {r.k for r in gone} == set(some) & set(held)
            for k in some:
                held.pop(k, None)
        elif step % 3 == 2:
            c.upsert(some, lambda old, here: {"v": F.when(here, old("v") + 1).otherwise(-1)})
            held |= {k: held[k] + 1 if k in held else -1 for k in set(some)}
        else:
            c.upsert_overwrite([(k, step) for k in some])
            held |= dict.fromkeys(some, step)
        assert {r.k: r.v for r in c.now().df.collect()} == held and c.size() == len(held)
        assert {(r.ik, r.tk) for r in i.now().df.collect()} == {(v, k) for k, v in held.items()}
        entry = store.manifest(store.version())["by_v"]
        assert entry["rows"] == len(held) and len(entry["deltas"]) < deltas


def test_columns_with_keys_alone_and_composite_keys(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}", "keys")
    alone = store.collection_create("alone", "k", "k int")
    alone.upsert_overwrite([(k,) for k in range(40)])
    version = store.version()
    alone.upsert_overwrite([(1,)])
    alone.delete([99])
    assert store.version() == version and alone.size() == 40  # nothing changed
    alone.delete([3])
    alone.upsert_overwrite([(50,)])
    assert alone.size() == 40 and not alone.contains(3) and alone.contains(50)
    pair = store.collection_create("pair", ("a", "b"), "v string, a int, b int")
    pair.upsert_overwrite([(str(k), k // 5, k % 5) for k in range(50)])
    with store.read_only() as before:
        pair.upsert_overwrite([("new", 2, 3)])
        with pair.read_write() as p:
            p.delete([(2, 4)])
            p.upsert_overwrite([("back", 2, 4)])
            p.delete([(0, 0)])
        assert before.collection("pair").df.count() == 50 and before.collection("pair").fetch((2, 3)).first().v == "13"
    assert pair.now().df.columns == ["v", "a", "b"] and pair.size() == 49 == pair.now().df.count()
    assert pair.fetch((2, 3)).v == "new" and pair.fetch((2, 4)).v == "back" and pair.fetch((0, 0)) is None
    store.vacuum(keep=1)
    assert pair.now().df.count() == 49
    pair.clear()
    assert pair.size() == 0
    pair.upsert_overwrite([("z", 1, 1)])
    assert pair.fetch((1, 1)).v == "z" and pair.size() == 1
