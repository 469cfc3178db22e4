import duckdb
import pytest
from pyspark.sql import functions as F

from keyloom.llm import mixing


def water_level(sizes, weights, share=1.5, most=2.0):
    """Shares by weight, what is above the cap given to the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        above = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not above:
            return out | {s: left * w[s] / total for s in open_}
        for s in above:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in above)
        open_ -= above
    return out


def test_targets_and_takes(docs):
    texts = [("w " * (1 + i * 7 % 40), s) for i in range(400) for s in (["a"] * 5 + ["b", None, "c"])[i % 8 : i % 8 + 1]]
    got = mixing.mix(docs(texts)).toPandas()
    sizes = {None if s != s or s is None else s: n for s, n in got.groupby("source", dropna=False)["_size"].sum().items()}
    want = water_level(sizes, mixing.WEIGHTS)
    for s, rows in got.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert rows["_target"].iloc[0] == pytest.approx(want[s]) and rows["_source_size"].iloc[0] == sizes[s]
        assert abs((rows["_size"] * rows["_copies"]).sum() - want[s]) <= 2 * rows["_size"].max()
    assert got["_copies"].max() <= 2 and got["_copies"].min() >= 0
    assert got["_target"].groupby(got["source"].fillna("none")).first().sum() == pytest.approx(1.5 * got["_size"].sum())


def test_reruns_agree_whatever_the_partitions(docs):
    d = docs([("w " * (i % 9), "abc"[i % 3]) for i in range(200)])
    one, two = (mixing.mix(x).select("doc_id", "_copies").toPandas().sort_values("doc_id")._copies.tolist() for x in (d.repartition(1), d.repartition(7)))
    assert one == two


def test_the_number_of_buckets_changes_nothing(docs, monkeypatch):
    texts = [("w " * (i % 4), "abc"[i % 3]) for i in range(300)]
    d = docs(texts, [(-1) ** i * i * 1_000_003 for i in range(300)])
    found = []
    for n in (2, 256, 1 << 20):
        monkeypatch.setattr(mixing, "buckets_for", lambda rows, n=n: n)
        found.append({r.doc_id: r._copies for r in mixing.mix(d).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 300


def test_odd_texts_ties_and_clashing_columns(docs, odd_texts):
    d = docs([(t, None if i % 2 else "s") for i, t in enumerate(odd_texts * 2)], [1] * 10 + [None] * 20)
    d = d.withColumns({c: F.lit("x") for c in ("_size", "src", "bucket", "rank", "copies", "id", "size", "doc")})
    got = mixing.mix(d)
    assert got.count() == len(odd_texts) * 2
    out = mixing.mixed(docs(odd_texts).withColumn("rank", F.lit(1)))
    assert out.columns == [*docs([]).columns, "rank"]


def test_nothing_to_mix(docs):
    assert mixing.mix(docs([])).count() == 0
    got = mixing.mix(docs([None, "", " "])).toPandas()
    assert got["_copies"].sum() == 0 and got["_target"].tolist() == [0.0] * 3


def test_copies_are_rows(docs):
    d = docs([("w " * (i % 5 + 1), "ab"[i % 2]) for i in range(60)])
    want = {r.doc_id: r._copies for r in mixing.mix(d).collect() if r._copies}
    assert {r.doc_id: r["count"] for r in mixing.mixed(d).groupBy("doc_id").count().collect()} == want


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    mine = mixing.op3_source_mixing(spark, sf)
    theirs = con.execute(mixing.SQL).df()[mine.columns]
    assert sorted(map(tuple, mine.toPandas().values.tolist())) == sorted(map(tuple, theirs.values.tolist()))
