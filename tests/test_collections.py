"""Scans, points, steps, indexes, queries and joins on small literal tables."""

import pytest
from pyspark.sql import functions as F

from keyloom.operators.collection import Collection
from keyloom.operators.index import Index
from keyloom.plans.query import python_test

PEOPLE = [("p1", "Ana", 25, True), ("p2", "Bo", 40, True), ("p3", "Cy", 28, False), ("p4", "Di", 31, True), ("p5", "Ed", 27, False)]
NOTES = [("n1", "p1", "one"), ("n2", "p1", "two"), ("n3", "p2", "three"), ("n4", "p4", "four")]
REPLIES = [("r1", "n1", "a"), ("r2", "n1", "b"), ("r3", "n3", "c"), ("r4", "n4", "d")]


@pytest.fixture(scope="module")
def people(spark):
    return Collection.of(spark.createDataFrame(PEOPLE, "id string, name string, age int, active boolean"), "id", "people")


@pytest.fixture(scope="module")
def notes(spark):
    return Collection.of(spark.createDataFrame(NOTES, "id string, author string, title string"), "id", "notes")


@pytest.fixture(scope="module")
def replies(spark):
    return Collection.of(spark.createDataFrame(REPLIES, "id string, note string, text string"), "id", "replies")


@pytest.fixture(scope="module")
def letters(spark):
    return Collection.of(spark.createDataFrame([(chr(65 + i), i) for i in range(26)], "k string, v int"), "k")


def ids(rows):
    return [r.id for r in rows]


def test_filters_add_up(people):
    assert len(people.query().to_list()) == 5
    assert ids(people.query().where_value(lambda c: c("age") > 30).to_df().collect()) == ["p2", "p4"]
    assert ids(people.query().where_key(lambda k: k.isin("p1", "p5")).to_df().collect()) == ["p1", "p5"]
    q = people.query().where_value(lambda c: c("active")).where_value(lambda c: c("age") < 30)
    assert ids(q.to_df().collect()) == ["p1"]
    assert ids(people.query().where_value(python_test(lambda n: n.startswith("D"), "name")).to_df().collect()) == ["p4"]


def test_limit_counts_what_passes_and_last_call_counts(people):
    q = people.query().where_value(lambda c: ~c("active")).limit(5).limit(1)
    assert ids(q.to_df().collect()) == ["p3"]
    assert people.query().limit(0).to_list() == [] == people.query().limit(-2).to_list()


def test_reverse_does_not_toggle(people):
    assert ids(people.query().reverse().reverse().to_df().collect()) == ["p5", "p4", "p3", "p2", "p1"]
    assert ids(people.query().reverse().limit(2).to_df().collect()) == ["p5", "p4"]


def test_start_after_both_ways(letters):
    assert [r.v for r in letters.query().start_after("D").reverse().to_list()] == [2, 1, 0]
    assert [r.v for r in letters.query().start_after("A").start_after("T").to_list()] == list(range(20, 26))
    assert [r.v for r in letters.query().start_after("D5").limit(1).to_list()] == [4]


def test_values_and_keys(people):
    assert people.query().values_df().columns == ["name", "age", "active"]
    assert next(people.query().to_stream_with_keys()).id == "p1"
    assert next(people.query().to_stream()).name == "Ana"
    assert people.collect(limit=1)[0].name == "Ana"
    assert [r.name for r in people.stream()][:2] == ["Ana", "Bo"]


def test_text_keys_order_by_bytes(spark):
    c = Collection.of(spark.createDataFrame([(k,) for k in ["id2", "id10", "B", "b", "é", "z"]], "k string"), "k")
    assert [r.k for r in c.query().to_df().collect()] == ["B", "b", "id10", "id2", "z", "é"]


def test_points_and_steps(letters):
    assert letters.fetch("C").first().v == 2 and letters.fetch("nope").first() is None
    assert letters.contains("C").first().found and not letters.contains("nope").first().found
    assert letters.head().first().k == "A" and letters.last().first().k == "Z"
    assert letters.next("A").first().k == "B" and letters.next("Z").first() is None
    assert letters.previous("B").first().k == "A" and letters.previous("A").first() is None
    assert letters.next("A5").first().k == "B" and letters.previous("A5").first().k == "A"
    assert letters.fetch_at(0).first().k == "A" and letters.fetch_at(25).first().k == "Z"
    assert letters.fetch_at(26).first() is None and letters.fetch_at(-1).first() is None
    assert letters.size() == 26


def test_empty_collection(spark):
    c = Collection.of(spark.createDataFrame([], "k string, v int"), "k")
    assert c.head().first() is None and c.last().first() is None and c.next("a").first() is None
    assert c.query().to_list() == [] and c.size() == 0 and not c.contains("a").first().found


def test_composite_keys(spark):
    c = Collection.of(spark.createDataFrame([(a, b, a * b) for a in range(3) for b in range(3)], "a int, b int, v int"), ("a", "b"))
    assert [(r.a, r.b) for r in c.query().start_after((1, 1)).to_df().collect()] == [(1, 2), (2, 0), (2, 1), (2, 2)]
    assert [(r.a, r.b) for r in c.query().start_after((1, 1)).reverse().to_df().collect()] == [(1, 0), (0, 2), (0, 1), (0, 0)]
    assert c.fetch((2, 2)).first().v == 4


def test_neighbours(spark):
    c = Collection.of(spark.createDataFrame([(k,) for k in range(0, 1000, 10)], "k long"), "k")
    asked = [-5, 0, 5, 10, 500, 501, 990, 991, 5000]
    got = {r.k: (r.previous, r.next) for r in c.neighbours(spark.createDataFrame([(x,) for x in asked], "k long"), "k").collect()}
    have = list(range(0, 1000, 10))
    assert got == {x: (max((h for h in have if h < x), default=None), min((h for h in have if h > x), default=None)) for x in asked}


@pytest.fixture(scope="module")
def groups(spark):
    return Index.of(spark.createDataFrame([("A", "2"), ("A", "1"), ("B", "3"), ("A", "1")], "ik string, tk string"))


def pair(df):
    r = df.first()
    return r and (r.ik, r.tk)


def test_index_navigation(groups):
    assert groups.df.count() == 3
    assert pair(groups.head()) == ("A", "1") and pair(groups.last()) == ("B", "3")
    assert pair(groups.next("A")) == ("A", "2") and groups.next("B").first() is None
    assert pair(groups.next("A5")) is None or pair(groups.next("A5")) == ("B", "3")
    assert pair(groups.previous("B")) == ("A", "2") and groups.previous("A").first() is None
    assert groups.fetch("A").first().tk == "1" and groups.fetch("C").first() is None
    assert [pair(groups.fetch_at(i)) for i in (-1, 0, 1, 2, 3)] == [("A", "1"), ("A", "1"), ("A", "2"), ("B", "3"), None]
    assert groups.contains("A", "2").first().found and not groups.contains("B", "2").first().found
    assert groups.has_key("B").first().found and not groups.has_key("C").first().found


def test_indexed_stops_or_goes_on(groups):
    assert [tuple(r) for r in groups.indexed("A").collect()] == [("A", "1"), ("A", "2")]
    assert len(groups.indexed("A", limit_to_key=False).collect()) == 3
    assert groups.indexed("0", limit_to_key=False).collect() == [] == groups.indexed("0").collect()


def test_index_is_a_set(spark, groups):
    more = spark.createDataFrame([("A", "1"), ("C", "9")], "ik string, tk string")
    assert groups.index(more).index(more).df.count() == 4
    less, there = groups.unindex(more)
    assert less.df.count() == 2 and [tuple(r) for r in there.collect()] == [("A", "1")]
    assert groups.clear().df.count() == 0


def test_index_query(groups, spark):
    assert groups.query("A").to_list() == ["1", "2"]
    assert groups.query("A").where_target_key(lambda k: k > "1").to_list() == ["2"]
    assert groups.query("A").limit(1).to_list() == ["1"] and groups.query("A").limit(0).to_list() == []
    assert groups.query("A").proceed().to_list() == ["1", "2", "3"]
    right = Collection.of(spark.createDataFrame([("2", "x"), ("3", "y")], "id string, v string"), "id")
    # A target that leads nowhere counts for the limit.
    assert [(r.left, r.right.v) for r in groups.query("A").proceed().limit(2).join(right).to_list()] == [("2", "x")]


def test_join_by_key_keeps_left_order(people, notes):
    j = notes.query().reverse().join_by_key(people, lambda n: n["author"]).to_list()
    assert [(r.left.id, r.right.id) for r in j] == [("n4", "p4"), ("n3", "p2"), ("n2", "p1"), ("n1", "p1")]


def test_limit_applies_before_the_join(people, notes):
    j = people.query().limit(2).join_by_index(notes, notes.derive(F.array("author")), lambda p: p["id"]).to_list()
    assert [(r.left.id, r.right.id) for r in j] == [("p1", "n1"), ("p1", "n2"), ("p2", "n3")]


def test_chains(people, notes, replies):
    up = replies.query().join_by_key(notes, lambda r: r["note"]).join_by_key(people, lambda _, n: n["author"]).to_list()
    assert [(r.left.left.id, r.left.right.id, r.right.id) for r in up] == [("r1", "n1", "p1"), ("r2", "n1", "p1"), ("r3", "n3", "p2"), ("r4", "n4", "p4")]
    by_author, by_note = notes.derive(F.array("author")), replies.derive(F.array("note"))
    down = people.query().where_value(lambda c: c("active")).join_by_index(notes, by_author, lambda p: p["id"]).join_by_index(replies, by_note, lambda _, n: n["id"])
    assert [r.right.id for r in down.to_list()] == ["r1", "r2", "r3", "r4"]
    assert [r.right.id for r in down.filter(lambda left, r: (left["left"]["age"] > 30) & (r["text"] != "d")).to_list()] == ["r3"]


def test_dangling_keys_drop_out(people, spark):
    left = Collection.of(spark.createDataFrame([(1, "p1"), (2, "nobody"), (3, None)], "k int, p string"), "k")
    assert [r.left.k for r in left.query().join_by_key(people, lambda x: x["p"]).to_list()] == [1]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS a", "id * 3 AS b").write.parquet(str(tmp_path / "t.parquet"))
    c = Collection.of(spark.read.parquet(str(tmp_path / "t.parquet")), "id")
    plan = c.query().start_after(5).where_value(lambda v: v("a") > 20).to_df(ordered=False).select("id")._jdf.queryExecution().toString()
    assert "GreaterThan(id,5)" in plan and "GreaterThan(a,20)" in plan and "ReadSchema: struct<id:bigint,a:bigint>" in plan


def test_writes(spark, people):
    batch = spark.createDataFrame([("p1", "X", 1, True, 1), ("p1", "Y", 2, True, 2), ("p9", "Z", 3, False, 1)], "id string, name string, age int, active boolean, seq int")
    after = people.upsert_overwrite(batch, "seq").df.collect()
    assert len(after) == 6 and {r.id: r.name for r in after}["p1"] == "Y"
    keys = spark.createDataFrame([("p1",), ("p0",)], "id string")
    both, new = people.upsert(keys, lambda old, here: {"age": F.coalesce(old("age"), F.lit(0)) + 1, "active": here})
    assert {r.id: (r.age, r.active) for r in new.collect()} == {"p1": (26, True), "p0": (1, False)} and both.size() == 6
    same, changed = people.update(keys, lambda old: {"age": old("age") + 1})
    assert [r.id for r in changed.collect()] == ["p1"] and same.size() == 5
    rest, gone = people.delete(keys)
    assert [r.name for r in gone.collect()] == ["Ana"] and rest.size() == 4
    assert people.clear().size() == 0


def test_indexes_follow_writes(spark, people):
    c = people.with_index("by_name", F.array("name")).rebuild_indexes()
    pairs = lambda c: sorted((r.ik, r.tk) for r in c.index("by_name").df.collect())
    assert len(pairs(c)) == 5
    c = c.upsert_overwrite(spark.createDataFrame([("p1", "Zoe", 25, True)], "id string, name string, age int, active boolean"))
    assert ("Zoe", "p1") in pairs(c) and ("Ana", "p1") not in pairs(c)
    c, _ = c.update(spark.createDataFrame([("p2",)], "id string"), lambda old: {"name": F.upper(old("name"))})
    assert ("BO", "p2") in pairs(c) and ("Bo", "p2") not in pairs(c)
    c, _ = c.delete(spark.createDataFrame([("p3",)], "id string"))
    assert len(pairs(c)) == 4
    assert c.clear().index("by_name").df.count() == 0


def test_null_and_many_index_keys(spark):
    c = Collection.of(spark.createDataFrame([(1, ["a", "b", None]), (2, None), (3, ["a", "a"])], "k int, tags array<string>"), "k")
    assert sorted((r.ik, r.tk) for r in c.derive(F.col("tags")).df.collect()) == [("a", 1), ("a", 3), ("b", 1)]


def test_pairs_are_not_counted(spark):
    c = Collection.of(spark.createDataFrame([(1, "x"), (2, "x")], "k int, g string"), "k")
    full = F.array(F.struct(F.col("g").alias("ik"), F.concat(F.lit("label-"), "g").alias("tk")))
    c = c.with_index_full("g", full).rebuild_indexes()
    assert c.index("g").df.count() == 1
    assert c.delete(spark.createDataFrame([(1,)], "k int"))[0].index("g").df.count() == 0
