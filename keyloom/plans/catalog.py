"""Registered queries over the standard tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import keycodecs as K
from keyloom.functions import valuecodecs as V
from keyloom.operators.collection import Collection
from keyloom.operators.index import Index, Updater
from keyloom.plans.query import python_test
from keyloom.sources.store import Store
from keyloom.sources.tables import collection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "part": "p_partkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "url", "benchmark": "item_id", "embeddings": "vec_id", "conversations": ("conv_id", "turn")}


class Tables:
    """The tables of a folder as collections."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> Collection:
        return collection(self.spark, self.folder, name, KEYS[name])

    @property
    def lineitem(self) -> DataFrame:
        """Not a collection: its rows have no unique key, so it only stands left of a join."""
        return self.spark.read.parquet(f"{self.folder}/lineitem.parquet")

    @property
    def customer_orders(self) -> Index:
        return self.orders.derive(F.array("o_custkey"))

    @property
    def nation_customers(self) -> Index:
        return self.customer.derive(F.array("c_nationkey"))

    @property
    def part_words(self) -> Index:
        return self.part.derive(F.split("p_name", " "))


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Scans and filters.
CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


@query(f"SELECT {CUSTOMER} FROM customer")
def scan_all(t: Tables) -> DataFrame:
    return t.customer.query().to_df()


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_acctbal > 5000")
def where_value(t: Tables) -> DataFrame:
    return t.customer.query().where_value(lambda c: c("c_acctbal") > 5000).to_df(ordered=False)


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def where_value_and(t: Tables) -> DataFrame:
    q = t.customer.query().where_value(lambda c: c("c_acctbal") > 5000)
    return q.where_value(lambda c: c("c_mktsegment") == "BUILDING").to_df(ordered=False)


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_custkey IN (3, 77, 140)")
def where_key(t: Tables) -> DataFrame:
    return t.customer.query().where_key(lambda k: k.isin(3, 77, 140)).to_df()


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_custkey % 7 = 3 AND c_acctbal < 0")
def where_key_and_value(t: Tables) -> DataFrame:
    return t.customer.query().where_key(lambda k: k % 7 == 3).where_value(lambda c: c("c_acctbal") < 0).to_df()


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_mktsegment LIKE '%U%'")
def where_python(t: Tables) -> DataFrame:
    return t.customer.query().where_value(python_test(lambda s: s is not None and "U" in s, "c_mktsegment")).to_df()


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 50")
def start_after_fwd(t: Tables) -> DataFrame:
    return t.customer.query().start_after(100).limit(50).to_df()


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_custkey < 100 ORDER BY c_custkey DESC LIMIT 50")
def start_after_bwd(t: Tables) -> DataFrame:
    return t.customer.query().start_after(100).reverse().limit(50).to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > -5 ORDER BY o_orderkey LIMIT 10")
def start_after_absent(t: Tables) -> DataFrame:
    return t.orders.query().start_after(-5).limit(10).to_df().select("o_orderkey", "o_totalprice")


@query(f"SELECT {CUSTOMER} FROM customer ORDER BY c_custkey DESC LIMIT 20")
def reverse_limit(t: Tables) -> DataFrame:
    return t.customer.query().reverse().reverse().limit(20).to_df()


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 20")
def limit_after_filter(t: Tables) -> DataFrame:
    return t.customer.query().where_value(lambda c: c("c_acctbal") > 5000).limit(5).limit(20).to_df()


@query("SELECT count(*)::BIGINT AS n FROM customer WHERE false")
def limit_zero(t: Tables) -> DataFrame:
    return t.customer.query().limit(0).to_df().agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (10, 1) ORDER BY conv_id, turn LIMIT 25")
def composite_start_after(t: Tables) -> DataFrame:
    return t.conversations.query().start_after((10, 1)).limit(25).to_df().select("conv_id", "turn", "role")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def stream_with_keys(t: Tables) -> DataFrame:
    return t.nation.query().to_df()


@query("SELECT n_name, n_regionkey FROM nation")
def stream_values(t: Tables) -> DataFrame:
    return t.nation.query().values_df()


# Points and steps.
@query(f"SELECT {CUSTOMER} FROM customer WHERE c_custkey = 42")
def fetch(t: Tables) -> DataFrame:
    return t.customer.fetch(42)


@query("SELECT count(*)::BIGINT AS n FROM customer WHERE c_custkey = -1")
def fetch_missing(t: Tables) -> DataFrame:
    return t.customer.fetch(-1).agg(F.count("*").alias("n"))


@query("SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 42")
def contains(t: Tables) -> DataFrame:
    return t.customer.contains(42)


@query("SELECT count(*) > 0 AS found FROM pages WHERE url = 'no such page'")
def contains_missing(t: Tables) -> DataFrame:
    return t.pages.contains("no such page")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 0 AND turn = 1")
def fetch_composite(t: Tables) -> DataFrame:
    return t.conversations.fetch((0, 1))


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn LIMIT 1")
def head_composite(t: Tables) -> DataFrame:
    return t.conversations.head()


@query(f"SELECT {CUSTOMER} FROM customer ORDER BY c_custkey OFFSET 17 LIMIT 1")
def fetch_at(t: Tables) -> DataFrame:
    return t.customer.fetch_at(17)


@query("SELECT count(*)::BIGINT AS n FROM customer WHERE false")
def fetch_at_negative(t: Tables) -> DataFrame:
    return t.customer.fetch_at(-1).agg(F.count("*").alias("n"))


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 1")
def head(t: Tables) -> DataFrame:
    return t.benchmark.head()


@query("SELECT item_id, text FROM benchmark ORDER BY item_id DESC LIMIT 1")
def last(t: Tables) -> DataFrame:
    return t.benchmark.last()


@query("SELECT item_id, text FROM benchmark WHERE item_id > 7 ORDER BY item_id LIMIT 1")
def next_key(t: Tables) -> DataFrame:
    return t.benchmark.next(7)


@query("SELECT item_id, text FROM benchmark WHERE item_id < 7 ORDER BY item_id DESC LIMIT 1")
def previous_key(t: Tables) -> DataFrame:
    return t.benchmark.previous(7)


@query("SELECT count(*)::BIGINT AS n FROM benchmark WHERE item_id > (SELECT max(item_id) FROM benchmark)")
def next_past_end(t: Tables) -> DataFrame:
    return t.benchmark.next(1 << 60).agg(F.count("*").alias("n"))


@query("SELECT page_id, url FROM pages WHERE url > 'https' ORDER BY url LIMIT 1")
def next_text_key(t: Tables) -> DataFrame:
    return t.pages.next("https").select("page_id", "url")


@query("SELECT count(*)::BIGINT AS n FROM orders")
def collection_size(t: Tables) -> DataFrame:
    return t.orders.df.agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT DISTINCT event_id AS k FROM events) SELECT k, p.o_orderkey AS previous, n.o_orderkey AS next FROM k ASOF LEFT JOIN orders AS p ON k.k > p.o_orderkey ASOF LEFT JOIN orders AS n ON k.k < n.o_orderkey")
def neighbours(t: Tables) -> DataFrame:
    asked = t.events.df.select(F.col("event_id").alias("k"))
    return t.orders.neighbours(asked, "k")


# Indexes.
@query("SELECT DISTINCT o_custkey AS ik, o_orderkey AS tk FROM orders")
def index_build(t: Tables) -> DataFrame:
    return t.customer_orders.df


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS ik, p_partkey AS tk FROM part")
def index_multi(t: Tables) -> DataFrame:
    return t.part_words.df


@query("SELECT DISTINCT c_mktsegment AS ik, c_nationkey AS tk FROM customer")
def index_full(t: Tables) -> DataFrame:
    return t.customer.derive_full(F.array(F.struct(F.col("c_mktsegment").alias("ik"), F.col("c_nationkey").alias("tk")))).df


@query("SELECT DISTINCT o_custkey AS ik, o_orderkey AS tk FROM orders")
def index_duplicates(t: Tables) -> DataFrame:
    pairs = t.orders.df.select(F.col("o_custkey").alias("ik"), F.col("o_orderkey").alias("tk"))
    return Index.of(pairs).index(pairs).index(pairs).df


@query("SELECT o_custkey AS ik, o_orderkey AS tk FROM orders WHERE o_orderkey % 2 = 0")
def index_unindex(t: Tables) -> DataFrame:
    pairs = t.orders.df.select(F.col("o_custkey").alias("ik"), F.col("o_orderkey").alias("tk"))
    return Index.of(pairs).unindex(pairs.where("tk % 2 <> 0"))[0].df


@query("SELECT o_custkey AS ik, o_orderkey AS tk FROM orders WHERE o_custkey = 10")
def index_lookup(t: Tables) -> DataFrame:
    return t.customer_orders.indexed(10)


@query("SELECT o_custkey AS ik, o_orderkey AS tk FROM orders WHERE o_custkey >= 10")
def index_continue(t: Tables) -> DataFrame:
    return t.customer_orders.indexed(10, limit_to_key=False)


@query("SELECT 0::BIGINT AS n")
def index_continue_missing(t: Tables) -> DataFrame:
    return t.customer_orders.indexed(-10, limit_to_key=False).agg(F.count("*").alias("n"))


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_custkey = 10")
def index_has_key(t: Tables) -> DataFrame:
    return t.customer_orders.has_key(10)


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_custkey = 10 AND o_orderkey = 11")
def index_contains(t: Tables) -> DataFrame:
    return t.customer_orders.contains(10, 11)


@query("SELECT count(*) > 0 AS found FROM orders AS o JOIN (SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1) AS f USING (o_custkey, o_orderkey)")
def index_contains_present(t: Tables) -> DataFrame:
    first = t.orders.head().first()
    return t.customer_orders.contains(first.o_custkey, first.o_orderkey)


@query("SELECT min(o_orderkey) AS tk FROM orders WHERE o_custkey = 10")
def index_fetch(t: Tables) -> DataFrame:
    return t.customer_orders.fetch(10)


@query("SELECT o_custkey AS ik, o_orderkey AS tk FROM orders ORDER BY 1, 2 OFFSET 25 LIMIT 1")
def index_fetch_at(t: Tables) -> DataFrame:
    return t.customer_orders.fetch_at(25)


@query("SELECT o_custkey AS ik, o_orderkey AS tk FROM orders ORDER BY 1, 2 LIMIT 1")
def index_fetch_at_negative(t: Tables) -> DataFrame:
    return t.customer_orders.fetch_at(-3)


@query("SELECT o_custkey AS ik, o_orderkey AS tk FROM orders ORDER BY 1, 2 LIMIT 1")
def index_head(t: Tables) -> DataFrame:
    return t.customer_orders.head()


@query("SELECT o_custkey AS ik, o_orderkey AS tk FROM orders ORDER BY 1 DESC, 2 DESC LIMIT 1")
def index_last(t: Tables) -> DataFrame:
    return t.customer_orders.last()


@query("SELECT o_custkey AS ik, o_orderkey AS tk FROM orders WHERE o_custkey >= 10 ORDER BY 1, 2 OFFSET 1 LIMIT 1")
def index_next(t: Tables) -> DataFrame:
    return t.customer_orders.next(10)


@query("SELECT o_custkey AS ik, o_orderkey AS tk FROM orders WHERE o_custkey < 10 ORDER BY 1 DESC, 2 DESC LIMIT 1")
def index_previous(t: Tables) -> DataFrame:
    return t.customer_orders.previous(10)


@query("SELECT o_orderkey AS tk FROM orders WHERE o_custkey = 10 AND o_orderkey % 2 = 0 ORDER BY 1 LIMIT 3")
def index_target_filter_limit(t: Tables) -> DataFrame:
    return t.customer_orders.query(10).where_target_key(lambda k: k % 2 == 0).limit(3).to_df()


@query("SELECT p_partkey AS tk FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS ik, p_partkey FROM part) WHERE ik >= (SELECT max(string_split(p_name, ' ')[1]) FROM part WHERE p_name <= 'm')")
def index_targets_onward(t: Tables) -> DataFrame:
    word = t.part.df.where("p_name <= 'm'").agg(F.max(F.split("p_name", " ")[0])).first()[0]
    return t.part_words.query(word).proceed().to_df(ordered=False)


# Joins.
class _Side:
    """A side of a joined query; columns can only be made once Spark runs."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __getitem__(self, field: str) -> Column:
        return F.col(self.name)[field]

    def alias(self, name: str) -> Column:
        return F.col(self.name).alias(name)


L, R = _Side("left"), _Side("right")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10")
def index_join(t: Tables) -> DataFrame:
    return t.customer_orders.query(10).join(t.orders).to_df().select(L.alias("o_orderkey"), R["o_totalprice"].alias("o_totalprice"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_by_key(t: Tables) -> DataFrame:
    j = t.orders.query().join_by_key(t.customer, lambda o: o["o_custkey"])
    return j.to_df(ordered=False).select(L["o_orderkey"].alias("o_orderkey"), R["c_name"].alias("c_name"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id")
def join_by_key_dangling(t: Tables) -> DataFrame:
    j = t.documents.query().join_by_key(t.labels, lambda d: d["doc_id"])
    return j.to_df(ordered=False).select(L["doc_id"].alias("doc_id"), L["lang"].alias("lang"), R["quality"].alias("quality"))


@query("SELECT d.doc_id, l.toxic FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50) AS d JOIN labels AS l ON d.doc_id = l.doc_id")
def join_limit_left(t: Tables) -> DataFrame:
    j = t.documents.query().limit(50).join_by_key(t.labels, lambda d: d["doc_id"])
    return j.to_df().select(L["doc_id"].alias("doc_id"), R["toxic"].alias("toxic"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'")
def join_by_index(t: Tables) -> DataFrame:
    j = t.customer.query().where_value(lambda c: c("c_mktsegment") == "MACHINERY").join_by_index(t.orders, t.customer_orders, lambda c: c["c_custkey"])
    return j.to_df(ordered=False).select(L["c_custkey"].alias("c_custkey"), R["o_orderkey"].alias("o_orderkey"), R["o_totalprice"].alias("o_totalprice"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000")
def chain_keys(t: Tables) -> DataFrame:
    j = t.orders.query().where_value(lambda c: c("o_totalprice") > 100000).join_by_key(t.customer, lambda o: o["o_custkey"])
    j = j.join_by_key(t.nation, lambda _, c: c["c_nationkey"]).join_by_key(t.region, lambda _, n: n["n_regionkey"])
    order = L["left"]["left"]
    return j.to_df(ordered=False).select(order["o_orderkey"].alias("o_orderkey"), L["left"]["right"]["c_name"].alias("c_name"), L["right"]["n_name"].alias("n_name"), R["r_name"].alias("r_name"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity >= 45")
def chain_lineitem(t: Tables) -> DataFrame:
    lines = Collection.of(t.lineitem.where("l_quantity >= 45"), ("l_orderkey", "l_linenumber"), "lineitem")
    j = lines.query().join_by_key(t.orders, lambda x: x["l_orderkey"]).join_by_key(t.customer, lambda _, o: o["o_custkey"]).join_by_key(t.nation, lambda _, c: c["c_nationkey"])
    line = L["left"]["left"]
    return j.to_df(ordered=False).select(*[line[c].alias(c) for c in ("l_orderkey", "l_linenumber", "l_quantity")], L["right"]["c_name"].alias("c_name"), R["n_name"].alias("n_name"))


@query("SELECT n_name, c_custkey, o_orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 2")
def chain_index(t: Tables) -> DataFrame:
    j = t.nation.query().where_value(lambda c: c("n_regionkey") == 2).join_by_index(t.customer, t.nation_customers, lambda n: n["n_nationkey"])
    j = j.join_by_index(t.orders, t.customer_orders, lambda _, c: c["c_custkey"])
    return j.to_df(ordered=False).select(L["left"]["n_name"].alias("n_name"), L["right"]["c_custkey"].alias("c_custkey"), R["o_orderkey"].alias("o_orderkey"))


@query("SELECT c_custkey, r_name, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def chain_mixed(t: Tables) -> DataFrame:
    j = t.customer.query().where_value(lambda c: c("c_acctbal") > 9000).join_by_key(t.nation, lambda c: c["c_nationkey"]).join_by_key(t.region, lambda _, n: n["n_regionkey"])
    j = j.join_by_index(t.orders, t.customer_orders, lambda left, _: left["left"]["c_custkey"])
    return j.to_df(ordered=False).select(L["left"]["left"]["c_custkey"].alias("c_custkey"), L["right"]["r_name"].alias("r_name"), R["o_orderkey"].alias("o_orderkey"))


@query("SELECT o_orderkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 20 * c_acctbal AND c_acctbal > 1000")
def joined_filter(t: Tables) -> DataFrame:
    j = t.orders.query().join_by_key(t.customer, lambda o: o["o_custkey"])
    j = j.filter(lambda o, c: o["o_totalprice"] > 20 * c["c_acctbal"]).filter(lambda _, c: c["c_acctbal"] > 1000)
    return j.to_df(ordered=False).select(L["o_orderkey"].alias("o_orderkey"), L["o_totalprice"].alias("o_totalprice"), R["c_acctbal"].alias("c_acctbal"))


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_supplier_nation(t: Tables) -> DataFrame:
    j = t.supplier.query().join_by_key(t.nation, lambda s: s["s_nationkey"])
    return j.to_df(ordered=False).select(L["s_suppkey"].alias("s_suppkey"), L["s_name"].alias("s_name"), R["n_name"].alias("n_name"))


# Writes.
_BATCH = "SELECT c_custkey, 'new' AS c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0"


def _batch(t: Tables) -> DataFrame:
    return t.customer.df.where("c_custkey % 10 = 0").withColumn("c_name", F.lit("new")).withColumn("c_acctbal", F.col("c_acctbal") + 1)


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_custkey % 10 <> 0 UNION ALL {_BATCH}")
def upsert_overwrite(t: Tables) -> DataFrame:
    return t.customer.upsert_overwrite(_batch(t)).df


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'third' ELSE n_name END AS n_name, n_regionkey FROM nation")
def upsert_overwrite_sequence(t: Tables) -> DataFrame:
    some = t.nation.df.where("n_nationkey < 5")
    batch = some.withColumn("v", F.explode(F.array(F.struct(F.lit(3).alias("n"), F.lit("third").alias("s")), F.struct(F.lit(1).alias("n"), F.lit("first").alias("s")))))
    return t.nation.upsert_overwrite(batch.select("n_nationkey", F.col("v.s").alias("n_name"), "n_regionkey", F.col("v.n").alias("seq")), "seq").df


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'made', 0")
def upsert_modify(t: Tables) -> DataFrame:
    keys = t.nation.df.where("n_nationkey < 3").select("n_nationkey").unionByName(t.spark.createDataFrame([(100,)], "n_nationkey int"))
    new = lambda old, here: {"n_name": F.when(here, F.concat(F.upper(old("n_name")), F.lit("!"))).otherwise("made"), "n_regionkey": F.coalesce(old("n_regionkey"), F.lit(0))}
    return t.nation.upsert(keys, new)[0].df


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_existing(t: Tables) -> DataFrame:
    keys = t.spark.createDataFrame([(0,), (1,), (2,), (100,)], "n_nationkey int")
    return t.nation.update(keys, lambda old: {"n_name": F.lower(old("n_name"))})[0].df


@query("SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation WHERE n_nationkey < 3")
def update_returning(t: Tables) -> DataFrame:
    keys = t.spark.createDataFrame([(0,), (1,), (2,), (100,)], "n_nationkey int")
    return t.nation.update(keys, lambda old: {"n_name": F.lower(old("n_name"))})[1]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0")
def delete_keys(t: Tables) -> DataFrame:
    return t.orders.delete(t.orders.df.where("o_orderkey % 3 = 0"))[0].df.select("o_orderkey", "o_custkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey IN (1, 2)")
def delete_returning(t: Tables) -> DataFrame:
    return t.nation.delete(t.spark.createDataFrame([(1,), (2,), (500,)], "n_nationkey int"))[1]


@query("SELECT 0::BIGINT AS n")
def clear(t: Tables) -> DataFrame:
    return t.nation.clear().df.agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CASE WHEN n_nationkey < 5 THEN 4 ELSE n_regionkey END AS ik, n_nationkey AS tk FROM nation")
def index_after_update(t: Tables) -> DataFrame:
    c = t.nation.with_index("by_region", F.array("n_regionkey")).rebuild_indexes()
    return c.upsert_overwrite(t.nation.df.where("n_nationkey < 5").withColumn("n_regionkey", F.lit(4))).index("by_region").df


@query("SELECT n_regionkey AS ik, n_nationkey AS tk FROM nation WHERE n_nationkey >= 5")
def index_after_delete(t: Tables) -> DataFrame:
    c = t.nation.with_index("by_region", F.array("n_regionkey")).rebuild_indexes()
    return c.delete(t.nation.df.where("n_nationkey < 5"))[0].index("by_region").df


@query("SELECT n_regionkey AS ik, n_nationkey AS tk FROM nation")
def index_rebuild(t: Tables) -> DataFrame:
    return t.nation.with_index("by_region", F.array("n_regionkey")).rebuild_indexes().index("by_region").df


@query("SELECT DISTINCT n_regionkey AS ik, n_regionkey * 10 AS tk FROM nation WHERE n_regionkey <> (SELECT n_regionkey FROM nation WHERE n_nationkey = 0)")
def index_collision(t: Tables) -> DataFrame:
    # Several nations imply one pair; when one of them goes, the pair goes.
    pairs = F.array(F.struct(F.col("n_regionkey").alias("ik"), (F.col("n_regionkey") * 10).alias("tk")))
    c = t.nation.with_index_full("regions", pairs).rebuild_indexes()
    return c.delete(t.nation.df.where("n_nationkey = 0"))[0].index("regions").df


@query("SELECT c_mktsegment AS ik, c_custkey AS tk FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'updated', c_custkey FROM customer WHERE c_custkey % 3 = 1")
def index_updater(t: Tables) -> DataFrame:
    # An index of its own making: rows by segment, and by a word of their own once they were changed.
    by = lambda df, ik: df.select(ik.alias("ik"), F.col("c_custkey").alias("tk"))
    segment = F.col("c_mktsegment")
    updater = Updater(lambda i, new: i.index(by(new, segment)), lambda i, old: i.unindex(by(old, segment))[0], lambda i, _, new: i.index(by(new, F.lit("updated"))))
    rows = t.customer.df
    c = t.customer.with_updater("by_segment", Index(by(rows.limit(0), segment)), updater).rebuild_indexes()
    c, _ = c.delete(rows.where("c_custkey % 3 = 0"))
    return c.upsert_overwrite(rows.where("c_custkey % 3 = 1").withColumn("c_acctbal", F.col("c_acctbal") + 1)).index("by_segment").df


@query("SELECT 0::BIGINT AS rows, 0::BIGINT AS pairs")
def clear_indexed(t: Tables) -> DataFrame:
    c = t.nation.with_index("by_region", F.array("n_regionkey")).rebuild_indexes().clear()
    return c.df.agg(F.count("*").alias("rows")).crossJoin(c.index("by_region").df.agg(F.count("*").alias("pairs")))


# Stores and transactions.
def _store(t: Tables) -> Store:
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # only a session on one machine may use that machine's disk
        if not t.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return Store.open(t.spark, base, f"store-{uuid.uuid4().hex}")


def _nations(t: Tables, store: Store):  # noqa: ANN202
    nation = store.collection_create("nation", "n_nationkey", t.nation.df.schema)
    store.index_create("by_region", "int", "int")
    nation = nation.with_index("by_region", F.array("n_regionkey"))
    nation.upsert_overwrite(t.nation.df)
    return nation


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def txn_rollback(t: Tables) -> DataFrame:
    store = _store(t)
    nation = _nations(t, store)
    try:
        with nation.read_write() as n:
            n.delete([1, 2, 3])
            n.clear()
            raise KeyError("changed my mind")
    except KeyError:
        pass
    return nation.now().df


@query("SELECT 'inside' AS seen, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'after', count(*) - 3 FROM nation")
def txn_snapshot(t: Tables) -> DataFrame:
    store = _store(t)
    nation = _nations(t, store)
    with nation.read_only() as before:
        nation.delete([1, 2, 3])
        inside = before.now().df.agg(F.lit("inside").alias("seen"), F.count("*").alias("n"))
    return inside.unionByName(nation.now().df.agg(F.lit("after").alias("seen"), F.count("*").alias("n")))


@query("SELECT 'nation' AS name, count(*)::BIGINT AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'pairs', count(*) FROM nation WHERE n_regionkey <> 1")
def txn_multi(t: Tables) -> DataFrame:
    store = _store(t)
    nation, region = _nations(t, store), store.collection_create("region", "r_regionkey", t.region.df.schema)
    region.upsert_overwrite(t.region.df)
    with store.read_write() as txn:
        n, r = txn.lift(nation), txn.lift(region)
        r.delete([1])
        n.delete(n.now().df.where("n_regionkey = 1"))
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count(nation.now().df, "nation").unionByName(count(region.now().df, "region")).unionByName(count(store.index_get("by_region").now().df, "pairs"))


@query("SELECT * FROM (VALUES ('by_region', 'index', (SELECT count(*) FROM nation)), ('nation', 'collection', (SELECT count(*) FROM nation))) AS v(name, kind, size)")
def store_catalog(t: Tables) -> DataFrame:
    store = _store(t)
    _nations(t, store)
    found = store.manifest(store.version())
    return t.spark.createDataFrame([(n, found[n]["kind"], found[n]["rows"]) for n in store.list_all()], "name string, kind string, size long")


# Key codecs.
_HASH = "md5('u' || event_id)"


@query(f"SELECT event_id, upper({_HASH}) AS bytes FROM events")
def uuid_bytes(t: Tables) -> DataFrame:
    return t.events.df.select("event_id", F.hex(K.uuid_to_bytes(_uuid(F.md5(F.concat(F.lit("u"), F.col("event_id").cast("string")))))).alias("bytes"))


def _uuid(h: Column) -> Column:
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS same FROM events")
def uuid_roundtrip(t: Tables) -> DataFrame:
    text = _uuid(F.md5(F.col("event_id").cast("string")))
    return t.events.df.agg(F.count("*").alias("n"), F.sum((K.bytes_to_uuid(K.uuid_to_bytes(text)) == text).cast("long")).alias("same"))


@query("SELECT event_id, hex(event_type::BLOB) || '00' || hex(md5(event_id::VARCHAR)::BLOB) AS bytes FROM events")
def pair_key_hex(t: Tables) -> DataFrame:
    pair = F.struct(F.col("event_type").alias("a"), F.md5(F.col("event_id").cast("string")).alias("b"))
    return t.events.df.select("event_id", F.hex(K.pair_key(K.string_key, K.string_key).encode(pair)).alias("bytes"))


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS same FROM conversations")
def pair_roundtrip(t: Tables) -> DataFrame:
    codec = K.pair_key(K.string_key, K.uuid_key)
    zeros = F.concat("role", F.unhex(F.lit("00")).cast("string"), F.col("turn").cast("string"))
    pair = F.struct(zeros.alias("a"), _uuid(F.concat(F.lit("0"), F.substring(F.md5("text"), 2, 31))).alias("b"))
    return t.conversations.df.agg(F.count("*").alias("n"), F.sum((codec.decode(codec.encode(pair)) == pair).cast("long")).alias("same"))


@query("SELECT event_id, printf('%016X', epoch_us(ts) // 1000000 + 9223372036854775808::UBIGINT::HUGEINT) || printf('%08X', epoch_us(ts) % 1000000 * 1000) AS bytes FROM events")
def timestamp_key_hex(t: Tables) -> DataFrame:
    return t.events.df.select("event_id", F.hex(K.instant_key.encode(K.instant(F.col("ts")))).alias("bytes"))


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS same FROM events")
def timestamp_roundtrip(t: Tables) -> DataFrame:
    back = K.instant_timestamp(K.instant_key.decode(K.instant_key.encode(K.instant(F.col("ts")))))
    return t.events.df.agg(F.count("*").alias("n"), F.sum((back == F.col("ts").cast("timestamp")).cast("long")).alias("same"))


_LAT, _LON = "(c_custkey * 37 % 18000) / 100.0 - 90", "(c_custkey * 101 % 36000) / 100.0 - 180"


def _point(t: Tables) -> DataFrame:
    return t.customer.df.select("c_custkey", ((F.col("c_custkey") * 37 % 18000) / 100.0 - 90).alias("lat"), ((F.col("c_custkey") * 101 % 36000) / 100.0 - 180).alias("lon"))


@query(f"""WITH p AS (SELECT c_custkey, trunc((({_LAT})::DOUBLE + 90.0) / 180.0::DOUBLE * 4294967295.0::DOUBLE)::BIGINT AS y, trunc((({_LON})::DOUBLE + 180.0) / 360.0::DOUBLE * 4294967295.0::DOUBLE)::BIGINT AS x FROM customer),
b AS (SELECT c_custkey, x, y, unnest(range(32)) AS i FROM p)
SELECT c_custkey, printf('%016X', sum((((x >> i) & 1)::HUGEINT << (2 * i)) + (((y >> i) & 1)::HUGEINT << (2 * i + 1)))::HUGEINT) AS bytes FROM b GROUP BY c_custkey""")
def geo_zkey_hex(t: Tables) -> DataFrame:
    return _point(t).select("c_custkey", F.hex(K.location_bytes(F.col("lat"), F.col("lon"))).alias("bytes"))


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS near FROM customer")
def geo_roundtrip(t: Tables) -> DataFrame:
    p = _point(t).withColumn("back", K.bytes_location(K.location_bytes(F.col("lat"), F.col("lon"))))
    near = (F.abs(F.col("back.lat") - F.col("lat")) < 1e-7) & (F.abs(F.col("back.lon") - F.col("lon")) < 1e-7)
    return p.agg(F.count("*").alias("n"), F.sum(near.cast("long")).alias("near"))


@query()
def geo_cells(t: Tables) -> DataFrame:
    return _point(t).groupBy(F.hex(K.location_cell(K.location_bytes(F.col("lat"), F.col("lon")), 2)).alias("cell")).agg(F.count("*").alias("n"))


@query()
def collation_order(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    words = t.part.df.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", F.row_number().over(Window.orderBy(K.collated(F.col("word")), "word")).alias("place"))


@query("SELECT event_id, md5('l' || event_id) AS bytes FROM events")
def ulid_roundtrip(t: Tables) -> DataFrame:
    b = F.unhex(F.md5(F.concat(F.lit("l"), F.col("event_id").cast("string"))))
    return t.events.df.select("event_id", F.lower(F.hex(K.ulid_to_bytes(K.bytes_to_ulid(b)))).alias("bytes"))


@query("SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS millis, 7 AS version FROM events")
def uuidv7_from_instant(t: Tables) -> DataFrame:
    u = K.uuidv7_of(F.col("ts").cast("timestamp"), F.md5(F.col("event_id").cast("string")))
    return t.events.df.select("event_id", K.uuidv7_millis(u).alias("millis"), K.uuidv7_version(u).alias("version"))


# Value codecs.
@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_value_decode(t: Tables) -> DataFrame:
    return t.events.df.select("event_id", V.record_decode(F.col("props"), "k bigint")["k"].alias("k"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_any_decode(t: Tables) -> DataFrame:
    return t.events.df.select("event_id", F.variant_get(V.any_decode(F.col("props")), "$.k", "bigint").alias("k"))


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS same FROM conversations")
def json_text_roundtrip(t: Tables) -> DataFrame:
    same = V.text_decode(V.text_encode(F.col("text"))) == F.col("text")
    return t.conversations.df.agg(F.count("*").alias("n"), F.sum(same.cast("long")).alias("same"))


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: customers of a segment, their orders through an index, and each order's customer's nation."""
    t = Tables(spark, Path(folder).as_posix() if "://" not in folder else folder)
    j = t.customer.query().where_value(lambda c: c("c_mktsegment") == "BUILDING").join_by_index(t.orders, t.customer_orders, lambda c: c["c_custkey"])
    j = j.join_by_key(t.nation, lambda c, _: c["c_nationkey"])
    return j.to_df().select(L["left"]["c_name"].alias("c_name"), L["right"]["o_orderkey"].alias("o_orderkey"), L["right"]["o_totalprice"].alias("o_totalprice"), R["n_name"].alias("n_name"))
