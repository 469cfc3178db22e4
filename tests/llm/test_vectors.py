import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def sample(seed=5, n=160, dims=8):
    rng = np.random.RandomState(seed)
    rows = []
    for i in range(n):
        v = rng.randn(dims) if i % 4 == 0 else np.array(rows[-1][1], float) + rng.randn(dims) * 0.25
        rows.append((i * 7, [float(np.float32(x)) for x in v], int(rng.randint(3))))
    rows += [(5000 + i, rows[3][1], rows[3][2]) for i in range(6)]  # copies
    rows += [(6000, None, 1), (6001, [0.0] * dims, 1), (6002, [float("nan")] * dims, 1), (6003, [None] * dims, 1), (6004, rows[0][1], None), (6005, [float("inf"), *[1.0] * (dims - 1)], 1), (6006, [], 1), (6007, [1.0, 2.0], 1), (6008, [2.0, 4.0], 1)]
    return rows


def near(rows, least=0.93):
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    parent, n = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    p, q = sorted((find(a[0]), find(b[0])))
                    parent[q] = p
    return {i: (n[i], find(i), find(i) == i) for i in n}


def check_near(spark, rows, **options):
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "x", "key", "n", "root", "copies")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(d, **options).collect()}
    want = near(rows)
    assert got == want and any(v[0] for v in want.values())


def test_near_vectors(spark):
    check_near(spark, sample())


def test_near_vectors_over_many_nodes(spark):
    check_near(spark, sample(6, 400), top=7, node=64)


def test_near_vectors_without_a_sampled_label(spark):
    check_near(spark, sample(8), top=1)


def test_near_vectors_of_many_and_of_large_labels_without_a_sample(spark):
    """Three of four large labels and forty small ones have no vector in the top level; large ones are cut into nodes."""
    rng = np.random.RandomState(11)
    rows = []
    for i in range(700):
        v = rng.randn(8) if i % 5 == 0 else np.array(rows[-1][1], float) + rng.randn(8) * 0.2
        rows.append((i * 3, [float(np.float32(x)) for x in v], i // 150 if i < 600 else 10 + i % 40))
    check_near(spark, rows, top=1, node=64)


def test_a_node_that_meets_an_empty_one_counts_nothing():
    raw = np.ones((3, 4))
    ids, copies = np.arange(3), np.ones(3, np.int64)
    assert [len(x) for x in vectors._linked(ids, copies, raw, np.zeros(3, int), 0.93)] == [0, 0, 0]
    assert vectors._linked(ids, copies, raw, np.full(3, vectors.SELF), 0.93)[1].tolist() == [2, 2, 2]


def test_dual_traversal_prunes_and_includes():
    rng = np.random.RandomState(1)
    centres = rng.randn(12, 16)
    raw = np.repeat(centres, 40, axis=0) + rng.randn(480, 16) * 0.02
    units = raw / np.linalg.norm(raw, axis=1)[:, None]
    tree = vectors.tree(units)
    assert tree.kids
    links, looked = np.zeros((480, 480), bool), 0
    for a, b, m in vectors.threshold_pairs(raw, units, tree, tree, 0.93):
        links[np.ix_(a, b)] = True if m is None else m
        looked += 0 if m is None else m.size
    assert (links == (units @ units.T >= 0.93)).all() and looked < 480 * 480 / 2

    def radii(node):
        for kid in node.kids:
            assert kid.radius <= node.radius / 2 + 1e-12
            radii(kid)

    radii(tree)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.near_vectors(empty).count() == 0 and vectors.top_k(empty).count() == 0
    lone = spark.createDataFrame([(None, [1.0], 1), (3, None, 1)], SCHEMA)
    assert sorted(str(r.component_id) for r in vectors.near_vectors(lone).collect()) == ["3", "None"]


def best(rows, k=10):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in good:
        if q % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def test_top_k(spark):
    rows = sample(9, 300)
    rows += [(7000 + i, [1.0] * 8, 0) for i in range(15)]  # ties
    rows += [(9000, [3e7] * 8, 0), (9001, [-3e7] * 8, 0)]  # beyond exact doubles
    got = {tuple(r) for r in vectors.top_k(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)), bucket_rows=40, block_rows=2).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == best(rows) and got


def test_top_k_with_few_candidates(spark):
    rows = [(0, [1.0], 1), (1, [2.0], 1), (2, [0.5, 9.0], None)]
    assert {tuple(r) for r in vectors.top_k(spark.createDataFrame(rows, SCHEMA)).collect()} == best(rows)


def test_blocks_are_exact():
    rng = np.random.RandomState(3)
    rows, queries = rng.randint(-300, 300, (900, 50)).astype(float), rng.randint(-300, 300, (5, 50)).astype(float)
    ids = np.array(random.Random(1).sample(range(5000), 900))
    for q, near_ids, scores in vectors.best_by_blocks(queries, np.full(5, -1), rows, ids, 10, 8):
        s = rows @ queries[q]
        want = np.lexsort((ids, -s))[:10]
        assert near_ids.tolist() == ids[want].tolist() and scores.tolist() == s[want].astype(int).tolist()


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    for query, sql in ((vectors.op8_embedding_near_dedup, vectors.NEAR_SQL), (vectors.op9_exact_top_k, vectors.TOP_K_SQL)):
        mine = query(spark, sf)
        theirs = con.execute(sql).df()[mine.columns]
        assert sorted(map(tuple, mine.toPandas().values.tolist())) == sorted(map(tuple, theirs.values.tolist()))
