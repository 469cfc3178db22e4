"""Repeated ids, scores beyond a long, and long lists of candidates."""

import time

from pyspark.sql import functions as F

from keyloom.llm import pii, simhash, vectors


def test_queries_that_share_an_id(spark):
    v = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [5.0, 1.0]), (2, [1.0, 5.0])], "vec_id long, embedding array<float>")
    got = vectors.top_k(v).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(100, 1, 1), (100, 1, 2), (100, 2, 1), (100, 2, 2)]


def test_scores_beyond_a_long(spark):
    v = spark.createDataFrame([(0, [1e17, 0.0]), (1, [1e17, 0.0]), (2, [-1e17, 0.0]), (3, [1e17, 5.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in vectors.top_k(v).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 3, 2**63 - 1), (3, 4, 0), (4, 2, -(2**63))]


def test_many_candidates_take_time_in_proportion():
    took = []
    for n in (4_000, 32_000):
        text = " ".join(f"{i:08x}a1b2c3d4e5f6" for i in range(n))
        began = time.process_time()
        assert len(pii.candidates(text, pii.base_spans(text))) == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_candidates_keep_clear_of_base_spans_and_each_other():
    text = "mail a1b2c3d4e5f6@example.com key=a1b2c3d4e5f6a7b8 and 4111111111111111 +1 (555) 555-0000"
    base = pii.base_spans(text)
    spans = sorted([(a, b) for _, a, b in base] + [(a, b) for _, a, b, _, _ in pii.candidates(text, base)])
    assert any(text[a:b] == "a1b2c3d4e5f6a7b8" for a, b in spans)
    extra = [(a, b) for _, a, b, _, _ in pii.candidates(text, base)]
    assert all(b <= x or y <= a for a, b in extra for _, x, y in base)


def test_one_stays_of_rows_that_share_an_id(spark, docs):
    d = docs(["one text of its own", "another text that is unlike it", "another text that is unlike it", "a third one here"], [1, 1, None, None]).withColumn("key", F.lit("x"))
    got = simhash.keep_one(d)
    assert got.columns == d.columns and sorted(r.text for r in got.collect()) == ["a third one here", "another text that is unlike it", "one text of its own"]
