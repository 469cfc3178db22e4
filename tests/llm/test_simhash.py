import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import simhash
from keyloom.llm.common import Scratch, components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, k=3):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints(odd_texts):
    texts = [*odd_texts, "A b", "Ä B c D e", "one two three", " ".join(f"w{i % 17}" for i in range(500))]
    assert [simhash.fingerprint(t.encode() if t else None, part=64) for t in texts] == [plain(t) for t in texts]


def test_links_of_fingerprints(spark):
    rng = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(4):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    pairs = [(r.a, r.b) for r in got]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and want


def test_variants_stay_off_the_driver(spark):
    fps = Scratch(spark.range(5000).select(F.xxhash64("id").alias("fp"))).df  # a file of 40 KB, but 320,000 variants
    got = simhash.near_fingerprints(fps)
    assert got.collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for pair in links for n in pair}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def brute(ids, texts):
    fps = [plain(t) for t in texts]
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    return fps, roots(ids, links)


def test_documents(docs, odd_texts):
    rng = random.Random(4)
    texts = list(odd_texts)
    base = [f"word{rng.randrange(300)}" for _ in range(400)]
    for _ in range(30):
        near = base[:]
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(400)] = "changed"
        texts.append(" ".join(near))
    ids = list(range(len(texts)))
    fps, want = brute(ids, texts)
    d = docs(texts).withColumns({c: F.lit(1) for c in ("fp", "id", "root", "node", "component_id", "fingerprint")})
    got = simhash.near_duplicates(d).collect()
    assert {r.id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_null_and_repeated_ids(docs):
    d = docs(["a b c d", "a b c d", "e f g h", "e f g h", "x"], [4, None, None, None, 4])
    got = simhash.near_duplicates(d).collect()
    assert sorted((str(r.id), str(r.component_id)) for r in got) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None"), ("None", "None")]
    assert simhash.keep_one(d).count() == 3
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.keep_one(docs([])).count() == 0


def test_query(spark, sf):
    got = simhash.op1_simhash_near_dedup(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    fps, want = brute(table.doc_id.tolist(), table.text.tolist())
    assert dict(zip(got.doc_id, got.component_id)) == want
    assert dict(zip(got.doc_id, got.fingerprint)) == {i: f"{f:016x}" for i, f in zip(table.doc_id, fps)}
    assert np.issubdtype(got.doc_id.dtype, np.integer)
