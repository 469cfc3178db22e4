"""The pipeline's near-copy stage: five-word shingles, similarity 0.8."""

import random

import numpy as np

import corpus_pipeline as pipeline
from keyloom.llm import shingles


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def planted(rng, copies=60):
    """Texts and, for each copy, the place of its original."""
    texts, of = [], {}
    for _ in range(copies):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 400))]
        near = base[:]
        while True:
            more = near[:]
            more[rng.randrange(len(more))] = f"x{rng.randrange(10**6)}"
            a, b = sets(" ".join(base)), sets(" ".join(more))
            if len(a & b) < 0.8 * len(a | b):
                break
            near = more
        of[len(texts) + 1] = len(texts)
        texts += [" ".join(base), " ".join(near)]
    return texts, of


def test_edited_copies_at_similarity_08(spark, docs, sf):
    texts, of = planted(random.Random(21))
    texts += ["all by itself", "All  by\nitself", "", None]
    got = {r.doc_id for r in pipeline.drop_near_copies(spark, docs(texts), sf).collect()}
    n = len(texts)
    assert got == {i for i in range(n) if i not in of} - {n - 3, n - 1}


def test_simhash_finds_pairs(spark, docs, sf):
    # Similar by 8 of 10 shingles, in no band together, but alike in half a fingerprint save a bit.
    a = "w3414 w2286 w2582 w443 w1484 w710 w3104 w2819 w3776 w1419 w1419 w781 "
    b = "w1226 w2774 w2714 w1851 w2141 w1855 w2059 w3429 w2281 w1980 w3847 w3315 "
    texts = [a + "w415", a + "w1944", b + "w82", b + "w3531"]
    for x, y in (texts[:2], texts[2:]):
        hx, hy = (shingles.shingles(t.encode()) for t in (x, y))
        apart = shingles.fingerprint(hx) ^ shingles.fingerprint(hy)
        assert not (shingles.bands(hx) == shingles.bands(hy)).any() and min((apart >> 32).bit_count(), (apart & (1 << 32) - 1).bit_count()) < 2
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs(texts), sf).collect()) == [0, 2]


def test_fingerprints():
    rng = random.Random(23)
    for n in (1, 2, 9, 700):
        h = np.array([rng.getrandbits(64) for _ in range(n)], "<u8")
        assert shingles.fingerprint(h, part=64) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)


def test_against_brute_force(docs):
    rng = random.Random(22)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):  # a crowd of copies about the limit
        t = base[:]
        for _ in range(rng.randrange(4)):
            t[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    s = [sets(t) for t in texts]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert [shingles.shingles(t.encode()).size for t in texts] == [len(x) for x in s]
    assert {r.doc_id for r in shingles.keep_one(docs(texts)).collect()} == set(root)


def test_null_and_repeated_ids(docs):
    d = docs(["a b c d e f", "a b c d e f", "g h", "g h", "i"], [4, None, None, None, 4])
    got = sorted((str(r.doc_id), r.text) for r in shingles.keep_one(d).collect())
    assert got == [("4", "a b c d e f"), ("4", "i"), ("None", "g h")]
    assert shingles.keep_one(docs([])).count() == 0
