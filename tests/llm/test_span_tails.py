"""Substring dedup to the last sentence of a repeated passage."""

import random
from collections import defaultdict

from keyloom.llm import spans


def every_run(texts, least=2, words=16, alone=24):
    """What is left when every sentence in any repeated run that is long enough goes, but for the first."""
    parts = [[t[a:b] for a, b in zip(s, s[1:])] for t in texts for s in [spans.sentences(t)]]
    places = defaultdict(list)
    for d, p in enumerate(parts):
        w = [x.lower().split() for x in p]
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                full, held = sum(map(bool, w[i:j])), sum(map(len, w[i:j]))
                if w[i] and w[j - 1] and ((full >= least and held >= words) or (j == i + 1 and held >= alone)):
                    places[" ".join(x for y in w[i:j] for x in y)].append((d, i, j))
    gone = {(d, k) for at in places.values() for d, i, j in sorted(at)[1:] for k in range(i, j)}
    return ["".join(x for k, x in enumerate(p) if (d, k) not in gone) for d, p in enumerate(parts)]


def sentence(rng, n, end=". "):
    return " ".join(rng.choice("bcdfg") + str(rng.randrange(9999)) for _ in range(n)) + end


def test_the_end_of_a_passage_goes(spark, tmp_path):
    rng = random.Random(31)
    passage = sentence(rng, 30) + sentence(rng, 20)
    texts = [passage + sentence(rng, 9), sentence(rng, 12) + passage + sentence(rng, 7)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_removed for r in spans.op10_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 2}


def test_all_repeated_runs_are_covered(docs):
    rng = random.Random(32)
    passages = ["".join(sentence(rng, rng.randrange(1, 32), rng.choice([". ", "! ", "\n", ".\n \n"])) for _ in range(rng.randrange(2, 7))) for _ in range(8)]
    texts = ["".join(rng.choice([sentence(rng, rng.randrange(1, 30)), rng.choice(passages)]) for _ in range(6)) for _ in range(40)]
    got = [r.text for r in spans.drop_repeated_spans(docs(texts), tails=True).orderBy("doc_id").collect()]
    assert got == every_run(texts)
