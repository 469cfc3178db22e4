"""Toxicity, personal data, line and span deduplication."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import lines, pii, spans, toxicity


# Lines.
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s[i : i + rng.randrange(2)] = rng.choice([[], ["q"], ["é"]])
    return "".join(s)


def test_banded_distance(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(14)))
        pair = sorted((a, edited(rng, a, rng.randrange(5))), key=len, reverse=True)
        rows.append((list(pair[0]), list(pair[1]), distance(*pair)))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, d int")
    for edits in (1, 2, 3):
        got = df.select("d", lines.edit_distance(F.col("a"), F.col("b"), edits).alias("e")).collect()
        assert all(r.e == r.d if r.d <= edits else r.e > edits for r in got)


def cut_lines(texts, edits=2, shortest=24):
    key = lambda s: s.strip(" \t\r\x0b\x0c")
    first, order = {}, []
    for i, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            if key(line) and key(line) not in first:
                first[key(line)] = (i, p)
                order.append(key(line))
    long = [s for s in order if len(s) >= shortest]
    gone = {b for n, b in enumerate(long) if any(abs(len(a) - len(b)) <= edits and distance(a, b) <= edits for a in long[:n])}
    stay = lambda i, p, line: not key(line) or (first[key(line)] == (i, p) and key(line) not in gone)
    return [t if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if stay(i, p, line)) for i, t in enumerate(texts)]


def line_texts():
    rng = random.Random(6)
    base = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(20, 60))) for _ in range(12)]
    texts = ["\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 5])) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    return [*texts, "short\nshort\n\n short ", "shorr", texts[0], texts[0]]


def test_lines_against_brute_force(docs, odd_texts):
    texts = line_texts() + [t for t in odd_texts if t is None or len(t) < 6000]
    d = docs(texts).withColumns({c: F.lit("x") for c in ("id", "pos", "line", "h1", "kept", "_kept", "key", "n")})
    got = lines.drop_repeated_lines(d)
    assert got.columns == [*d.columns, "_n_lines", "_n_removed"]
    assert [r.text for r in got.orderBy("doc_id").collect()] == cut_lines(texts)


def test_hot_lines(docs):
    line = "one very common line of some length"
    texts = [line] * 150 + [line + "x", "another line that stands here alone"]
    got = [r.text for r in lines.drop_repeated_lines(docs(texts)).orderBy("doc_id").collect()]
    assert got == [line] + [""] * 150 + ["another line that stands here alone"]


def test_hot_segments(docs, monkeypatch):
    monkeypatch.setattr(lines, "SHARED", 2)
    monkeypatch.setattr(lines, "SALTS", 3)
    texts = line_texts()
    assert [r.text for r in lines.drop_repeated_lines(docs(texts)).orderBy("doc_id").collect()] == cut_lines(texts)


def test_large_group_of_near_copies(docs):
    base, rng = "the quick brown fox jumps over the lazy dog and runs away from it", random.Random(8)
    texts = [base] + [edited(rng, base, 2) for _ in range(1500)] + ["a line that is like no other one at all, it stays"]
    got = [r.text for r in lines.drop_repeated_lines(docs(texts)).orderBy("doc_id").collect()]
    assert got == [base] + [""] * 1500 + texts[-1:]


def test_lines_that_share_segments_only(docs):
    rng = random.Random(9)
    texts = [f"{rng.randrange(10**12):012d} common text of a log line that goes on for a while {rng.randrange(10**4):04d}" for _ in range(300)]
    texts += [t[:40] + "#" + t[41:] for t in texts[::7]]
    assert [r.text for r in lines.drop_repeated_lines(docs(texts)).orderBy("doc_id").collect()] == cut_lines(texts)


def test_lines_fetched_by_shuffle(docs, monkeypatch):
    monkeypatch.setattr(lines, "FETCH", 0)
    texts = line_texts()[:20]
    assert [r.text for r in lines.drop_repeated_lines(docs(texts)).orderBy("doc_id").collect()] == cut_lines(texts)


def test_no_lines_and_null_ids(docs):
    assert lines.drop_repeated_lines(docs([])).count() == 0
    got = lines.drop_repeated_lines(docs(["a\nb", "b\na", "c"], [None, 3, None])).collect()
    assert {r.text for r in got if r.doc_id == 3} == {""} and len(got) == 3


def test_lines_run_no_python(spark, sf):
    plan = lines.op5_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Spans.
def cut_spans(texts, least=2, words=16, alone=24):
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        bits = re.split(r"((?<=[.!?])\s+|\n\s*)", t)
        parts = [a + b for a, b in zip(bits[::2], [*bits[1::2], ""])]
        if not parts[-1]:
            parts.pop()
        w, gone = [p.lower().split() for p in parts], set()
        for a in range(len(parts)):
            if not w[a]:
                continue
            ends = [a + 1] if len(w[a]) >= alone else [b for b in range(a + 1, len(parts) + 1) if sum(map(bool, w[a:b])) >= least and sum(map(len, w[a:b])) >= words]
            if not ends:
                break
            run = " ".join(x for p in w[a : ends[0]] for x in p)
            if run in seen:
                gone.update(range(a, ends[0]))
            seen.add(run)
        out.append("".join(p for i, p in enumerate(parts) if i not in gone))
    return out


def span_texts():
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice(["sun", "moon", "Star", "é"]) + str(rng.randrange(60)) for _ in range(rng.randrange(1, 30))) + rng.choice([". ", "! ", ".\n", "\n"])
    passages = ["".join(sentence() for _ in range(8)) for _ in range(5)]
    texts = ["".join(rng.choice([sentence(), rng.choice(passages)]) for _ in range(6)) for _ in range(30)]
    return [*texts, passages[0] + "More text. " + passages[0].upper()]


def test_spans_against_brute_force(docs, odd_texts):
    texts = span_texts() + odd_texts
    d = docs(texts).withColumns({c: F.lit("x") for c in ("id", "at", "n", "h1", "_id", "_spans", "c0", "c1")}).repartition(5)
    got = spans.drop_repeated_spans(d)
    assert got.columns == [*d.columns, "_n_sentences", "_n_removed"]
    rows = got.orderBy("doc_id").collect()
    assert [r.text for r in rows] == cut_spans(texts)
    assert sum(r._n_removed for r in rows) > 20


def test_a_planted_passage_goes_but_for_its_first(docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    passage = " ".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(5))
    clean = [" ".join(" ".join(word() for _ in range(9)) + "." for _ in range(6)) for _ in range(6)]
    texts = [clean[0], f"{clean[1]} {passage} {clean[2]}", f"{clean[3]}\n{passage}\n{clean[4]}", clean[5]]
    got = [r.text for r in spans.drop_repeated_spans(docs(texts)).orderBy("doc_id").collect()]
    assert got[:2] == texts[:2] and got[3] == texts[3] and passage not in got[2] and got[2] == f"{clean[3]}\n{clean[4]}"


def test_no_spans_and_null_ids(docs):
    assert spans.drop_repeated_spans(docs([])).count() == 0
    long = "a b c d e f g h i. j k l m n o p q r. "
    got = spans.drop_repeated_spans(docs([long, long, long], [None, 1, 1])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", ""), ("1", ""), ("None", long)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.!? \n\té"), max_size=40))
def test_sentences_make_up_the_text(text):
    starts = spans.sentences(text)
    assert "".join(text[a:b] for a, b in zip(starts, starts[1:])) == text and sorted(set(starts)) == starts


# Personal data.
def plain_spans(x):
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, x):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")[:4]) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                found.append((kind, *m.span()))
    return found


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@.1 +-()9%\n٣é0"), max_size=50))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_cards_and_long_runs():
    assert pii.base_spans("pay 4111 1111-1111 1111 now") == [("card", 4, 23)] == plain_spans("pay 4111 1111-1111 1111 now")
    for text in ("1" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "+1" * 20_000, "@." * 20_000):
        pii.base_spans(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_personal_data(docs, odd_texts):
    rng = random.Random(10)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    secrets = [f'plain words here token = "{hexes(40)}" and more' for _ in range(20)] + [f"words password={hexes(18)} follow" for _ in range(20)]
    clean = [f"the section-{i} of version 1.2.{i} says abcdefghijkl{i}mnop" for i in range(40)]
    mails = ["write to a.b@c-d.example or 10.0.0.1, call +1 (555) 123-4567 4556737586899855 now"]
    texts = secrets + clean + mails + odd_texts
    d = docs(texts).withColumns({c: F.lit(1) for c in ("base", "more", "m", "kind")})
    got = {r.doc_id: r for r in pii.personal_data(d).collect()}
    for i, t in enumerate(texts):
        assert got[i].base == [f"{k}:{a}:{b}" for k, a, b in plain_spans(t or "")]
    assert all(len(got[i].more) == 1 and got[i].more[0].startswith("secret:") for i in range(40))
    assert not any(got[i].more for i in range(40, 80))
    kind, a, b = got[0].more[0].split(":")
    assert re.fullmatch("[0-9a-f]{40}", texts[0][int(a) : int(b)])
    # A phone and a card that run into each other: no pattern holds, the labelers tell them apart.
    assert {x.split(":")[0] for x in got[80].more} == {"phone", "card"}
    assert pii.personal_data(docs([])).count() == 0


def test_query_4(spark, sf):
    for r in pii.op4_personal_data(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        base = plain_spans(r.text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS[:4]]
        every = [x.split(":") for x in r.spans.split(",") if x]
        assert every == sorted(every, key=lambda x: (pii.KINDS.index(x[0]), int(x[1]))) and len(every) == len(base) + r.n_added


def test_reliabilities_find_the_better_labeler():
    rng = random.Random(11)
    votes = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        say = lambda right: 2 if (rng.random() < right) == truth else 1  # noqa: B023, E731
        pattern = ("secret", sum(v * 3**i for i, v in enumerate([say(0.95), say(0.9), say(0.9), say(0.6), 0])))
        votes[pattern] = votes.get(pattern, 0) + 1
    p = pii.reliabilities(votes)
    assert p["secret", 2 + 3 * 2 + 9 * 2 + 27] > 0.9 and p["secret", 1 + 3 + 9 + 27 * 2] < 0.1


# Toxicity.
@pytest.fixture(scope="module")
def talk(docs, spark):
    rng = random.Random(12)
    words = ["garden", "window", "river", "letter", "music", "silver", "planet", "butter", "travel", "winter", "stones", "idea", "dotted", "ideal"]
    bad = ["idiot", "moron"]
    texts, toxic = [], []
    for i in range(700):
        t = [rng.choice(words) for _ in range(rng.randrange(6, 30))]
        if i % 3 == 0:
            t.insert(rng.randrange(len(t)), rng.choice(bad) + ("s" if i % 2 else ""))
        texts.append(" ".join(t))
        toxic.append(int(i % 3 == 0))
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic) if i % 5], "doc_id long, toxic int")
    return docs(texts), labels, toxic


def test_restored_words(talk):
    cost = toxicity.language_model([(r.gram, r.n) for r in toxicity.trigram_counts(talk[0]).collect()])
    for seen, meant in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idioooot", "idiot"), ("m0r0n!!", "moron"), ("###moron###", "moron"), ("letter,", "letter"), ("butttttter", "butter"), ("1989", ""), ("don't", "dont")):
        assert toxicity.decode(seen, cost) == meant
    assert "idiot" in toxicity.restored_words("you are an i d i o t now", cost)


def test_counts_cover_all_texts(docs, odd_texts):
    table = toxicity.class_table()
    assert toxicity.trigram_counts(docs([])).count() == 0
    n = sum(r.n for r in toxicity.trigram_counts(docs(odd_texts)).collect())
    assert n >= sum(len(t) for t in odd_texts if t) and table[ord("A")] == table[ord("a")] == 1


def test_held_out_documents(talk):
    d, labels, toxic = talk
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert len(got) == len(toxic)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97


def test_held_out_labels_teach_nothing(talk, spark):
    d, labels, _ = talk
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(d, x).collect()} for x in (labels, flipped))
    assert a == b


def test_disguised_documents_and_odd_texts(talk, docs, odd_texts):
    d, labels, _ = talk
    model = toxicity.train(d, labels)
    asked = docs(["garden 1d10t river", "you m.o.r.o.n music", "i d i o t s", "garden river ideal dotted", *odd_texts]).withColumns({c: F.lit(1) for c in ("score", "traits", "toxic")})
    got = {r.doc_id: r.score for r in toxicity.score(asked, model, ["doc_id"]).collect()}
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] > 0.5 and all(got[i] < 0.5 for i in range(3, 4 + len(odd_texts)))
    kept = toxicity.drop_toxic(docs(["garden idiot river", None, "garden"]).withColumn("score", F.lit(1)), labels.limit(0))
    assert kept.columns[-1] == "score" and kept.count() == 3  # without labels nothing goes


def test_nothing_to_score(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs([]), none).count() == 0
    nulls = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs(["a", None]), nulls).where("predicted = 0").count() == 2
