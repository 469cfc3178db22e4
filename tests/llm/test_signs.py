"""Words disguised at their edges, or by signs alone."""

import random

import pytest

from keyloom.llm import toxicity

WORDS = ["garden", "window", "river", "letter", "music", "silver", "planet", "winter", "stones", "ideal", "first", "as"]
BAD = ["stupid", "ass", "idiot", "moron"]


@pytest.fixture(scope="module")
def cost(docs):
    rng = random.Random(41)
    texts = [" ".join(rng.choice(WORDS + BAD) for _ in range(20)) for _ in range(100)]
    return toxicity.language_model([(r.gram, r.n) for r in toxicity.trigram_counts(docs(texts)).collect()])


@pytest.mark.parametrize(
    ("seen", "meant"),
    [("$tupid", "stupid"), ("@ss", "ass"), ("|diot", "idiot"), ("a$$", "ass"), ("@$$", "ass"), ("455", "ass"), ("\"$tupid\",", "stupid"), ("|d10t!", "idiot"), ("$tup|d!!", "stupid")],
)
def test_signs_at_the_edges(cost, seen, meant):
    assert meant in toxicity.restored_words(f"you {seen} there", cost) and toxicity.decode(seen, cost) == meant


@pytest.mark.parametrize(("seen", "meant"), [("garden!", "garden"), ("(garden)", "garden"), ("*river*", "river"), ("letter,", "letter"), ("1989", ""), ("--", ""), ("!!!", ""), ("$$$", "")])
def test_punctuation_and_numbers_say_nothing_new(cost, seen, meant):
    assert toxicity.decode(seen, cost) == meant


def test_plain_letters_behind_a_sign_are_still_read(cost):
    assert "idiot" in toxicity.restored_words("@idiot", cost)


def cheapest(token, cost, lead=0, trail=0):
    """Every path through the lattice, one by one."""
    best = (float("inf"), "")
    stack = [(0, 0.0, "")]
    cls = lambda c: toxicity.letter_class(c) if c.strip() else 0
    while stack:
        at, paid, text = stack.pop()
        last = text.rpartition(" ")[2][-2:]
        one, two = cls(last[-2:-1]), cls(last[-1:])
        if at == len(token):
            best = min(best, (paid + cost[one, two, 0], text))
            continue
        c = token[at]
        if c == " ":
            stack += [(at + 1, paid + toxicity.GAP, text), (at + 1, paid + cost[one, two, 0], text + " ")]
            continue
        if c.isalpha():
            stack.append((at + 1, paid + cost[one, two, cls(c)], text + c))
            if last[-1:] == c and at and token[at - 1] == c:
                a, b = at, at
                while a and token[a - 1] == c:
                    a -= 1
                while b < len(token) and token[b] == c:
                    b += 1
                stack.append((at + 1, paid + (toxicity.AGAIN if b - a > 2 else toxicity.TWICE), text))
            continue
        usual = c == "*" or (at < lead and c in toxicity._BEFORE) or (at >= len(token) - trail and c in toxicity._BEHIND)
        stack.append((at + 1, paid + (toxicity.DROP if c in toxicity.LEET and not usual else toxicity.MARK), text))
        stack += [(at + 1, paid + toxicity.SWAP + cost[one, two, cls(x)], text + x) for x in toxicity.LEET.get(c, "")]
    return best


def test_viterbi_against_all_paths(cost):
    rng = random.Random(12)
    for _ in range(300):
        token = "".join(rng.choice("idotaassmrn011@$!*. -") for _ in range(rng.randrange(1, 8))).strip() or "a"
        lead, trail = rng.randrange(2), rng.randrange(2)
        paid, text = toxicity._cheapest(token, cost, lead, trail)
        assert paid == pytest.approx(cheapest(token, cost, lead, trail)[0]), token


@pytest.mark.parametrize("seen", ["i d i o t", "1 d 1 0 t", "s t u p i d i d i o t", "you i  d i o t", "m o r o n i d i o t"])
def test_words_spaced_out(cost, seen):
    assert "idiot" in toxicity.restored_words(f"say {seen} again", cost)


def test_long_tokens_take_time_in_proportion(cost):
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        toxicity.restore("0a1b2c3d4e5f6789" * (n // 16), cost)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_bytes_that_are_no_text(cost):
    import pyarrow as pa

    assert toxicity._readable(pa.array([b"a\xffb", None], pa.binary())).to_pylist() == ["a�b", None]
