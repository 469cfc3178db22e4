"""Personal data by weak supervision (4): labelers vote, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, documents
from keyloom.llm.tokens import blocks

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Behind a digit none of these can begin anew, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: Words that announce a credential.
GAZETTEER = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "key")
#: What else may be personal data: plain card and phone numbers inside longer runs of digits, and random-looking words.
_MORE_CARD = re.compile(r"(?<![0-9.-])[0-9]{16,19}(?![0-9.-])")
_MORE_PHONE = re.compile(r"\+[0-9]{1,3}[\x20-]?\([0-9]{3}\)[\x20-]?[0-9]{3}[\x20-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{12,}(?![A-Za-z0-9_/+-])")
_SHAPE = re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{16,}|[0-9A-F]{16,}|(?:sk|pk|gh[pousr])[-_][A-Za-z0-9_-]{16,}")
_AHEAD = re.compile(r"([A-Za-z_-]+)[\"']?\s{0,2}(?:[:=]\s{0,2})?[\"']?$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind, those that fail their test dropped."""
    found, at, sign = [], 0, text.find("@")
    while sign >= 0:
        # The leftmost match takes the whole run of letters before a sign; if that fails, every shorter one does.
        start = sign
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        if start < sign and (m := _EMAIL.match(text, start)):
            found.append(("email", start, m.end()))
            at = m.end()
        else:
            at = sign + 1
        sign = text.find("@", at)
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _ahead(text: str, start: int) -> tuple[str, bool]:
    before = text[max(0, start - 32) : start]
    m = _AHEAD.search(before)
    return (m[1].lower() if m else ""), bool(re.search(r"[:=]\s{0,2}[\"']?$", before))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, votes, traits) of what the patterns left out, clear of their spans.

    Five labelers vote 2 (yes), 1 (no) or 0 (abstain), packed in base 3: known
    shapes (regex), words that announce a credential (gazetteer), an
    assignment or quotes around (context), randomness (entropy), and the check
    digit.  Traits are kind, length and mix of letters, in small classes.
    """
    out, starts, ends = [], [], []
    # What is taken, as stretches that do not overlap, in order.
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def add(kind: str, a: int, b: int, votes: tuple[int, ...]) -> None:
        at = bisect.bisect_left(starts, b)
        if not at or ends[at - 1] <= a:
            starts.insert(at, a)
            ends.insert(at, b)
            s = text[a:b]
            digits, upper = sum(c.isdigit() for c in s) / len(s), sum(c.isupper() for c in s) / len(s)
            mix = min(3, int(digits * 4)) * 3 + (0 if upper == 0 else 1 if upper < 0.5 else 2)
            traits = (KINDS.index(kind) * 4 + min(3, len(s) // 12)) * 12 + mix
            out.append((kind, a, b, sum(v * 3**i for i, v in enumerate(votes)), traits))

    for m in _MORE_CARD.finditer(text):
        good = luhn(m[0])
        word, assigned = _ahead(text, m.start())
        add("card", *m.span(), (2 if m[0][0] in "3456" else 1, 2 if word in ("card", "visa", "iban") else 0, 1 if assigned else 0, 2 if _entropy(m[0]) > 2 else 1, 2 if good else 1))
    for m in _MORE_PHONE.finditer(text):
        add("phone", *m.span(), (2, 0, 0, 2 if _entropy(m[0]) > 2 else 1, 2))
    for m in _SECRET.finditer(text):
        s = m[0]
        if not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
            continue
        word, assigned = _ahead(text, m.start())
        wild = _entropy(s) >= 3 and sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:])) >= 3
        add("secret", *m.span(), (2 if _SHAPE.fullmatch(s) else 1, 2 if word in GAZETTEER else 0, 2 if assigned else 0, 2 if wild else 1, 0))
    return out


def reliabilities(votes: dict[tuple[str, int], int], labelers: int = 5, rounds: int = 60) -> dict[tuple[str, int], float]:
    """Probability that a (kind, votes) pattern is personal data, by expectation-maximisation over the patterns' counts.

    Each labeler has, for either truth, its own chances of abstaining, no and
    yes.  It starts from the belief that labelers are right four times in five.
    """
    keys = sorted(votes)
    if not keys:
        return {}
    n = np.array([votes[k] for k in keys], float)
    v = np.array([[k[1] // 3**i % 3 for i in range(labelers)] for k in keys])
    yes, no = (v == 2).sum(1), (v == 1).sum(1)
    p = 1 / (1 + 0.25 ** (yes - no).astype(float))
    for _ in range(rounds):
        table = np.empty((2, labelers, 3))
        for truth, weight in enumerate((n * (1 - p), n * p)):
            for i in range(labelers):
                # A few imagined votes keep rare patterns from running away and the two truths from trading places.
                prior = (2.0, 8.0, 2.0) if truth == 0 else (2.0, 2.0, 8.0)
                table[truth, i] = [prior[x] + weight[v[:, i] == x].sum() for x in range(3)]
                table[truth, i] /= table[truth, i].sum()
        prior = min(0.95, max(0.05, float((n * p).sum() / n.sum())))
        like = [np.log(table[t, np.arange(labelers), v]).sum(1) for t in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1] + math.log((1 - prior) / prior), -50, 50)))
    return {k: float(x) for k, x in zip(keys, p)}


def span_classifier(counts: dict[tuple[str, int, int], int], labelers: int = 5, rounds: int = 300) -> dict[tuple[str, int, int], float]:
    """The score of every (kind, votes, traits) pattern under a logistic model fitted to the labelers' weighed votes."""
    keys = sorted(counts)
    if not keys:
        return {}
    marginal: Counter = Counter()
    for (kind, votes, _), n in counts.items():
        marginal[kind, votes] += n
    soft = reliabilities(marginal, labelers)
    y = np.array([soft[k[:2]] for k in keys])
    n = np.array([counts[k] for k in keys], float)
    x = np.zeros((len(keys), 3 * labelers + 12 + 4 + len(KINDS) + 1))
    for row, (_, votes, traits) in zip(x, keys):
        for i in range(labelers):
            row[3 * i + votes // 3**i % 3] = 1
        row[3 * labelers + traits % 12] = row[3 * labelers + 12 + traits // 12 % 4] = row[3 * labelers + 16 + traits // 48] = row[-1] = 1
    w, n = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (n * (y - p)) - 1e-4 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {k: float(s) for k, s in zip(keys, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))}


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, base (kind:start:end texts) and more (kind, start, end, votes, traits)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("traits", pa.int32())]))
        for whole in batches:
            for batch in blocks(whole, 1):
                base, more = [], []
                for raw in batch.column(1):
                    text = (raw.as_py() or b"").decode("utf-8", "replace")
                    found = base_spans(text) if _ANY.search(text) else []
                    base.append([f"{k}:{a}:{b}" for k, a, b in found])
                    extra = candidates(text, found) if _ANY.search(text) else []
                    more.append([dict(zip(("kind", "start", "end", "votes", "traits"), x)) for x in extra])
                yield pa.record_batch([batch.column(0), pa.array(base, pa.list_(pa.string())), pa.array(more, more_type)], names=["doc_id", "base", "more"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, base array<string>, more array<struct<kind:string,start:bigint,end:bigint,votes:int,traits:int>>")


def personal_data(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find personal data in whole texts: doc_id, base and more, both arrays of kind:start:end in code points.

    ``base`` are the spans of fixed patterns.  Every other candidate gets votes
    and traits; the driver learns how often each of their patterns occurs in
    all documents (some thousand patterns, however many documents), weighs the
    labelers, fits the classifier and adds the candidates it scores ``least``
    or more.  A null text is an empty one; repeated rows give equal rows; an
    empty table gives none.
    """
    scanned = Scratch(spans_of(docs, id_col, text_col))
    each = scanned.df.select(F.explode("more").alias("m")).select("m.kind", "m.votes", "m.traits")
    counts = {(r.kind, r.votes, r.traits): r.n for r in each.groupBy("kind", "votes", "traits").agg(F.count("*").alias("n")).collect()}
    good = [k for k, s in span_classifier(counts).items() if s >= least]
    # At most 5 kinds x 243 votes x 240 traits.
    if good:
        keys = F.array(*[F.lit(f"{k}:{v}:{t}") for k, v, t in good])
        keep = lambda m: F.array_contains(keys, F.concat_ws(":", m["kind"], m["votes"].cast("string"), m["traits"].cast("string")))
        more = F.transform(F.filter("more", keep), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string")))
    else:
        more = F.expr("cast(array() as array<string>)")
    return scanned.df.select("doc_id", "base", more.alias("more"))


def _of(kind: str):  # noqa: ANN202
    return lambda s: s.startswith(f"{kind}:")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base", _of(kind))).cast("long")
    # All spans by kind as listed, then by start.
    both = F.concat("base", "more")
    start = lambda s: F.split(s, ":")[1].cast("long")
    order = lambda a, b: F.when(start(a) < start(b), -1).when(start(a) > start(b), 1).otherwise(0)
    of_kind = [F.array_sort(F.filter(both, _of(kind)), order) for kind in KINDS]
    joined = F.when(F.size("more") == 0, F.array_join("base", ",")).otherwise(F.array_join(F.concat(*of_kind), ","))
    return found.select(
        "doc_id",
        *[n(kind).alias(f"n_{kind}") for kind in KINDS[:4]],
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        joined.alias("spans"),
        F.size("more").cast("long").alias("n_added"),
        (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )
