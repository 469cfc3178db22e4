"""Toxicity (2): a noisy-channel decoder restores disguised words, a linear model scores what it restores."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, documents, give_back, table
from keyloom.llm.tokens import blocks

#: Letters that a sign may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "€": "e", "£": "l", "¢": "c", "¡": "i",
}
#: What the channel pays for a sign in a letter's place, for such a sign put between letters, for any other mark there, for a letter said again, and for a space within a word.
SWAP, DROP, MARK, AGAIN, TWICE, GAP = 1.2, 8.0, 0.3, 0.4, 6.0, 0.3
_PUNCT = string.punctuation + "…“”«»¿¡’‘–—"
_NO_SIGNS = "".join(c for c in _PUNCT if c not in LEET)
#: Signs of LEET that also punctuate, in front of words and behind them.
_BEFORE, _BEHIND = "(<¡", "!"
_TRIPLE = re.compile(r"(.)\1\1", re.DOTALL)
#: Single characters one after another that may be a word spaced out.
SPACED = 3
#: Bytes of words that a worker keeps the readings of, and of a word that is kept at most.
CACHE, WORD_BYTES = 8 << 20, 64
#: Classes of letters: 0 is a word's edge, 1-26 a-z, the others share the rest by code point.
CLASSES, OTHERS = 64, 37
PREFIXES = (4, 5, 6, 7)


def letter_class(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % OTHERS if c.isalpha() else 0


#: The letters that signs may stand for, with their classes.
_SIGNS = {sign: tuple((x, letter_class(x)) for x in found) for sign, found in LEET.items()}


def class_table() -> np.ndarray:
    """Classes of the code points below 0x10000; upper case counts as lower case."""
    return np.array([letter_class(chr(i).lower()[0]) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x10000)], np.int64)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): how often three classes of letters follow each other, over all whole texts."""
    classes = class_table()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for whole in batches:
            for batch in blocks(whole, 0):
                raw = b" ".join(x for x in batch.column(0).to_pylist() if x)
                cp = np.frombuffer(f" {raw.decode('utf-8', 'replace')} ".encode("utf-32-le", "surrogatepass"), "<u4")
                c = np.concatenate([[0], classes[np.where(cp < 0x10000, cp, 0)]])
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    each = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "gram long, n long")
    return each.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: Iterable[tuple[int, int]]) -> np.ndarray:
    """-log of the chance of a class behind two others, smoothed by the chances behind one."""
    n = np.zeros(CLASSES**3)
    for gram, k in counts:
        n[gram] = k
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    two = n.sum(axis=0) + 0.1
    back = two / two.sum(axis=1, keepdims=True)
    return -np.log((n + 20.0 * back[None]) / (n.sum(axis=2, keepdims=True) + 20.0))


def restore(token: str, cost: np.ndarray, lead: int = 0, trail: int = 0) -> str:
    """The letters that ``token`` most likely stands for: Viterbi over its lattice.

    Every character may be the letter it is, a letter it resembles, a mark
    between letters, or the last letter said again; a space may be nothing or
    the end of a word.  The language model weighs the letters, the channel the
    disguise.  A state is the last two letters.  Of the first ``lead`` and last
    ``trail`` characters, signs that punctuate that edge of a word cost no more
    than any other mark to leave out.
    """
    return _cheapest(token, cost, lead, trail)[1]


def _cheapest(token: str, cost: np.ndarray, lead: int = 0, trail: int = 0) -> tuple[float, str]:
    # For each state: what it cost, where its two letters stand in the flat table, and how it was reached, as (text, state before).
    best: dict[str, tuple] = {"": (0.0, 0, None)}
    price, before, behind = memoryview(cost.reshape(-1)), "", len(token) - trail
    for at, c in enumerate(token):
        new: dict[str, tuple] = {}
        if c == " ":
            whole = min(((paid + price[row], way) for paid, row, way in best.values()), key=lambda x: x[0])
            for last, (paid, row, way) in best.items():
                new[last] = (paid + GAP, row, way)
            if "" not in new or whole[0] < new[""][0]:
                new[""] = (whole[0], 0, (" ", whole[1]))
        elif c.isalpha():
            k = letter_class(c)
            again = None if c != before else AGAIN if token[at - 2 : at] == c + c or token[at - 1 : at + 2] == c * 3 else TWICE
            for last, (paid, row, way) in best.items():
                if again is not None and last[-1:] == c and (last not in new or paid + again < new[last][0]):
                    new[last] = (paid + again, row, way)
                to, total = last[-1:] + c, paid + price[row + k]
                if to not in new or total < new[to][0]:
                    new[to] = (total, (row % (CLASSES * CLASSES) + k) * CLASSES, (c, way))
        else:
            signs = _SIGNS.get(c, ())
            out = DROP if signs and not (c == "*" or (at < lead and c in _BEFORE) or (at >= behind and c in _BEHIND)) else MARK
            for last, (paid, row, way) in best.items():
                if last not in new or paid + out < new[last][0]:
                    new[last] = (paid + out, row, way)
                for x, k in signs:
                    to, total = last[-1:] + x, paid + SWAP + price[row + k]
                    if to not in new or total < new[to][0]:
                        new[to] = (total, (row % (CLASSES * CLASSES) + k) * CLASSES, (x, way))
        best, before = new, c
    paid, way = min(((paid + price[row], way) for paid, row, way in best.values()), key=lambda x: x[0])
    text = []
    while way:
        text.append(way[0])
        way = way[1]
    return paid, "".join(reversed(text))


def decode(word: str, cost: np.ndarray) -> str:
    """A lower-case word restored; words of plain letters without signs of LEET at their edges have one path only.

    A word of signs alone is letters only if they cost less than signs that
    say nothing, each a letter of any kind; numbers mostly do not.
    """
    core = word.strip(_PUNCT)
    if core.isalpha() and not _TRIPLE.search(core) and not _signs(word, core):
        return core
    lettered = any(c.isalpha() for c in word)
    if not lettered and not any(c in LEET for c in word):
        return ""
    # Long runs of one letter say no more than three of it; a lattice is for words.
    whole = re.sub(r"(.)\1{3,}", r"\1\1\1", word, flags=re.DOTALL)
    if not lettered:
        whole = whole.strip(_NO_SIGNS)
        paid, text = _cheapest(whole, cost)
        signs = sum(c in LEET for c in whole)
        return text if paid < signs * (SWAP + float(np.log(26))) + MARK * (len(whole) - signs) else ""
    core = whole.strip(_PUNCT)
    if _signs(whole, core):
        edges = whole.strip(_NO_SIGNS)
        return restore(edges, cost, len(edges) - len(edges.lstrip(_PUNCT)), len(edges) - len(edges.rstrip(_PUNCT)))
    edges = core if len(whole) - len(core) >= 2 else whole.strip(".,;:?\"'()[]")
    return restore(edges, cost)


def _signs(word: str, core: str) -> bool:
    """Whether what was stripped off ``core`` holds signs of LEET."""
    at = word.find(core)
    return any(c in LEET for c in word[:at] + word[at + len(core) :])


def readings(word: str, cost: np.ndarray) -> tuple[str, ...]:
    """A word restored and, if signs stand at the edges of plain letters, those letters as well."""
    word = word.lower()
    if word.isalpha() and not _TRIPLE.search(word):
        return (word,)
    core, r = word.strip(_PUNCT), decode(word, cost)
    plain = core.isalpha() and not _TRIPLE.search(core)
    return tuple(x for x in ((r, core) if plain and core != r else (r,)) if x)


def spaced_readings(letters: str, cost: np.ndarray) -> set[str]:
    """Words of single characters that stood one after another: those of the best path, which may end words at spaces, and what begins at each letter."""
    letters = re.sub(r"(.)\1{3,}", r"\1\1\1", letters.lower(), flags=re.DOTALL)
    if not any(c.isalpha() or c in LEET for c in letters):
        return set()
    r = restore(" ".join(letters), cost)
    joined = r.replace(" ", "")
    return {*r.split(), *(joined[i : i + max(PREFIXES)] for i in range(len(joined) - 2))}


def restored_words(text: str, cost: np.ndarray) -> set[str]:
    """All words of a text, restored."""
    words, spaced = _tokens(pa.array([text]))
    found = {r for w in words[0] for r in readings(w, cost)}
    return found.union(*(spaced_readings(letters, cost) for _, letters in spaced))


def _tokens(texts: pa.StringArray) -> tuple[tuple[list[str], np.ndarray, np.ndarray], list[tuple[int, str]]]:
    """(distinct words, each place's word, where each text begins), and (text, characters) of the runs of single characters."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten().dictionary_encode()
    words, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    edges = np.asarray(split.offsets) - split.offsets[0].as_py()
    single = np.fromiter((len(w) == 1 for w in words), bool, len(words))[codes]
    # Runs end where a text does.
    text = np.repeat(np.arange(len(texts)), np.diff(edges))
    cut = np.flatnonzero((np.diff(single.astype(np.int8)) != 0) | (np.diff(text) != 0)) + 1
    spaced = []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(single)]):
        if b - a >= SPACED and single[a]:
            spaced.append((int(text[a]), "".join(words[c] for c in codes[a:b].tolist())))
    return (words, codes, edges), spaced


def traits(word: str) -> list[str]:
    """What the model sees of a restored word: itself and its beginnings."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) >= k)]


class Cache(dict):
    """What words give, for some bytes of words."""

    def __init__(self, make: Callable[[str], tuple]) -> None:
        self.make, self.held = make, 0

    def __missing__(self, word: str) -> tuple:
        found = self.make(word)
        if len(word) <= WORD_BYTES:
            self.held += len(word) + 64
            if self.held > CACHE:
                self.clear()
                self.held = len(word) + 64
            self[word] = found
        return found


def _words(docs: DataFrame, cost: np.ndarray, names: list[str]) -> DataFrame:
    """``names`` of every row, and all traits of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache(lambda w: tuple(t for r in readings(w, cost) for t in traits(r)))
        for whole in batches:
            for batch in blocks(whole, len(names)):
                (words, codes, edges), spaced = _tokens(_readable(batch.column(len(names))))
                rows = []
                for a, b in zip(edges, edges[1:]):
                    rows.append({t for c in np.unique(codes[a:b]).tolist() for t in known[words[c]]})
                for row, letters in spaced:
                    rows[row].update(t for r in spaced_readings(letters, cost) for t in traits(r))
                yield pa.record_batch([*batch.columns[: len(names)], pa.array(map(list, rows), pa.list_(pa.string()))], names=[*names, "traits"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{schema}, traits array<string>")


def _readable(raw: pa.BinaryArray) -> pa.StringArray:
    """Texts of bytes; what is no UTF-8 is replaced."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _chosen(docs: DataFrame, cost: np.ndarray, chosen: dict[str, int], weights: np.ndarray | None, names: list[str]) -> DataFrame:
    """``names`` of every row, and its score or, without weights, the numbers of the traits that its text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda found: tuple({chosen[t] for r in found for t in traits(r) if t in chosen})
        known = Cache(lambda w: of(readings(w, cost)))
        for whole in batches:
            for batch in blocks(whole, len(names)):
                (words, codes, edges), spaced = _tokens(_readable(batch.column(len(names))))
                found = [known[w] for w in words]
                at = np.flatnonzero(np.fromiter(map(bool, found), bool, len(found))[codes])
                rows = [set() for _ in range(batch.num_rows)]
                for row, c in zip((np.searchsorted(edges, at, "right") - 1).tolist(), codes[at].tolist()):
                    rows[row].update(found[c])
                for row, letters in spaced:
                    rows[row].update(of(spaced_readings(letters, cost)))
                if weights is None:
                    out = pa.array(map(sorted, rows), pa.list_(pa.int32()))
                else:
                    z = np.array([weights[-1] + sum(weights[i] for i in sorted(r)) for r in rows], float)
                    out = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                yield pa.record_batch([*batch.columns[: len(names)], out], names=[*names, "found"])
        known.clear()
        give_back()

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    rows = docs.select(*names, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"{schema}, found {'array<int>' if weights is None else 'double'}")


def fit(rows: list[list[int]], y: np.ndarray, size: int, rounds: int = 400, ridge: float = 2e-4) -> np.ndarray:
    """Weights of a logistic model over present traits, the constant last; gradient steps with momentum."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64)
    w, v = np.zeros(size + 1), np.zeros(size + 1)
    rate = y.mean() if n else 0.0
    w[-1] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
    scale = np.zeros(size + 1)
    np.add.at(scale, col, 1.0)
    scale = 1 / np.sqrt(scale / max(n, 1) + 1e-3)
    for _ in range(rounds):
        z = np.full(n, w[-1])
        np.add.at(z, at, w[col])
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(col, error[at], size + 1) / max(n, 1) + ridge * w
        g[-1] = error.mean() if n else 0.0
        v = 0.9 * v - 0.5 * scale * g
        w = w + v
    return w


class Model:
    def __init__(self, cost: np.ndarray, chosen: dict[str, int], weights: np.ndarray) -> None:
        self.cost, self.chosen, self.weights = cost, chosen, weights


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most: int = 4096, id_col: str = "doc_id") -> Model:
    """Fit the language model on all documents and the classifier on labelled ones.

    ``labels`` has (doc_id, toxic); at most ``sample`` of them, drawn by hash,
    are used, and at most ``most`` traits, those that tell most.  The letters'
    counts come from all of ``docs``.  Rows without a text, an id or a label
    teach nothing; without any label every score is one half or less.
    """
    cost = language_model([(r.gram, r.n) for r in trigram_counts(docs).collect()])
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers: small enough for every task.
    picked = Scratch(docs.select(F.col(id_col).alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id"))
    seen = _words(picked.df, cost, ["toxic"]).select("toxic", F.explode("traits").alias("trait"))
    counts = seen.groupBy("trait").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    size = picked.df.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    rate = (size.bad + 0.5) / (size.n + 1)
    # How far a trait's rate of toxic documents is from the usual rate, in nats over all its documents.
    p = (F.col("bad") + 0.5 * rate) / (F.col("n") + 0.5)
    gain = F.col("bad") * F.log(p / rate) + (F.col("n") - F.col("bad")) * F.log((1 - p) / (1 - rate))
    best = counts.where("n >= 2").withColumn("gain", gain).where("gain > 3").orderBy(F.col("gain").desc(), "trait").limit(most).select("trait").collect()
    chosen = {r.trait: i for i, r in enumerate(best)}
    rows = _chosen(picked.df, cost, chosen, None, ["toxic"]).collect()
    weights = fit([list(r.found) for r in rows], np.array([r.toxic for r in rows], float), len(chosen))
    picked.drop()
    return Model(cost, chosen, weights)


def score(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """``names`` of every row and its score from 0 to 1; a null text is an empty one."""
    return _chosen(docs, model.cost, model.chosen, model.weights, names).withColumnRenamed("found", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """True for documents that nothing is learned from: one in five, by a checksum of the id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted.  Learns from labels that are not held out only."""
    model = train(docs, labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score is below ``least``, with the columns they came with."""
    model = train(docs, labels.where(~held_out()))
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*plain).withColumn("text", F.col(plain[names.index("text")]))
    kept = score(rows, model, plain).where(F.col("score") < least).select(*plain)
    return kept.toDF(*names)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
