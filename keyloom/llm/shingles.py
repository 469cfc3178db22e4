"""Near copies by SimHash, held to the Jaccard similarity of their word shingles; the pipeline's stage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import simhash
from keyloom.llm.common import Scratch, components, numbered
from keyloom.llm.tokens import blocks

#: Bands of minima and minima in a band: a pair at similarity 0.8 shares no band once in 20,000 times.
BANDS, ROWS = 25, 5
#: Rounds in which a band's documents meet one of them only, before all that are still apart meet each other.
STARS = 3
#: Times that shingles which no other text has are counted before all that are left meet each other.
PRUNED = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(42).integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of a UTF-8 text's word shingles, A-Z lower-cased; of all words if they are fewer."""
    from xxhash import xxh64_intdigest as xxh

    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh, found), np.uint64, len(found))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _MIX + w[i : i + len(h)]
    return np.unique(_mixed(h))


def fingerprint(h: np.ndarray, part: int = 1 << 15) -> int:
    """64-bit SimHash of the shingles."""
    return simhash.majority(sum(simhash.ones(h[at : at + part]) for at in range(0, len(h), part)), len(h))


def bands(h: np.ndarray, part: int = 1024) -> np.ndarray:
    """A hash for each band of minima of the shingles under different orders."""
    low = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), part):
        low = np.minimum(low, (h[None, at : at + part] * _ODD).min(axis=1))
    low, out = low.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = _mixed(out * _MIX + low[:, i])
    return out


def _signatures(docs: DataFrame, words: int, key: str, text_col: str) -> DataFrame:
    """(key, node, n, fp, bands): node is the same for texts of the same words, n the number of shingles, fp their SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as whole_hash

        for whole in batches:
            for batch in blocks(whole, 1):
                node, n, fp, found = [], [], [], []
                for x in batch.column(1):
                    text = x.as_py() or b""
                    h = shingles(text, words)
                    node.append(whole_hash(b" ".join(text.lower().split())))
                    n.append(len(h))
                    fp.append(fingerprint(h) if len(h) else 0)
                    found.append(bands(h).view("<i8") if len(h) else [])
                longs = [pa.array(np.array(x, "<u8").view("<i8")) for x in (node, n, fp)]
                yield pa.record_batch([batch.column(0), *longs, pa.array(found, pa.list_(pa.int64()))], names=["key", "node", "n", "fp", "bands"])

    rows = docs.select(F.col(key).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, node long, n long, fp long, bands array<long>")


def _similar(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose texts' shingles have that similarity: exact, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ha = None, None
        for whole in batches:
            for batch in blocks(whole, 3):
                good = []
                for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                    if ha is None or a != last:
                        last, ha = a, shingles(ta.as_py(), words)
                    hb = shingles(tb.as_py(), words)
                    both = len(np.intersect1d(ha, hb, assume_unique=True))
                    good.append(100 * both >= percent * (len(ha) + len(hb) - both))
                yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _shared(texts: DataFrame, words: int) -> DataFrame:
    """(node, alone): how many of a text's shingles no other of these texts has; only texts that have such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    h = shingles(text.as_py(), words)
                    yield pa.record_batch([pa.array(np.full(len(h), node), pa.int64()), pa.array(h.view("<i8"))], names=["node", "h"])

    each = texts.select("node", "text").mapInArrow(run, "node long, h long")
    once = each.groupBy("h").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
    return once.groupBy("node").agg(F.count("*").alias("alone"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component left; links are pairs of a similarity of ``percent`` or more.

    Similarity is the Jaccard similarity of the sets of ``words``-word
    shingles.  Candidates are texts that share a deletion variant of their
    shingles' SimHash, so all whose fingerprints differ by two bits or fewer and
    all that are alike but for a bit in either half.  A pair at 0.8 differs by
    ten bits of 64 on average; for such there are 25 bands of five minima
    besides, and texts that share one are candidates too.  Every candidate is
    verified on the whole texts.  The row with the smallest id
    stays, rows without an id behind the others, then by an own row number, so
    null and repeated ids are documents like any other.  Texts without words
    are copies of each other.

    Copies are one node from the start, and variants and bands that the same
    nodes have are one band.  In each of three rounds a band's nodes
    that are still in different components meet one of them, which settles
    large groups at a pair a node; in the first round that is the one that
    shares most bands with others.  Then all nodes that share a band and are
    still apart meet each other, unless too few of their shingles occur in any
    other such text for the similarity asked for; so no pair is left out.
    """
    spark, names = docs.sparkSession, docs.columns
    # Under plain names no column of the input can clash with those in between.
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at_id, at_text = (f"c{names.index(c)}" for c in (id_col, text_col))
    docs = numbered(docs, at_id, "key", nulls_last=True)
    rows = Scratch(_signatures(docs, words, "key", at_text))
    nodes = Scratch(rows.df.groupBy("node").agg(F.min("key").alias("key")))
    single = Scratch(rows.df.join(nodes.df.select("key"), "key", "left_semi").where("n > 0"))
    rows.drop()
    text = ("key", "node", "n")
    near = simhash.variants(single.df.select(*text, "fp")).select(*text, F.xxhash64(F.lit("simhash"), "variant").alias("band"))
    every = single.df.select(*text, F.explode("bands").alias("band")).unionByName(near)
    shared = every.groupBy("band").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("all"), F.min("node").alias("low"), F.max("node").alias("high")).where("k > 1")
    shared = Scratch(shared.groupBy("k", "all", "low", "high").agg(F.min("band").alias("band"), F.count("*").alias("times")).select("band", (F.col("k") * F.col("times")).alias("k")))
    # A merge, since Spark takes the rows of 64 variants for no more than the one they come from and may broadcast them.
    every = Scratch(every.hint("merge").join(shared.df, "band"))
    single.drop()
    # Of copies with an edit each, the one that they were made from shares the most.
    weight = Scratch(every.df.groupBy("node").agg(F.sum("k").alias("weight")))
    every, old = Scratch(every.df.drop("k").join(weight.df, "node")), every
    old.drop()
    wanted = every.df.select("key", "node").distinct()
    texts = Scratch(docs.select("key", F.col(at_text).cast("binary").alias("text")).join(wanted, "key").select("node", "text"))
    links, roots, seen = None, None, None
    for turn in range(STARS + 1):
        at = every.df.select("band", "node", "n", "weight")
        at = at.withColumn("root", F.col("node")) if roots is None else at.join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").withColumn("root", F.coalesce("root", "node")).drop("x")
        drawn = F.xxhash64(F.lit(turn), "node")
        star = F.max_by(F.struct("node", "root", "n"), drawn if turn else F.struct("weight", drawn)).alias("star")
        # A table of its own, so that Spark splits a band that many documents share.
        open_ = Scratch(at.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s"), star).where("r <> s")).df
        if turn < STARS:
            met = at.join(open_.select("band", "star"), "band").select(F.col("node").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("star.node").alias("y"), F.col("star.root").alias("ry"), F.col("star.n").alias("ny"))
        else:
            at = at.join(open_.select("band"), "band")
            for _ in range(PRUNED):
                alone = Scratch(_shared(texts.df.join(at.select("node").distinct(), "node", "left_semi"), words)).df
                at = Scratch(at.drop("shared").join(alone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")).df
                # Texts that are too unlike the smallest of their band for what they share go, which leaves more shingles alone.
                least = Scratch(at.groupBy("band").agg(F.min("n").alias("least"))).df
                most = F.greatest("least", "shared") - F.col("shared")
                at = Scratch(at.join(least, "band").where(100 * F.col("shared") >= percent * (F.col("n") + most)).drop("least")).df
            x, y = (at.select("band", F.col("node").alias(s), F.col("root").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("shared").alias(f"s{s}")) for s in "xy")
            # What two texts have in common is no more than either has in common with any.
            both = F.least("sx", "sy")
            met = x.join(y, (x.band == y.band) & (F.col("rx") < F.col("ry")) & (100 * both >= percent * (F.col("nx") + F.col("ny") - both)))
        near = met.where("rx <> ry").where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
        pairs = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new = Scratch(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))
        found = Scratch(_similar(new.df, texts.df, words, percent))
        seen = new.df if seen is None else seen.unionByName(new.df)
        links = found.df if links is None else links.unionByName(found.df)
        roots = components(spark, links)
    of = nodes.df.join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("key", F.coalesce("root", "node").alias("root"))
    kept = of.groupBy("root").agg(F.min("key").alias("key")).select("key")
    return docs.join(kept, "key", "left_semi").drop("key").toDF(*names)
