"""SimHash near-duplicates by deletion-variant signatures (1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, components, documents, numbered
from keyloom.llm.tokens import blocks


def ones(h: np.ndarray) -> np.ndarray:
    """How many of these 64-bit hashes ("<u8") have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint: the bits that over half of n hashes have."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42, part: int = 1 << 15) -> int:
    """64-bit SimHash of a UTF-8 text's word shingles, A-Z lower-cased; 0 without words."""
    from xxhash import xxh64_intdigest as xxh

    found = (text or b"").lower().split()
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    if n == 1:
        return xxh(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.zeros(64, np.int64)
    for at in range(0, n, part):
        # The shingles of a part, cut out of the joined words.
        bounds = zip(starts[at : min(n, at + part)].tolist(), ends[at + words - 1 : at + part + words - 1].tolist())
        h = np.array([xxh(joined[a:b], seed) for a, b in bounds], "<u8")
        counts += ones(h)
    return majority(counts, n)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], "<u8").view("<i8")
                yield pa.record_batch([batch.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def variants(fps: DataFrame, segment_bits: int = 32) -> DataFrame:
    """Each row once for every bit of its ``fp``; ``variant`` has the bit's segment without that bit, and above it which bit that is.

    Rows share a variant if a segment of theirs differs by a bit at most.
    """
    full = (1 << segment_bits) - 1
    names = fps.columns
    v = fps.select(*names, F.explode(F.sequence(F.lit(0), F.lit(2 * segment_bits - 1))).alias("k"))
    v = v.select(*names, "k", F.expr(f"k div {segment_bits}").cast("int").alias("s"), (F.col("k") % segment_bits).alias("i"))
    segment = F.when(F.col("s") == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", segment_bits)).bitwiseAND(F.lit(full))
    hole = segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i)")))
    tag = F.shiftleft(F.col("k").cast("long"), segment_bits)
    return v.select(*names, hole.bitwiseOR(tag).alias("variant"))


def near_fingerprints(fps: DataFrame, segment_bits: int = 32) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints ``fp`` that differ in one or two bits, each pair once.

    Of two segments of 32 bits one differs by at most one bit, so both
    fingerprints have that segment with the same one bit left out in common.
    Every fingerprint is indexed under these variants, equal variants meet, and
    the join itself verifies the whole fingerprints.  A pair counts under one
    variant only: the first segment if that one differs by a bit at most, else
    the second; the bit that differs, or the first bit if none does.

    The join asks to be a merge: Spark takes 64 variants to be no larger than the
    fingerprint they come from and would send them all through the driver.
    """
    full = (1 << segment_bits) - 1
    # Both sides have the same columns, so that one shuffle serves them; the variant's upper half tells segment and bit.
    v = variants(fps.select("fp"), segment_bits)
    x, y = v.alias("x"), v.alias("y")
    k = F.shiftright("x.variant", segment_bits)
    s, i = F.floor(k / segment_bits), (k % segment_bits).cast("int")
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    low, high = apart.bitwiseAND(F.lit(full)), F.shiftrightunsigned(apart, segment_bits)
    here = F.when(s == 0, low).otherwise(high)
    once = F.when(here == 0, i == 0).otherwise(here == F.call_function("shiftleft", F.lit(1).cast("long"), i))
    first = (s == 0) | (F.bit_count(low) > 1)
    match = (F.col("x.variant") == F.col("y.variant")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(apart) <= 2) & once & first
    return x.hint("merge").join(y.hint("merge"), match).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose fingerprints differ by two bits at most.

    Returns a row per input row: its id, its fingerprint (16 hex digits) and
    component_id, the smallest id reachable.  A null text is an empty one;
    texts without words have fingerprint zero, which links like any other.
    Equal fingerprints are one node from the start, so copies cost nothing
    more, and only pairs of unlike fingerprints are looked for.  A row whose id
    is null gets the component of its fingerprint, null if no row with an id
    is in it.  Rows that repeat an id are one document.
    """
    rows = Scratch(fingerprints(docs, words, id_col, text_col))
    distinct = Scratch(rows.df.groupBy("fp").agg(F.min("id").alias("id")))
    links = Scratch(near_fingerprints(distinct.df.select("fp")))
    # A fingerprint is a node of its own; its smallest id only comes in at the end.
    roots = components(docs.sparkSession, links.df)
    of = distinct.df.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    linked = of.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    in_groups = linked.join(least, "root").select("fp", "component_id")
    # A table of its own, so that Spark splits a fingerprint that many rows have.
    alone = Scratch(of.join(in_groups, "fp", "left").select("fp", F.coalesce("component_id", "id").alias("component_id")))
    out = rows.df.join(alone.df, "fp")
    return out.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component left: the one with the smallest id.

    Rows without an id come behind the others, then an own row number decides,
    so null and repeated ids are documents like any other.
    """
    names = docs.columns
    # Under plain names no column of the input can clash with those in between.
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at_id, at_text = (f"c{names.index(c)}" for c in (id_col, text_col))
    docs = numbered(docs, at_id, "key", nulls_last=True)
    found = near_duplicates(docs, words, "key", at_text).where(F.col("id") == F.col("component_id")).select(F.col("id").alias("key"))
    return docs.join(found, "key", "left_semi").drop("key").toDF(*names)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
