"""Mixing sources to target weights by systematic sampling (3); DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, Scratch, buckets_for, documents, salted_rank

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def _offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) drawn for each source: 52 bits of a hash, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), source)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed_id(ident: Column) -> Column:
    """32 bits of a multiplicative hash, whose upper ones lie evenly for ids in any regular distance."""
    return F.pmod(ident, F.lit(1 << 31)) * F.lit(2654435761) % F.lit(1 << 32)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``target`` for each row (src, source_size) of ``sizes``, one row per source.

    Sources in order of ``src`` weigh ``weights`` over and over.  They share
    ``share`` of all sizes by weight, none above ``most`` times its size; what
    is cut off goes to the others by weight until none is above.  That is
    ``min(most * size, level * weight)`` at the level that uses up the share:
    in order of ``most * size / weight`` a source is cut off as long as the
    rest at its own level would ask for less than there is.
    """
    every = Window.orderBy("src")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # Sources from the first that stays below its cap get that source's level.
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "src", "level"))).over(whole)["level"])
    return s.select("src", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Add _size, _source_size, _target and _copies to every document.

    Within a source every document has the same expected number of copies,
    target / size.  Documents in order of size add theirs up, from one random
    offset, and one copy is made for each whole number that is crossed: so
    large and small documents are taken alike, and a source's words miss its
    target by about one of its largest documents at most.  Documents of equal
    size are in order of ``mixed_id``, then of their id, however many rows or
    buckets there are.  A null text has size 0; null is a source of its own, the last
    one; a source without words has target 0 and no copies.  An empty table
    gives no rows.

    The sums are counts: of sizes within a source, of buckets within a size,
    and of documents within a bucket, so no task gets a whole source.
    """
    names = docs.columns
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    sized = sized.select(
        "doc",
        # Null sorts behind every text: texts get a lower first letter.
        F.when(F.col(f"doc.`{source_col}`").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(f"doc.`{source_col}`").cast("string"))).alias("src"),
        F.coalesce(F.regexp_count(F.col(f"doc.`{text_col}`"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        F.coalesce(F.col(f"doc.`{id_col}`").cast("long"), F.lit(-1).cast("long")).alias("id"),
    )
    skinny = Scratch(sized.select("src", "size", "id"))
    # The upper bits of the mixed id are the bucket, so the number of buckets does not change the order.
    bits = (buckets_for(skinny.df.count()) - 1).bit_length()
    placed = lambda df: df.withColumn("mixed", mixed_id(F.col("id"))).withColumn("bucket", F.shiftright("mixed", 32 - bits))
    hist = skinny.df.groupBy("src", "size").agg(F.count("*").alias("n"))
    ends = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("smaller", F.coalesce(F.sum("n").over(ends), F.lit(0)))
    by_source = targets(skinny.df.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, most)
    # One row for each size of each source.
    level = hist.join(by_source, "src").select("src", "size", "smaller", "source_size", "target")
    ranked = salted_rank(placed(sized), ["src", "size"], "bucket", ["mixed", "id"], "rank", placed(skinny.df))
    r = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    at = (F.col("smaller") + F.col("rank")).cast("double")
    crossed = lambda x: F.floor(x * r + _offset(F.col("src"), seed))
    out = ranked.join(level, ["src", "size"]).withColumn("copies", crossed(at) - crossed(at - 1))
    return out.select("doc.*", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("copies").cast("int").alias("_copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each as many times as it has copies, with the columns it came with."""
    m = mix(docs, **options)
    return m.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).cast("long").alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(doc_id, -1) AS id
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *,
    1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest_w
  FROM w),
l AS (SELECT rest / rest_w AS level FROM o WHERE rest / rest_w * w <= cap ORDER BY cap / w, src LIMIT 1),
t AS (SELECT src, source_size, CASE WHEN (SELECT count(*) FROM l) = 0 THEN cap ELSE least(cap, (SELECT level FROM l) * w) END AS target,
    CAST('0x' || substr(md5('mix:' || src), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM o),
k AS (SELECT d.*, t.source_size, t.target, t.u,
    CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0.0 END AS r,
    row_number() OVER (PARTITION BY d.src ORDER BY size, (((id % 2147483648) + 2147483648) % 2147483648) * 2654435761 % 4294967296, id)::DOUBLE AS nth
  FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target, (size * (floor(nth * r + u) - floor((nth - 1) * r + u)))::BIGINT AS taken FROM k
"""
