"""From raw documents to packed sequences, in five stages that each read what the one before kept.

1. ``toxicity``: documents scored 0.5 or more go.
2. ``line_dedup``: lines that an earlier line equals or nearly equals go from
   their texts; every document stays, though it may end up empty.
3. ``near_dedup``: of documents that links of a similarity of 0.8 or more of
   their five-word shingles connect, one stays.  Candidates come from the
   deletion variants of the shingles' SimHash, as in op1, and for links that 64
   bits do not show from bands of minima; all are verified on the whole texts.
4. ``mixing``: each source's documents are taken zero, one or two times, so
   that its words come near its target.
5. ``packing``: the token ids of all that is left, packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import lines, mixing, packing, shingles, toxicity
from keyloom.llm.common import Scratch, documents, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.drop_repeated_lines(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return shingles.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_by_histogram(docs, packing.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL has no tokenizer and no Viterbi decoding; tests/llm holds the stages against plainer versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = Scratch(docs).df
    return docs
