"""Substring deduplication by sliding spans of sentences (10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import Scratch, documents, numbered
from keyloom.llm.tokens import blocks

_END = re.compile(r"[.!?]\s+|\n\s*")


def sentences(text: str) -> list[int]:
    """Where each sentence begins, and the length of the text behind them.

    A sentence ends behind ``.``, ``!`` or ``?`` and white space, or behind a
    line; white space belongs to the sentence before it, so that sentences
    joined together are the text.
    """
    starts = [0, *(m.end() for m in _END.finditer(text))]
    if starts[-1] != len(text):
        starts.append(len(text))
    return starts


def runs(text: str, least: int = 2, words: int = 16, alone: int = 24, tails: bool = False) -> tuple[int, list[tuple[int, int, bytes]]]:
    """The number of sentences, and (first sentence, sentences, 128-bit hash) of every run.

    A run starts at each sentence and takes the fewest sentences that are
    ``least`` or more and hold ``words`` words or more; a sentence of ``alone``
    words is as long as several, and a run by itself.  With ``tails`` the
    fewest sentences that end at each sentence are a run too, so that runs
    within a passage of several sentences cover it to its last one; a long
    sentence at its end is in the run of any sentence before it.  Letter case
    and white space do not matter.
    """
    from xxhash import xxh3_128_digest

    starts = sentences(text)
    n, low = len(starts) - 1, text
    parts = [low[a:b].lower().split() for a, b in zip(starts, starts[1:])]
    size = [len(p) for p in parts]
    joined = [" ".join(p) for p in parts]
    found = []
    hashed = lambda i, j: (i, j - i, xxh3_128_digest(" ".join(joined[i:j]).encode("utf-8", "surrogatepass")))
    ends = {}
    for i in range(n):
        if not size[i]:
            continue
        if size[i] >= alone:
            j = i + 1
        else:
            j, held, full = i, 0, 0
            while j < n and (full < least or held < words):
                held += size[j]
                full += size[j] > 0
                j += 1
            if full < least or held < words:
                break
        found.append(hashed(i, j))
        ends[i] = j
    for j in range(n, 0, -1) if tails else ():
        if not 0 < size[j - 1] < alone:
            continue
        i, held, full = j, 0, 0
        while i and (full < least or held < words):
            i -= 1
            held += size[i]
            full += size[i] > 0
        if full < least or held < words:
            break
        if ends.get(i) != j:
            found.append(hashed(i, j))
    return n, found


def span_hashes(docs: DataFrame, least: int, words: int, alone: int, id_col: str, text_col: str, tails: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1, 2 << 20):
                ids, at, n, h = [], [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for i, k, digest in runs((text or b"").decode("utf-8", "replace"), least, words, alone, tails)[1]:
                        ids.append(doc)
                        at.append(i)
                        n.append(k)
                        h.append(digest)
                both = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
                yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["h1", "h2", "id", "at", "n"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "h1 long, h2 long, id long, at int, n int")


def repeated_spans(docs: DataFrame, least: int = 2, words: int = 16, alone: int = 24, id_col: str = "doc_id", text_col: str = "text", tails: bool = False) -> DataFrame:
    """(id, at, n): runs of sentences that occur before, in order of id and place.

    First occurrences are minima of a group, which Spark sums up before it
    shuffles, so a span that a third of all documents share is one row for each
    task; only spans that repeat meet their occurrences again.
    """
    spans = span_hashes(docs, least, words, alone, id_col, text_col, tails)
    first = spans.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("k")).where("k > 1").select("h1", "h2", "first")
    # A table of its own, so that Spark splits a span that many documents share.
    later = spans.join(Scratch(first).df, ["h1", "h2"]).where((F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at")))
    return later.select("id", "at", "n")


def drop_repeated_spans(docs: DataFrame, least: int = 2, words: int = 16, alone: int = 24, id_col: str = "doc_id", text_col: str = "text", tails: bool = False) -> DataFrame:
    """Remove every sentence that a non-first repeated span covers; with ``tails`` also at a passage's end.

    Returns the input's columns with the text cut down, _n_sentences and
    _n_removed.  Spans are compared over all documents, and within one; the
    first occurrence, by id and place, stays.  A null text stays null and has
    no sentences; a document may end up empty.  Rows that share an id, or lack
    one, are documents of their own, in order of an own row number; those
    without an id come first.  An empty table gives no rows.
    """
    names = docs.columns
    text_at = names.index(text_col)
    fields = [*docs.schema.fields, T.StructField("_n_sentences", T.LongType()), T.StructField("_n_removed", T.LongType())]
    # Under plain names no column of the input can clash with those in between.
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at_id = f"c{names.index(id_col)}"
    plain, docs = docs, numbered(docs, at_id, "id")
    spans = repeated_spans(docs, least, words, alone, "id", f"c{text_at}", tails)
    covered = spans.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    joined = docs.join(covered, "id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, text_at):
                texts, n, gone = [], [], []
                for text, spans in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist()):
                    starts = sentences(text.decode("utf-8", "replace")) if text else [0]
                    drop = np.zeros(len(starts), int)
                    for s in spans or ():
                        if s["at"] + s["n"] < len(starts):
                            drop[s["at"]] += 1
                            drop[s["at"] + s["n"]] -= 1
                    out = np.cumsum(drop)[:-1] > 0
                    if out.any():
                        whole_text = text.decode("utf-8", "replace")
                        text = "".join(whole_text[a:b] for a, b, x in zip(starts, starts[1:], out) if not x).encode()
                    texts.append(text)
                    n.append(len(out))
                    gone.append(int(out.sum()))
                columns = list(batch.columns[: len(names)])
                columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.record_batch([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[f"c{i}" for i in range(len(names) + 2)])

    flat = joined.select(*plain.columns, "spans")
    return flat.mapInArrow(cut, T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])).toDF(*[f.name for f in fields])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeated_spans(documents(spark, sf_dir).select("doc_id", "text"), tails=True)
    return cut.select("doc_id", F.col("_n_sentences").alias("n_sentences"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"), "text")
