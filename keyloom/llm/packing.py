"""Packing token sequences: best fit by counts of lengths (7) and best fit with a segment tree (6)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, buckets_for, documents, salted_rank
from keyloom.llm.tokens import blocks, encoder

#: Vocabulary file of the registered queries; every operator takes its path as a parameter.
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut every document's ids, ``end_id`` behind them, into pieces of ``seq_len`` at most.

    Returns doc_id, piece (from 0), start (the document's ids before it),
    length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit).
    Only documents longer than ``seq_len`` are cut; the pieces of a document
    joined together are its ids.  A null text is an empty one: it gives the
    end id alone, or no piece if there is none.  Repeated rows give a piece
    each, and a null id stays null.
    """
    end = np.array([] if end_id is None else [end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in blocks(whole, 1):
                ids, at = enc.encode(batch.column(1))
                rows = ([], [], [], [], [])
                bodies = []
                for row in range(batch.num_rows):
                    own = np.concatenate([ids[at[row] : at[row + 1]], end])
                    for piece, start in enumerate(range(0, len(own), seq_len)):
                        body = own[start : start + seq_len].tobytes()
                        for to, x in zip(rows, (row, piece, start, len(body) // 4, zlib.crc32(body))):
                            to.append(x)
                        if with_ids:
                            bodies.append(body)
                out = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])]
                yield pa.record_batch([*out, *([pa.array(bodies, pa.binary())] if with_ids else [])], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths rather than over pieces.

    Bins that look alike are handled as one range.  Returns rows (length,
    first rank, bins, pieces in each bin, first bin, place in the bin): the
    pieces of a length take these slots in order of their ranks from 0.  The
    number of rows depends on the capacity, not on the number of pieces.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first bin, bins)
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, room = counts[length], 0, length
        while left:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:
                bins = -(-left // (capacity // length))
                free[capacity].append((opened, bins))
                opened, room = opened + bins, capacity
            first, bins = free[room].pop()
            each = room // length
            used = min(bins, left // each)
            if not used:  # the last few share one bin
                each, used = left, 1
            plan.append((length, rank, used, each, first, capacity - room))
            free[room - each * length].append((first, used))
            if used < bins:
                free[room].append((first + used, bins - used))
            left, rank = left - used * each, rank + used * each
            room = length
    return plan


def place(pieces: DataFrame, plan: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Join pieces that know their rank (from 1) within their length with the planned slots.

    The plan has a few rows for each length and room at most, whatever the
    number of pieces, so each task gets it whole.
    """
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) | table[:, 1]
    names = [x for x in pieces.columns if x != "rank"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy() - 1
            slot = table[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            nth = rank - slot[:, 1]
            out = [slot[:, 4] + nth // slot[:, 3], slot[:, 5] + nth % slot[:, 3] * length]
            yield pa.record_batch([*batch.columns[: len(names)], *map(pa.array, out)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{x} {pieces.schema[x].dataType.simpleString()}" for x in names)
    return pieces.select(*names, "rank").mapInArrow(join, f"{schema}, sequence_id long, offset long")


def pack_by_histogram(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into as few sequences of ``seq_len`` ids as best fit finds.

    The driver sees a count for each length, ``seq_len`` of them at most, and
    plans over those.  Pieces then take slots by their rank within their
    length; ranks are counted within salted buckets, so that one length may
    hold any share of the pieces.  Returns ``token_pieces`` with sequence_id
    and offset; the pieces of a sequence follow each other without gaps from
    offset 0.  An empty table gives no rows.
    """
    cut = Scratch(token_pieces(docs, tokenizer, seq_len, end_id, id_col, text_col).withColumn("_uid", F.monotonically_increasing_id()))
    hist = {r.length: r.n for r in cut.df.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bucket = F.pmod(F.xxhash64("_uid"), F.lit(buckets_for(sum(hist.values())))).cast("int")
    ranked = salted_rank(cut.df.withColumn("_bucket", bucket), ["length"], "_bucket", ["_uid"], "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return place(ranked, plan_best_fit(hist, seq_len))


class Rooms:
    """A segment tree over bins: finds the fullest bin that still has some room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)  # node i covers 2i and 2i + 1; a leaf is an amount of room
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of ``need`` or more, and that room."""
        i = need + self.size
        if not self.any[i]:
            while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i + (not self.any[2 * i])
        room = i - self.size
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            self.any[i] = 0
            while i > 1 and not self.any[i ^ 1]:
                i >>= 1
                self.any[i] = 0
        return room, bin_


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[list[int]], int]:
    """The items of each bin, and the number of bins, by best fit with the longest first."""
    rooms, bins = Rooms(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := rooms.take(lengths[item])) is None:
            found = capacity, len(bins)
            bins.append([])
        room, bin_ = found
        bins[bin_].append(item)
        if room > lengths[item]:
            rooms.add(room - lengths[item], bin_)
    return bins, len(bins)


def packed_matrix(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int | None = 0, pad_id: int = 0, block_tokens: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids packed into rows of a matrix by best-fit-decreasing, ready to be written as Parquet.

    Each task packs blocks of ``block_tokens`` ids as it reads its documents,
    so no token is shuffled and memory is bounded; only a block's last rows may
    be loosely filled.  A document longer than ``seq_len`` is split into pieces
    that, joined, are its ids.  Returns one row per packed sequence:
    block (task and number), row (within the block), input_ids (``seq_len``
    little-endian unsigned 32-bit ids, padded with ``pad_id``), position_ids
    (the same shape; from 0 again at every segment and at the padding),
    cu_seqlens (cumulative segment lengths, from 0), doc_ids and starts (of
    each segment: its document, and that document's ids before it).  A null
    text is an empty one; an empty table gives no rows.
    """
    end = np.array([] if end_id is None else [end_id], "<u4")
    kind = docs.schema[id_col].dataType.simpleString()

    def emit(block: str, pieces: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        bins, n = best_fit_decreasing([len(x[2]) for x in pieces], seq_len)
        matrix, places = np.full((n, seq_len), pad_id, "<u4"), np.zeros((n, seq_len), "<u4")
        edges = []
        for row, items in enumerate(bins):
            at = [0]
            for i in items:
                body = pieces[i][2]
                matrix[row, at[-1] : at[-1] + len(body)] = body
                places[row, at[-1] : at[-1] + len(body)] = np.arange(len(body))
                at.append(at[-1] + len(body))
            places[row, at[-1] :] = np.arange(seq_len - at[-1])
            edges.append(at)
        out = [pa.array([block] * n), pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array([x.tobytes() for x in places], pa.binary()), pa.array(edges, pa.list_(pa.int32()))]
        out += [pa.array([[pieces[i][0] for i in items] for items in bins], pa.list_(ids)), pa.array([[pieces[i][1] for i in items] for items in bins], pa.list_(pa.int64()))]
        return pa.record_batch(out, names=["block", "row", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        pieces, held = [], 0
        for whole in batches:
            for batch in blocks(whole, 1, block_tokens // 2):
                ids, at = enc.encode(batch.column(1))
                for row, doc in enumerate(batch.column(0).to_pylist()):
                    own = np.concatenate([ids[at[row] : at[row + 1]], end])
                    for start in range(0, len(own), seq_len):
                        pieces.append((doc, start, own[start : start + seq_len]))
                        held += len(pieces[-1][2])
                        if held >= block_tokens:
                            yield emit(f"{task:06d}-{number:06d}", pieces, whole.schema.field(0).type)
                            pieces, held, number = [], 0, number + 1
        if pieces:
            yield emit(f"{task:06d}-{number:06d}", pieces, whole.schema.field(0).type)

    schema = f"block string, row int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{kind}>, starts array<bigint>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, schema)


def write_packed(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write ``packed_matrix`` as Parquet with fixed-width binary rows; any reader of Parquet can map them."""
    packed_matrix(docs, tokenizer, **options).write.parquet(path)


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed sequence: where it is, how full, its documents, and a checksum of its ids and positions."""
    p = packed_matrix(documents(spark, sf_dir), vocabulary())
    return p.select(
        "block",
        "row",
        F.size("doc_ids").cast("long").alias("n_segments"),
        F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"),
        "doc_ids",
        "starts",
        F.concat_ws(",", F.col("cu_seqlens").cast("array<string>")).alias("cu_seqlens"),
        F.crc32("input_ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("positions_crc32"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_histogram(documents(spark, sf_dir), vocabulary())
