import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import packing
from keyloom.llm.tokens import Encoder, blocks


@pytest.fixture(scope="module")
def encoder():
    return Encoder(packing.vocabulary(), cache=50)


def plain(encoder, text):
    return list(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids)


def same(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    return all(ids[at[i] : at[i + 1]].tolist() == plain(encoder, t) for i, t in enumerate(texts))


PIECES = st.sampled_from(["a", "B", "é", "é", "́", " ", "\n", " ", "\x1c", "\x85", "'s", "'S", "9", "½", "İ", "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "!", "漢", "ᄀ", "ᅡ", "‍", "👩", "\x00", "$$$", ".", "²", "ª", "ﬁ", "ⅷ", "hello", "World"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), max_size=40))
def test_ids_equal_the_tokenizers(texts):
    assert same(Encoder.shared, texts)


Encoder.shared = Encoder(packing.vocabulary(), cache=50)


def test_ids_of_odd_texts(encoder, odd_texts):
    assert encoder.by_word and same(encoder, odd_texts) and same(encoder, []) and same(encoder, [None])


def test_other_vocabularies_get_whole_texts(odd_texts):
    other = Encoder(packing.vocabulary("byte_bpe_50k.json"))
    assert not other.by_word and same(other, odd_texts[:5] + ["  two  spaces "])


def test_blocks_cover_a_batch():
    b = pa.record_batch([pa.array(["aa", None, "b" * 50, "", "c"])], names=["t"])
    parts = list(blocks(b, 0, 3))
    assert [x for p in parts for x in p.column(0).to_pylist()] == b.column(0).to_pylist() and len(parts) > 1
    assert list(blocks(b.slice(0, 0), 0)) == []


def slots(plan):
    return [(length, rank + n * each + k, first + n, at + k * length) for length, rank, bins, each, first, at in plan for n in range(bins) for k in range(each)]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_fills_bins_without_gaps(counts):
    found = slots(packing.plan_best_fit(counts, 30))
    assert sorted((length, rank) for length, rank, _, _ in found) == [(length, r) for length in sorted(counts) for r in range(counts[length])]
    bins = {}
    for length, _, b, at in found:
        bins.setdefault(b, []).append((at, length))
    for parts in bins.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 30
    # As good as best fit over the pieces themselves.
    lengths = [length for length, n in counts.items() for _ in range(n)]
    assert len(bins) == packing.best_fit_decreasing(lengths, 30)[1] if lengths else not bins


def naive_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 33), max_size=60))
def test_segment_tree_equals_plain_best_fit(lengths):
    bins, n = packing.best_fit_decreasing(lengths, 33)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and n == naive_best_fit(lengths, 33)
    assert all(sum(lengths[i] for i in b) <= 33 for b in bins)


def test_packed_by_histogram(docs, odd_texts, encoder):
    got = packing.pack_by_histogram(docs(odd_texts), packing.vocabulary(), 64).toPandas()
    for i, t in enumerate(odd_texts):
        ids = np.array([*plain(encoder, t), 0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == list(range(0, len(ids), 64))
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 64].tobytes()) for s in own.start]
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 1


def test_repeated_and_null_ids_are_pieces_each(docs):
    got = packing.pack_by_histogram(docs(["a b"] * 40 + ["c"], [7] * 20 + [None] * 21), packing.vocabulary(), 16).toPandas()
    assert len(got) == 41 and not got.duplicated(["sequence_id", "offset"]).any()


def test_empty_table(docs):
    assert packing.pack_by_histogram(docs([]), packing.vocabulary()).count() == 0
    assert packing.packed_matrix(docs([]), packing.vocabulary()).count() == 0


def test_extra_columns_do_not_clash(docs):
    d = docs(["a b", "c"]).withColumns({c: F.lit(1) for c in ("piece", "length", "rank", "_uid", "_bucket", "ids")})
    assert packing.pack_by_histogram(d, packing.vocabulary()).count() == 2


def test_matrix_round_trip(docs, odd_texts, encoder, tmp_path, spark):
    packing.write_packed(docs(odd_texts), str(tmp_path / "m"), packing.vocabulary(), seq_len=64, end_id=49407, pad_id=5, block_tokens=4096)
    back = {i: {} for i in range(len(odd_texts))}
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids, places = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        edges = r.cu_seqlens
        assert len(ids) == len(places) == 64 and edges[0] == 0 and (ids[edges[-1] :] == 5).all()
        for doc, start, a, b in zip(r.doc_ids, r.starts, edges, edges[1:]):
            back[doc][start] = ids[a:b].tolist()
            assert places[a:b].tolist() == list(range(b - a))
        assert places[edges[-1] :].tolist() == list(range(64 - edges[-1]))
    for i, t in enumerate(odd_texts):
        assert [x for s in sorted(back[i]) for x in back[i][s]] == [*plain(encoder, t), 49407]


def test_query_6(spark, sf):
    got = packing.op6_token_binary(spark, sf).toPandas()
    n = packing.token_pieces(spark.read.parquet(f"{sf}/documents.parquet"), packing.vocabulary()).agg(F.sum("length"), F.count("*")).first()
    assert (got.n_tokens.sum(), got.n_segments.sum()) == tuple(n) and json.dumps(got.columns.tolist())
