"""Token ids of whole texts under a bounded cache of words."""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PUNCT = string.punctuation.replace("'", "")
#: Bytes of text that are encoded at once, and of a word that is kept at most.
BLOCK, WORD_BYTES = 2 << 20, 64
#: What each worker process has loaded, by path.
_loaded: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves, the others for the code
    points from 256, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with some ``most`` bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < len(size):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
        end = max(at + 1, end)
        yield batch.slice(at, end - at)
        at = end


class Encoder:
    """Encodes texts to unsigned 32-bit ids, as ``tokenizers`` does without special tokens added.

    A vocabulary that drops white space (a Split pre-tokenizer whose pieces
    hold none, after normalizers that work within words) gives a text the ids
    of its words one after another, so each distinct word of a block is looked
    up once, and words of letters go through a faster merge of the same ranks.
    Other vocabularies, texts that hold ``<|``, and long words go through
    ``tokenizers`` as they are.  The cache holds two generations: when the
    young one is full it becomes the old one, and words still used move back.
    """

    def __init__(self, path: str, cache: int = 150_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = cache
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normalizers = {x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])}
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = next((x for x in pre if x["type"] == "Split"), {})
        special = [x for x in spec.get("added_tokens", []) if x.get("lstrip") or x.get("rstrip") or x.get("single_word") or not x["content"].startswith("<|") or any(c.isspace() for c in x["content"])]
        model = spec["model"]
        self.by_word = normalizers == {"NFC", "Replace", "Lowercase"} and [x["type"] for x in pre] == ["Split", "ByteLevel"] and bool(split.get("invert")) and split.get("behavior") == "Removed" and not special and not spec.get("post_processor") and model.get("end_of_word_suffix") == "</w>"
        if self.by_word:
            # Ids are in order of merging, so they serve as ranks.  0xFF, no byte of UTF-8, marks a word's end.
            byte = {c: b for b, c in byte_letters().items()}
            ranks = {}
            for token, i in model["vocab"].items():
                body, end = (token[:-4], b"\xff") if token.endswith("</w>") and token != "</w>" else (token, b"")
                if all(c in byte for c in body):
                    ranks[bytes(byte[c] for c in body) + end] = i
            self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def _whole(self, text: bytes) -> bytes:
        found = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)
        return np.asarray(found[0].ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes | None:
        """The ids of a word of letters only, which is one piece; None for other words."""
        if word.isascii():
            if not word.isalpha():
                return None
            piece = word.lower()
        else:
            piece = "".join([c.lower() for c in word])
            if not piece.isalpha() or not is_normalized("NFC", word):
                return None
        return np.array(self.merge(piece.encode() + b"\xff"), "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        key = text.encode()
        if (found := self.young.get(key) or self.old.get(key)) is None:
            found = self._letters(text) if len(key) <= WORD_BYTES else None
            if found is None:
                found = self._whole(key)
            if len(key) <= WORD_BYTES:
                self.young[key] = found
        return found

    def _word(self, word: bytes) -> bytes:
        """The ids of a word that the young generation lacks."""
        if (found := self.old.get(word)) is None:
            try:
                text = word.decode()
            except UnicodeDecodeError:
                return self._whole(word)
            core = text.rstrip(_PUNCT)
            # Behind a letter a run of punctuation is a piece of its own.
            if len(core) < len(text) and core and core[-1].lower().isalpha():
                found = self._part(core) + self._part(text[len(core) :])
            else:
                found = self._part(text)
        if len(word) <= WORD_BYTES:
            self.young[word] = found
        return found

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after another, and where each text begins and the last one ends; null: no ids."""
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)) if self.by_word else np.arange(len(texts))
        if len(odd):
            raw, own = texts.view(pa.binary()), {}
            for i in odd.tolist():
                own[i] = np.frombuffer(self._whole(raw[i].as_py()), "<u4")
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            ids, at = self._by_word(pc.if_else(pa.array(mask), "", texts))
            each = [own.get(i, ids[at[i] : at[i + 1]]) for i in range(len(texts))]
            return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        return self._by_word(texts)

    def _by_word(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.view(pa.binary()).to_pylist(), coded.indices.to_numpy()
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        known, word = self.young, self._word
        found = [known[w] if w in known else word(w) if w else b"" for w in words]
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(n) - n
        each = n[codes]
        end = np.cumsum(each)
        ids = pool[np.repeat(start[codes] - (end - each), each) + np.arange(end[-1] if len(end) else 0)]
        edges = np.asarray(split.offsets) - split.offsets[0].as_py()
        return ids, np.concatenate([[0], end])[edges]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
