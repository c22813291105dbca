"""Byte-level BPE encoding and decoding, and the word-wise encoders it shares with packing.

Text is encoded by the tokenizers library, over Arrow batches.  The library's
pre-tokenizer never merges across a word's edge, so a text's ids are the ids of
its words in order; each task remembers the ids of the words it has met
(bounded), and hands the library the new words of a batch in one call.  Texts
with unusual white space go to the library whole.  No shuffle.

Decoding reverses the byte table.  A token may end inside a character: the
bytes of neighbouring tokens are put together before they are read as UTF-8,
and a token's offset is that of the character its first byte belongs to.

Null or empty text: no ids, the hash of no bytes.  Empty table: no rows.
Repeated rows get equal results.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from arcweave.llm.common import arrays, id_text, map_arrow

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, reversed: printable bytes stand for themselves, others are moved up from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(moved)}


def load(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are then ordinary text
    return found


def packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def encoded(tokenizer, text: str) -> np.ndarray:
    """The library's ids of one text, without its offsets (which cost as much again)."""
    return np.asarray(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


class WordIds(dict):
    """Ids, as little-endian unsigned 32-bit integers, of the words of a text; at most `most` are remembered, none of over `longest` characters."""

    def __init__(self, tokenizer, most: int = 300_000, longest: int = 200):
        super().__init__({"": b""})
        self.tokenizer, self.most, self.longest = tokenizer, most, longest

    def __missing__(self, word: str) -> bytes:
        ids = packed(encoded(self.tokenizer, word))
        if len(word) <= self.longest:
            self[word] = ids
        return ids

    def make_room(self, texts: list[list[str]]) -> set[str]:
        """The short words of the texts that aren't known yet."""
        new = set().union(*texts)
        if len(self) + len(new) > self.most:
            self.clear()
            self[""] = b""
        return {w for w in new if w not in self and len(w) <= self.longest}

    def learn(self, words: list[str], text: str, first: np.ndarray, drop: int | None = None) -> None:
        """Encode the words as one text; first: whether a token id begins a word; drop: an id that only separates them."""
        if not words:
            return
        ids = encoded(self.tokenizer, text)
        starts = np.flatnonzero(first[ids])
        if drop is not None:
            starts = np.concatenate([[0], np.flatnonzero(ids == drop) + 1])
        if len(starts) != len(words):  # the library saw other edges: one by one
            for w in words:
                self[w]
            return
        ends = np.append(starts[1:], len(ids) + (drop is not None)) - (drop is not None)
        data = ids.astype("<u4").tobytes()
        self.update((w, data[4 * a : 4 * b]) for w, a, b in zip(words, starts.tolist(), ends.tolist(), strict=True))


class ByteLevel:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    #: Two white spaces in a row, or any other than space and line end; also the separator used here.
    UNUSUAL = re.compile(r"\s\s|[^\S \n]|\x00")

    def __init__(self, path: str, most: int = 300_000):
        self.tokenizer = load(path)
        back = byte_table()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        special = {t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]}
        for token, i in vocabulary.items():
            self.pieces[i] = token.encode() if token in special else bytes(back[c] for c in token)
        self.spaced = np.array([p[:1] == b" " for p in self.pieces])
        self.newline = self.pieces.index(b"\n")
        self.words = WordIds(self.tokenizer, most)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed."""
        split = [None if self.UNUSUAL.search(t) else t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") for t in texts]
        known = self.words
        new = known.make_room([s for s in split if s])
        spaced = [w for w in new if w[0] == " " and len(w) > 1]
        bare = [w for w in new if w[0] not in " \n"]
        known.learn(spaced, "".join(spaced), self.spaced)
        known.learn(bare, "\n".join(bare), self.spaced, self.newline)
        return [b"".join(map(known.__getitem__, s)) if s is not None else packed(encoded(self.tokenizer, t)) for s, t in zip(split, texts, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """For each token, the character that its first byte belongs to."""
        pieces = [self.pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]
        if not pieces:
            return np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.cumsum([0] + [len(p) for p in pieces[:-1]])
        return (np.cumsum((data & 0xC0) != 0x80) - 1)[at]


_LOADED: dict[str, ByteLevel] = {}


def byte_level(path: str) -> ByteLevel:
    """One encoder for each file and process."""
    if path not in _LOADED:
        _LOADED[path] = ByteLevel(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, starts (character offsets) and decoded (the text read back) of every document."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = byte_level(path)
        ids = coder.encode(batch.column(1).to_pylist())
        return arrays(schema, batch.column(0), [np.frombuffer(i, "<u4").astype(np.int32) for i in ids], [coder.offsets(i).astype(np.int32) for i in ids], [coder.decode(i).decode("utf-8", "replace") for i in ids])

    return map_arrow(id_text(docs), run, "doc_id long, ids array<int>, starts array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encode() without the arrays."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = byte_level(path)
        ids = coder.encode(batch.column(1).to_pylist())
        return arrays(schema, batch.column(0), [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(coder.decode(i)).hexdigest() for i in ids])

    return map_arrow(id_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
