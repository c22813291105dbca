"""Packing: order-preserving dynamic programming over cut places.

Documents are packed in the order in which a task reads them.  Places where a
sequence may end are ends of documents, ends of sentences (dearer), and, where
neither comes for long, any 16th token (dearest).  The cost of a sequence is
its padding plus the penalty of its last cut; the best cost up to a place is
the least, over all places at most `size` tokens before, of that place's cost
plus its position, kept in a queue with rising costs: each place enters and
leaves once.  Documents go through in blocks; a block's last, open sequence is
carried into the next.  The last sequence of a task is cut into powers of two,
which need no padding.  No shuffle: a task holds one block.

Null or empty text: only the end id.  Repeated rows are packed each.  Empty
table: no rows.  A longer document than a sequence is cut.  Other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from arcweave.llm.bpe import encoded, load
from arcweave.llm.common import id_text, release, slices

SENTENCE, HARD, HARD_STEP = 4, 16, 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs source[start : start + length], one after another."""
    before = np.cumsum(lengths) - lengths
    return source[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class WordLevel:
    """Encoder of a BPE file with word ends, which drops white space.

    A batch's words are told apart by Arrow; Python sees only the distinct
    ones, and the library only those not met before.  When a batch leaves more
    than `most` words or four times as many ids, all are forgotten.
    """

    LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\sA-Za-z0-9'À-ÖØ-öø-ÿ\u0080-\U0010ffff]*)")

    def __init__(self, path: str, most: int = 600_000):
        self.tokenizer, self.most = load(path), most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        n = max(vocabulary.values()) + 1
        self.ends, self.stops = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
            self.stops[i] = token.endswith("</w>") and token[:-4] != "" and set(token[:-4]) <= set(".!?")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.size = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of distinct new words, which stand one after another."""
        first, n = len(self.known), len(words)
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + n > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.size : self.size + len(ids)] = ids
        self.starts[first : first + n] = self.size + np.cumsum(lengths) - lengths
        self.lengths[first : first + n] = lengths
        self.known.update(zip(words, range(first, first + n), strict=True))
        self.size += len(ids)

    def learn(self, new: list[str]) -> None:
        """Remember words that aren't known yet."""
        known = self.known
        letters = {w: None for w in new if w.isascii() and w.isalpha()}
        rest = [w for w in new if w not in letters]
        parts = [(w, m[1], m[2]) for w, m in zip(rest, map(self.LETTERS.fullmatch, rest), strict=True) if m]
        odd = dict.fromkeys(set(rest).difference(w for w, _, _ in parts))
        letters |= dict.fromkeys(a for _, a, _ in parts if a not in known)
        if letters:
            ids = encoded(self.tokenizer, " ".join(letters))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(letters):
                self.remember(list(letters), ids, np.diff(ends, prepend=0))
            else:  # the library saw other edges: one by one
                odd |= letters
        odd |= dict.fromkeys(b for _, _, b in parts if b not in known)
        if odd:
            found = [encoded(self.tokenizer, w) for w in odd]
            self.remember(list(odd), np.concatenate(found), np.array([len(x) for x in found]))
        parts = [p for p in parts if p[2]]
        if parts:
            at = np.array([known[x] for _, a, b in parts for x in (a, b)])
            lengths = self.lengths[at]
            self.remember([w for w, _, _ in parts], gathered(self.ids, self.starts[at], lengths), lengths.reshape(-1, 2).sum(1))

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word's ids are remembered."""
        coded = pc.dictionary_encode(words)
        own, known = coded.dictionary.to_pylist(), self.known
        new = [w for w in own if w not in known]
        if new:
            self.learn(new)
        return np.fromiter(map(known.__getitem__, own), np.int64, len(own))[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and where each text ends.

        A stop after a letter or digit is a token run of its own, so words are
        looked up without the stops at their end.
        """
        if len(self.known) > self.most or self.size > 4 * self.most:
            self.forget()
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        words = pc.ascii_lower(split.flatten())  # not of a slice, which it reads wrongly
        cores = pc.ascii_rtrim(words, ".,!?")
        more = pc.subtract(pc.binary_length(words), pc.binary_length(cores)).to_numpy(zero_copy_only=False)
        stopped = np.flatnonzero(more)
        stopped = stopped[pc.match_substring_regex(cores.take(pa.array(stopped)), "[a-zß-öø-ÿ0-9]$").to_numpy(zero_copy_only=False)]
        whole = np.ones(len(words), bool)
        whole[stopped] = False
        at = self.places(pc.if_else(pa.array(whole), words, cores))
        ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        if len(stopped):
            last = np.empty(len(stopped), np.int64)
            for n in np.unique(more[stopped]).tolist():
                own = more[stopped] == n
                last[own] = self.places(pc.utf8_slice_codeunits(words.take(pa.array(stopped[own])), -n, None))
            at, ends = np.insert(at, stopped + 1, last), ends + np.searchsorted(stopped, ends)
        lengths = self.lengths[at]
        return gathered(self.ids, self.starts[at], lengths), np.append(0, np.cumsum(lengths))[ends]


_LOADED: dict[str, WordLevel] = {}


def word_level(path: str) -> WordLevel:
    if path not in _LOADED:
        _LOADED[path] = WordLevel(path)
    return _LOADED[path]


def cut_places(stops: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a sequence may end, rising from 0, and their penalties, from those of sentence ends and of document ends."""
    edges = np.union1d(np.append(0, stops), ends)
    more = (np.diff(edges) - 1) // HARD_STEP + 1  # places in each gap: its end, and before that every HARD_STEP
    last = np.cumsum(more) - 1
    places = np.repeat(edges[:-1], more) + (np.arange(int(more.sum())) - np.repeat(last - more + 1, more) + 1) * HARD_STEP
    places[last] = edges[1:]
    penalty = np.full(len(places), HARD, np.int64)
    penalty[last] = SENTENCE
    penalty[np.searchsorted(places, ends)] = 0
    return np.append(0, places), np.append(0, penalty)


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int, whole: bool) -> list[int]:
    """Positions of the cuts of least cost; whole: the last one is the last place, else the best one near it."""
    place, extra = at.tolist(), penalty.tolist()
    cost, before = [0] * len(place), [0] * len(place)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])
    for j in range(1, len(place)):
        p = place[j]
        while queue[0][1] < p - size:
            queue.popleft()
        key, _, before[j] = queue[0]
        c = cost[j] = key + size - p + extra[j]
        key = c + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    j = len(place) - 1
    if not whole:
        near = int(np.searchsorted(at, at[-1] - size, side="right"))
        j = min(range(max(near, 1), len(place)), key=lambda i: (cost[i], -i))
    cuts = []
    while j:
        cuts.append(place[j])
        j = before[j]
    return cuts[::-1]


def powers(n: int) -> list[int]:
    """Powers of two, falling, that sum to n."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs documents given one after another; rows() gives the pieces of finished sequences."""

    def __init__(self, size: int, block: int, first: int):
        self.size, self.block, self.sequence = size, block, first
        self.docs: list[tuple[int | None, bytes, int, int, np.ndarray]] = []  # id, ids, tokens used before, all tokens, stops
        self.held, self.rows = 0, []

    def add(self, doc_id: int | None, ids: bytes, stops: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids) // 4, stops))
        self.held += len(ids) // 4
        if self.held >= self.block:
            self.flush(False)

    def flush(self, last: bool) -> None:
        if not self.docs:
            return
        ends = np.cumsum([len(d[1]) // 4 for d in self.docs])
        at, penalty = cut_places(np.concatenate([d[4] + (e - len(d[1]) // 4) for d, e in zip(self.docs, ends, strict=True)]), ends)
        cuts = best_cuts(at, penalty, self.size, last)
        if last:
            rest = cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0)
            start = cuts.pop() - rest
            cuts += [start + int(x) for x in np.cumsum(powers(rest))]
        i, used, left = 0, 0, 0
        for cut in cuts:
            offset = 0
            while left < cut:
                doc_id, ids, before, total, _ = self.docs[i]
                n = min(len(ids) // 4 - used, cut - left)
                self.rows.append((doc_id, before + used, n, zlib.crc32(memoryview(ids)[4 * used : 4 * (used + n)]), total, self.sequence, offset))
                offset, left, used = offset + n, left + n, used + n
                if used == len(ids) // 4:
                    i, used = i + 1, 0
            self.sequence += 1
        self.docs = self.docs[i:]
        if used:
            doc_id, ids, before, total, stops = self.docs[0]
            self.docs[0] = (doc_id, ids[4 * used :], before + used, total, stops[stops > used] - used)
        self.held -= left


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, end: int = 1, block: int = 1 << 18) -> DataFrame:
    """A row for each piece of a document in a sequence: where it starts in its document and in the sequence, its length and checksum."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    types = [pa.int64()] * 7
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    ending = np.array([end], "<u4").tobytes()

    def emit(packer: Packer) -> pa.RecordBatch:
        columns = list(zip(*packer.rows, strict=True))
        packer.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_level(path)
        packer = Packer(size, block, TaskContext.get().partitionId() << 32)
        for b in slices(batches):
            ids, ends = coder.encode(b.column(1))
            stops = np.flatnonzero(coder.stops[ids]) + 1
            before = np.append(0, ends[:-1])
            within = np.searchsorted(stops, before, side="right"), np.searchsorted(stops, ends, side="right")
            for doc_id, start, stop, low, high in zip(b.column(0).to_pylist(), before.tolist(), ends.tolist(), *(x.tolist() for x in within), strict=True):
                packer.add(doc_id, ids[start:stop].astype("<u4").tobytes() + ending, stops[low:high] - start)
            if packer.rows:
                yield emit(packer)
        packer.flush(True)
        if packer.rows:
            yield emit(packer)
        release()

    return id_text(docs).mapInArrow(run, SCHEMA)
