"""Subword lattice likelihood.

A word's probability is the sum, over all ways to cut it into pieces of an
existing vocabulary, of the product of the pieces' probabilities: a forward
recursion in log space over the word's characters.  Characters that no piece
covers are spelt in bytes.  A text's score adds up its words and one end, in
log10.  The pieces' probabilities start from the vocabulary's order of scores
and are fitted to the training words by a round of expectation-maximisation
(forward-backward over the same lattice), with one added to every count: the
vocabulary has no unigram scores, only merge ranks.  `score` is the lattice's
alone.  In `mixed_score` a word of the training tokens has one more edge, over
all of it: its count less a discount, as a share of all words; what the
discounts leave is the lattice's.

Counting: each task counts the words of its documents, and one aggregation over
words gives the training counts; only distinct words are scored on the lattice.
A word with at least N / heavy_share of the N training tokens is heavy: there
are at most heavy_share of them, so they are broadcast.  The other words of a
document are joined to their counts and summed by document again.

Null or empty text: the end token alone.  Repeated rows are scored each.
Null ids: not held out, not learnt from.  Empty table: no rows.  Other columns
are not read.  Very long texts and words are scored whole, in time linear in
them.  No training tokens: every count is 0, and V counts as 0.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import arrays, bytes_list, fold, map_arrow, slices, written

END = b"\n"  # stands for the end token: never a word
SPACE = "▁"  # begins each word in the vocabulary
LONG = 256  # words of more characters are taken one by one, all their places at once


class Lattice:
    """All segmentations of many words at once.  probabilities: one for each piece, bytes last."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.longest = max(map(len, pieces))
        codes = np.zeros((len(pieces), self.longest), np.uint64)
        for i, p in enumerate(pieces):
            codes[i, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        hashes = np.zeros(len(pieces), np.uint64)
        lengths = np.array([len(p) for p in pieces])
        for j in range(self.longest):
            on = lengths > j
            hashes[on] = hashes[on] * np.uint64(0x9E3779B97F4A7C15) + codes[on, j] + np.uint64(1)
        order = np.argsort(hashes)
        self.hashes, self.index = hashes[order], order
        self.logp, self.byte = logp, len(pieces)

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of the pieces that words of one length have at each place."""
        n = codes.shape[1]
        for start in range(n):
            h = np.zeros(len(codes), np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, end - 1] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                rows = np.flatnonzero(self.hashes[at] == h)
                if len(rows):
                    yield start, end, rows, self.index[at[rows]]

    def spelt(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of a character in bytes."""
        return (1 + (codes > 0x7F).astype(float) + (codes > 0x7FF) + (codes > 0xFFFF)) * self.logp[self.byte]

    def forward(self, codes: np.ndarray, edges: list) -> np.ndarray:
        n = codes.shape[1]
        alpha = np.full((n + 1, len(codes)), -np.inf)
        alpha[0] = 0
        by_end: list[list] = [[] for _ in range(n + 1)]
        for e in edges:
            by_end[e[1]].append(e)
        for end in range(1, n + 1):
            alpha[end] = alpha[end - 1] + self.spelt(codes[:, end - 1])
            for start, _, rows, pieces in by_end[end]:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.logp[pieces])
        return alpha

    def matches(self, codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, pieces), by start, of the pieces that one word has from low to high (exclusive), all places at once."""
        n, found = len(codes), []
        h, at = np.zeros(high - low, np.uint64), np.arange(low, high)
        for size in range(1, min(self.longest, n - low) + 1):
            at = at[: max(0, min(high, n - size + 1) - low)]
            h = h[: len(at)] * np.uint64(0x9E3779B97F4A7C15) + codes[at + size - 1] + np.uint64(1)
            i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[i] == h)
            found.append((at[hit], at[hit] + size, self.index[i[hit]]))
        starts, ends, pieces = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], pieces[order]

    def blocks(self, codes: np.ndarray, back: bool = False, block: int = 1 << 16) -> Iterator[tuple]:
        """Of one word, block by block: where it begins, the spelling's log-probabilities, bounds of each place's edges, their ends, pieces and starts."""
        lows = range(0, len(codes), block)
        for low in reversed(lows) if back else lows:
            high = min(len(codes), low + block)
            starts, ends, pieces = self.matches(codes, low, high)
            yield low, self.spelt(codes[low:high]), np.searchsorted(starts, np.arange(low, high + 1)), ends, pieces, starts

    def chain(self, codes: np.ndarray) -> array:
        """forward() of one long word: each place passes its sum on to the ends of its edges."""
        alpha = array("d", [-math.inf]) * (len(codes) + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for low, spelt, bounds, ends, pieces, _ in self.blocks(codes):
            bounds, ends, logp = bounds.tolist(), ends.tolist(), self.logp[pieces].tolist()
            for j, x in enumerate(spelt.tolist()):
                a = alpha[low + j]
                for e, lp in ((low + j + 1, x), *zip(ends[bounds[j] : bounds[j + 1]], logp[bounds[j] : bounds[j + 1]], strict=True)):
                    y, z = a + lp, alpha[e]
                    alpha[e] = y + log1p(exp(z - y)) if y > z else z + log1p(exp(y - z))
        return alpha

    def chain_expect(self, codes: np.ndarray, count: float, total: np.ndarray) -> None:
        """Adds one long word's expected counts to total."""
        n = len(codes)
        alpha, beta = np.frombuffer(self.chain(codes)), array("d", [-math.inf]) * (n + 1)
        beta[n] = 0.0
        weight = math.log(count) - alpha[n]
        exp, log1p = math.exp, math.log1p
        for low, spelt, bounds, ends, pieces, starts in self.blocks(codes, back=True):
            edges, to, logp, spell = bounds.tolist(), ends.tolist(), self.logp[pieces].tolist(), spelt.tolist()
            for j in range(len(spell) - 1, -1, -1):
                z = beta[low + j + 1] + spell[j]
                for k in range(edges[j], edges[j + 1]):
                    y = beta[to[k]] + logp[k]
                    z = y + log1p(exp(z - y)) if y > z else z + log1p(exp(y - z))
                beta[low + j] = z
            after = np.frombuffer(beta)
            total[: self.byte] += np.bincount(pieces, np.exp(alpha[starts] + self.logp[pieces] + after[ends] + weight), self.byte)
            high = low + len(spelt)
            total[self.byte] += float((spelt / self.logp[self.byte] * np.exp(alpha[low:high] + spelt + after[low + 1 : high + 1] + weight)).sum())
            del after

    def by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which words, their character codes), words of equal length together."""
        text = [SPACE + w.decode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, text), np.int64, len(text))
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, bounds):
            if len(group):
                joined = "".join([text[i] for i in group]).encode("utf-32-le")
                yield group, np.frombuffer(joined, np.uint32).reshape(len(group), -1).astype(np.uint64)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability."""
        out = np.zeros(len(words))
        for group, codes in self.by_length(words):
            if codes.shape[1] > LONG:
                out[group] = [self.chain(c)[-1] for c in codes]
            else:
                out[group] = self.forward(codes, list(self.edges(codes)))[-1]
        return out

    def expect(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece (bytes last) in the words, over all segmentations."""
        total = np.zeros(self.byte + 1)
        for group, codes in self.by_length(words):
            if codes.shape[1] > LONG:
                for c, count in zip(codes, counts[group].tolist(), strict=True):
                    self.chain_expect(c, count, total)
                continue
            edges = list(self.edges(codes))
            n = codes.shape[1]
            alpha = self.forward(codes, edges)
            beta = np.full((n + 1, len(codes)), -np.inf)
            beta[n] = 0
            by_start: list[list] = [[] for _ in range(n + 1)]
            for e in edges:
                by_start[e[0]].append(e)
            weight = np.log(counts[group]) - alpha[n]
            for start in range(n - 1, -1, -1):
                spelt = self.spelt(codes[:, start])
                beta[start] = beta[start + 1] + spelt
                for _, end, rows, pieces in by_start[start]:
                    beta[start, rows] = np.logaddexp(beta[start, rows], beta[end, rows] + self.logp[pieces])
                    share = np.exp(alpha[start, rows] + self.logp[pieces] + beta[end, rows] + weight[rows])
                    total[: self.byte] += np.bincount(pieces, share, self.byte)
                size = spelt / self.logp[self.byte]
                total[self.byte] += float((size * np.exp(alpha[start] + spelt + beta[start + 1] + weight)).sum())
        return total


def vocabulary(path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece file with their first log-probabilities: by the order of its scores, the k-th in proportion to 1 / k."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    scored = [(-model.get_score(i), model.id_to_piece(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [p for _, p in sorted(scored)]
    p = np.append(1 / (np.arange(len(pieces)) + 1.0), 1e-3)
    return pieces, np.log(p / p.sum())


def fitted(counts: DataFrame, path: str | None = None) -> Lattice:
    """The lattice with probabilities fitted to counts(word, c): one aggregation whose result has one row per piece."""
    pieces, logp = vocabulary(path)
    start = Lattice(pieces, logp)
    schema = pa.schema([("piece", pa.int64()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(start.byte + 1)
        for b in slices(batches, 1 << 19):
            total += start.expect(bytes_list(b, "word"), np.asarray(b.column(1), float))
        at = np.flatnonzero(total)
        yield arrays(schema, at, total[at])

    learnt = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", "c")
    rows = learnt.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    total = np.ones(start.byte + 1)
    for r in sorted(rows):
        total[r.piece] += r.n
    return Lattice(pieces, np.log(total / total.sum()))


def words_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def counted(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """word and c, its count in the documents to learn from (0 for words of the others alone)."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in slices(batches):
            for text, learn in zip(bytes_list(b, "text"), b.column(1).to_pylist(), strict=True):
                if learn:
                    held.update(words_of(text))
                else:
                    held.update(dict.fromkeys(set(words_of(text)), 0))
            if len(held) > most:
                yield arrays(schema, list(held), list(held.values()))
                held.clear()
        if held:
            yield arrays(schema, list(held), list(held.values()))

    return docs.select("text", "learn").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, path: str | None = None, fold_mod: int = 7, held: int = 2, heavy_share: int = 400_000, discount: float = 0.75) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and mixed_score of every document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), fold_mod) == held, F.lit(False))).withColumn("learn", F.col("doc_id").isNotNull() & ~F.col("held_out"))
    counts = written(counted(base), "counts")
    n, v = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    lattice = fitted(counts, path)
    end = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words, spare = max(0, n - end), 1.0
    if words:
        spare = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).agg(F.sum(F.least("c", F.lit(discount)))).first()[0] / words
    log_end, log_word = math.log10((end + 1) / (n + 2)), math.log10((words + 1) / (n + 2))
    scored = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("lp", pa.float64()), ("mix", pa.float64())])

    def on_lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 19):
            found = bytes_list(b, "word")
            lp = lattice.score(found) / math.log(10)
            mix = lp
            if words:
                own = np.maximum(np.asarray(b.column(1), float) - discount, 0) / words
                mix = np.where(own > 0, np.log10(own + spare * 10.0**lp), math.log10(spare) + lp)
            both = np.array([lp, mix]) + log_word
            both[:, [i for i, w in enumerate(found) if w == END]] = log_end
            yield arrays(scored, b.column(0), b.column(1), *both)

    table = written(counts.select("word", "c").mapInArrow(on_lattice, "word binary, c long, lp double, mix double"), "scored")
    heavy = {bytes(r.word): (r.c, r.lp, r.mix) for r in table.where(F.col("c") * heavy_share >= n).where("c > 0").collect()}
    shared = docs.sparkSession.sparkContext.broadcast({w: (i, c) for i, (w, (c, *_)) in enumerate(heavy.items())} | {None: np.array(list(heavy.values()), float).reshape(-1, 3)})
    smooth = math.log10(n + v + 1)
    parts = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()), ("mix", pa.float64()), ("word", pa.binary()), ("k", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document one row with the sums over its heavy words, and one for each other word."""
        known = shared.value
        values = np.column_stack([np.log10(known[None][:, 0] + 1), known[None][:, 1:]]) if len(known[None]) else np.zeros((0, 3))
        for b in slices(batches):
            out: list[list] = [[] for _ in parts]
            for row, doc, held_out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), bytes_list(b, "text"), strict=True):
                bag = Counter(words_of(text))
                at, times, rest = [], [], []
                for w, k in bag.items():
                    found = known.get(w)
                    if found:
                        at.append(found[0])
                        times.append(k)
                    else:
                        rest.append((w, k))
                sums = np.array(times, float) @ values[at] if at else np.zeros(3)
                more = len(rest)
                out[0] += [row] * (more + 1)
                for column, first in zip(out[1:8], (doc, held_out, sum(bag.values()), sum(times), *sums), strict=True):
                    column.append(first)
                    column += [None] * more
                out[8] += [b" %d" % row, *(w for w, _ in rest)]  # never a word: the document's own row
                out[9] += [0, *(k for _, k in rest)]
            yield arrays(parts, *out)

    rows = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(split, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lp double, mix double, word binary, k long")
    joined = rows.join(table.select("word", "c", F.col("lp").alias("word_lp"), F.col("mix").alias("word_mix")), "word", "left")
    k, c = F.col("k"), F.coalesce("c", F.lit(0))
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.lit(0)) + F.when(c > 0, k).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + k * F.log10(c + 1.0)).alias("base"), F.sum(F.coalesce("lp", F.lit(0.0)) + k * F.coalesce("word_lp", F.lit(0.0))).alias("lp"),
        F.sum(F.coalesce("mix", F.lit(0.0)) + k * F.coalesce("word_mix", F.lit(0.0))).alias("mix"),
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(smooth)).alias("base_score"), F.col("lp").alias("score"), F.col("mix").alias("mixed_score"))
