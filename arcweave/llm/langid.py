"""Language identification: interpolated Kneser-Ney character models, one per language.

Each language's model predicts a character of the lower-cased text (white space
as one space) from the characters before it.  The n-grams of all languages lie in one sorted hash
array per order, with a matrix of probabilities beside it, so one look-up
serves all languages.  A text's language is the one with the lowest
cross-entropy per character; scores are calibrated on held-out labelled texts,
and so is the cross-entropy above which a text is rejected.

One pass over the documents, no shuffle.

Null text or a text without a letter (Unicode's L): `und`, score 0.  Ties go to
the language that sorts first.  Very long texts are read whole.  Repeated rows
get equal results; rows that share an id are each learnt from and each judged.
Empty table: no rows.  Nothing to learn from: always `und`.  Other columns are
kept, whatever their names, by keep(), and not read by identify().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.common import arrays, fold, map_arrow

LETTER = regex.compile(r"\p{L}")
_MULTIPLIER = 0x9E3779B97F4A7C15


def _codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each after order - 1 spaces; the places of those to predict; how many each text has."""
    pad = " " * (order - 1)
    clean = [" ".join(t.lower().split()) + " " for t in texts]
    codes = np.frombuffer("".join([pad + t for t in clean]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, clean), np.int64, len(clean))
    places = np.arange(lengths.sum()) + np.repeat(np.arange(1, len(clean) + 1) * (order - 1), lengths)
    return codes, places, lengths


class Table:
    """Values beside a sorted array of 64-bit hashes; an index of their top bits gives where to look."""

    BITS = 18

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.first = np.searchsorted(keys, np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)).astype(np.int32)
        self.widest = int(np.diff(np.append(self.first, len(keys))).max())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash lies, and whether it is there at all."""
        at = np.minimum(self.first[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)], len(self.keys) - 1)
        found = self.keys[at] == hashes
        for _ in range(self.widest - 1):
            rest = np.flatnonzero(~found)
            if not len(rest):
                break
            at[rest] = np.minimum(at[rest] + 1, len(self.keys) - 1)
            found[rest] = self.keys[at[rest]] == hashes[rest]
        return at, found


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order 1, 2, ...: the hash of the n-gram that ends at each place (order 0: zeros)."""
    out = [np.zeros(len(codes), np.uint64)]
    scattered = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    scattered ^= scattered >> np.uint64(29)
    for k in range(order):
        h = out[-1].copy()
        h[k:] += scattered[: len(codes) - k] * np.uint64(pow(_MULTIPLIER, k, 1 << 64))
        out.append(h)
    return out


@dataclass
class Model:
    """grams[k]: log2 probabilities, by language, of the n-grams of order k; backoff[k]: weights of their contexts."""

    langs: list[str]
    order: int
    grams: list[Table]
    backoff: list[Table]
    temperature: float = 1.0
    limit: float = np.inf

    def entropies(self, texts: list[str], most: int = 1 << 19) -> np.ndarray:
        """Bits per character of each text by language; the last column holds the characters."""
        out, start, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held > most or i == len(texts) - 1:
                out.append(self._entropies(texts[start : i + 1]))
                start, held = i + 1, 0
        return np.concatenate(out) if out else np.zeros((0, len(self.langs) + 1))

    def _entropies(self, texts: list[str]) -> np.ndarray:
        codes, places, lengths = _codes(texts, self.order)
        grams = _grams(codes, self.order)
        at, found = self.grams[self.order].find(grams[self.order][places])
        bits = self.grams[self.order].values[at]
        left = np.flatnonzero(~found)
        bits[left] = 0
        for k in range(self.order, 0, -1):
            if not len(left):
                break
            at, found = self.backoff[k].find(grams[k - 1][places[left] - 1] if k > 1 else np.zeros(len(left), np.uint64))
            bits[left[found]] += self.backoff[k].values[at[found]]
            if k == 1:
                bits[left] += np.float32(-np.log2(0x110000))
                break
            at, found = self.grams[k - 1].find(grams[k - 1][places[left]])
            bits[left[found]] += self.grams[k - 1].values[at[found]]
            left = left[~found]
        sums = np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0).astype(float)
        return np.column_stack([-sums / lengths[:, None], lengths])


def train(texts: dict[str, list[str]], order: int, discount: float = 0.75) -> Model:
    """Kneser-Ney models of the texts of each language."""
    langs = sorted(texts)
    parts: list[list[tuple]] = [[] for _ in range(order + 1)]
    for j, lang in enumerate(langs):
        codes, at, _ = _codes(texts[lang], order)
        grams = _grams(codes, order)
        weights = np.ones(len(at))
        for k in range(order, 0, -1):
            keys, first, inverse = np.unique(grams[k][at], return_index=True, return_inverse=True)
            counts = np.bincount(inverse, weights)
            at, weights = at[first], np.ones(len(first))  # below, each distinct longer n-gram counts once
            context = grams[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64)
            ckeys, cinverse = np.unique(context, return_inverse=True)
            totals = np.bincount(cinverse, counts)
            parts[k].append((j, keys, np.maximum(counts - discount, 0) / totals[cinverse], ckeys, discount * np.bincount(cinverse) / totals, context, grams[k - 1][at] if k > 1 else context))
    none = Table(np.zeros(1, np.uint64), np.zeros((1, len(langs)), np.float32))
    model = Model(langs, order, [none] * (order + 1), [none] * (order + 1))
    lower = np.full((1, len(langs)), 1 / 0x110000)
    lower_keys = np.zeros(1, np.uint64)
    for k in range(1, order + 1):
        keys = np.unique(np.concatenate([p[1] for p in parts[k]]))
        ckeys = np.unique(np.concatenate([p[3] for p in parts[k]]))
        weight = np.ones((len(ckeys), len(langs)))
        own = np.zeros((len(keys), len(langs)))
        of, below = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for j, key, p, ckey, w, context, suffix in parts[k]:
            i = np.searchsorted(keys, key)
            own[i, j] = p
            weight[np.searchsorted(ckeys, ckey), j] = w
            of[i], below[i] = np.searchsorted(ckeys, context), np.searchsorted(lower_keys, suffix)
        lower = own + weight[of] * lower[below]
        lower_keys = keys
        model.grams[k] = Table(keys, np.log2(lower).astype(np.float32))
        model.backoff[k] = Table(ckeys, np.log2(weight).astype(np.float32))
    return model


def _posterior(model: Model, entropies: np.ndarray) -> np.ndarray:
    bits, n = entropies[:, :-1], entropies[:, -1:]
    z = -(bits - bits.min(1, keepdims=True)) * np.sqrt(n) * model.temperature
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, order: int = 4, max_docs: int = 150, long_chars: int = 20_000, spare: float = 0.001, max_langs: int = 200, max_chars: int = 3_000_000) -> Model | None:
    """Learn from the text and lang of documents whose fold is not 2: at most max_docs whole texts of each language, the last of which passes max_chars.

    More than max_langs languages are an error: what is collected is bounded by these parameters.

    Texts of over long_chars characters are taken only if a language has too
    few others; within that, those with the smallest hashes of the id.  Every
    fifth text is held out for the temperature and the limit of rejection:
    twice what all but a share `spare` of those texts stay below.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), 4) != 2) & F.col("text").rlike(r"\p{L}"))
    rank = Window.partitionBy("lang").orderBy("long", "h", "doc_id")
    ids = usable.select("doc_id", "lang", (F.length("text") > long_chars).alias("long"), F.xxhash64("doc_id").alias("h"), F.length("text").cast("long").alias("n"))
    ids = ids.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= max_docs)
    ids = ids.withColumn("before", F.sum("n").over(rank.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).where(F.col("before") < max_chars).select("doc_id", "lang").distinct().collect()
    if len({r.lang for r in ids}) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not ids:
        return None
    ids = docs.sparkSession.createDataFrame([(r.doc_id,) for r in ids], docs.select("doc_id").schema).distinct()
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.text))
    if not rows:
        return None
    texts: dict[str, list[str]] = {}
    for lang in sorted({r.lang for r in rows}):
        own = [r for r in rows if r.lang == lang]
        texts[lang] = [r.text for r in own if len(own) < 10 or r.doc_id % 5 != 0] or [own[0].text]
    model = train(texts, order)
    held = [r for r in rows if r.doc_id % 5 == 0] or rows
    entropies = model.entropies([r.text for r in held])
    truth = np.array([model.langs.index(r.lang) for r in held])

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(_posterior(model, entropies)[np.arange(len(held)), truth], 1e-9)).mean()

    model.temperature = min((0.05, 0.1, 0.2, 0.4, 0.8, 1.6), key=lambda t: (round(loss(t), 3), t))
    model.limit = 2 * float(np.quantile(entropies[:, :-1].min(1), 1 - spare))
    return model


def judged(texts: list[str | None], model: Model | None) -> tuple[list, list, list, list]:
    """Language, score, bits per character and rejection of each text."""
    n = len(texts)
    pred, score, bits, rejected = ["und"] * n, [0.0] * n, [None] * n, [True] * n
    some = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model else []
    if some:
        entropies = model.entropies([texts[i] for i in some])
        best, p = entropies[:, :-1].argmin(1), _posterior(model, entropies)
        for row, i in enumerate(some):
            pred[i], score[i], bits[i] = model.langs[best[row]], float(p[row, best[row]]), float(entropies[row, best[row]])
            rejected[i] = bits[i] > model.limit
    return pred, score, bits, rejected


def identify(docs: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (per character) and rejected of every document."""
    model = fit(docs, **params)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("rejected", pa.bool_())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return arrays(schema, batch.column(0), batch.column(1), *judged(batch.column(2).to_pylist(), model))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("text"))
    return map_arrow(picked, run, "doc_id long, held_out boolean, lang_pred string, score double, bits double, rejected boolean")


def keep(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs, all columns, that identify() doesn't reject (all, where there was nothing to learn from)."""
    model = fit(docs, **params)
    if model is None:
        return docs

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rejected = judged(batch.column(batch.schema.get_field_index("text")).to_pylist(), model)[3]
        return batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
