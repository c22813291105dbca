"""Quality rules: boosted trees over document statistics, after two fixed rules.

Words are runs of bytes other than ASCII white space.  The trees come from
all labelled documents, with monotone constraints on the ratios that can only
speak against a document, and are scored as flat numpy node arrays, one batch of
documents at a time.  One pass over the texts writes their statistics; labels
meet those, not the texts.

Null or empty text: no words, base_failed, not kept.  Repeated rows and ties:
each row gets its own equal result.  Empty table: no rows.  Other columns are
not read.  No usable labels: the fixed rules alone decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm import gbt
from arcweave.llm.common import WordHash, arrays, bytes_list, dropped, id_text, map_arrow, written

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "distinct", "ends", "line_words", "short")
#: More of these never raises the verdict.
MONOTONE = tuple(-1 if f in ("symbols", "dup_lines", "repeats", "upper", "marks") else 0 for f in FEATURES)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WINDOW)], np.uint64)


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside windows of eight words that occur twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        windows += hashes[j : j + n] * _POWERS[j]
    ordered = np.sort(windows)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    hit = np.isin(windows, ordered[1:][same])
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[:n] += hit
    edges[WINDOW : WINDOW + n] -= hit
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: bytes, cache: WordHash) -> tuple[list[int], list[float]]:
    """The five counts and the features of one document."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(histogram[0x80:0xC0].sum())
    word_chars = chars - int(histogram[SPACES].sum())
    symbols = int(histogram[SYMBOLS].sum())
    lines = text.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for line in lines:
            if line.strip():
                dup += line in seen
                seen.add(line)
    hashes = cache.of(words)
    repeats = repeated_words(hashes)
    lengths = np.fromiter(map(len, words), np.int64, n)
    spaces = max(1, histogram[0x20] + histogram[0x0A])
    features = [
        float(np.log(n)), word_chars / n, symbols / n, dup / len(lines), repeats / n, float(histogram[0x41:0x5B].sum()) / word_chars,
        float(histogram[0x21] + histogram[0x3F]) / n, float(histogram[0x30:0x3A].sum()) / word_chars, len(np.unique(hashes[:])) / n,
        (text.count(b". ") + text.count(b".\n") + text.endswith(b".")) / n, n / len(lines), float((lengths <= 3).sum()) / n * min(1.0, n / spaces),
    ]
    return [n, word_chars, symbols, dup, repeats], features


def features_of(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, and the feature vector of every document."""
    schema = pa.schema([("doc_id", pa.int64())] + [(c.split()[0], pa.int64()) for c in STATS.split(", ")] + [("features", pa.list_(pa.float64()))])
    cache = WordHash()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t, cache) for t in bytes_list(batch, "text")]
        return arrays(schema, batch.column(0), *(list(c) for c in zip(*(s for s, _ in found), strict=True)), [f for _, f in found])

    return map_arrow(id_text(docs), run, f"doc_id long, {STATS}, features array<double>")


def codes(features) -> np.ndarray:
    """Features (none is negative) as 16-bit numbers of the same order: exponent and seven bits of a float."""
    return (np.asarray(features, np.float32).reshape(-1, len(FEATURES)).view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def limits(counts: np.ndarray, bins: int = 64) -> np.ndarray:
    """The codes below which lie 1 / bins, 2 / bins, ... of the rows, from counts of all codes."""
    upto = np.cumsum(counts)
    return np.unique(np.searchsorted(upto, np.arange(1, bins) * (upto[-1] / bins), side="left")).astype(float)


def fit(facts: DataFrame, labels: DataFrame, spare: float = 0.005) -> tuple[gbt.Trees, float]:
    """Trees over codes() and the log-odds below which a document is rejected, from features_of() and all labels.

    A quarter of the labelled documents, by a hash of the id, is held out; the
    limit is such that at most a share `spare` of the good ones among those is
    lost.  Bins follow counts of all labelled documents; the driver gets 14
    bytes of each: its bins, its label and its side.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    rows = written(facts.select("doc_id", "features").join(known, "doc_id").select("features", (F.col("quality") > 0).alias("good"), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).alias("held")), "labelled")
    width, k = 1 << 16, len(FEATURES)

    def count(batches):
        total = np.zeros(k * width, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount((codes(b.column(0).flatten().to_numpy()) + np.arange(k) * width).ravel(), minlength=k * width)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    total = np.zeros(k * width, np.int64)
    for r in rows.select("features").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r.cell] = r.n
    if not total.any():
        return gbt.fit(np.zeros((0, k)), np.zeros(0)), -np.inf
    cuts = [limits(t) for t in total.reshape(k, width)]

    def pack(batches):
        for b in batches:
            x = codes(b.column(0).flatten().to_numpy())
            packed = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)] + [b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
            yield pa.record_batch([pa.array([np.stack(packed, axis=1).astype(np.uint8).tobytes()], pa.binary())], names=["rows"])

    packed = np.frombuffer(b"".join(r[0] for r in rows.mapInArrow(pack, "rows binary").collect()), np.uint8).reshape(-1, k + 2)
    packed = packed[np.lexsort(packed.T)]  # sums in an order of their own, whatever the partitions
    x, good, held = packed[:, :k], packed[:, k] > 0, packed[:, k + 1] > 0
    dropped(rows)
    trees = gbt.fit(x[~held], good[~held].astype(float), monotone=MONOTONE, cuts=cuts)
    inner = np.stack([np.append(c, width)[x[held & good][:, j]] for j, c in enumerate(cuts)], axis=1)  # a code of each bin
    scores = np.sort(trees.margin(inner))
    limit = min(0.0, float(scores[int(spare * len(scores))])) if len(scores) else -np.inf
    return trees, limit if good.any() and not good.all() else -np.inf


def judge(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the trees' score of every document."""
    facts = written(features_of(docs), "facts")
    trees, limit = fit(facts, labels, **params)
    schema = pa.schema([("doc_id", pa.int64())] + [(c.split()[0], pa.int64()) for c in STATS.split(", ")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.stack([batch.column(i).to_numpy() for i in range(1, 6)], axis=1)
        margin = trees.margin(codes(batch.column(6).flatten().to_numpy()))
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
        return arrays(schema, batch.column(0), *counts.T, failed, ~failed & (margin >= limit), 1 / (1 + np.exp(-np.clip(margin, -40, 40))))

    return map_arrow(facts, run, f"doc_id long, {STATS}, base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs, all columns, that judge() keeps: the same verdict, in a second pass that reads them."""
    facts = written(features_of(docs), "facts")
    trees, limit = fit(facts, labels, **params)
    dropped(facts)
    cache = WordHash()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t, cache) for t in bytes_list(batch, "text")]
        counts = np.array([s for s, _ in found], np.int64)
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
        return batch.filter(pa.array(~failed & (trees.margin(codes([f for _, f in found])) >= limit)))

    return map_arrow(docs, run, docs.schema)
