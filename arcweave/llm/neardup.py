"""Near-duplicate groups by b-bit MinHash.

A document's set holds the hashes of its distinct k-word shingles (words are
runs of bytes other than ASCII white space, A-Z in lower case; a text of fewer
words is one shingle).  One pass over the texts gives each document 256 minima.
Of the first 128, bands of four each name a bucket; of every minimum only two
low bits are kept, packed into eight 64-bit numbers.  Two documents' share of equal bit pairs,
corrected for chance, estimates their similarity, by XOR and bit counts.

Documents with equal sets (by their 128-bit hash) are one class, represented by
the smallest id and numbered by a row that has it.  Buckets of more than one class give candidates:
  1. each class with one leader of its buckets (a star, never all pairs of a bucket);
  2. the stars of other, hashed leaders, for buckets that still hold several components;
  3. at last the pairs of different components within a bucket, each only in
     the first bucket it shares, and only if their rarest shingles overlap enough.
A pair whose estimate is more than five standard deviations below the threshold
is dropped; the others are confirmed on the full sets.  A pair that shares no
bucket is lost with probability (1 - 0.8^4)^32 < 1e-7 at similarity 0.8.
Groups are the connected components of the confirmed links, by label
propagation with pointer jumping over written tables.  Joins on a key that many
rows may share (a bucket, a leader, a label, a class) deal it over many tasks.

Null or empty text, or one of white space only: no set, linked with nothing.
Very long texts are read whole.  Repeated rows and copies: one class.  Rows
that share an id are linked with each other, whatever their texts.  Null ids are
set aside, each its own group with a null id.  Empty table: no rows.  Other
columns are not read, but kept by keep().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import WordHash, arrays, bytes_list, dropped, id_text, map_arrow, spread, swept, written, written_with

BANDS, ROWS, BITS, HASHES = 32, 4, 2, 256
SIGNED = "doc_id long, n_shingles long, cls binary, sketch array<long>, bands array<long>"
_RANDOM = np.random.Generator(np.random.PCG64(20))
_A = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64)
_P = _RANDOM.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = cache.of(words)
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(0 if len(h) >= k else len(h)), np.uint64)
    for j in range(min(k, len(h))):
        out += h[j : j + n] * _P[j]
    return np.unique(mixed(out))


def minima(sets: list[np.ndarray], most: int = 1 << 16) -> np.ndarray:
    """The minimum of each hash function over each (non-empty) set."""
    out = np.empty((len(sets), HASHES), np.uint64)
    start = 0
    while start < len(sets):
        end, held = start, 0
        while end < len(sets) and (end == start or held + len(sets[end]) <= most):
            held += len(sets[end])
            end += 1
        x = np.concatenate(sets[start:end])
        at = np.cumsum([0] + [len(s) for s in sets[start : end - 1]])
        for i in range(HASHES):
            out[start:end, i] = np.minimum.reduceat(x * _A[i] + _B[i], at)
        start = end
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """Each document's set size, the key of its set, its packed low bits and its bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
    cache = WordHash()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k, cache) for t in bytes_list(batch, "text")]
        some = [i for i, s in enumerate(sets) if len(s)]
        n = len(sets)
        cls, sketch, bands = [None] * n, [None] * n, [None] * n
        if some:
            low = minima([sets[i] for i in some])
            keys = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                keys += low[:, : BANDS * ROWS].reshape(len(some), BANDS, ROWS)[:, :, r] * _P[r]
            keys = mixed(keys + np.arange(BANDS, dtype=np.uint64) * _P[ROWS]).view(np.int64)
            bits = (mixed(low) & np.uint64((1 << BITS) - 1)).reshape(len(some), -1, 64 // BITS)
            packs = (bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64).view(np.int64)
            for row, i in enumerate(some):
                cls[i], sketch[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), packs[row], keys[row]
        return arrays(schema, batch.column(0), [len(s) for s in sets], cls, sketch, bands)

    return map_arrow(id_text(docs), run, SIGNED)


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from two packed sketches: the share of equal bit pairs, corrected for pairs equal by chance."""
    spread = F.lit(0x5555555555555555).cast("long")
    unequal = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(spread))
    chance = 0.5**BITS
    return ((HASHES - unequal) / HASHES - chance) / (1 - chance)


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of every node in links(a, b)."""
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("next")).union(links.select("b", "a")).distinct(), "links")
    total = both.count()
    degrees = both.groupBy("node").agg(F.count("*").alias("n")).withColumnRenamed("node", "next")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("comp")), "labels")
    nodes = labels.count()
    while True:
        near = spread(both, labels.select(F.col("node").alias("next"), "comp"), "next", F.col("node"), total, degrees).groupBy("node").agg(F.min("comp").alias("low"))
        lowered = written(labels.join(near, "node").select("node", F.least("comp", "low").alias("comp"), F.col("comp").alias("before")), "lowered")
        jump = lowered.where("comp <> node").select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = spread(lowered, jump, "comp", F.col("node"), nodes, how="left").select("node", F.least("comp", F.coalesce("root", "comp")).alias("comp"), "before")
        new, changed = written_with(new.withColumn("fell", F.col("comp") != F.col("before")), "labels", "fell")
        dropped(labels, lowered)
        labels = new
        if not changed:
            dropped(both)
            return labels.select("node", "comp")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ids (a, b) of the pairs (x, y) of classes with 100 * |X and Y| >= percent * |X or Y|."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        return arrays(schema, kept.column(0), kept.column(1))

    total = pairs.count()
    joined = pairs
    for c in ("y", "x"):
        own = sets.join(pairs.select(F.col(c).alias("row")).distinct(), "row", "left_semi")
        joined = spread(joined, own.select(F.col("row").alias(c), F.col("hashes").alias(f"set_{c}")), c, F.col("x" if c == "y" else "y"), total, pairs.groupBy(c).agg(F.count("*").alias("n")))
    return map_arrow(joined.select("a", "b", "set_x", "set_y"), run, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, bits: int = 1 << 25) -> DataFrame:
    """row, hashes: the sets of the classes wanted(row, doc_id, cls).

    A map of fixed size, a bit for each id's hash, tells most of the other texts
    apart where they are read, so texts aren't shuffled: only the sets are.
    """
    place = lambda ids: mixed(ids.astype(np.uint64)) % np.uint64(bits)
    marked = pa.schema([("word", pa.int64()), ("mask", pa.int64())])

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = place(batch.column(0).to_numpy())
        return arrays(marked, (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64))

    rows = map_arrow(wanted.select("doc_id"), mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("hashes", pa.binary())])
    cache = WordHash()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = place(batch.column(0).to_numpy())
        batch = batch.filter(pa.array((shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0))
        sets = [shingles(t, k, cache).tobytes() for t in bytes_list(batch, "text")]
        return arrays(schema, batch.column(0), [xxhash.xxh3_128_digest(s) for s in sets], sets)

    found = map_arrow(id_text(docs).where("doc_id IS NOT NULL"), run, "doc_id long, cls binary, hashes binary").dropDuplicates(["doc_id", "cls"])
    return found.join(wanted.hint("merge"), ["doc_id", "cls"]).select("row", "hashes")


def rare_first(sets: DataFrame, percent: int, cells: int = 1 << 18) -> DataFrame:
    """row, rare: the low halves of the first n - t n + 1 of each set's n hashes, rarest first; marks: a bit of 512 for each.

    hidden and twins: how many of them share a bit or a half with another, so
    that counts of common bits and halves can bound the hashes shared.  The
    order is the same for all sets: by the count of the hash's cell (a table of
    fixed size), then by hash.
    """
    cell = np.uint64(64 - cells.bit_length() + 1)
    counted = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for x in batch.column(1).to_pylist():
                np.add.at(total, (np.frombuffer(x, np.uint64) >> cell).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield arrays(counted, at, total[at])

    rows = sets.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(cells, np.int64)
    table[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("row", pa.int64()), ("rare", pa.list_(pa.int32())), ("marks", pa.list_(pa.int64())), ("hidden", pa.int32()), ("twins", pa.int32())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rare, marks, hidden, twins = [], [], [], []
        for x in batch.column(1).to_pylist():
            h = np.frombuffer(x, np.uint64)
            h = h[np.lexsort((h, shared.value[(h >> cell).astype(np.int64)]))].view(np.int64)
            n = len(h)
            rare.append(h[: n - -(-percent * n // 100) + 1].astype(np.int32))
            bits = np.unique(rare[-1] & 511)
            marks.append(np.bitwise_or.reduceat(np.append(np.uint64(1) << (bits & 63).astype(np.uint64), np.uint64(0)), np.searchsorted(bits, np.arange(8) * 64)) if len(bits) else np.zeros(8, np.uint64))
            marks[-1] = np.where(np.bincount(bits >> 6, minlength=8) > 0, marks[-1], 0).astype(np.uint64).view(np.int64)
            hidden.append(len(rare[-1]) - len(bits))
            twins.append(len(rare[-1]) - len(np.unique(rare[-1])))
        return arrays(schema, batch.column(0), rare, marks, hidden, twins)

    return map_arrow(sets, run, "row long, rare array<int>, marks array<long>, hidden int, twins int")


def last_pairs(left: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, low: float) -> DataFrame:
    """Pairs (x, y) of classes, of different components of a bucket, each in the first bucket they share, that size, sketch and rarest hashes allow."""
    rare = rare_first(sets.join(left.select("row").distinct(), "row", "left_semi"), percent)
    own = left.groupBy("row").agg(F.collect_set("bucket").alias("buckets"))  # no more than there are bands
    facts = written(reps.select("row", "rep", "n_shingles", "sketch").join(rare.hint("merge"), "row").join(own.hint("merge"), "row"), "facts")
    # dealt by bucket once: both sides of the join read the same shuffle, so they must use the same columns
    rows = left.select("bucket", "row", "comp").join(facts.hint("merge"), "row").repartition("bucket")
    a, b = (rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns)) for side in "ab")
    larger = F.struct("a_n_shingles", "a_row") > F.struct("b_n_shingles", "b_row")
    sized = (F.col("a_comp") != F.col("b_comp")) & (100 * F.col("b_n_shingles") >= percent * F.col("a_n_shingles"))
    # what two sets share beyond the common part of their rarest is at most what either leaves over
    rest = F.greatest(F.col("a_n_shingles") - F.size("a_rare"), F.col("b_n_shingles") - F.size("b_rare"))
    needed = percent * (F.col("a_n_shingles") + F.col("b_n_shingles")) / (100.0 + percent) - rest - 1e-6
    marked = F.least("a_hidden", "b_hidden") + sum((F.bit_count(F.col("a_marks")[i].bitwiseAND(F.col("b_marks")[i])) for i in range(8)), F.lit(0))  # no fewer than they share
    overlap = F.least("a_twins", "b_twins") + F.size(F.array_intersect("a_rare", "b_rare"))  # no fewer either
    alike = (estimate(F.col("a_sketch"), F.col("b_sketch")) >= low) & (marked >= needed) & (overlap >= needed)
    first = ~F.exists("a_buckets", lambda x: (x < F.col("a_bucket")) & F.array_contains("b_buckets", x))
    pairs = a.join(b.hint("merge"), (F.col("a_bucket") == F.col("b_bucket")) & larger & sized & alike & first)
    return pairs.select(F.col("a_row").alias("x"), F.col("b_row").alias("y"), F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    low = percent / 100 - 5 * 0.03
    table = written(signed(docs, k).withColumn("row", F.monotonically_increasing_id()), "signed")
    some = table.where(F.col("doc_id").isNotNull() & F.col("cls").isNotNull())
    reps = some.groupBy("cls").agg(F.min(F.struct("doc_id", "row", "n_shingles", "sketch", "bands")).alias("r"), F.count("*").alias("copies"))
    reps = written(reps.select("cls", F.col("r.doc_id").alias("rep"), "r.row", "r.n_shingles", "r.sketch", "r.bands", "copies"), "reps")
    several = some.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("doc_id")
    whole, table = table, written(table.select("doc_id", "n_shingles", "cls"), "ids")  # sketches and bands stay with the classes
    same_id = written(some.join(several, "doc_id", "left_semi").select("doc_id", "cls").join(reps.select("cls", "rep"), "cls").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "same_id")
    dropped(whole)
    entries = reps.select(F.explode("bands").alias("bucket"), "row")
    shared = written(entries.groupBy("bucket").agg(F.min("row").alias("leader"), F.count("*").alias("n")).where("n > 1"), "buckets")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    swept(docs.sparkSession)
    members = written(spread(entries, shared.select("bucket", "leader"), "bucket", F.col("row"), total, shared.select("bucket", "n")), "members")
    banded, reps = reps, written(reps.drop("bands"), "reps")
    dropped(banded, shared)
    swept(docs.sparkSession)
    ids = reps.select("row", "rep")
    sketches = reps.select("row", "rep", "n_shingles", "sketch")

    def likely(pairs: DataFrame) -> DataFrame:
        """Of pairs (x, y) of classes, those whose set sizes and sketches allow the threshold, with their ids (a, b)."""
        pairs = written(pairs, "stars")
        x = sketches.select(F.col("row").alias("x"), F.col("rep").alias("a"), F.col("n_shingles").alias("nx"), F.col("sketch").alias("sx"))
        y = sketches.select(F.col("row").alias("y"), F.col("rep").alias("b"), F.col("n_shingles").alias("ny"), F.col("sketch").alias("sy"))
        sized = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
        return spread(pairs.join(y.hint("merge"), "y"), x, "x", F.col("y"), pairs.count(), pairs.groupBy("x").agg(F.count("*").alias("n"))).where(sized & (estimate(F.col("sx"), F.col("sy")) >= low)).select("x", "y", "a", "b")

    stars = members.where("row <> leader").select(F.col("leader").alias("x"), F.col("row").alias("y")).distinct()
    swept(docs.sparkSession)
    first = written(likely(stars).groupBy("y").agg(F.min(F.struct("x", "a", "b")).alias("r")).select("r.x", "y", "r.a", "r.b"), "pairs")
    wanted = written(members.select("row").distinct().join(reps.select("row", F.col("rep").alias("doc_id"), "cls"), "row"), "wanted")
    swept(docs.sparkSession)
    sets = written(sets_of(docs, wanted, k), "sets")
    swept(docs.sparkSession)
    links = written(confirmed(first, sets, percent), "links").union(same_id)
    swept(docs.sparkSession)
    tried = first.select("x", "y")
    comps = components(links)
    for turn in range(rounds + 1):
        labelled = ids.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("row", F.coalesce("comp", "rep").alias("comp"))
        placed = written(members.select("bucket", "row").join(labelled.hint("merge"), "row"), "placed")
        open_ = placed.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min_by(F.struct("row", "comp"), F.xxhash64("row", F.lit(turn))).alias("head"), F.count("*").alias("n")).where("least < most")
        open_ = written(open_.select("bucket", F.col("head.row").alias("head"), F.col("head.comp").alias("head_comp"), "n"), "open")
        swept(docs.sparkSession)
        left = spread(placed, open_.drop("n"), "bucket", F.col("row"), total, open_.select("bucket", "n"))
        if turn < rounds:
            pairs = left.where("comp <> head_comp").select(F.least("row", "head").alias("x"), F.greatest("row", "head").alias("y")).distinct()
        else:
            part = written(left.select("bucket", "row", "comp"), "left")
            pairs = written(last_pairs(part, reps, sets, percent, low), "met").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
            dropped(part)
            swept(docs.sparkSession)
        new = written(likely(pairs.join(tried.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")), "pairs")
        dropped(placed, open_)
        swept(docs.sparkSession)
        if not new.limit(1).count():
            if turn < rounds:
                continue
            break
        found = written(confirmed(new, sets, percent), "links")
        tried = tried.union(new.select("x", "y"))
        if found.limit(1).count():
            links = links.union(found)
            comps = components(links)
            swept(docs.sparkSession)
    dropped(members, sets, wanted)
    swept(docs.sparkSession)
    owners = reps.select("cls", "rep", "copies").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("comp", "rep").alias("comp"))
    out = spread(table.select("doc_id", "n_shingles", "cls"), owners, "cls", F.coalesce("doc_id", F.lit(0)), table.count(), reps.select("cls", F.col("copies").alias("n")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs, all columns, without those that groups() doesn't keep: one document of each group stays."""
    dropped = groups(docs, **params).where("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
