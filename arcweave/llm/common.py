"""Helpers that the text operators share: column selection, written tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.session import dropped, shared_path, swept, written, written_with  # noqa: F401

#: Bytes of text that a Python function holds at a time; larger Arrow batches are cut between rows.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no other column is read or can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(mod)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that each holds about `most` bytes (a longer single row stays whole)."""
    for b in batches:
        n, parts = b.num_rows, -(-b.nbytes // most)
        if n <= 1 or parts <= 1:
            if n:
                yield b
            continue
        sizes = [0] * n
        for col in b.columns:
            if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type):
                lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
                sizes = [x + y for x, y in zip(sizes, lengths, strict=True)]
        start, held = 0, 0
        for i, x in enumerate(sizes):
            if held and held + x > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += x
        yield b.slice(start)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow of a function from one bounded batch to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield fn(b)
        release()

    return df.mapInArrow(run, schema)


def spread(left: DataFrame, right: DataFrame, key: str, by: Column, total: int, counts: DataFrame | None = None, how: str = "inner", share: int = 1000, least: int = 200, salts: int = 64) -> DataFrame:
    """left joined to right, which has one row a key, without hot keys.

    Both sides grow with the input, so the join is a sorted one at every size:
    what a small input shuffles tells what a large one will.

    A key of more than 1 / share of left's `total` rows (and of more than
    `least`) is dealt over `salts` tasks by a hash of `by`, right's row being
    repeated for each: such keys number at most `share`, so the list of them and
    the rows added are bounded.  counts: (key, n) of left, if at hand.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = [r[0] for r in counts.where((F.col("n") * share > total) & (F.col("n") > least)).select(key).collect()]
    if not hot:
        return left.join(right.hint("merge"), key, how)
    often = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = left.withColumn("_salt", F.when(often, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0))
    repeated = right.withColumn("_salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated.hint("merge"), [key, "_salt"], how).drop("_salt")


def release() -> None:
    """Give freed memory back to the machine: workers live on between tasks and operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class WordHash(dict):
    """64-bit hashes of words (bytes), remembered; forgets all when it holds `most` words, so its memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def bytes_list(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [b or b"" for b in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def arrays(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
