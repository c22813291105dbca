"""Media columns: texts as lossless WebP images, and pixel arrays read back from them.

A text's UTF-8 bytes, filled with zeros to a positive multiple of 64, are rows
of 16 ARGB pixels.  Long payloads become several images of at most 1,024 rows,
one file after another (a RIFF file tells its own length).  Each image is stored
in the form of least estimated size: plain literals for most texts, else a
palette, a predictor, less green, cross-colour, a colour cache or
back-references.  Encoding and decoding treat a bounded slice of an Arrow batch
at once.  No shuffle.

Null or empty text: 64 zero bytes.  Equal texts, equal files.  Repeated rows
are stored each; empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arcweave.llm import webp
from arcweave.llm.common import arrays, bytes_list, id_text, map_arrow

WIDTH, ROWS, UNIT = 16, 1024, 64


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT if text else UNIT)


def stored(payloads: list[bytes]) -> list[bytes]:
    """Each payload's WebP files, joined."""
    step = UNIT * ROWS
    images, counts = [], []
    for p in payloads:
        parts = [np.frombuffer(p, np.uint8, min(step, len(p) - k), k).reshape(-1, 4) for k in range(0, len(p), step)]
        images += parts
        counts.append(len(parts))
    files = iter(webp.encode_many(images, WIDTH))
    return [b"".join(next(files) for _ in range(n)) for n in counts]


def read_back(media: list[bytes]) -> list[bytes]:
    """Each payload, from its joined files."""
    files, counts = [], []
    for m in media:
        at, n = 0, 0
        while at < len(m):
            size = 8 + int.from_bytes(m[at + 4 : at + 8], "little")
            files.append(m[at : at + size])
            at, n = at + size, n + 1
        counts.append(n)
    pixels = iter(webp.decode_many(files))
    return [b"".join(next(pixels).tobytes() for _ in range(n)) for n in counts]


def described(payload: bytes) -> str:
    """Rows, mean and deviation of the samples, and entropy of their values in bits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(float)
    n, values = counts.sum(), np.arange(256)
    mean = float(counts @ values) / n
    p = counts[counts > 0] / n
    return f"rows={len(payload) // UNIT} mean={mean:.4f} sd={np.sqrt(max(0.0, float(counts @ (values - mean) ** 2) / n)):.4f} entropy={float(-(p * np.log2(p)).sum()):.4f}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stored form) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = bytes_list(batch, "text")
        return arrays(schema, batch.column(0), [len(t) for t in texts], stored([payload_of(t) for t in texts]))

    return map_arrow(id_text(docs), run, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame) -> DataFrame:
    """doc_id, width, height and pixels (an array of samples A, R, G, B) of every stored row."""
    schema = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = read_back(bytes_list(batch, "media"))
        return arrays(schema, batch.column(0), [WIDTH] * len(found), [len(p) // UNIT for p in found], found)

    return map_arrow(media.select("doc_id", "media"), run, "doc_id long, width int, height int, pixels binary")


def digests(docs: DataFrame) -> DataFrame:
    """store() and load() in one pass: sizes and hashes of the payload as read back and of the stored form, and a feature."""
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in names.split(", ")])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = bytes_list(batch, "text")
        media = stored([payload_of(t) for t in texts])
        found = read_back(media)
        sha = lambda all_: [hashlib.sha256(x).hexdigest() for x in all_]
        return arrays(schema, batch.column(0), [len(t) for t in texts], [len(p) for p in found], sha(found), [zlib.crc32(p[-UNIT:]) for p in found], [len(m) for m in media], sha(media), [described(p) for p in found])

    return map_arrow(id_text(docs), run, names)
