"""WARC archives as a PySpark data source.

write() makes a record for each row of a table of pages: of the rows with one
payload, the one with the largest id is a response and the others revisit it.
Digests are aggregated to that id by partial sums over (id, digest) alone.
Digests that hold more than a share of all rows, so at most 1 / share of them,
are broadcast; the others are joined, so no payload makes a hot group.  What
comes out, the ids that revisit, is joined to the pages by id and digest: a
small table is broadcast, a large one shuffles the pages once and evenly.

The source writes one or more files per task, each record a gzip member whose
extra field `SL` tells its lengths and that of its deflated head, and reads
them back: one partition per file, record-type and header predicates pushed
down.  Only the head of a record is inflated first; a record that the
predicates reject is passed over by its length, its payload never inflated.
Files lie in any file system that pyarrow opens.  Each committed write adds a
list of its files, `_files-*`, to the folder; a reader takes the files of all
lists, so appends add up, an overwrite names the lists that it replaces, and
files of failed or repeated tasks don't count.  abort() deletes what was written.

Archives of other makers are read too: gzip members without the field, plain
`.warc`, any record type and id.  page_id and refers_to are those of this
writer's ids, else null; record_id holds the id as it stands.  Payloads are
those of responses (after the HTTP header), resources and conversions.

Null html: an empty payload.  Rows that repeat the largest id are responses
each.  Null ids: written and read as null; such a row is the response only if
all rows of its payload have none.  Empty table: no rows.  Long payloads are
written and read whole, one at a time.  Other columns are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from arcweave.llm.common import map_arrow, shared_path, slices, written

RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, record_id string"
SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in RECORD.split(", ")])
#: Columns whose values stand in the head of a record.
IN_HEAD = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "record_id")
LISTS = "_files-"
GAP = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def named(i: int | None) -> str:
    return f"<urn:page:{'none' if i is None else i}>"


def number(name: str | None) -> int | None:
    """The page id in a record id of named(); null for other ids."""
    tail = (name or "").strip("<>")
    if not tail.startswith("urn:page:") or tail == "urn:page:none":
        return None
    try:
        return int(tail.removeprefix("urn:page:"))
    except ValueError:
        return None


def record_of(row: dict) -> tuple[bytes, bytes]:
    """Head and payload part of a record."""
    body = row["payload"] or b"" if row["record_type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {named(row['page_id'])}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {url}"] if row["url"] is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}"]
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {named(row['refers_to'])}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http, body + b"\r\n\r\n"


def member(head: bytes, rest: bytes, level: int) -> bytes:
    """A gzip member; its head is flushed apart, so it inflates without the payload."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    first = z.compress(head) + z.flush(zlib.Z_FULL_FLUSH)
    data = first + z.compress(rest) + z.flush()
    raw = len(head) + len(rest)
    lengths = (28 + len(data) + 8, raw, len(first))
    if max(lengths) >= 1 << 32:
        raise ValueError("a record of 4 GB or more")
    extra = b"SL" + (12).to_bytes(2, "little") + b"".join(n.to_bytes(4, "little") for n in lengths)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + len(extra).to_bytes(2, "little") + extra + data + zlib.crc32(rest, zlib.crc32(head)).to_bytes(4, "little") + raw.to_bytes(4, "little")


def fields_of(part: bytes) -> dict[str, str]:
    """Header fields after the first line, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in part.decode("utf-8", "replace").split("\r\n")[1:])}


def has_http(fields: dict[str, str]) -> bool:
    return fields.get("content-type", "").replace(" ", "").startswith("application/http")


class Record:
    """A record of an open file: raw holds its first bytes, all of its header fields and HTTP header among them."""

    def __init__(self, more: Callable[[int], bytes]):
        self.more, self.raw = more, b""
        while GAP not in self.raw and self.grow():
            pass
        self.block = self.raw.find(GAP) + 4
        if self.block < 4:
            raise ValueError("a record without an end of its head")
        self.fields = fields_of(self.raw[: self.block - 4])
        self.length = int(self.fields.get("content-length", 0))
        self.http, self.body = {}, self.block
        if has_http(self.fields):
            while (at := self.raw.find(GAP, self.block)) < 0 and len(self.raw) < self.block + self.length and self.grow():
                pass
            if 0 <= at < self.block + self.length:
                self.http, self.body = fields_of(self.raw[self.block : at]), at + 4

    def grow(self, wanted: int = 4096) -> bool:
        new = self.more(wanted)
        self.raw += new
        return bool(new)

    def row(self) -> dict:
        f, kind = self.fields, self.fields.get("warc-type")
        size = self.http.get("content-length") if kind == "revisit" else self.block + self.length - self.body if kind in ("response", "resource", "conversion") else None
        return {
            "page_id": number(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "record_type": kind, "refers_to": number(f.get("warc-refers-to")),
            "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": int(size) if size is not None else None, "payload": None, "record_id": f.get("warc-record-id"),
        }

    def payload(self) -> bytes:
        end, parts = self.block + self.length, [self.raw]
        held = len(self.raw)
        while held < end:
            parts.append(self.more(1 << 18))
            if not parts[-1]:
                raise ValueError("a record is cut short")
            held += len(parts[-1])
        self.raw = b"".join(parts)
        return self.raw[self.body : end]


def inflater(source, at: int, size: int, first: bytes) -> tuple[Callable[[int], bytes], Callable[[], int]]:
    """A function that gives more inflated bytes of the gzip member at a place ("" at its end), and one that passes over the rest and gives the member's end.

    first: what is already read of the member, and given at once.
    """
    z, state = zlib.decompressobj(31), {"fed": at, "first": first}

    def more(wanted: int) -> bytes:
        while not z.eof:
            data, state["first"] = state["first"], b""
            if not data:
                if state["fed"] >= size:
                    raise ValueError("a record is cut short")
                source.seek(state["fed"])
                data = source.read(min(wanted, size - state["fed"]))
            state["fed"] += len(data)
            if out := z.decompress(data):
                return out
        return b""

    def end() -> int:
        while more(1 << 18):
            pass
        return state["fed"] - len(z.unused_data)

    return more, end


def records_in(source, size: int, start: int = 4096) -> Iterator[Record]:
    """The records of an open file of gzip members or of plain records; the file is read no further than asked of each."""
    at = 0
    while at < size:
        source.seek(at)
        first = source.read(min(start, size - at))
        if first[:2] == b"\x1f\x8b":
            told = first[3:4] == b"\x04" and first[12:14] == b"SL" and int.from_bytes(first[14:16], "little") == 12
            if told:  # only the deflated head; the payload is inflated if it is asked for
                length, head = int.from_bytes(first[16:20], "little"), int.from_bytes(first[24:28], "little")
                more, _ = inflater(source, at, at + length, first[: 28 + head])
                yield Record(more)
                at += length
                continue
            more, end = inflater(source, at, size, first)
            yield Record(more)
            at = end()
            continue
        place = [at]

        def plain(wanted: int, place=place) -> bytes:
            source.seek(place[0])
            data = source.read(min(wanted, size - place[0]))
            place[0] += len(data)
            return data

        found = Record(plain)
        yield found
        at += found.block + found.length
        source.seek(at)
        gap = source.read(4)
        at += len(gap) - len(gap.lstrip(b"\r\n"))


@dataclass
class Part(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def opened(path: str):
    """File system and path of a URI."""
    from pyarrow import fs

    if "://" not in path and ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def listed(system, root: str) -> dict[str, dict]:
    """The lists of files in a folder that no other list replaces, by name."""
    from pyarrow import fs

    names = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith(LISTS)] if system.get_file_info(root).type != fs.FileType.File else []
    found = {}
    for path in sorted(names):
        with system.open_input_stream(path, compression=None) as f:
            found[path.rpartition("/")[2]] = json.loads(f.read())
    gone = {name for x in found.values() for name in x["replaces"]}
    return {k: v for k, v in found.items() if k not in gone}


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters):  # noqa: N802
        """Keep the tests on columns in the head; hand back the others."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in IN_HEAD and isinstance(f, EqualTo):
                self.tests.append((name, "in", [f.value]))
            elif name in IN_HEAD and isinstance(f, In):
                self.tests.append((name, "in", list(f.value)))
            elif name in IN_HEAD and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name in IN_HEAD and isinstance(f, IsNotNull):
                self.tests.append((name, "some", None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = opened(self.path)
        lists = listed(system, root)
        if lists:
            return [Part(f"{root}/{name}") for x in lists.values() for name in x["files"]] or [Part("")]
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        return [Part(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith((".warc.gz", ".warc"))] or [Part("")]

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            v = row[name]
            if v is None or kind == "in" and v not in value or kind == "starts" and not v.startswith(value):
                return False
        return True

    def read(self, partition: Part):
        if not partition.path:
            return
        system, _ = opened(self.path)
        rows, held = [], 0
        size = system.get_file_info(partition.path).size
        with system.open_input_file(partition.path) as source:
            for record in records_in(source, size):
                row = record.row()
                if not self.wanted(row):
                    continue
                if row["record_type"] in ("response", "resource", "conversion"):
                    row["payload"] = record.payload()
                    held += len(row["payload"])
                rows.append(row)
                held += 300
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int, most: int, overwrite: bool):
        self.path, self.level, self.most, self.overwrite = path, level, most, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        files, sink, size = [], None, 0
        try:
            for batch in slices(iterator):
                for row in batch.to_pylist():
                    if sink is None or size > self.most:
                        if sink is not None:
                            sink.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        sink, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    data = member(*record_of(row), self.level)
                    sink.write(data)
                    size += len(data)
            if sink is not None:
                sink.close()
        except BaseException:
            if sink is not None and not sink.closed:
                sink.close()
            removed(system, root, files)
            raise
        return Written(files)

    def commit(self, messages) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        old = listed(system, root) if self.overwrite else {}
        with system.open_output_stream(f"{root}/{LISTS}{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps({"files": sorted(x for m in messages if m for x in m.files), "replaces": sorted(old)}).encode())
        removed(system, root, [name for x in old.values() for name in x["files"]])

    def abort(self, messages) -> None:
        removed(*opened(self.path), [x for m in messages if m for x in m.files])


def removed(system, root: str, files: list[str]) -> None:
    for name in files:
        with contextlib.suppress(FileNotFoundError):
            system.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Options: path; level (of compression, 1); max_file_bytes (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", 1)), int(self.options.get("max_file_bytes", 64 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32(bits: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1, by SQL functions."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def four(i: int) -> list[Column]:
        n = F.conv(F.substring(bits, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(alphabet), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]

    return F.concat(*(c for i in range(8) for c in four(i)))


def records(pages: DataFrame, least: int = 0, share: int = 1000) -> DataFrame:
    """The columns of RECORD but record_id for each page; payloads under `least` bytes are all responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    narrow = written(rows.where(F.col("payload_bytes") >= least).select("page_id", F.unhex("sha").alias("key")), "digests")
    owners = written(narrow.groupBy("key").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1"), "owners")
    hot = F.col("n") * share > narrow.count()
    often = F.broadcast(owners.where(hot).select("key", "owner"))
    found = narrow.join(often, "key").union(narrow.join(often, "key", "left_anti").join(owners.where(~hot).select("key", "owner"), "key"))
    again = written(found.where(~F.col("page_id").eqNullSafe(F.col("owner"))).distinct(), "revisits").select(F.col("page_id").alias("again"), "key", "owner")
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("again")) & (F.unhex("sha") == F.col("key")), "left")
    first = F.col("key").isNull()
    return joined.select(
        "page_id", "url", F.when(first, "response").otherwise("revisit").alias("record_type"), F.col("owner").alias("refers_to"),
        base32(F.col("sha")).alias("payload_digest"), "payload_bytes", F.when(first, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, least: int = 0, mode: str = "append") -> None:
    """Write pages as archives into a folder; mode: append, or overwrite."""
    register(pages.sparkSession)
    records(pages, least).write.format("warc").mode(mode).option("path", path).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).load()


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives to the shared folder and read them back; digest and size of a response come from its payload as read."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, least)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, digest = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i, p in enumerate(batch.column(5).to_pylist()):
            if p is not None:
                size[i], digest[i] = len(p), digest_of(p)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.string()), batch.column(3), batch.column(4)], schema=schema)

    found = read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return map_arrow(found, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
