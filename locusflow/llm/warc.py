"""WARC archives as a PySpark Python data source, and pages stored without repeated payloads.

The source ``warc`` writes one archive file per task, every record a gzip member, and reads folders of them. Reading plans partitions of whole
files, packed to about ``bytesPerPartition``; filters on record_type, page_id, target_uri, payload_digest and
refers_to are pushed down. Headers are parsed first: of a record that a filter turns away, only the header is
inflated; the rest is skipped by the lengths that the member's ``sl`` field gives. Payloads that nobody asks for
(option ``payload`` = false) are skipped too. Archives of other writers, gzip members without that field or plain files
(.warc), are read as well: rows without page_id, the payload of an HTTP response without its HTTP header.

Defined results of ``archive``: a null html is an empty payload, and empty payloads are equal payloads; of the
rows with equal payloads that with the largest page_id is the response (a null page_id is smaller than any;
of repeated rows with that page_id each is a response); the others are revisits without a payload of their
own, whose headers carry the full payload's digest and length; an empty table gives an empty folder that reads
as no rows; other columns of pages aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

from locusflow.llm.common import shared_dir, table

SCHEMA = "page_id bigint, target_uri string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
PUSHED = {"page_id", "target_uri", "record_type", "payload_digest", "refers_to"}
BATCH_BYTES = 4 << 20
#: Bytes of a member before its data, and of data read at first for a record's header.
MEMBER, HEADER = 24, 512


def files_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a URI or a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict) -> bytes:
    """A WARC record of a row with the columns of SCHEMA; revisits carry no payload."""
    payload = row["payload"] if row["record_type"] == "response" else b""
    uri = (row["target_uri"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(row['page_id']))}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {uri}"] if row["target_uri"] is not None else []
    head += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    head += [f"X-Page-ID: {row['page_id']}"] if row["page_id"] is not None else []
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"X-Refers-To-Page: {row['refers_to']}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(row['refers_to']))}>"] if row["refers_to"] is not None else []
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member of a record. Its extra field ``sl`` holds the compressed and the plain length, for skipping."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = deflate.compress(raw) + deflate.flush()
    return struct.pack("<4sIBBH2sHII", b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, len(data), len(raw)) + data + struct.pack("<II", zlib.crc32(raw), len(raw))


def fields_of(head: bytes) -> dict[str, str]:
    """A record's header fields by lower-case name."""
    first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not the start of a WARC record: {first[:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def from_header(fields: dict[str, str]) -> dict:
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("x-page-id"),
        "target_uri": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": number("x-payload-length"),
        "refers_to": number("x-refers-to-page"),
    }


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        fs, root = files_of(self.path)
        fs.create_dir(root, recursive=True)
        name, out = f"{root}/{uuid.uuid4().hex}.warc.gz", None
        for row in rows:
            if out is None:
                out = fs.open_output_stream(name + ".tmp")
            out.write(member(record(row.asDict())))
        if out is None:
            return Written([])
        out.close()
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        """Files of the tasks that counted get their names; others stay as .tmp, which readers pass over."""
        fs, _ = files_of(self.path)
        for name in [n for m in messages if m for n in m.paths]:
            fs.move(name + ".tmp", name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = files_of(self.path)
        for name in [n for m in messages if m for n in m.paths]:
            fs.delete_file(name + ".tmp")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, per_partition: int, payload: bool):
        self.path, self.per_partition, self.payload, self.tests = path, per_partition, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in PUSHED and isinstance(f, (EqualTo, In, IsNull, IsNotNull)):
                self.tests.append((name, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            x = row[name]
            if not {"IsNull": x is None, "IsNotNull": x is not None, "EqualTo": x is not None and x == value, "In": x is not None and x in (value or ())}[kind]:
                return False
        return True

    def partitions(self) -> list[Files]:
        fs, root = files_of(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        out, size = [Files([])], 0
        for info in sorted((i for i in found if i.path.endswith((".warc.gz", ".warc"))), key=lambda i: i.path):
            if out[-1].paths and size + info.size > self.per_partition:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(info.path)
            size += info.size
        return out

    def rows(self, part: Files) -> Iterator[dict]:
        fs, _ = files_of(self.path)
        for path in part.paths:
            with fs.open_input_file(path) as raw:
                reader = _Buffered(raw)
                start = reader.peek(MEMBER)
                if start[:2] != b"\x1f\x8b":
                    yield from self.plain(path, reader)
                elif len(start) == MEMBER and start[3] & 4 and start[12:14] == b"sl":
                    yield from self.members(path, reader)
                else:
                    yield from self.plain(path, _Inflated(reader))

    def members(self, path: str, reader: _Buffered) -> Iterator[dict]:
        """The records of members with lengths, as the writer makes them."""
        while start := reader.read(MEMBER):
            if len(start) < MEMBER or start[:2] != b"\x1f\x8b" or not start[3] & 4 or start[12:14] != b"sl":
                raise ValueError(f"{path}: a member without its lengths among others with them")
            size, _ = struct.unpack("<II", start[-8:])
            inflate, plain, left = zlib.decompressobj(-15), b"", size
            while b"\r\n\r\n" not in plain and left:
                data = reader.read(min(HEADER, left))
                left -= len(data)
                plain += inflate.decompress(data)
            head, _, plain = plain.partition(b"\r\n\r\n")
            row = from_header(fields := fields_of(head))
            row["payload"] = None
            wanted = self.wanted(row)
            if wanted and self.payload and row["record_type"] == "response":
                row["payload"] = (plain + inflate.decompress(reader.read(left)))[: int(fields["content-length"])]
                left = 0
                if digest(row["payload"]) != row["payload_digest"]:
                    raise ValueError(f"{path}: the payload of page {row['page_id']} doesn't match its digest")
            reader.skip(left + 8)
            if wanted:
                yield row

    def plain(self, path: str, reader) -> Iterator[dict]:
        """The records of any archive, from its plain bytes: a header, then as many bytes as it says, then two line ends.

        The payload of an HTTP response is what follows its own header.
        """
        while head := reader.until(b"\r\n\r\n").lstrip(b"\r\n"):
            row = from_header(fields := fields_of(head))
            size = int(fields.get("content-length", 0))
            row["payload"] = None
            if row["payload_bytes"] is None and not fields.get("content-type", "").startswith("application/http"):
                row["payload_bytes"] = size
            wanted = self.wanted(row)
            if wanted and self.payload and row["record_type"] != "revisit":
                block = reader.read(size)
                if fields.get("content-type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                row["payload"], row["payload_bytes"] = block, len(block)
            else:
                reader.skip(size)
            reader.skip(4)
            if wanted:
                yield row

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]
        held, size = [], 0
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
        for row in self.rows(part):
            held.append(row)
            size += 200 + len(row["payload"] or b"")
            if size >= BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)


class _Buffered:
    """Reads and skips over a random-access file; skips longer than the buffer are seeks."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.held, self.at = raw, size, b"", 0

    def _fill(self) -> bool:
        more = self.raw.read(self.size)
        self.held, self.at = self.held[self.at :] + more, 0
        return bool(more)

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._fill():
            pass
        return self.held[self.at : self.at + n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> bytes:
        """The bytes up to a mark, which is passed over; all that is left where there is none."""
        seen = 0
        while (found := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._fill():
                return self.read(len(self.held) - self.at)
        out, self.at = self.held[self.at : found], found + len(mark)
        return out

    def skip(self, n: int) -> None:
        rest = len(self.held) - self.at
        if n <= rest:
            self.at += n
        else:
            self.raw.seek(n - rest, 1)
            self.held, self.at = b"", 0


class _Inflated(_Buffered):
    """The plain bytes of gzip members one after the other; what is skipped is inflated and forgotten."""

    def __init__(self, packed: _Buffered, size: int = 1 << 18):
        super().__init__(None, size)
        self.packed, self.inflate, self.left = packed, zlib.decompressobj(31), b""

    def _fill(self) -> bool:
        more = b""
        while not more:
            data = self.left or self.packed.read(self.size)
            if not data:
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            more = self.inflate.decompress(data, self.size)
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.held, self.at = self.held[self.at :] + more, 0
        return True

    def skip(self, n: int) -> None:
        while n > len(self.held) - self.at:
            n -= len(self.held) - self.at
            self.held, self.at = b"", 0
            if not self._fill():
                return
        self.at += n


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); options bytesPerPartition and payload."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("bytesPerPartition", 64 << 20)), self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed) -> F.Column:
    """Forty hexadecimal digits as base32: eight symbols for each ten digits."""
    parts = []
    for at in range(1, 41, 10):
        number = F.conv(F.substring(hexed, at, 10), 16, 10).cast("bigint")
        parts += [F.substring(F.lit(BASE32), (F.shiftright(number, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*parts)


def resolved(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as rows of SCHEMA: who is the response and who revisits it.

    Two exchanges: digests and ids alone for the largest id of each payload, with partial maxima before it; then
    the pages on their digest, a join that splits a hot digest.
    """
    whole = pages.select("page_id", F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    whole = whole.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("bigint"))
    last = whole.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"))
    row = whole.join(last, ["payload_digest", "payload_bytes"])
    is_last = F.col("page_id").eqNullSafe(F.col("last"))
    return row.select(
        "page_id",
        "target_uri",
        F.when(is_last, "response").otherwise("revisit").alias("record_type"),
        base32(F.col("payload_digest")).alias("payload_digest"),
        "payload_bytes",
        F.when(~is_last, F.col("last")).alias("refers_to"),
        F.when(is_last, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str) -> None:
    """Write a record for every page into the folder."""
    register(pages.sparkSession)
    resolved(pages).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload)).load(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every page's record as the archives give it back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = read(spark, path).where(F.col("record_type").isin("response", "revisit"))
    return back.select("page_id", F.coalesce(F.length("payload").cast("bigint"), "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
