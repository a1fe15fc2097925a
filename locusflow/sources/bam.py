"""A Python data source for BAM files that cuts files into ranges, skips what filters or regions rule out and reads through shared file systems.

A file of independent blocks (BGZF) is cut every ``split`` bytes. A task looks for the first block that begins in its
range and, in it, for the first record: a place from which whole valid records follow one another. It owns the records
that begin in its blocks and reads on to finish the last. A gzip file without block sizes is one range.

Equalities and bounds on contig and pos are pushed down, and the option ``regions`` ("c1:100-200 c2") keeps the
alignments that meet any of several regions, each once; ``*`` stands for those without a place, ``.`` for all. In a file sorted by coordinate the ranges are chosen by binary
search over the first records of ranges, a few blocks of a file, and a task ends at the first record behind the last
wanted place. Without an index nothing bounds how far back an alignment that reaches into a region begins; the option
``longest`` (reference bases of an alignment) does, else its contig is read from the start. Only the fixed fields of a
turned-away record are looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from locusflow.sources import files

SCHEMA = "qname string, flag int, contig string, pos bigint, mapq int, cigar string, mate_contig string, mate_pos bigint, tlen bigint, seq string, qual string, tags map<string,string>, path string, nth bigint"
ARROW = pa.schema([
    ("qname", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_contig", pa.string()), ("mate_pos", pa.int64()), ("tlen", pa.int64()),
    ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("path", pa.string()), ("nth", pa.int64()),
])
# Fixed values of the format.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
WIDTHS = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}
BLOCK_HEAD = b"\x1f\x8b\x08\x04"
MAX_BLOCK = 1 << 16
ON_REFERENCE = {0, 2, 3, 7, 8}  # operations that take reference bases
ON_READ = {0, 1, 4, 7, 8}
#: Bytes of a range; records that must follow one another where a range's first one is looked for; rows of a batch.
SPLIT, CHAIN, ROWS = 64 << 20, 6, 4096
FAR = 1 << 40


def _tags(data: bytes, at: int) -> dict[str, str]:
    out = {}
    while at < len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[name], at = f"{kind}:{data[at:end].decode()}", end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{WIDTHS[sub]}", data, at + 5)
            out[name], at = f"B:{sub}," + ",".join(f"{v:g}" if sub in "fd" else str(v) for v in values), at + 5 + struct.calcsize(f"<{n}{WIDTHS[sub]}")
        else:
            (value,) = struct.unpack_from("<" + WIDTHS[kind], data, at)
            at += struct.calcsize("<" + WIDTHS[kind])
            out[name] = f"A:{value.decode()}" if kind == "A" else f"{'f' if kind in 'fd' else 'i'}:{value:g}" if kind in "fd" else f"i:{value}"
    return out


def record(data: bytes, names: list[str | None]) -> tuple:
    """The fields of one record's bytes."""
    tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + l_name
    cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", data, at))
    at += 4 * n_cigar
    packed = data[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    at += len(packed)
    qual = data[at : at + l_seq]
    text = None if not l_seq or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    name = lambda i: names[i] if i >= 0 else None
    return data[32 : 31 + l_name].decode(), flag, name(tid), pos + 1, mapq, cigar or None, name(mtid), mpos + 1, tlen, seq or None, text, _tags(data, at + l_seq)


def _span(data: bytes) -> int:
    """Reference bases of a record, 1 at least."""
    n_cigar, l_name = struct.unpack_from("<H", data, 12)[0], data[8]
    return max(1, sum(c >> 4 for c in struct.unpack_from(f"<{n_cigar}I", data, 32 + l_name) if c & 15 in ON_REFERENCE))


def _sound(data: memoryview, at: int, n_names: int) -> int | None:
    """Where the record that begins at a place ends if all its fields agree; None if it isn't a record, -1 if data ends first."""
    if len(data) - at < 36:
        return -1
    size, tid, pos, l_name, _, _, n_cigar, _, l_seq, mtid, mpos = struct.unpack_from("<iiiBBHHHiii", data, at)
    fixed = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if size < fixed or l_name < 2 or l_seq < 0 or size > 1 << 28 or not (-1 <= tid < n_names and -1 <= mtid < n_names) or pos < -1 or mpos < -1:
        return None
    if len(data) - at < 36 + l_name + 4 * n_cigar:
        return -1
    name = bytes(data[at + 36 : at + 36 + l_name])
    ops = struct.unpack_from(f"<{n_cigar}I", data, at + 36 + l_name)
    if name[-1] or not all(33 <= c < 127 for c in name[:-1]) or any(c & 15 > 8 for c in ops) or n_cigar and l_seq and sum(c >> 4 for c in ops if c & 15 in ON_READ) != l_seq:
        return None
    return at + 4 + size


class Blocks:
    """A file's blocks; ``read`` counts those that were unpacked."""

    def __init__(self, path: str):
        self.file, self.read = files.opened(path), 0
        self.size = self.file.size()
        self.cut = self._head(0) is not None  # whether the file is of blocks that tell their sizes

    def _head(self, offset: int) -> int | None:
        """The length of the block at offset if one begins there."""
        self.file.seek(offset)
        head = self.file.read(18)
        if len(head) < 18 or head[:4] != BLOCK_HEAD:
            return None
        extra = head[12:18] if struct.unpack_from("<H", head, 10)[0] == 6 else head[12:18] + self.file.read(struct.unpack_from("<H", head, 10)[0] - 6)
        at = 0
        while at + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, at + 2)[0]
            if extra[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(extra):
                return struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + n
        return None

    def first(self, begin: int) -> int:
        """The first block at begin or behind it; the file's size if there is none. A block's head must be followed by another, or by the file's end."""
        while begin < self.size:
            self.file.seek(begin)
            window = self.file.read(MAX_BLOCK + 18)
            at = window.find(BLOCK_HEAD)
            while at >= 0:
                size = self._head(begin + at)
                if size and (begin + at + size == self.size or self._head(begin + at + size)):
                    return begin + at
                at = window.find(BLOCK_HEAD, at + 1)
            begin += MAX_BLOCK
        return self.size

    def block(self, offset: int) -> tuple[bytes, int]:
        """A block's bytes and where the next begins."""
        size = self._head(offset)
        if size is None:
            raise ValueError(f"no block at {offset}")
        self.file.seek(offset)
        raw = self.file.read(size)
        self.read += 1
        data = zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : -8], -15)
        if zlib.crc32(data) != struct.unpack_from("<I", raw, size - 8)[0]:
            raise ValueError(f"the block at {offset} is damaged")
        return data, offset + size

    def bytes(self, offset: int) -> Iterator[tuple[int, bytes]]:
        """(block, its bytes) from a block on; a file without block sizes comes in one stream, as if from block 0."""
        if not self.cut:
            self.file.seek(0)
            unpack = zlib.decompressobj(31)
            while chunk := self.file.read(1 << 20):
                while chunk:
                    yield 0, unpack.decompress(chunk)
                    chunk = unpack.unused_data
                    if unpack.eof:
                        unpack = zlib.decompressobj(31)
            return
        while offset < self.size:
            data, after = self.block(offset)
            yield offset, data
            offset = after


@dataclass
class Header:
    names: list[str]
    sorted: bool
    first: tuple[int, int]  # block and place in it of the first record


class Stream:
    """Bytes over block borders, with the block that each record begins in."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]):
        self.blocks, self.data, self.at = blocks, b"", 0
        self.starts: list[tuple[int, int]] = []  # (place of its first byte in data, block), of the current block and those behind it

    def more(self) -> bool:
        got = next(self.blocks, None)
        if got is None:
            return False
        kept = self.data[self.at :]
        self.starts = [(p - self.at, b) for p, b in self.starts]
        self.starts = self.starts[max((i for i, (p, _) in enumerate(self.starts) if p <= 0), default=0) :]
        self.starts.append((len(kept), got[0]))
        self.data, self.at = kept + got[1], 0
        return True

    def take(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            if not self.more():
                raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def place(self) -> tuple[int, int] | None:
        """(block, byte in it) of what comes next; None at the end."""
        while self.at >= len(self.data):
            if not self.more():
                return None
        start, block = next((p, b) for p, b in reversed(self.starts) if p <= self.at)
        return block, self.at - start


def header(blocks: Blocks) -> Header:
    stream = Stream(blocks.bytes(0))
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", stream.take(4))[0]
    text, names = stream.take(number()), []
    for _ in range(number()):
        names.append(stream.take(number())[:-1].decode())
        number()
    line = text.split(b"\n", 1)[0]
    return Header(names, line.startswith(b"@HD") and b"\tSO:coordinate" in line, stream.place() or (blocks.size, 0))


def records(blocks: Blocks, head: Header, begin: int, end: int) -> Iterator[tuple[tuple[int, int], bytes]]:
    """((block, byte), record) for the records that begin in the blocks from begin to before end."""
    if begin > head.first[0]:
        start = blocks.first(begin)
        stream = Stream(blocks.bytes(start))
        if start >= end or not _seek_record(stream, len(head.names), end):
            return
    else:
        stream = Stream(blocks.bytes(head.first[0]))
        if stream.place() is None:
            return
        stream.at += head.first[1] if blocks.cut else 0
        if not blocks.cut:
            _skip_header(stream)
    while (place := stream.place()) is not None and place[0] < end:
        (size,) = struct.unpack("<i", stream.take(4))
        yield place, stream.take(size)


def _skip_header(stream: Stream) -> None:
    stream.take(4)
    number = lambda: struct.unpack("<i", stream.take(4))[0]
    stream.take(number())
    for _ in range(number()):
        stream.take(number() + 4)


def _seek_record(stream: Stream, n_names: int, end: int) -> bool:
    """Moves to the first place before block end from which CHAIN sound records, or all that are left, follow."""
    while (place := stream.place()) is not None and place[0] < end:
        if _follows(stream, n_names):
            return True
        stream.at += 1
    return False


def _follows(stream: Stream, n_names: int) -> bool:
    at, ended = stream.at, False
    for _ in range(CHAIN):
        after = _sound(memoryview(stream.data), at, n_names)
        while after == -1 or after is not None and after > len(stream.data) and not ended:
            moved = stream.at
            if not stream.more():
                if after == -1:
                    return at == len(stream.data)
                ended = True
                break
            at -= moved  # what was behind is gone
            after = _sound(memoryview(stream.data), at, n_names)
        if after is None or ended:
            return False
        at = after
    return True


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.regions, self.longest = options.get("regions"), int(options.get("longest", FAR))
        self.contigs: set[str] | None = None
        self.low, self.high = 0, FAR

    def keep(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes the filters that ranges and records are chosen by; those that it can't apply come back."""
        for f in filters:
            if f.attribute == ("contig",) and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = values if self.contigs is None else self.contigs & values
            elif f.attribute == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo):
                    self.high = min(self.high, f.value)
            elif f.attribute == ("pos",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def wanted(self, names: list[str]) -> list[tuple[int, int, int, int, int]] | None:
        """(tid, first pos, last pos, beg, end): where alignments begin that are wanted, and what they must meet; None for all there are."""
        from locusflow.sources.text import merged_regions

        if self.regions is None and self.contigs is None and self.low <= 0 and self.high >= FAR:
            return None
        texts = (self.regions or "").split()
        near = self.regions is not None and "." not in texts
        asked = merged_regions(" ".join(x for x in texts if x != "*")) if near else [(c, 1, FAR) for c in (names if self.contigs is None else self.contigs)]
        if unknown := [c for c, *_ in asked if c not in names and near]:
            raise ValueError(f"no such contig: {unknown[0]}")
        out = []
        for contig, beg, end in asked:
            if contig in names and (self.contigs is None or contig in self.contigs):
                lo = max(self.low, beg - self.longest + 1) if near else self.low
                if lo <= (hi := min(self.high, end)):
                    out.append((names.index(contig), lo, hi, beg, end))
        if ("*" in texts or not near) and self.contigs is None and self.low <= 0 <= self.high:
            out.append((-1, 0, FAR, 0, FAR))  # unplaced alignments have no contig and pos 0
        return sorted(out)

    def partitions(self) -> list[Range]:
        return [r for path, size in files.listed(self.path) for r in self._ranges(path, size)]

    def _ranges(self, path: str, size: int) -> list[Range]:
        blocks = Blocks(path)
        if not blocks.cut:
            return [Range(path, 0, size)]
        begins = list(range(0, size, self.split))
        ranges = [Range(path, b, min(b + self.split, size)) for b in begins]
        head = header(blocks)
        if (wanted := self.wanted(head.names)) is None or not head.sorted:
            return ranges
        known: dict[int, tuple] = {}

        def key(i: int) -> tuple:
            """Of the first record at range i or behind it."""
            if i not in known:
                got = next(records(blocks, head, begins[i], size), None)
                known[i] = _order(got[1]) if got else (FAR, FAR)
            return known[i]

        kept = set()
        for tid, lo, hi, *_ in wanted:
            at = (FAR, 0) if tid < 0 else (tid, lo)
            last = (FAR, FAR) if tid < 0 else (tid, hi)
            first = _last(len(begins), lambda i, at=at: i == 0 or key(i) < at)
            until = _last(len(begins), lambda i, last=last: i == 0 or key(i) <= last)
            kept.update(range(first, until + 1))
        return [ranges[i] for i in sorted(kept)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(part.path)
        head = header(blocks)
        wanted = self.wanted(head.names)
        last = max(((FAR, FAR) if t < 0 else (t, hi) for t, _, hi, *_ in wanted), default=(-1, 0)) if wanted is not None else None
        rows: list[tuple] = []
        for n, ((block, byte), data) in enumerate(records(blocks, head, part.begin, part.end)):
            if wanted is not None:
                order = _order(data)
                if head.sorted and order > last:
                    break
                if not any(self._meets(data, order, w) for w in wanted):
                    continue
            rows.append((*record(data, head.names), part.path, block << 16 | byte if blocks.cut else n))
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _meets(self, data: bytes, order: tuple, w: tuple) -> bool:
        tid, lo, hi, beg, _ = w
        if tid < 0:
            return order[0] == FAR
        return order[0] == tid and lo <= order[1] <= hi and (self.regions is None or order[1] + _span(data) > beg)


class PushingBamReader(BamReader):
    """For sessions with spark.sql.python.filterPushdown.enabled; without it Spark refuses a reader that takes filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.keep(filters)


def _last(n: int, holds) -> int:
    """The last of n numbers for which a test holds that holds for all before it."""
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if holds(mid) else (lo, mid - 1)
    return lo


def _order(data: bytes) -> tuple[int, int]:
    """(tid, pos from 1) of a record, unplaced ones last."""
    tid, pos = struct.unpack_from("<ii", data)
    return (FAR if tid < 0 else tid), pos + 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)]
    columns[11] = [list(t.items()) for t in columns[11]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


class BamSource(DataSource):
    """spark.read.format("bam").load(a file, a folder or a pattern of files); options split, regions, longest, and pushdown.

    With pushdown "true", filters reach the reader; the session must allow it (spark.sql.python.filterPushdown.enabled).

    nth is a record's place in its file: the block it begins in and the byte in that.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        options = dict(self.options)
        return (PushingBamReader if options.get("pushdown", "false").lower() == "true" else BamReader)(options)
