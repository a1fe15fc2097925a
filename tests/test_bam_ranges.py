"""BAM files cut into ranges: whatever the cuts, the same records; fewer blocks under filters and regions."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from locusflow.sources import alignments, bam

NAMES = ["c1", "c2", "c3"]


def block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def raw_record(name, tid, pos, ops, seq, flag=0):
    codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", tid, pos - 1, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | bam.OPS.index(o)) for n, o in ops)
    return struct.pack("<i", len(body)) + body + b""


def body_of(record, seq):
    codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    more = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + bytes([30] * len(seq)) + b"NMC\x01"
    return struct.pack("<i", len(record) - 4 + len(more)) + record[4:] + more


def write(path, reads, size, order="coordinate", names=NAMES):
    """reads (name, tid, pos, ops, seq) in blocks of size bytes, so that records lie across them."""
    text = f"@HD\tVN:1.6\tSO:{order}\n".encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 10**6) for n in names)
    data = head + b"".join(body_of(raw_record(*r[:5], 4 if r[1] < 0 else 0), r[4]) for r in reads)
    path.write_bytes(b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + block(b""))


def some_reads(seed, n):
    r = random.Random(seed)
    reads = []
    for i in range(n):
        m = r.randint(1, 40)
        ops = [(2, "S"), (m, "M"), (r.randint(1, 500), "N"), (3, "M")]
        reads.append((f"q{i}", r.choice([0, 0, 0, 1, 2]), r.randint(1, 5000), ops, "".join(r.choice("ACGT") for _ in range(m + 5))))
    reads.sort(key=lambda x: (x[1], x[2]))
    return reads + [(f"u{i}", -1, 0, [], "ACGT") for i in range(5)]


def span(ops):
    return sum(n for n, o in ops if o in "MN")


def rows(options, filters=()):
    reader = bam.BamReader(options)
    assert not list(reader.keep(list(filters)))
    return [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]


@pytest.mark.parametrize("size", [61, 300, 65000])
@pytest.mark.parametrize("order", ["coordinate", "unsorted"])
def test_any_cut_gives_the_same_records(tmp_path, size, order):
    reads = some_reads(1, 400)
    if order == "unsorted":
        random.Random(2).shuffle(reads)
    write(tmp_path / "x.bam", reads, size, order)
    want = [r[0] for r in reads]
    for split in (50, 999, 20_000, 1 << 30):
        got = rows({"path": str(tmp_path / "x.bam"), "split": str(split)})
        assert [x["qname"] for x in got] == want, split
        assert [x["nth"] for x in got] == sorted({x["nth"] for x in got})
    asked = {"path": str(tmp_path / "x.bam"), "split": "999", "regions": "c1:100-220 c1:200-300 c3:4,000"}
    meets = lambda r: r[1] == 0 and r[2] <= 300 and r[2] + span(r[3]) > 100 or r[1] == 2 and r[2] + span(r[3]) > 4000
    assert [x["qname"] for x in rows(asked)] == [r[0] for r in reads if meets(r)]
    assert [x["qname"] for x in rows(asked | {"regions": "c3:4000 *"})] == [r[0] for r in reads if r[1] < 0 or r[1] == 2 and r[2] + span(r[3]) > 4000]
    assert len(rows(asked | {"regions": "."})) == len(reads)
    assert [x["qname"] for x in rows(asked | {"longest": "543"})] == [r[0] for r in reads if meets(r)]


@pytest.fixture
def counted(monkeypatch):
    seen, read = [], bam.Blocks.block
    monkeypatch.setattr(bam.Blocks, "block", lambda self, offset: (seen.append(offset), read(self, offset))[1])
    return seen


def test_fewer_blocks_under_filters(tmp_path, counted):
    reads = some_reads(3, 3000)
    write(tmp_path / "x.bam", reads, 400)
    path = {"path": str(tmp_path / "x.bam"), "split": "2000"}
    assert len(rows(path)) == len(reads)
    every = len(counted)
    for filters, want, most in [
        ([bam.EqualTo(("contig",), "c2"), bam.GreaterThan(("pos",), 1000), bam.LessThanOrEqual(("pos",), 1200)], lambda r: r[1] == 1 and 1000 < r[2] <= 1200, 0.3),
        ([bam.EqualTo(("contig",), "c9")], lambda r: False, 0.1),
        ([bam.In(("contig",), ("c1", "c3"))], lambda r: r[1] in (0, 2), 1.1),
        ([bam.LessThan(("pos",), 1)], lambda r: r[1] < 0, 0.3),
    ]:
        counted.clear()
        assert [x["qname"] for x in rows(path, filters)] == [r[0] for r in reads if want(r)]
        assert len(counted) < most * every, (len(counted), every)
    counted.clear()
    assert {x["qname"] for x in rows(path | {"regions": "c1:2000-2100", "longest": "600"})} == {r[0] for r in reads if r[1] == 0 and r[2] <= 2100 and r[2] + span(r[3]) > 2000}
    assert len(counted) < 0.4 * every


def test_spark_reads_ranges_and_pushes_filters(spark, tmp_path):
    reads = some_reads(4, 500)
    write(tmp_path / "x.bam", reads, 700)
    write(tmp_path / "y.bam", reads[:3], 700)
    spark.dataSource.register(bam.BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("bam").options(split="4000", pushdown="true").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 4 and df.count() == 508
    near = df.where("contig = 'c1' AND pos BETWEEN 1000 AND 1500")
    assert {(r["qname"], r["pos"]) for r in near.collect()} >= {(r[0], r[2]) for r in reads if r[1] == 0 and 1000 <= r[2] <= 1500}
    assert near.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="no such contig"):
        spark.read.format("bam").option("regions", "c7").load(str(tmp_path / "x.bam")).count()


def test_reads_by_content(spark, tmp_path):
    write(tmp_path / "odd.name", some_reads(5, 20), 300)
    (tmp_path / "s.txt").write_text("@HD\tVN:1.6\nr1\t0\tc1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\n")
    (tmp_path / "f.txt").write_text("@r1 x\nACGT\n+\nIIII\n")
    (tmp_path / "a.txt").write_text(">r1 x\nAC\nGT\n")
    (tmp_path / "v.txt").write_text("##fileformat=VCFv4.2\n")
    got = {n: alignments.alignments(spark, str(tmp_path / n)) for n in ("odd.name", "s.txt", "f.txt", "a.txt")}
    assert all(df.columns == alignments.COLUMNS for df in got.values()) and got["odd.name"].count() == 25
    assert [(r["qname"], r["flag"], r["seq"], r["end_pos"]) for n in ("s.txt", "f.txt", "a.txt") for r in got[n].collect()] == [("r1", 0, "ACGT", 8), ("r1", 4, "ACGT", 0), ("r1", 4, "ACGT", 0)]
    with pytest.raises(ValueError, match="no reads"):
        alignments.alignments(spark, str(tmp_path / "v.txt"))
    assert got["odd.name"].where(F.col("contig").isNull()).count() == 5
