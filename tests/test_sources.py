import gzip
import struct

import pytest
from pyspark.sql import functions as F

from locusflow.functions import cigar as cg
from locusflow.functions.terms import Term, both, default, exists, length, matching, no, some
from locusflow.sources import bam, sequences, sinks, text

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:T1\tLN:40
@SQ\tSN:T2\tLN:50
@RG\tID:g1\tSM:alice
@RG\tID:g2\tSM:bob
@CO\ta comment: here
r1\t99\tT1\t5\t60\t2S4M1I3M2D2M\t=\t20\t30\tACGTACGTACGT\tIIIIIIIIIIII\tNM:i:3\tRG:Z:g1
r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*
"""


@pytest.fixture
def reads(spark, tmp_path):
    (tmp_path / "s1.x.sam").write_text(SAM)
    return text.sam(spark, str(tmp_path / "s1.x.sam"))


def test_sam_fields_header_and_round_trip(spark, tmp_path, reads):
    one, two = reads.orderBy("nth").collect()
    assert (one.qname, one.flag, one.contig, one.pos, one.end_pos, one.mate_contig, one.tags) == ("r1", 99, "T1", 5, 15, "T1", {"NM": "i:3", "RG": "Z:g1"})
    assert (two.contig, two.cigar, two.qual, two.end_pos) == (None, None, None, 0)
    header = text.sam_header(spark, str(tmp_path / "s1.x.sam"))
    assert {r["type"]: r["count"] for r in header.groupBy("type").count().collect()} == {"HD": 1, "SQ": 2, "RG": 2, "CO": 1}
    assert [r["sample"] for r in text.sample_of(header).collect()] == ["alice"]
    assert [(r.tid, r.contig, r.length) for r in text.contigs_of(header).orderBy("tid").collect()] == [(0, "T1", 40), (1, "T2", 50)]
    assert [r[0] for r in reads.select(text.sample_from_path(F.col("path"))).distinct().collect()] == ["s1"]
    line = reads.orderBy("nth").select(sinks.sam_line(reads)).first()[0]
    assert line == "r1\t99\tT1\t5\t60\t2S4M1I3M2D2M\tT1\t20\t30\tACGTACGTACGT\tIIIIIIIIIIII\tNM:i:3\tRG:Z:g1"


def test_filters_on_reads(reads):
    names = lambda *e: [r.qname for r in matching(reads, *e).collect()]
    assert names(lambda r: r.tag("NM") == "i:3") == ["r1"]
    assert names(lambda r: some(r.tag("XX") == "", r.qlen > 3), lambda r: r.has("paired")) == ["r1"]
    assert sorted(names(lambda r: some(no(exists(r.tag("NM"))), r.mapq >= 0))) == ["r1", "r2"]
    assert names(lambda r: r.qname.matches("^r[2-9]$")) == ["r2"]
    for bad in (lambda r: r.qname + 1, lambda r: r.pos.matches("1"), lambda r: length(r.pos) > 1):
        with pytest.raises(ValueError):
            matching(reads, bad)
    with pytest.raises(AttributeError):
        matching(reads, lambda r: r.nothing > 1)


def test_undefined_terms(spark):
    row = spark.createDataFrame([(1, None)], "x int, y int").select(
        *[t.column.alias(k) for k, t in {
            "both": both(Term(F.lit(0)), Term(F.col("y"))), "some": some(Term(F.col("y")), Term(F.col("x"))), "no": no(Term(F.col("y"))), "mixed": Term(F.lit("1"), True) == 1, "unlike": Term(F.lit("1"), True) != 1,
            "rest": Term(F.lit(7)) % Term(F.col("y")), "default": default(Term(F.col("y")), 4), "bits": (Term(F.lit(6)) & 3) | 8,
        }.items()]
    ).first()
    assert row.asDict() == {"both": None, "some": 1.0, "no": 1.0, "mixed": 0.0, "unlike": 1.0, "rest": None, "default": 4.0, "bits": 10.0}


def test_cigar_example(spark):
    row = spark.createDataFrame([("3M1I50M5D46M", 22862751)], "cigar string, pos bigint").withColumn("placed", cg.placed(cg.blocks(F.col("cigar"))))
    got = row.select(cg.alignment_blocks(F.col("pos"), F.col("placed"))).first()[0]
    assert [(b.beg, b.end) for b in got] == [(22862750, 22862753), (22862753, 22862803), (22862808, 22862854)]


def test_vcf(spark, tmp_path):
    (tmp_path / "v.vcf").write_text('##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer,Description="a, b">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n1\t7\t.\tA\tG,T\t30\tPASS;q\tDP=3;DB\tGT:DP\t0/1:3\t./.\n1\t9\trs1\tA\t.\t.\t.\t.\n')
    a, b = text.vcf(spark, str(tmp_path / "v.vcf")).orderBy("pos").collect()
    assert (a.pos, a.id, a.alts, a.qual, a.filters, a.info, a.calls) == (7, None, ["G", "T"], 30.0, ["PASS", "q"], {"DP": "3", "DB": ""}, [{"GT": "0/1", "DP": "3"}, {"GT": "./.", "DP": None}])
    assert (b.id, b.alts, b.filters, b.qual, b.calls) == ("rs1", [], [], None, [])
    head = text.vcf_header((tmp_path / "v.vcf").read_text())
    assert head["samples"] == ["S1", "S2"] and head["INFO"]["DP"]["Description"] == "a, b"


def test_regions_and_lists(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# x\nc1\t4\t9\n")
    (tmp_path / "a.reg").write_text("c1:5-9\nc2\nc3:1,000\n")
    (tmp_path / "a.tab").write_text("c1 9 5\nc2 7\n")
    (tmp_path / "g").write_text("s1 A x\ns2 B\ns1 C")
    assert [tuple(r) for r in text.regions(spark, str(tmp_path / "a.bed"), "bed").collect()] == [("c1", 5, 9)]
    assert [tuple(r) for r in text.regions(spark, str(tmp_path / "a.reg"), "reg").collect()] == [("c1", 5, 9), ("c2", 1, 2**31 - 1), ("c3", 1000, 2**31 - 1)]
    assert [tuple(r) for r in text.regions(spark, str(tmp_path / "a.tab")).collect()] == [("c1", 5, 9), ("c2", 7, 7)]
    assert {r["sample"]: r["group"] for r in text.groups(spark, str(tmp_path / "g")).collect()} == {"s1": "C", "s2": "B"}
    assert text.first_column(spark, str(tmp_path / "g")).count() == 3
    assert [text.parse_region(r) for r in ("c", "c:", "c:5", "c:-9", "c:1,005-2000", "{a:b}:3-4")] == [("c", 1, None), ("c", 1, None), ("c", 5, None), ("c", 1, 9), ("c", 1005, 2000), ("a:b", 3, 4)]
    for bad in ("c:9-5", "", ":5"):
        with pytest.raises(ValueError):
            text.parse_region(bad)


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">r1 first\nACGTACGTAC\nGTTT\n\n>r2\nGGCC\n")
    ref = sequences.fasta(spark, str(tmp_path / "r.fa"), chunk=4)
    assert {r.contig: r.length for r in sequences.lengths(ref).collect()} == {"r1": 14, "r2": 4}
    assert [sequences.fetch(ref, "r1", a, b).first()[0] for a, b in ((1, 14), (3, 9), (12, 99), (20, 30))] == ["ACGTACGTACGTTT", "GTACGTA", "TTT", ""]
    sites = spark.createDataFrame([("r1", 9), ("r2", 4), ("r9", 1)], "contig string, pos bigint")
    assert {r.contig: r.ref_base for r in sequences.reference_bases(sites, ref, 4).collect()} == {"r1": "A", "r2": "C", "r9": None}
    (tmp_path / "r.fq").write_text("@a x\nACGT\n+\nIIII\n@b\nGG\n+b\n@@\n")
    assert sorted(tuple(r) for r in sequences.fastq(spark, str(tmp_path / "r.fq")).collect()) == [("a", "ACGT", "IIII"), ("b", "GG", "@@")]


def bam_file(path):
    def rec(name, flag, tid, pos, cigar, seq, qual, tags):
        raw = name.encode() + b"\0"
        codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(raw), 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + raw + b"".join(struct.pack("<I", n << 4 | bam.OPS.index(o)) for n, o in cigar)
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + bytes(qual) + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100)
    tags = b"NMC\x03" + b"RGZg1\0" + b"XBBs" + struct.pack("<I2h", 2, -1, 5)
    path.write_bytes(gzip.compress(head) + gzip.compress(rec("q1", 16, 0, 9, [(3, "M"), (1, "S")], "ACGN", [30, 31, 32, 33], tags)) + gzip.compress(rec("q2", 4, -1, -1, [], "AC", [255, 255], b"")))


def test_bam(spark, tmp_path):
    bam_file(tmp_path / "x.bam")
    spark.dataSource.register(bam.BamSource)
    a, b = spark.read.format("bam").load(str(tmp_path / "*.bam")).orderBy("nth").collect()
    assert (a.qname, a.flag, a.contig, a.pos, a.mapq, a.cigar, a.seq, a.qual, a.tags) == ("q1", 16, "c1", 10, 60, "3M1S", "ACGN", "?@AB", {"NM": "i:3", "RG": "Z:g1", "XB": "B:s,-1,5"})
    assert (b.contig, b.pos, b.cigar, b.qual) == (None, 0, None, None)
    assert sinks.sniff((tmp_path / "x.bam").read_bytes()[:64]).startswith("gzip")


def test_sniffing():
    assert [sinks.sniff(x) for x in (b"##fileformat=VCFv4", b">x", b"@r\nAC", b"@HD\tVN", b"c\t1\t2\n", b"what", gzip.compress(b"BAM\1xx"), b"\x28\xb5\x2f\xfdzz")] == ["vcf", "fasta", "fastq", "sam", "bed", "unknown", "gzip+bam", "zstd"]
