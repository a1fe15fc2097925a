"""Variant files with the types of their headers: what is read, what is noticed, and that writing restores it."""

import gzip

from locusflow.operators import report
from locusflow.sources import text, typed_vcf

HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=q10,Description="Quality \\"below\\" 10, or so">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=AF,Number=A,Type=Float,Description="Share, by ALT">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">
##INFO=<ID=NOTE,Number=.,Type=String,Description="Notes">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depths">
##contig=<ID=c1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb
"""
LINES = [
    "c1\t5\trs1\tA\tC,G\t30.5\tq10\tDP=7;AF=0.25,.;DB;NOTE=x,y\tGT:AD\t0/1:3,4,.\t./.",
    "c1\t9\t.\tAT\tA\t.\tPASS\t.\tGT:AD\t0|0:.\t1/1:1,2",
    "c9\t2\t.\tA\t.\t3\tq10;hot\tDP=many;ODD=1;SEEN\tGT:XX\t0:1\t1:2",
]


def test_round_trip_and_faults(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.vcf").write_text(HEADER + "\n".join(LINES) + "\n")
    header = typed_vcf.read_header(str(tmp_path / "in"))
    one, two, three = typed_vcf.vcf(spark, str(tmp_path / "in")).orderBy("nth").collect()
    assert one["info"].asDict() == {"DP": 7, "AF": [0.25, None], "DB": True, "NOTE": ["x", "y"]} and one["faults"] == []
    assert [c.asDict() for c in one["calls"]] == [{"GT": "0/1", "AD": [3, 4, None]}, {"GT": "./.", "AD": None}]
    assert two["info"].asDict() == {"DP": None, "AF": None, "DB": False, "NOTE": None} and (two["qual"], two["filters"], two["calls"][0]["AD"]) == (None, ["PASS"], None)
    assert three["info"]["DP"] is None and three["other_info"] == {"ODD": "1", "SEEN": ""}
    assert three["faults"] == ["contig c9 isn't declared", "FILTER hot isn't declared", "INFO ODD isn't declared", "INFO SEEN isn't declared", "FORMAT XX isn't declared", "INFO DP isn't Integer"]

    lines = typed_vcf.lines(typed_vcf.vcf(spark, str(tmp_path / "in")), header)
    report.write(lines, typed_vcf.header_lines(header), str(tmp_path / "out"), ["c1", "c9"])
    assert typed_vcf.header_lines(header) == HEADER.splitlines()
    written = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert written == HEADER.splitlines() + [LINES[0].replace("./.", "./.:."), LINES[1], "c9\t2\t.\tA\t.\t3\tq10;hot\tODD=1;SEEN\tGT:AD\t0:.\t1:."]
    back = typed_vcf.typed(text.vcf(spark, str(tmp_path / "out")), header).orderBy("nth").collect()
    assert [r["info"] for r in back] == [r["info"] for r in (one, two, three)] and [r["calls"] for r in back[:2]] == [r["calls"] for r in (one, two)]


def test_packed_header_and_empty_dictionaries(spark, tmp_path):
    (tmp_path / "y.vcf.gz").write_bytes(gzip.compress(b"##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc1\t1\t.\tA\tC\t1\t.\tDP=3\n"))
    (row,) = typed_vcf.vcf(spark, str(tmp_path / "y.vcf.gz")).collect()
    assert (row["calls"], row["other_info"], row["faults"]) == ([], {"DP": "3"}, ["contig c1 isn't declared", "INFO DP isn't declared"])
