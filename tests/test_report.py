"""The statistics of calls take the called alleles alone, and the variant file can be read back."""

from pyspark.sql import functions as F

from locusflow.operators import caller, pileup, report
from locusflow.sources import text

SCHEMA = "contig string, pos int, sample_idx int, base string, qual int, mapq int, strand string, rank int, ref_base string"


def cohort(spark):
    """Position 1: reference A, called G, and a lone T of low quality that isn't called; position 2: reference alone; an indel and an N."""
    rows = [("c1", 1, i, "A", 35, 40 + i % 3, "+-"[i % 2], i, "A") for i in range(20)] + [("c1", 1, 20 + i, "G", 35, 20 + i % 5, "+", 9 + i, "A") for i in range(15)]
    rows += [("c1", 1, 40, "T", 2, 60, "-", 1, "A"), ("c1", 1, 41, "+AC", 30, 30, "+", 1, "A"), ("c1", 1, 42, "N", 30, 30, "+", 1, "A")]
    rows += [("c1", 2, i, "C", 30, 30, "+", 1, "C") for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


def test_statistics_of_called_alleles(spark):
    obs = cohort(spark)
    calls = caller.call(obs)
    (row,) = caller.info(obs, calls).collect()
    assert row.alts == ["G"] and (row.ref_fwd, row.ref_rev, row.alt_fwd, row.alt_rev) == (10, 10, 15, 0)
    own = {r["name"]: int(r["phred"]) for r in pileup.ranksums(obs.where("base in ('A', 'G') and pos = 1"), {"mapq": "mapq", "rank": "rank", "qual": "qual"}).collect()}
    assert (row.MQRankSum, row.ReadPosRankSum, row.BaseQRankSum) == (own["mapq"], own["rank"], own["qual"])
    one = pileup.ranksum(obs.where("base in ('A', 'G') and pos = 1"), "mapq").first()
    assert int(one.phred) == own["mapq"] and (one.n1, one.n2) == (20, 15)
    assert row.QD == row.qual / 15


def test_variant_file(spark, tmp_path):
    obs = cohort(spark)
    calls = caller.call(obs)
    groups = spark.createDataFrame([(i, "east" if i % 2 else "west") for i in range(43)], "sample_idx int, group string")
    samples = spark.createDataFrame([(i,) for i in range(44)], "sample_idx int")
    lines = report.variant_lines(obs, calls, groups, samples)
    header = report.variant_header([("c1", 100)], [f"s{i}" for i in range(44)], ["east", "west"], "/ref.fa")
    path = str(tmp_path / "calls.vcf")
    report.write(lines, header, path, ["c1"])
    whole = [r.value for r in spark.read.text(path).orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()]
    assert whole[: len(header)] == header and len(whole) == len(header) + 1
    fields = whole[-1].split("\t")
    assert fields[:5] == ["c1", "1", ".", "A", "G"] and fields[8] == "GT:AB:SO:BP" and len(fields) == 9 + 44
    assert fields[9].startswith("0/.:A:+:0.99968") and fields[9 + 20].startswith("./1:G:+:") and fields[9 + 40].startswith("./.:T:-:") and fields[9 + 41 :] == ["./."] * 3
    assert ";SB_REF=10,10;SB_ALT=15,0;east_AF=" in fields[7] and ";west_AF=" in fields[7]
    (record,) = text.vcf(spark, path).collect()
    assert (record.contig, record.pos, record.ref, record.alts) == ("c1", 1, "A", ["G"])
