"""Reads of any known format by what a file begins with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions import cigar as cg
from locusflow.sources import bam, files, sequences, sinks, text

COLUMNS = ["qname", "flag", "contig", "pos", "end_pos", "mapq", "cigar", "mate_contig", "mate_pos", "tlen", "seq", "qual", "tags"]
UNMAPPED = 4


def alignments(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The alignments of SAM or BAM files, or the reads of FASTA or FASTQ files as unmapped ones; ValueError for other formats.

    The format is that of the first file; options are the ``bam`` source's.
    """
    first = files.listed(path)[0][0]
    with files.opened(first) as f:
        kind = sinks.sniff(f.read(1 << 16)).removeprefix("bgzf+").removeprefix("gzip+")
    if kind == "sam":
        return text.sam(spark, path).select(*COLUMNS)
    if kind == "bam":
        spark.dataSource.register(bam.BamSource)
        push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
        rows = spark.read.format("bam").options(**({"pushdown": push} | options)).load(path)
        return rows.withColumn("end_pos", cg.end_of(F.col("pos"), cg.blocks(F.col("cigar")))).select(*COLUMNS)
    if kind in ("fasta", "fastq"):
        rows = sequences.fastq(spark, path) if kind == "fastq" else sequences.records(sequences.fasta(spark, path))
        zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
        fixed = {"flag": F.lit(UNMAPPED), "contig": none, "pos": zero, "end_pos": zero, "mapq": F.lit(0), "cigar": none, "mate_contig": none, "mate_pos": zero, "tlen": zero, "tags": F.create_map().cast("map<string,string>")}
        return rows.withColumns(fixed).select(*COLUMNS)
    raise ValueError(f"{first} holds no reads: {kind}")
