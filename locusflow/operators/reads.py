"""Read-level predicates and projections over flag, mapq and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the alignment format.
FLAGS = {"paired": 1, "proper_pair": 2, "unmap": 4, "munmap": 8, "reverse": 16, "mreverse": 32, "read1": 64, "read2": 128, "secondary": 256, "qcfail": 512, "dup": 1024, "supplementary": 2048}


def has(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(FLAGS[name]) != 0


def is_mapped(flag: Column) -> Column:
    return ~has(flag, "unmap")


def is_duplicate(flag: Column) -> Column:
    """Only a mapped read can be a duplicate; the same holds for quality failures."""
    return is_mapped(flag) & has(flag, "dup")


def is_qc_fail(flag: Column) -> Column:
    return is_mapped(flag) & has(flag, "qcfail")


def strand(flag: Column) -> Column:
    return F.when(has(flag, "reverse"), "-").otherwise("+")


def proper_orientation(flag: Column, pos: Column, mate_pos: Column, same_contig: Column) -> Column:
    """Forward read before its reverse mate, on one contig."""
    fr = F.when(pos < mate_pos, ~has(flag, "reverse") & has(flag, "mreverse")).otherwise(has(flag, "reverse") & ~has(flag, "mreverse"))
    return is_mapped(flag) & ~has(flag, "munmap") & same_contig & fr


def flag_names(flag: Column) -> Column:
    """PAIRED,REVERSE,... in bit order."""
    return F.concat_ws(",", *[F.when(flag.bitwiseAND(bit) != 0, name.upper()) for name, bit in FLAGS.items()])


def flag_number(names: Column) -> Column:
    """The inverse of ``flag_names``."""
    parts = F.split(names, ",")
    return sum((F.when(F.array_contains(parts, n.upper()), b).otherwise(0) for n, b in FLAGS.items()), F.lit(0))


def passing(reads: DataFrame, min_mapq: int) -> DataFrame:
    """Reads of enough mapping quality that are neither duplicates nor failed; secondary ones stay."""
    flag = F.col("flag")
    return reads.where((F.col("mapq") >= min_mapq) & ~is_duplicate(flag) & ~is_qc_fail(flag))


def in_region(df: DataFrame, contig: str, beg: int | None = None, end: int | None = None, start: str = "pos", stop: str = "pos") -> DataFrame:
    """Rows that overlap the closed region."""
    out = df.where(F.col("contig") == contig)
    out = out if end is None else out.where(F.col(start) <= end)
    return out if beg is None else out.where(F.col(stop) >= beg)


def read_group(tags: Column, qname: Column) -> Column:
    """The RG tag, or else the name up to its first colon; null where it has none."""
    return F.coalesce(tags["RG"], F.when(F.instr(qname, ":") > 0, F.substring_index(qname, ":", 1)))


def marked_failed(flag: Column, failed: Column) -> Column:
    """flag with the quality failure bit where a mapped read failed."""
    return F.when(failed & is_mapped(flag), flag.bitwiseOR(FLAGS["qcfail"])).otherwise(flag)


def mapping_quality(flag: Column, mapq: Column) -> Column:
    """0 for reads that aren't mapped."""
    return F.when(is_mapped(flag), mapq).otherwise(0)


def with_tag(tags: Column, name: str, value: Column, where: Column | None = None) -> Column:
    """tags with one of them set to 'type:value', or removed by a null; only where a condition holds."""
    rest = F.map_filter(tags, lambda k, v: k != name)
    edited = F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))
    return edited if where is None else F.when(where, edited).otherwise(tags)
