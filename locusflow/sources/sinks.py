"""Text outputs: SAM lines, variant and coverage files, sniffing of formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First bytes of formats, after unpacking where they are packed.
MAGIC = {b"BAM\1": "bam", b"CRAM": "cram", b"BAI\1": "bai", b"CSI\1": "csi", b"TBI\1": "tbi", b"BCF\2": "bcf", b"BZh": "bzip2", b"\xfd7zXZ": "xz", b"\x28\xb5\x2f\xfd": "zstd", b"##fileformat=VCF": "vcf", b"@HD\t": "sam", b"@SQ\t": "sam", b"@RG\t": "sam", b"@PG\t": "sam", b">": "fasta", b"@": "fastq"}


def sniff(head: bytes) -> str:
    """The format of a file's first bytes."""
    import zlib

    if head[:2] == b"\x1f\x8b":
        inner = sniff(zlib.decompressobj(31).decompress(head, 64))
        return ("bgzf" if head[12:14] == b"BC" else "gzip") + ("" if inner == "unknown" else f"+{inner}")
    found = next((kind for magic, kind in MAGIC.items() if head.startswith(magic)), None)
    if found:
        return found
    parts = head.split(b"\n", 1)[0].split(b"\t")
    if len(parts) >= 11 and parts[1].isdigit() and parts[3].isdigit():
        return "sam"
    return "bed" if len(parts) >= 3 and parts[1].isdigit() and parts[2].isdigit() else "unknown"


def sam_line(df: DataFrame) -> Column:
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws(":", e["key"], e["value"])), "\t") if "tags" in df.columns else F.lit("")
    fixed = F.concat_ws("\t", "qname", F.col("flag").cast("string"), star("contig"), F.col("pos").cast("string"), F.col("mapq").cast("string"), star("cigar"), star("mate_contig"), F.col("mate_pos").cast("string"), F.col("tlen").cast("string"), star("seq"), star("qual"))
    return F.when(F.coalesce(tags, F.lit("")) == "", fixed).otherwise(F.concat_ws("\t", fixed, tags))


def short(x: Column) -> Column:
    """Six significant digits."""
    return F.format_string("%.6g", x.cast("double"))


def fixed(x: Column) -> Column:
    """Six decimals, never a negative zero."""
    return F.format_string("%.6f", x.cast("double") + 0.0)


def variant_line() -> Column:
    """A line of called sites (see plans.calls.site_info): fixed fields and INFO."""
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    qd = F.col("qual") / F.aggregate("acs", F.lit(0.0), lambda s, n: s + n)
    whole = lambda n: F.concat(F.lit(f"{n}="), F.col(n).cast("string"))
    info = F.concat_ws(
        ";", F.concat(F.lit("CM_DP="), F.col("dp").cast("string")), F.concat(F.lit("CM_AC="), joined("acs", lambda x: x.cast("string"))), F.concat(F.lit("CM_AF="), joined("afs", short)), F.concat(F.lit("CM_CAF="), joined("cafs", short)),
        whole("MQRankSum"), whole("ReadPosRankSum"), whole("BaseQRankSum"), F.concat(F.lit("QD="), fixed(qd)), F.concat(F.lit("SOR="), fixed(F.col("SOR"))), F.concat(F.lit("FS="), fixed(F.col("FS"))),
        F.concat(F.lit("SB_REF="), F.concat_ws(",", "ref_fwd", "ref_rev")), F.concat(F.lit("SB_ALT="), F.concat_ws(",", "alt_fwd", "alt_rev")),
    )
    return F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref_base", F.array_join("alts", ","), fixed(F.col("qual")), F.when(F.col("qual") > 20, ".").otherwise("LowQual"), info)


def coverage_line() -> Column:
    numbers = ["depth", "depth_A", "depth_C", "depth_G", "depth_T"]
    return F.concat_ws("\t", "contig", F.col("pos").cast("string"), "ref_base", *[F.col(c).cast("string") for c in numbers], "indels", fixed(F.col("fs")), fixed(F.col("sor")), F.concat_ws(",", "ref_fwd", "ref_rev", "alt_fwd", "alt_rev"))
