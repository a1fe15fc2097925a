"""Line formats read with spark.read.text and taken apart by Column expressions: SAM, VCF, BED, region and group lists, FAI."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions import cigar as cg


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, path and nth: nth orders the lines of a file."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("nth"))


def _column(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments: the eleven fields, end_pos, tags by name as 'type:value', the file and the line's order. '*' is null."""
    p = F.split("value", "\t")
    given = lambda i: F.when(_column(p, i) != "*", _column(p, i))
    tags = F.transform(F.slice(p, 12, F.greatest(F.size(p) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(4), F.length(t))))
    rows = lines(spark, path).where("value <> '' AND NOT startswith(value, '@')")
    out = rows.select(
        _column(p, 0).alias("qname"), _column(p, 1).cast("int").alias("flag"), given(2).alias("contig"), _column(p, 3).cast("bigint").alias("pos"), _column(p, 4).cast("int").alias("mapq"), given(5).alias("cigar"),
        F.when(_column(p, 6) == "=", given(2)).otherwise(given(6)).alias("mate_contig"), _column(p, 7).cast("bigint").alias("mate_pos"), _column(p, 8).cast("bigint").alias("tlen"), given(9).alias("seq"), given(10).alias("qual"),
        F.map_from_entries(tags).alias("tags"), "path", "nth",
    )
    return out.withColumn("end_pos", cg.end_of(F.col("pos"), cg.blocks(F.col("cigar"))))


def sam_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header lines: type (HD, SQ, RG, PG, CO), tags by name, the file and the line's order."""
    rows = lines(spark, path).where("startswith(value, '@')")
    p = F.split("value", "\t")
    tags = F.transform(F.filter(F.slice(p, 2, F.size(p)), lambda t: t.contains(":")), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(4), F.length(t))))
    kind = F.substring(_column(p, 0), F.lit(2), F.length(_column(p, 0)))
    return rows.select(kind.alias("type"), F.when(kind != "CO", F.map_from_entries(tags)).alias("tags"), "value", "path", "nth")


def sample_of(header: DataFrame) -> DataFrame:
    """path and sample: SM of each file's first read group."""
    return header.where("type = 'RG'").groupBy("path").agg(F.min_by(F.col("tags")["SM"], "nth").alias("sample"))


def sample_from_path(path: Column) -> Column:
    """A file's base name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def contigs_of(header: DataFrame) -> DataFrame:
    """tid, contig and length from the SQ lines, in header order."""
    from pyspark.sql import Window

    sq = header.where("type = 'SQ'").select(F.col("tags")["SN"].alias("contig"), F.col("tags")["LN"].cast("bigint").alias("length"), "nth")
    return sq.withColumn("tid", F.row_number().over(Window.orderBy("nth")) - 1).select("tid", "contig", "length")


def vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Variants: the fixed fields, INFO as a map (flags map to ''), genotypes as an array of maps by FORMAT key. '.' is null or empty."""
    p = F.split("value", "\t")
    given = lambda i: F.when(_column(p, i) != ".", _column(p, i))
    listed = lambda i, sep: F.coalesce(F.split(given(i), sep), F.array().cast("array<string>"))
    info = F.transform(listed(7, ";"), lambda x: F.struct(F.substring_index(x, "=", 1), F.when(x.contains("="), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("")))
    keys = F.split(_column(p, 8), ":")
    calls = F.transform(F.slice(p, 10, F.greatest(F.size(p) - 9, F.lit(0))), lambda c: F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), F.split(c, ":").alias("v")), lambda e: e["k"].isNotNull())))
    rows = lines(spark, path).where("value <> '' AND NOT startswith(value, '#')")
    return rows.select(
        _column(p, 0).alias("contig"), _column(p, 1).cast("bigint").alias("pos"), given(2).alias("id"), _column(p, 3).alias("ref"), listed(4, ",").alias("alts"), given(5).cast("double").alias("qual"), listed(6, ";").alias("filters"),
        F.map_from_entries(info).alias("info"), calls.alias("calls"), "path", "nth",
    )


META = re.compile(r'^##(\w+)=<(.*)>$')


def vcf_header(text: str) -> dict:
    """Samples and the INFO, FORMAT, FILTER and contig dictionaries of a header."""
    out: dict = {"samples": [], "INFO": {}, "FORMAT": {}, "FILTER": {}, "contig": {}}
    for line in text.splitlines():
        if line.startswith("#CHROM"):
            out["samples"] = line.split("\t")[9:]
        elif (m := META.match(line)) and m[1] in out:
            fields = dict(re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2]))
            out[m[1]][fields.get("ID")] = {k: v.strip('"') for k, v in fields.items()}
    return out


# Places of contig, begin and end in a line, and what begins are short of counting from 1.
PRESETS = {"gff": (0, 3, 4, 0), "psltbl": (14, 16, 17, 1), "sam": (2, 3, None, 0)}


def regions(spark: SparkSession, path: str, form: str = "tab") -> DataFrame:
    """contig, beg, end (closed, from 1) of bed, tab, reg (one region text per line), vcf, gff, psltbl or sam files; comments are left out."""
    rows = lines(spark, path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    p = F.split(F.trim("value"), r"\s+")
    if form == "bed":
        beg, end = _column(p, 1).cast("bigint") + 1, _column(p, 2).cast("bigint")
    elif form in PRESETS:
        contig, b, e, shift = PRESETS[form]
        return rows.where("NOT startswith(value, '@')").select(_column(p, contig).alias("contig"), (_column(p, b).cast("bigint") + shift).alias("beg"), (_column(p, e).cast("bigint") if e is not None else cg.end_of(_column(p, b).cast("bigint"), cg.blocks(_column(p, 5)))).alias("end"))
    elif form == "vcf":
        beg, end = _column(p, 1).cast("bigint"), _column(p, 1).cast("bigint") + F.length(_column(p, 3)) - 1
    elif form == "reg":
        own = F.regexp_replace(_column(p, 0), ",", "")
        beg = F.coalesce(F.regexp_extract(own, r":(\d+)", 1).try_cast("bigint"), F.lit(1))
        end = F.coalesce(F.regexp_extract(own, r":\d*-(\d+)$", 1).try_cast("bigint"), F.lit((1 << 31) - 1).cast("bigint"))
        return rows.select(F.regexp_extract(own, r"^([^:]+)", 1).alias("contig"), beg.alias("beg"), end.alias("end"))
    else:
        beg, end = _column(p, 1).cast("bigint"), F.coalesce(_column(p, 2).try_cast("bigint"), _column(p, 1).cast("bigint"))
    return rows.select(_column(p, 0).alias("contig"), F.least(beg, end).alias("beg"), F.greatest(beg, end).alias("end"))


#: What a number in a region may end with.
SCALES = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}
_NUMBER = r"[\d,]+(?:\.\d+)?(?:[eE]\d+)?[kKmMgG]?"


def _number(text: str | None) -> int | None:
    """1,000 or 1e3 or 1k; ValueError where a fraction is left."""
    if not text:
        return None
    scale = text[-1].lower() if text[-1].lower() in SCALES else ""
    value = Decimal(text.replace(",", "").rstrip("kKmMgG")) * SCALES[scale]
    if value != int(value):
        raise ValueError(f"not a whole number: {text!r}")
    return int(value)


def parse_region(text: str) -> tuple[str | None, int, int | None]:
    """contig, beg, end of 'c', 'c:', 'c:5', 'c:-9', 'c:5-9', with thousands separators, exponents or k, M, G, and {c}:... for names with colons.

    '.' is every contig (None), and '*' the contig '*' of unplaced reads.
    """
    if text in (".", "*"):
        return (None if text == "." else "*"), 1, None
    m = re.fullmatch(rf"(?:\{{(.+)\}}|([^:]+))(?::(?:({_NUMBER}))?(?:(-)({_NUMBER})?)?)?", text)
    if not m:
        raise ValueError(f"not a region: {text!r}")
    beg, end = _number(m[3]) or 1, _number(m[5])
    if end is not None and end < beg:
        raise ValueError(f"the region ends before it starts: {text!r}")
    return m[1] or m[2], beg, end


def region_list(text: str) -> list[tuple[str | None, int, int | None]]:
    """Regions between commas; a comma that splits a number is one of its separators."""
    return [parse_region(x) for x in re.split(r",(?!\d{3}(?:\D|$))", text) if x]


def merged_regions(text: str, far: int = 1 << 40) -> list[tuple[str, int, int]]:
    """Regions between spaces, those of a contig that overlap or touch as one, in order of contig and place."""
    out: list[tuple[str, int, int]] = []
    for contig, beg, end in sorted((c, b, far if e is None else e) for c, b, e in map(parse_region, text.split())):
        if out and out[-1][0] == contig and beg <= out[-1][2] + 1:
            out[-1] = (contig, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((contig, beg, end))
    return out


def groups(spark: SparkSession, path: str) -> DataFrame:
    """sample and group of a two-column list; of lines with one sample the last counts."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(F.size(p) >= 2).select(_column(p, 0).alias("sample"), _column(p, 1).alias("group"), "nth")
    return rows.groupBy("sample").agg(F.max_by("group", "nth").alias("group"))


def first_column(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).where("trim(value) <> ''").select(_column(p, 0).alias("value"))


def fai(spark: SparkSession, path: str, contigs: list[str] | None = None) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema="contig string, length bigint, offset bigint, line_bases int, line_width int")
    return rows.where(F.col("contig").isin(contigs)) if contigs else rows


def site_table(rows: DataFrame, value: str = "value") -> DataFrame:
    """Lines of contig, pos, ref, ALTs, frequencies and three regions' depths (reference first), as a row for each ALT.

    Lines of other than nine fields, and comments, are left out. A region's share is that of the first ALT's depth, whichever ALT the row
    has, to five places; null where the region has no depth.
    """
    p = F.split(F.trim(value), r"\s+")
    ok = rows.where((F.size(p) == 9) & ~F.startswith(F.col(value), F.lit("#")))
    whole = lambda i: F.transform(F.split(_column(p, i), ":"), lambda x: x.cast("double").cast("bigint"))
    names = ("central", "north", "south")
    each = ok.select(_column(p, 0).alias("contig"), _column(p, 1).cast("bigint").alias("pos"), F.split(_column(p, 4), ",").alias("freqs"), *[whole(5 + i).alias(n) for i, n in enumerate(names)], F.posexplode(F.split(_column(p, 3), ",")).alias("i", "alt"))

    def region(n: str) -> list[Column]:
        total = F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return [F.get(n, F.lit(0)).alias(f"{n}_ref"), F.get(n, F.col("i") + 1).alias(f"{n}_alt"), F.when(total > 0, F.round(F.get(n, F.lit(1)) / total, 5)).alias(f"{n}_af")]

    return each.select("contig", "pos", F.upper("alt").alias("alt"), F.get("freqs", F.col("i")).cast("double").alias("freq"), *[c for n in names for c in region(n)])
