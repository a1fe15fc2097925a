"""Variant files whose INFO and FORMAT fields have the types that their headers declare, read and written.

A header's dictionaries say of each field how many values it has (Number) and of what kind (Type). They make the schema:
a flag is a boolean, one value a scalar, any other number an array; INFO is a struct, and each sample's call one. What a
line has that the header doesn't declare, or can't be read as declared, is noticed line by line and not lost.
"""

from __future__ import annotations

import gzip
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.sources import files, text

#: Type to the type of a value. A Flag has none.
TYPES = {"Integer": "bigint", "Float": "double", "Character": "string", "String": "string"}
FIXED = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
#: Attributes of a header line in the order in which they are written, and those that stand in quotes.
ORDER, QUOTED = ("ID", "Number", "Type", "Description", "length", "assembly", "Source", "Version"), ("Description", "Source", "Version")


def read_header(path: str) -> dict:
    """The dictionaries and samples (text.vcf_header) of the first file of a path: its lines up to the first that isn't a header's."""
    with files.opened(files.listed(path)[0][0]) as raw:
        packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        own = []
        for line in io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if packed else raw, "utf-8"):
            if not line.startswith("#"):
                break
            own.append(line.rstrip("\r\n"))
    return text.vcf_header("\n".join(own))


def header_lines(header: dict, version: str = "VCFv4.2") -> list[str]:
    """A header's lines, of its dictionaries and samples."""

    def line(kind: str, fields: dict) -> str:
        shown = {k: f'"{v}"' if k in QUOTED else v for k, v in fields.items()}  # what is escaped in a text stays so
        names = [k for k in ORDER if k in fields] + [k for k in fields if k not in ORDER]
        return f"##{kind}=<{','.join(f'{k}={shown[k]}' for k in names)}>"

    lines = [line(kind, fields) for kind in ("FILTER", "INFO", "FORMAT", "contig") for fields in header[kind].values()]
    samples = ["FORMAT", *header["samples"]] if header["samples"] else []
    return [f"##fileformat={version}", *lines, "\t".join([*FIXED, *samples])]


def _shape(declared: dict) -> tuple[str, bool]:
    """(type of a value, whether a field has several); a flag is boolean."""
    number, kind = declared.get("Number", "."), declared.get("Type", "String")
    if kind == "Flag" or number == "0":
        return "boolean", False
    return TYPES.get(kind, "string"), number != "1"


def _value(given: Column, declared: dict) -> Column:
    """A field's text as it is declared; '.' is null, and so is what can't be read."""
    kind, several = _shape(declared)
    if kind == "boolean":
        return given.isNotNull()
    one = lambda x: F.when(x != ".", x.try_cast(kind))
    return F.when(given != ".", F.transform(F.split(given, ","), one)) if several else one(given)


def _unreadable(given: Column, declared: dict) -> Column:
    kind, several = _shape(declared)
    if kind in ("boolean", "string"):
        return F.lit(False)
    bad = lambda x: (x != ".") & x.try_cast(kind).isNull()
    return F.coalesce(F.exists(F.split(given, ","), bad) if several else bad(given), F.lit(False))


def typed(rows: DataFrame, header: dict) -> DataFrame:
    """Variants of text.vcf with info as a struct, calls as an array of structs, other_info and faults.

    faults names contigs, filters and fields that the header doesn't declare, values that aren't of the declared type,
    and a number of samples other than the header's. Undeclared INFO stays in other_info, as text.
    """
    info = F.struct(*[_value(F.col("info")[k], d).alias(k) for k, d in header["INFO"].items()]) if header["INFO"] else F.struct(F.lit(None).cast("string").alias("none"))
    declared = F.array(*map(F.lit, header["INFO"])).cast("array<string>")
    other = F.map_filter("info", lambda k, v: ~F.array_contains(declared, k))
    calls = F.transform("calls", lambda c: F.struct(*[_value(c[k], d).alias(k) for k, d in header["FORMAT"].items()])) if header["FORMAT"] else F.array().cast("array<struct<none: string>>")
    known = lambda kind: F.array(*map(F.lit, header[kind])).cast("array<string>")
    said = lambda what, names: F.transform(names, lambda x: F.concat(F.lit(f"{what} "), x, F.lit(" isn't declared")))
    odd = [F.when(_unreadable(F.col("info")[k], d), F.lit(f"INFO {k} isn't {d.get('Type')}")) for k, d in header["INFO"].items()]
    odd += [F.when(_any_call(k, d), F.lit(f"FORMAT {k} isn't {d.get('Type')}")) for k, d in header["FORMAT"].items()]
    faults = F.concat(
        F.when(F.array_contains(known("contig"), F.col("contig")), F.array().cast("array<string>")).otherwise(said("contig", F.array("contig"))),
        said("FILTER", F.array_except(F.filter("filters", lambda f: f != "PASS"), known("FILTER"))),
        said("INFO", F.array_sort(F.map_keys(other))),
        said("FORMAT", F.array_except(F.array_distinct(F.flatten(F.transform("calls", lambda c: F.map_keys(c)))), known("FORMAT"))),
        F.filter(F.array(*odd, F.when(F.size("calls") != len(header["samples"]), F.format_string(f"%d samples of {len(header['samples'])}", F.size("calls")))), lambda x: x.isNotNull()),
    )
    return rows.select("contig", "pos", "id", "ref", "alts", "qual", "filters", info.alias("info"), calls.alias("calls"), other.alias("other_info"), faults.alias("faults"), *[c for c in ("path", "nth") if c in rows.columns])


def _any_call(name: str, declared: dict) -> Column:
    return F.exists("calls", lambda c: _unreadable(c[name], declared))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """The variants of a file or a folder of files that share a header."""
    return typed(text.vcf(spark, path), read_header(path))


def number_text(x: Column, kind: str) -> Column:
    """A value's text; whole numbers have no fraction, missing ones are '.'."""
    shown = F.regexp_replace(x.cast("string"), r"\.0($|E)", "$1") if kind == "double" else x.cast("string")
    return F.coalesce(shown, F.lit("."))


def _text(value: Column, declared: dict) -> Column:
    """A field's text; null for what is left out."""
    kind, several = _shape(declared)
    return F.when(value.isNotNull(), F.array_join(F.transform(value, lambda x: number_text(x, kind)), ",") if several else number_text(value, kind))


def lines(variants: DataFrame, header: dict) -> DataFrame:
    """contig, pos and line: the text of typed variants, INFO and FORMAT in the header's order; fields without a value are left out of INFO."""
    parts = []
    for k, d in header["INFO"].items():
        value = F.col("info")[k]
        parts.append(F.when(value, F.lit(k)) if _shape(d)[0] == "boolean" else F.concat(F.lit(f"{k}="), _text(value, d)))
    rest = F.array_join(F.transform(F.array_sort(F.map_entries("other_info")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";") if "other_info" in variants.columns else F.lit("")
    info = F.concat_ws(";", *parts, F.when(rest != "", rest))
    dot = lambda x: F.when(F.coalesce(x, F.lit("")) == "", ".").otherwise(x)
    columns = ["contig", F.col("pos").cast("string"), dot(F.col("id")), "ref", dot(F.array_join("alts", ",")), number_text(F.col("qual"), "double"), dot(F.array_join("filters", ";")), dot(info)]
    if header["samples"]:
        call = lambda c: F.concat_ws(":", *[F.coalesce(_text(c[k], d), F.lit(".")) for k, d in header["FORMAT"].items()])
        columns += [F.lit(":".join(header["FORMAT"])), F.array_join(F.transform("calls", call), "\t")]
    return variants.select("contig", "pos", F.concat_ws("\t", *columns).alias("line"))
