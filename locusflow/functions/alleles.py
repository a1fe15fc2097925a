"""Allele algebra as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of a variant's classes.
REF, SNP, MNP, INDEL, OTHER, BND, OVERLAP, INS, DEL = 0, 1, 2, 4, 8, 16, 32, 64, 128


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the longest common prefix."""
    i = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    first = F.array_position(F.transform(i, lambda k: F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1))), False)
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1)


def _change(ref: Column, alt: Column) -> Column:
    """(kind, n) of one ALT allele: its class bits, and bases gained, lost (negative) or changed.

    What both alleles begin with alike is cut off, whatever the case; then what they end with alike, but for one base each.
    """
    begun = common_prefix(F.upper(ref), F.upper(alt))
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  each value is computed once
    made = lambda kind, n: F.struct(F.lit(kind).alias("kind"), (F.lit(n) if isinstance(n, int) else n).cast("int").alias("n"))

    def middle(v: Column) -> Column:
        r, a = v["r"], v["a"]
        ended = F.least(common_prefix(F.reverse(r), F.reverse(a)), F.length(r) - 1, F.length(a) - 1)
        return bound(F.struct((F.length(r) - ended).alias("lost"), (F.length(a) - ended).alias("gained"), F.substring(r, F.length(r) - ended, F.lit(1)).alias("x"), F.substring(a, F.length(a) - ended, F.lit(1)).alias("y")), ends)

    def ends(v: Column) -> Column:
        lost, gained, alike = v["lost"], v["gained"], v["x"] == v["y"]
        return (
            F.when((lost == 1) & (gained == 1), made(SNP, 1)).when(gained == 1, F.when(alike, made(INDEL | DEL, 1 - lost)).otherwise(made(OTHER, 1 - lost)))
            .when(lost == 1, F.when(alike, made(INDEL | INS, gained - 1)).otherwise(made(OTHER, gained - 1))).when(lost == gained, made(MNP, gained)).otherwise(made(OTHER, F.when(lost > gained, -lost).otherwise(gained)))
        )

    def rest(v: Column) -> Column:
        r, a, more = v["r"], v["a"], F.length(alt) - F.length(ref)
        return (
            F.when((r == "") & (a == ""), made(REF, 0)).when(r == "", F.when(F.right(alt, F.lit(1)).isin("[", "]"), made(BND, 0)).otherwise(made(INDEL | INS, more)))
            .when(a == "", made(INDEL | DEL, more)).otherwise(middle(v))
        )

    plain = bound(F.struct(F.substring(F.upper(ref), begun + 1, F.length(ref)).alias("r"), F.substring(F.upper(alt), begun + 1, F.length(alt)).alias("a")), rest)
    return (
        F.when(alt == "*", made(OVERLAP, 0)).when((F.length(ref) == 1) & (F.length(alt) == 1), F.when(alt.isin(".", "X") | (alt == ref), made(REF, 0)).otherwise(made(SNP, 1)))
        .when(alt.startswith("<X>") | alt.startswith("<*>") | (alt == "<NON_REF>"), made(REF, 0)).when(alt.startswith("<"), made(OTHER, 0)).when(F.left(alt, F.lit(1)).isin("[", "]"), made(BND, 0)).otherwise(plain)
    )


def variant_class(ref: Column, alt: Column) -> Column:
    """The class bits of one ALT allele."""
    return _change(ref, alt)["kind"]


def variant_length(ref: Column, alt: Column) -> Column:
    """Bases gained or lost (negative) or, for SNPs and MNPs, changed; 0 for symbols, breakends and what equals REF."""
    return _change(ref, alt)["n"]


def classes(ref: Column, alts: Column) -> Column:
    """All class bits of a record."""
    return F.aggregate(F.transform(alts, lambda a: variant_class(ref, a)), F.lit(0), lambda s, x: s.bitwiseOR(x))


def is_snp(ref: Column, alts: Column) -> Column:
    return (F.length(ref) == 1) & F.forall(alts, lambda a: ((F.length(a) == 1) & (a != "*")) | a.isin("<X>", "<*>"))


def has_classes(bits: Column, mask: int, mode: str = "overlap") -> Column:
    """overlap: any bit; subset: no bit outside the mask; exact: equal. INS and DEL alone leave INDEL out of account."""
    if mask & (INS | DEL) and not mask & INDEL:
        bits = bits.bitwiseAND(~INDEL)
    elif mask & INDEL and not mask & (INS | DEL):
        bits = bits.bitwiseAND(~(INS | DEL))
    return {"overlap": bits.bitwiseAND(mask) != 0, "subset": (bits.bitwiseAND(~mask) == 0) & (bits != 0), "exact": bits == mask}[mode]


def has_filter(filters: Column, wanted: list[str]) -> Column:
    """Membership in FILTER; an empty list only matches '.'."""
    return F.when(F.size(filters) == 0, F.lit("." in wanted)).otherwise(F.arrays_overlap(filters, F.array(*map(F.lit, wanted))))


def genotype_class(gt: Column) -> Column:
    """HOM_RR, HET_RA, HOM_AA, HET_AA, HAPL_R, HAPL_A or UNKN of a genotype text."""
    parts = F.split(gt, r"[/|]")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return (
        F.when(gt.isNull() | F.array_contains(parts, "."), "UNKN").when(F.size(parts) == 1, F.when(a == "0", "HAPL_R").otherwise("HAPL_A"))
        .when((a == "0") & (b == "0"), "HOM_RR").when(a == b, "HOM_AA").when((a == "0") | (b == "0"), "HET_RA").otherwise("HET_AA")
    )


def used_alleles(gts: Column, n: Column) -> Column:
    """The ALT indexes (from 1) that occur in an array of genotype texts."""
    seen = F.flatten(F.transform(gts, lambda g: F.split(g, r"[/|]")))
    return F.filter(F.sequence(F.lit(1), n), lambda i: F.array_contains(seen, i.cast("string")))


def trimmed(alts: Column, used: Column) -> Column:
    return F.transform(used, lambda i: F.get(alts, i - 1))


def renumbered(gt: Column, used: Column) -> Column:
    """A genotype text after the unused ALTs are gone; removed alleles become missing, and phase stays as it is."""
    parts, between = F.split(gt, r"[/|]"), F.concat(F.regexp_extract_all(gt, F.lit(r"([/|])"), 1), F.array(F.lit("")))
    at = lambda p: F.array_position(used, p.try_cast("int"))
    place = lambda p: F.when((p == "0") | (p == "."), p).when(at(p) > 0, at(p).cast("string")).otherwise(".")
    return F.array_join(F.zip_with(parts, between, lambda p, b: F.concat(place(p), b)), "")
