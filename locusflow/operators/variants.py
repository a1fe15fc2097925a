"""Tables of variants: joining several sources by position and alleles, counting alleles, pruning samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions import alleles

#: How records of one position pair up across sources.
PAIRING = ("exact", "id", "any", "snps", "indels", "both")


def pair_key(pairing: str) -> Column:
    """What must be equal, besides contig and position, for records to pair. Records of other classes pair exactly."""
    exact = F.concat_ws(">", "ref", F.array_join(F.array_sort("alts"), ","))
    bits = alleles.classes(F.col("ref"), F.col("alts"))
    snp, indel = bits.bitwiseAND(alleles.SNP) != 0, bits.bitwiseAND(alleles.INDEL) != 0
    return {
        "exact": exact,
        "id": F.col("id"),
        "any": F.lit("*"),
        "snps": F.when(snp, "snp").otherwise(exact),
        "indels": F.when(indel, "indel").otherwise(exact),
        "both": F.when(snp, "snp").when(indel, "indel").otherwise(exact),
    }[pairing]


def sync_join(sources: list[DataFrame], pairing: str = "exact") -> DataFrame:
    """A row per position and pairing class with the records of each source, in order of ref and alts.

    One exchange over the union of the sources, whatever their number.
    """
    record = F.struct("ref", F.array_join("alts", ",").alias("alt"), "id")
    tagged = [s.select("contig", "pos", pair_key(pairing).alias("pair"), record.alias("record"), F.lit(i).alias("source")) for i, s in enumerate(sources)]
    per = [F.array_sort(F.collect_list(F.when(F.col("source") == i, F.col("record")))).alias(f"records_{i}") for i in range(len(sources))]
    return reduce(DataFrame.union, tagged).groupBy("contig", "pos", "pair").agg(F.countDistinct("source").alias("n_sources"), *per)


def shares_allele(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of records at one position, with the same ref, that have an ALT in common."""
    r = right.select("contig", "pos", "ref", F.col("alts").alias("r_alts"), F.col("key").alias("r_key"))
    return left.join(r, ["contig", "pos", "ref"]).where(F.arrays_overlap("alts", "r_alts")).select("contig", "pos", "ref", F.col("key").alias("l_key"), "r_key")


def allele_counts(genotypes: DataFrame, keys: list[str], gt: str = "gt") -> DataFrame:
    """AN and AC of ALT 1 and 2 by key from genotype texts."""
    each = genotypes.select(*keys, F.explode(F.split(gt, r"[/|]")).alias("a")).where("a <> '.'")
    return each.groupBy(*keys).agg(F.count("*").alias("an"), F.count_if(F.col("a") == "1").alias("ac1"), F.count_if(F.col("a") == "2").alias("ac2"))


def kept_values(values: Column, used: Column, number: str) -> Column:
    """The values of a field that stay when only the ALTs ``used`` (from 1) do: one value per ALT (A), allele (R) or genotype (G).

    The genotype of alleles a <= b has place b (b + 1) / 2 + a. A field of another length stays as it is null.
    """
    alleles_ = F.concat(F.array(F.lit(0)), used)
    if number == "A":
        return F.transform(used, lambda i: F.get(values, i - 1))
    if number == "R":
        return F.transform(alleles_, lambda i: F.get(values, i))
    place = lambda a, b: (b * (b + 1) / 2 + a).cast("int")
    return F.flatten(F.transform(alleles_, lambda b: F.transform(F.filter(alleles_, lambda a: a <= b), lambda a: F.get(values, place(a, b)))))


def with_field(info: Column, name: str, value: Column, where: Column | None = None) -> Column:
    """INFO (a map) with a value set, or removed by a null; only where a condition holds. A flag's value is ''."""
    rest = F.map_filter(info, lambda k, v: k != name)
    edited = F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))
    return edited if where is None else F.when(where, edited).otherwise(info)


def info_text(info: Column) -> Column:
    """key=value in order of the keys, flags alone; '.' where there is none."""
    entries = F.transform(F.array_sort(F.map_entries(info)), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(info) == 0, ".").otherwise(F.array_join(entries, ";"))


def with_filter(filters: Column, name: str) -> Column:
    """FILTER with one more; PASS goes when another comes, and PASS clears all others."""
    if name == "PASS":
        return F.array(F.lit("PASS"))
    return F.when(F.array_contains(filters, name), filters).otherwise(F.concat(F.filter(filters, lambda f: f != "PASS"), F.array(F.lit(name))))


def samples_kept(calls: Column, names: list[str], wanted: list[str], invert: bool = False) -> Column:
    """The calls of the wanted samples, or of all others, in the header's order; a name that the header lacks is refused."""
    if unknown := [w for w in wanted if w not in names]:
        raise ValueError(f"no such samples: {unknown}")
    return F.array(*[F.get(calls, F.lit(i)) for i, n in enumerate(names) if (n in wanted) != invert])


def spanned(df: DataFrame, mode: str) -> DataFrame:
    """df with beg and end of a record: its position alone ("pos"), its REF ("record"), or what is left of REF behind what all ALTs begin with alike ("variant").

    In the last an insertion lies between two bases: it begins behind its end, and only a region that holds both meets it.
    """
    pos, last = F.col("pos").cast("bigint"), (F.col("pos") + F.length("ref") - 1).cast("bigint")
    alike = F.array_min(F.transform("alts", lambda a: alleles.common_prefix(F.col("ref"), a)))
    beg, end = {"pos": (pos, pos), "record": (pos, last), "variant": (pos + F.coalesce(alike, F.lit(0)), last)}[mode]
    return df.withColumn("beg", beg).withColumn("end", end)
