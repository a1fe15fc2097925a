"""Queries that write variant files and read them back with the types of their headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusflow.functions import alleles
from locusflow.operators import report
from locusflow.plans import views as v
from locusflow.plans.views import VARIANTS
from locusflow.sources import files, text, typed_vcf

QUERIES, ORACLE = {}, {}
HEADER = text.vcf_header("\n".join([
    '##FILTER=<ID=q10,Description="low">', '##FILTER=<ID=LowQual,Description="low">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">', '##INFO=<ID=AF,Number=A,Type=Float,Description="share of each ALT">',
    '##INFO=<ID=DB,Number=0,Type=Flag,Description="known">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="depth of each allele">',
    *[f"##contig=<ID=c{i},length=1000000>" for i in range(4)], "\t".join([*typed_vcf.FIXED, "FORMAT", "s1", "s2"]),
]))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query(
    "typed_variants",
    f"""WITH {VARIANTS}, s AS (SELECT key, CAST(p_size AS BIGINT) AS dp FROM variants JOIN part ON p_partkey = key)
 SELECT v.key, v.contig, pos, array_to_string(alts, ',') AS alts, CASE WHEN v.key % 7 <> 0 THEN dp END AS dp, CASE WHEN v.key % 7 = 0 THEN 'INFO DP isn''t Integer' ELSE '' END || CASE WHEN v.contig = 'c4' THEN 'contig c4 isn''t declared' ELSE '' END AS faults,
  list_sum(list_transform(range(1, len(alts) + 1), lambda i: dp / (4.0 * i))) AS af, v.key % 2 = 0 AS db, CASE WHEN v.key % 3 = 0 THEN NULL ELSE '0/1' END AS gt_2, dp + len(alts) AS ad_1, v.key AS other FROM variants v JOIN s ON s.key = v.key""",
)
def typed_variants(spark, sf):
    """A file of every variant, written as text and read back: fields, flags, arrays, missing values, and what isn't as declared."""
    rows = v.variants(spark, sf).join(v.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("bigint").alias("dp")), "key")
    shares = F.transform("alts", lambda a, i: F.col("dp") / (4.0 * (i + 1)))
    depths = F.concat(F.array(F.col("dp")), F.transform("alts", lambda a: F.lit(1).cast("bigint")))
    call = lambda gt: F.struct(gt.alias("GT"), depths.alias("AD"))
    info = F.struct(F.col("dp").alias("DP"), shares.alias("AF"), (F.col("key") % 2 == 0).alias("DB"))
    rows = rows.withColumns({"qual": F.lit(30.5), "info": info, "calls": F.array(call(F.lit("0/0")), call(F.when(F.col("key") % 3 != 0, "0/1"))), "other_info": F.create_map(F.lit("KEY"), F.col("key").cast("string"))})
    written = typed_vcf.lines(rows, HEADER).withColumn("line", F.when(F.regexp_extract("line", r"KEY=(\d+)", 1).cast("bigint") % 7 == 0, F.regexp_replace("line", r"DP=\d+", "DP=x")).otherwise(F.col("line")))
    path = files.scratch(spark, "variants")
    report.write(written, typed_vcf.header_lines(HEADER), path, [f"c{i}" for i in range(5)])
    back = typed_vcf.typed(text.vcf(spark, path), HEADER)
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    said = F.array_join(F.array_sort(F.filter("faults", lambda x: ~x.startswith("INFO KEY"))), "")
    ad = F.aggregate(F.get("calls", F.lit(0))["AD"], F.lit(0).cast("bigint"), lambda s, x: s + x)
    return back.select(F.col("other_info")["KEY"].cast("bigint").alias("key"), "contig", "pos", F.array_join("alts", ",").alias("alts"), F.col("info.DP").alias("dp"), said.alias("faults"), add("info.AF").alias("af"), F.col("info.DB").alias("db"), F.get("calls", F.lit(1))["GT"].alias("gt_2"), ad.alias("ad_1"), F.col("other_info")["KEY"].cast("bigint").alias("other"))


_GTS = "[CASE key % 4 WHEN 0 THEN '0/1' WHEN 1 THEN '0|2' WHEN 2 THEN '2/2' ELSE './0' END, CASE key % 5 WHEN 0 THEN '0/0' WHEN 1 THEN '0|1' WHEN 2 THEN './.' ELSE '0/2' END]"


@query(
    "renumbered_genotypes",
    f"""WITH {VARIANTS}, g AS (SELECT key, alts, list_transform({_GTS}, lambda x: replace(x, '2', CAST(len(alts) AS VARCHAR))) AS gts FROM variants),
 u AS (SELECT *, array_to_string(gts, ' ') LIKE '%1%' AS one, array_to_string(gts, ' ') LIKE '%2%' AS two FROM g)
 SELECT key, array_to_string(list_concat(CASE WHEN one THEN [alts[1]] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN two THEN [alts[2]] ELSE CAST([] AS VARCHAR[]) END), ',') AS alts, array_to_string(list_transform(gts, lambda x: CASE WHEN one THEN x ELSE replace(x, '2', '1') END), ' ') AS gts FROM u""",
)
def renumbered_genotypes(spark, sf):
    """ALTs that no genotype has are taken out, and genotypes numbered anew."""
    k, n = F.col("key"), F.size("alts")
    one = F.when(k % 4 == 0, "0/1").when(k % 4 == 1, "0|2").when(k % 4 == 2, "2/2").otherwise("./0")
    two = F.when(k % 5 == 0, "0/0").when(k % 5 == 1, "0|1").when(k % 5 == 2, "./.").otherwise("0/2")
    rows = v.variants(spark, sf).select("key", "alts", *[F.replace(g, F.lit("2"), n.cast("string")).alias(c) for c, g in (("one", one), ("two", two))])
    rows = rows.withColumn("used", alleles.used_alleles(F.array("one", "two"), n))
    return rows.select("key", F.array_join(alleles.trimmed(F.col("alts"), F.col("used")), ",").alias("alts"), F.concat_ws(" ", alleles.renumbered(F.col("one"), F.col("used")), alleles.renumbered(F.col("two"), F.col("used"))).alias("gts"))
