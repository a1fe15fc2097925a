"""Queries over observations: filters, pileup, statistics, groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from locusflow.functions import stats
from locusflow.operators import pileup, reads
from locusflow.plans import views as v
from locusflow.plans.views import OBS, OBS_RAW

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


FOUR = "CAST(count(*) FILTER (base = ref_base AND strand = '+') AS BIGINT) AS ref_fwd, count(*) FILTER (base = ref_base AND strand = '-') AS ref_rev, count(*) FILTER (base <> ref_base AND strand = '+') AS alt_fwd, count(*) FILTER (base <> ref_base AND strand = '-') AS alt_rev"
DEPTHS = ", ".join(f"count(*) FILTER (base = '{b}') AS depth_{b}" for b in "ACGT")
FISHER = """fisher AS (SELECT *, CASE WHEN p <= 0 THEN 10000.0 ELSE -10 * log10(least(1.0, p)) + 0.0 END AS fs FROM (SELECT t.*,
 (SELECT sum(CASE WHEN q <= own * (1 + 1e-8) THEN q ELSE 0 END) FROM (SELECT exp(fixed - lgamma(k + 1) - lgamma(r1 - k + 1) - lgamma(c1 - k + 1) - lgamma(n - r1 - c1 + k + 1)) AS q FROM (SELECT unnest(range(greatest(0, r1 + c1 - n), least(r1, c1) + 1)) AS k))) AS p
 FROM (SELECT *, exp(fixed - lgamma(ref_fwd + 1) - lgamma(r1 - ref_fwd + 1) - lgamma(c1 - ref_fwd + 1) - lgamma(n - r1 - c1 + ref_fwd + 1)) AS own FROM (SELECT *, lgamma(r1 + 1) + lgamma(n - r1 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1) AS fixed
 FROM (SELECT *, ref_fwd + ref_rev AS r1, ref_fwd + alt_fwd AS c1, ref_fwd + ref_rev + alt_fwd + alt_rev AS n FROM four))) t))"""
SOR = "CASE WHEN ref_rev * alt_fwd > 0 THEN (ref_fwd * alt_rev) / CAST(ref_rev * alt_fwd AS DOUBLE) ELSE 10000.0 END"
P = "(((((({6} * z + {5}) * z + {4}) * z + {3}) * z + {2}) * z + {1}) * z + {0})".format(*(f"CAST({x!r} AS DOUBLE)" for x in stats.P))
Q = "((((((({7} * z + {6}) * z + {5}) * z + {4}) * z + {3}) * z + {2}) * z + {1}) * z + {0})".format(*(f"CAST({x!r} AS DOUBLE)" for x in stats.Q))
#: The upper tail of a normal variable at z >= 0.
TAIL = f"CASE WHEN z > 37 THEN 0.0 WHEN z < 10 / sqrt(2) THEN exp(z * z * -0.5) * {P} / {Q} ELSE exp(z * z * -0.5) / 2.506628274631001 / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) END"


@query("read_filter", f"WITH {OBS_RAW} SELECT contig, pos, sample_idx, base, qual, mapq, strand, flag, l_orderkey, l_linenumber FROM obs_raw WHERE mapq >= 10 AND NOT (flag & 1024 <> 0 AND flag & 4 = 0) AND NOT (flag & 512 <> 0 AND flag & 4 = 0)")
def read_filter(spark, sf):
    return reads.passing(v.obs_raw(spark, sf), 10).select("contig", "pos", "sample_idx", "base", "qual", "mapq", "strand", "flag", "ord.l_orderkey", "ord.l_linenumber")


@query("flag_predicates", f"WITH {OBS_RAW} SELECT flag, count(*) AS n, flag & 16 <> 0 AS reverse, flag & 1024 <> 0 AS dup, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, concat_ws(',', CASE WHEN flag & 16 <> 0 THEN 'REVERSE' END, CASE WHEN flag & 1024 <> 0 THEN 'DUP' END) AS names, flag AS number FROM obs_raw GROUP BY flag")
def flag_predicates(spark, sf):
    f = F.col("flag")
    counted = v.obs_raw(spark, sf).groupBy("flag").agg(F.count("*").alias("n"))
    named = counted.select("flag", "n", reads.has(f, "reverse").alias("reverse"), reads.is_duplicate(f).alias("dup"), reads.strand(f).alias("strand"), reads.flag_names(f).alias("names"))
    return named.withColumn("number", reads.flag_number(F.col("names")))


@query("obs_first_wins", f"WITH {OBS} SELECT contig, pos, sample_idx, base, qual, mapq, strand, rank, flag, ref_base FROM obs")
def obs_first_wins(spark, sf):
    return v.obs(spark, sf)


@query("base_depth", f"WITH {OBS} SELECT contig, pos, ref_base, count(*) AS covered, {DEPTHS}, '.' AS indels FROM obs GROUP BY contig, pos, ref_base")
def base_depth(spark, sf):
    return pileup.base_depth(v.obs(spark, sf))


@query(
    "indel_depth",
    f"""WITH {OBS}, named AS (SELECT contig, pos, ref_base, CASE WHEN rank % 9 = 0 THEN '+' || ref_base || base WHEN rank % 9 = 1 THEN '-' || ref_base || base WHEN rank % 9 = 2 THEN 'N' ELSE base END AS base FROM obs),
 counts AS (SELECT contig, pos, ref_base, base, count(*) AS n FROM named GROUP BY ALL)
 SELECT contig, pos, ref_base, CAST(sum(CASE WHEN base <> 'N' THEN n ELSE 0 END) AS BIGINT) AS covered, {", ".join(f"CAST(coalesce(sum(n) FILTER (base = '{b}'), 0) AS BIGINT) AS depth_{b}" for b in "ACGT")},
 coalesce(string_agg(base || '|' || n, ',' ORDER BY base || '|' || n) FILTER (base NOT IN ('A', 'C', 'G', 'T', 'N')), '.') AS indels FROM counts GROUP BY contig, pos, ref_base""",
)
def indel_depth(spark, sf):
    r, both = F.col("rank") % 9, F.concat("ref_base", "base")
    named = F.when(r == 0, F.concat(F.lit("+"), both)).when(r == 1, F.concat(F.lit("-"), both)).when(r == 2, "N").otherwise(F.col("base"))
    return pileup.base_depth(v.obs(spark, sf).withColumn("base", named))


@query(
    "coverage_report",
    f"""WITH {OBS}, four AS (SELECT contig, pos, ref_base, count(*) AS depth, count(*) AS covered, {DEPTHS}, {FOUR} FROM obs GROUP BY contig, pos, ref_base), {FISHER}
 SELECT contig, pos, ref_base, covered, depth_A, depth_C, depth_G, depth_T, '.' AS indels, depth, ref_fwd, ref_rev, alt_fwd, alt_rev, round(fs, 5) AS fs, round({SOR}, 6) AS sor FROM fisher""",
)
def coverage_report(spark, sf):
    return pileup.coverage(v.obs(spark, sf)).withColumn("fs", F.round("fs", 5)).withColumn("sor", F.round("sor", 6))


@query("coverage_by_group", f"WITH {OBS}, {v.GROUPS} SELECT contig, pos, ref_base, \"group\", count(*) AS covered, {DEPTHS} FROM obs JOIN groups USING (sample_idx) GROUP BY ALL")
def coverage_by_group(spark, sf):
    joined = v.obs(spark, sf).join(v.groups(spark, sf), "sample_idx")
    return joined.groupBy("contig", "pos", "ref_base", "group").agg(F.count("*").alias("covered"), *[F.count_if(F.col("base") == b).alias(f"depth_{b}") for b in pileup.BASES])


@query("strand_bias", f"WITH {OBS}, four AS (SELECT contig, pos, ref_base, count(*) AS depth, {FOUR} FROM obs GROUP BY contig, pos, ref_base), {FISHER} SELECT contig, pos, ref_fwd, ref_rev, alt_fwd, alt_rev, round(fs, 5) AS fs, round({SOR}, 6) AS sor FROM fisher")
def strand_bias(spark, sf):
    four = [F.col(c) for c in ("ref_fwd", "ref_rev", "alt_fwd", "alt_rev")]
    return pileup.strand_counts(v.obs(spark, sf)).select("contig", "pos", *four, F.round(stats.fisher_phred(*four), 5).alias("fs"), F.round(stats.odds_ratio(*four), 6).alias("sor"))


def _ranksum_sql(value: str) -> str:
    return f"""WITH {OBS}, ranked AS (SELECT contig, pos, base = ref_base AS is_ref, rank() OVER (PARTITION BY contig, pos ORDER BY {value} DESC) + (count(*) OVER (PARTITION BY contig, pos, {value}) - 1) / 2.0 AS r FROM obs),
 sums AS (SELECT contig, pos, CAST(count(*) FILTER (is_ref) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT is_ref) AS DOUBLE) AS n2, sum(CASE WHEN is_ref THEN CAST(r AS DOUBLE) ELSE 0 END) AS r1 FROM ranked GROUP BY contig, pos),
 zs AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN abs(r1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) END AS z FROM sums),
 ps AS (SELECT *, 2 * CASE WHEN z = 0 THEN 1 - ({TAIL}) ELSE {TAIL} END AS p FROM zs)
 SELECT contig, pos, n1, n2, round(CASE WHEN p IS NULL OR p <= 0 THEN 10000.0 ELSE -10 * log10(p) + 0.0 END, 5) AS phred FROM ps"""


def _ranksum(value: str):
    return lambda spark, sf: pileup.ranksum(v.obs(spark, sf), value).withColumn("phred", F.round("phred", 5))


for _value in ("mapq", "rank", "qual"):
    query(f"ranksum_{_value}", _ranksum_sql(_value))(_ranksum(_value))


@query("chi2_tail", f"WITH x AS (SELECT DISTINCT l_quantity - 3 AS x FROM lineitem), zs AS (SELECT x, CASE WHEN x > 0 THEN sqrt(x) END AS z FROM x) SELECT x, round(CASE WHEN x > 0 THEN 2 * ({TAIL}) ELSE 1.0 END, 9) AS p, round(CASE WHEN x > 0 THEN -10 * log10(2 * ({TAIL})) ELSE 0.0 END, 6) AS phred FROM zs")
def chi2_tail(spark, sf):
    x = v.table(spark, sf, "lineitem").select((F.col("l_quantity") - 3).alias("x")).distinct()
    p = stats.chi2_tail(F.col("x"))
    return x.select("x", F.round(p, 9).alias("p"), F.round(stats.phred(p), 6).alias("phred"))


@query("phred_error", f"WITH {OBS} SELECT contig, pos, round(sum(exp(-qual * ln(10) / 10)), 6) AS expected_errors, round(avg(CAST(qual AS DOUBLE)), 6) AS mean_qual FROM obs GROUP BY contig, pos")
def phred_error(spark, sf):
    return v.obs(spark, sf).groupBy("contig", "pos").agg(F.round(F.sum(stats.error_of(F.col("qual"))), 6).alias("expected_errors"), F.round(F.avg("qual"), 6).alias("mean_qual"))


@query("pileup_arrays", f"WITH {OBS} SELECT contig, pos, count(*) AS n, string_agg(base, '' ORDER BY sample_idx) AS bases, string_agg(strand, '' ORDER BY sample_idx) AS strands, string_agg(CAST(mapq AS VARCHAR), ' ' ORDER BY sample_idx) AS mapqs FROM obs GROUP BY contig, pos")
def pileup_arrays(spark, sf):
    part = lambda name, sep: F.array_join(F.transform("observations", lambda o: o[name].cast("string")), sep)
    return pileup.collected(v.obs(spark, sf)).select("contig", "pos", F.size("observations").cast("bigint").alias("n"), part("base", "").alias("bases"), part("strand", "").alias("strands"), part("mapq", " ").alias("mapqs"))


@query("depth_capped", f"WITH {OBS_RAW} SELECT contig, pos, sample_idx, base, qual FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY l_shipdate, l_orderkey, l_linenumber, sample_idx) AS rn FROM obs_raw) WHERE rn <= 8")
def depth_capped(spark, sf):
    w = Window.partitionBy("contig", "pos").orderBy("ord", "sample_idx")
    return v.obs_raw(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("contig", "pos", "sample_idx", "base", "qual")


@query("count_alleles", f"WITH {OBS} SELECT contig, pos, sum(CASE WHEN base <> ref_base THEN 1 ELSE 0 END)::BIGINT AS alt_depth, count(*) AS depth, round(sum(CASE WHEN base <> ref_base THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS caf FROM obs GROUP BY contig, pos HAVING sum(CASE WHEN base <> ref_base THEN 1 ELSE 0 END) / count(*)::DOUBLE >= 0.01")
def count_alleles(spark, sf):
    alt = F.count_if(F.col("base") != F.col("ref_base"))
    return v.obs(spark, sf).groupBy("contig", "pos").agg(alt.alias("alt_depth"), F.count("*").alias("depth"), F.round(alt / F.count("*"), 6).alias("caf")).where("alt_depth / depth >= 0.01")


@query("index_statistics", f"WITH {OBS_RAW} SELECT contig, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 <> 0) AS unmapped, count(*) FILTER (flag & 1024 <> 0) AS duplicates, min(pos) AS first_pos, max(pos) AS last_pos FROM obs_raw GROUP BY contig")
def index_statistics(spark, sf):
    f = F.col("flag")
    return v.obs_raw(spark, sf).groupBy("contig").agg(F.count_if(reads.is_mapped(f)).alias("mapped"), F.count_if(~reads.is_mapped(f)).alias("unmapped"), F.count_if(reads.is_duplicate(f)).alias("duplicates"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
