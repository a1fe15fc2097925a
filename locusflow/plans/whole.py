"""Queries over intervals and sites that need geometry of their own.

Intervals here have gaps and targets spread over the whole key range of part, so that semi joins, anti joins and merges
have something to decide without leaving intervals out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from locusflow.functions import stats
from locusflow.operators import caller
from locusflow.operators import intervals as iv
from locusflow.plans import calls
from locusflow.plans import views as v
from locusflow.plans.views import OBS

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


GAPPED = """intervals AS (SELECT p_partkey AS id, 'c' || CAST(p_partkey % 5 AS VARCHAR) AS contig, CAST(p_partkey + 1 + p_size % 7 AS BIGINT) AS beg, CAST(p_partkey + 1 + p_size % 7 + p_size % 9 AS BIGINT) AS "end" FROM part)"""
SPREAD = """targets AS (SELECT c_custkey AS tid, 'c' || CAST(c_custkey % 5 AS VARCHAR) AS contig, CAST(c_custkey * 4 // 3 AS BIGINT) AS beg, CAST(c_custkey * 4 // 3 + c_custkey % 4 AS BIGINT) AS "end" FROM customer)"""
MEETS = 't.contig = i.contig AND t.beg <= i."end" AND t."end" >= i.beg'


def gapped(spark, sf):
    """Closed intervals, one per part: 0 to 6 bases behind its site and 1 to 9 bases long, sites being 5 bases apart."""
    beg = (F.col("p_partkey") + 1 + F.col("p_size") % 7).cast("bigint")
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")).alias("contig"), beg.alias("beg"), (beg + F.col("p_size") % 9).alias("end"))


def spread(spark, sf):
    """Closed intervals of 1 to 4 bases, one per customer; there are four parts for three customers."""
    c = F.col("c_custkey")
    beg = F.floor(c * 4 / 3).cast("bigint")
    return v.table(spark, sf, "customer").select(c.alias("tid"), F.concat(F.lit("c"), (c % 5).cast("string")).alias("contig"), beg.alias("beg"), (beg + c % 4).alias("end"))


def _points(spark, sf):
    """The sites, as intervals of one base."""
    at = F.col("pos").cast("bigint")
    return v.obs(spark, sf).select("contig", "pos").distinct().select(F.struct("contig", "pos").alias("site"), "contig", at.alias("beg"), at.alias("end"))


@query("genotypes")
def genotypes(spark, sf):
    """Genotype, base and strand of every observation; an ALT is known by its place in the site's call."""
    obs = v.obs(spark, sf)
    return caller.genotypes(obs, caller.call(obs)).select("contig", "pos", "sample_idx", F.concat_ws(":", "gt", "base", "strand").alias("gt"))


@query("freq_neighbours", """WITH f AS (SELECT p_partkey AS key, p_retailprice AS freq FROM part) SELECT a.key, count(*) AS neighbours, count(*) FILTER (b.freq <= a.freq) AS below, round(count(*) FILTER (b.freq <= a.freq) / CAST(count(*) AS DOUBLE), 6) AS pct FROM f a JOIN f b ON b.freq BETWEEN 0.9 * a.freq AND 1.1 * a.freq GROUP BY a.key""")
def freq_neighbours(spark, sf):
    return calls.neighbours(v.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("freq")))


@query("overlap_semi", f'WITH {GAPPED}, {SPREAD} SELECT * FROM targets t WHERE EXISTS (SELECT 1 FROM intervals i WHERE {MEETS})')
def overlap_semi(spark, sf):
    return iv.overlapping(spread(spark, sf), gapped(spark, sf), "tid")


@query("overlap_anti", f'WITH {GAPPED}, {SPREAD} SELECT * FROM targets t WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE {MEETS})')
def overlap_anti(spark, sf):
    return iv.overlapping(spread(spark, sf), gapped(spark, sf), "tid", keep=False)


@query("missed_regions", f'WITH {GAPPED}, {OBS} SELECT * FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.contig = i.contig AND o.pos BETWEEN i.beg AND i."end")')
def missed_regions(spark, sf):
    return iv.overlapping(gapped(spark, sf), _points(spark, sf), "id", keep=False)


@query("site_except", f'WITH {GAPPED}, {OBS} SELECT DISTINCT contig, pos FROM obs o WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE o.contig = i.contig AND o.pos BETWEEN i.beg AND i."end")')
def site_except(spark, sf):
    return iv.overlapping(_points(spark, sf), gapped(spark, sf), "site", keep=False).select("site.contig", "site.pos")


@query("merge_intervals", f"""WITH {GAPPED}, flagged AS (SELECT *, CASE WHEN beg <= 1 + max("end") OVER (PARTITION BY contig ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM intervals),
 islands AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS island FROM flagged) SELECT contig, min(beg) AS beg, max("end") AS "end", count(*) AS n FROM islands GROUP BY contig, island""")
def merge_intervals(spark, sf):
    return iv.merge(gapped(spark, sf))


@query("base_composition", "SELECT doc_id, length(coalesce(text, '')) - length(replace(lower(coalesce(text, '')), 'g', '')) AS n_g, length(coalesce(text, '')) - length(replace(lower(coalesce(text, '')), 'c', '')) AS n_c FROM documents")
def base_composition(spark, sf):
    return calls.composition(v.table(spark, sf, "documents"))


MOST = 20


@query("sampled_neighbours", f"""WITH f AS (SELECT p_partkey AS key, CAST((p_partkey + 1) * (p_partkey + 1) AS DOUBLE) AS freq FROM part), n AS (SELECT a.key, count(*) AS n, sum(b.key) AS total FROM f a JOIN f b ON b.freq BETWEEN 0.9 * a.freq AND 1.1 * a.freq GROUP BY a.key)
 SELECT key, n, least(n, {MOST}) AS taken, least(n, {MOST}) AS distinct_taken, least(n, {MOST}) AS near, CASE WHEN n <= {MOST} THEN CAST(total AS BIGINT) END AS total FROM n""")
def sampled_neighbours(spark, sf):
    """At most MOST neighbours in frequency of every site; the sum of their keys where all are taken."""
    k = F.col("p_partkey")
    f = v.table(spark, sf, "part").select(k.alias("key"), ((k + 1) * (k + 1)).cast("double").alias("freq"))
    drawn = calls.sampled_neighbours(f, MOST)
    near = F.count_if(F.col("neighbour_freq").between(F.col("freq") * 0.9, F.col("freq") * 1.1))
    per = drawn.groupBy("key", "n").agg(F.count("*").alias("taken"), F.countDistinct("neighbour").alias("distinct_taken"), near.alias("near"), F.sum("neighbour").alias("total"))
    return per.withColumn("total", F.when(F.col("n") <= MOST, F.col("total")))


@query("chi_squared_tails", "SELECT DISTINCT l_quantity AS x, round(exp(-l_quantity / 2), 9) AS p2, round(exp(-l_quantity / 2) * (1 + l_quantity / 2), 9) AS p4, round(exp(-l_quantity / 2) * (1 + l_quantity / 2 + l_quantity * l_quantity / 8), 9) AS p6 FROM lineitem")
def chi_squared_tails(spark, sf):
    """Chances that a chi-squared value of 2, 4 and 6 degrees of freedom exceeds each quantity."""
    x = v.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x")).distinct()
    return x.select("x", *[F.round(stats.chi_squared_tail(F.col("x"), F.lit(n)), 9).alias(f"p{n}") for n in (2, 4, 6)])


@query("reversed_targets", f'WITH {GAPPED}, turned AS (SELECT c_custkey AS tid, \'c\' || CAST(c_custkey % 5 AS VARCHAR) AS contig, CAST(c_custkey + c_custkey % 7 AS BIGINT) AS a, CAST(c_custkey + c_custkey % 11 AS BIGINT) AS b FROM customer), targets AS (SELECT tid, contig, least(a, b) AS beg, greatest(a, b) AS "end" FROM turned) SELECT * FROM targets t WHERE EXISTS (SELECT 1 FROM intervals i WHERE {MEETS})')
def reversed_targets(spark, sf):
    """Targets some of which end before they begin, turned round and then met with intervals."""
    c = F.col("c_custkey")
    turned = v.table(spark, sf, "customer").select(c.alias("tid"), F.concat(F.lit("c"), (c % 5).cast("string")).alias("contig"), (c + c % 7).alias("beg"), (c + c % 11).alias("end"))
    return iv.overlapping(iv.normalised(turned), gapped(spark, sf), "tid").select("tid", "contig", "beg", "end")
