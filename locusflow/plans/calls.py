"""Queries over the site model, and smaller reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from locusflow.functions import stats
from locusflow.operators import caller, pileup, report
from locusflow.operators import intervals as iv
from locusflow.plans import views as v
from locusflow.plans.views import OBS, READS, VARIANTS

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_STEP = "list_transform([1, 2, 3, 4], lambda j: list_sum(list_transform(cl, lambda c: c.n * c.l[j] * {f}[j] / (c.l[1] * {f}[1] + c.l[2] * {f}[2] + c.l[3] * {f}[3] + c.l[4] * {f}[4]))) / total)"
_LOG = "ln(c.l[1] * {f}[1] + c.l[2] * {f}[2] + c.l[3] * {f}[3] + c.l[4] * {f}[4])"


@query(
    "em_frequencies",
    f"""WITH RECURSIVE {OBS}, classes AS (SELECT contig, pos, ref_base, base, qual, count(*) AS n, exp(-qual * ln(10) / 10) AS e FROM obs GROUP BY ALL),
 sites AS (SELECT contig, pos, ref_base, list({{'n': CAST(n AS DOUBLE), 'l': [CASE WHEN base = 'A' THEN 1 - e ELSE e / 3 END, CASE WHEN base = 'C' THEN 1 - e ELSE e / 3 END, CASE WHEN base = 'G' THEN 1 - e ELSE e / 3 END, CASE WHEN base = 'T' THEN 1 - e ELSE e / 3 END]}} ORDER BY base, qual) AS cl,
  CAST(sum(n) AS DOUBLE) AS total, [{", ".join(f"coalesce(sum(n) FILTER (base = '{b}'), 0) / CAST(sum(n) AS DOUBLE)" for b in "ACGT")}] AS f0 FROM classes GROUP BY contig, pos, ref_base),
 em AS (SELECT contig, pos, ref_base, cl, total, 0 AS it, f0 AS p, {_STEP.format(f="f0")} AS f, false AS done FROM sites
  UNION ALL SELECT contig, pos, ref_base, cl, total, it + 1, f, {_STEP.format(f="f")}, list_sum(list_transform(cl, lambda c: c.n * abs({_LOG.format(f="f")} - {_LOG.format(f="p")}))) < 0.001 FROM em WHERE NOT done AND it < 100),
 ends AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY it DESC) AS rn FROM em)
 SELECT contig, pos, ref_base, round(f[1], 5) AS af_A, round(f[2], 5) AS af_C, round(f[3], 5) AS af_G, round(f[4], 5) AS af_T, round(list_sum(list_transform(cl, lambda c: c.n * {_LOG.format(f="p")})), 3) AS loglike FROM ends WHERE rn = 1""",
)
def em_frequencies(spark, sf):
    out = caller.frequencies(v.obs(spark, sf))
    return out.select("contig", "pos", "ref_base", *[F.round(f"af_{b}", 5).alias(f"af_{b}") for b in "ACGT"], F.round("loglike", 3).alias("loglike"))


@query("site_calls")
def site_calls(spark, sf):
    """Variant calls with filter, count-based shares and quality by depth."""
    calls = caller.call(v.obs(spark, sf))
    qd = F.col("qual") / F.aggregate("acs", F.lit(0.0), lambda s, n: s + n)
    return calls.select("contig", "pos", "ref_base", "alts", "afs", "acs", "cafs", "dp", "qual", F.when(F.col("qual") > caller.LOW_QUAL, ".").otherwise("LowQual").alias("filter"), qd.alias("qd"))


@query("site_calls_by_group")
def site_calls_by_group(spark, sf):
    """The called alleles' frequencies by region."""
    obs = v.obs(spark, sf)
    return caller.call_groups(obs, caller.call(obs), v.groups(spark, sf)).select("contig", "pos", "group", "ref_base", "alts", "afs", "dp")


@query("site_info")
def site_info(spark, sf):
    """The calls with strand bias and the three rank sums of the called alleles."""
    obs = v.obs(spark, sf)
    return caller.info(obs, caller.call(obs))


@query("vcf_lines")
def vcf_lines(spark, sf):
    """The variant file's lines: INFO with the groups' frequencies, and a column for each sample that some position has."""
    obs = v.obs(spark, sf)
    calls = caller.call(obs)
    return report.variant_lines(obs, calls, v.groups(spark, sf), v.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("sample_idx")))


def ranked_bounds(f):
    """key, freq, rank (how many values are smaller or come before), low, own and high: how many values lie below a tenth less, up to it, and up to a tenth more.

    All follow from the ranks of the bounds: a union of values and bounds is sorted once by a range window, and no pairs
    are made.
    """
    # A value counts before the bounds at it, but for the lower bound, which looks at smaller values alone.
    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("at"), F.lit(o).alias("o"), F.lit(n).alias("one")) for k, x, o, n in (("value", F.col("freq"), 1, 1), ("low", F.col("freq") * 0.9, 0, 0), ("own", F.col("freq") * 1.0, 2, 0), ("high", F.col("freq") * 1.1, 2, 0))]))
    rows = f.select("key", marks.alias("m")).select("key", "m.*")
    # Buckets keep the running count from one task: counts of earlier buckets are added. They are as wide as a hundredth
    # of what is in them, whatever the scale of the values.
    bucket = F.when(F.col("at") > 0, F.floor(F.log("at") * 100)).otherwise(F.lit(-(1 << 40)))
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("bucket").agg(F.sum("one").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    run = F.sum("one").over(Window.partitionBy("bucket").orderBy("at", "o", "key").rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumn("run", run).join(before, "bucket").withColumn("upto", F.col("run") + F.col("before"))
    return ranked.groupBy("key").agg(F.max(F.when(F.col("kind") == "own", F.col("at"))).alias("freq"), *[F.max(F.when(F.col("kind") == k, F.col("upto"))).alias(n) for k, n in (("value", "rank"), ("low", "low"), ("own", "own"), ("high", "high"))])


def neighbours(f):
    """(key, freq): how many rows have a frequency within a tenth of each one's, and how many of those aren't larger."""
    n, below = F.col("high") - F.col("low"), F.col("own") - F.col("low")
    return ranked_bounds(f).select("key", n.alias("neighbours"), below.alias("below"), F.round(below / n, 6).alias("pct"))


def sampled_neighbours(f, most: int, seed: int = 0):
    """key, freq, n and the key and freq of each neighbour within a tenth of a row's frequency, at most ``most`` of them.

    Up to ``most``, all are taken; beyond, one is drawn from each of ``most`` equal shares of their ranks by a hash of
    the key, so that none comes twice and reruns agree. A row is joined to what it draws alone.
    """
    ranked = ranked_bounds(f)
    n = (F.col("high") - F.col("low")).cast("bigint")
    lo = lambda j: F.floor(j * F.col("n") / most)
    drawn = lambda j: lo(j) + F.pmod(F.xxhash64(F.lit(seed), "key", j), lo(j + 1) - lo(j))
    places = F.when(F.col("n") <= most, F.transform(F.sequence(F.lit(1).cast("bigint"), "n"), lambda i: F.col("low") + i)).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint")), lambda j: F.col("low") + 1 + drawn(j)))
    asked = ranked.withColumn("n", n).select("key", "freq", "n", F.explode(places).alias("rank")).withColumn("rank", F.col("rank").cast("bigint"))
    # The values under their ranks, from 1.
    values = ranked.select(F.col("rank").cast("bigint").alias("rank"), F.col("key").alias("neighbour"), F.col("freq").alias("neighbour_freq"))
    return asked.join(values, "rank").drop("rank")


@query("trend_test", f"""WITH {OBS}, c AS (SELECT contig, pos, {", ".join(f"CAST(count(*) FILTER (sample_idx % 3 = {i} AND base <> ref_base) AS DOUBLE) AS c{i}, CAST(count(*) FILTER (sample_idx % 3 = {i}) AS DOUBLE) AS n{i}" for i in range(3))} FROM obs GROUP BY contig, pos),
 q AS (SELECT *, n0 + n1 + n2 AS n, (c0 + c1 + c2) / (n0 + n1 + n2) AS p FROM c), t AS (SELECT *, (c0 - n0 * p) + 2 * (c1 - n1 * p) + 3 * (c2 - n2 * p) AS t, (n0 + 2 * n1 + 3 * n2) / n AS m FROM q), w AS (SELECT *, p * (1 - p) * (n0 + 4 * n1 + 9 * n2 - n * m * m) AS var FROM t)
 SELECT contig, pos, round(CASE WHEN var > 1e-9 THEN t * t / var END, 6) AS chi FROM w""")
def trend_test(spark, sf):
    third, alt = F.col("sample_idx") % 3, F.col("base") != F.col("ref_base")
    per = v.obs(spark, sf).groupBy("contig", "pos").agg(*[F.count_if((third == i) & alt).cast("double").alias(f"c{i}") for i in range(3)], *[F.count_if(third == i).cast("double").alias(f"n{i}") for i in range(3)])
    chi = stats.trend([F.col(f"c{i}") for i in range(3)], [F.col(f"n{i}") for i in range(3)])
    flat = (F.col("c0") + F.col("c1") + F.col("c2") == 0) | (F.col("c0") + F.col("c1") + F.col("c2") == F.col("n0") + F.col("n1") + F.col("n2")) | (F.greatest("n0", "n1", "n2") == F.col("n0") + F.col("n1") + F.col("n2"))
    return per.select("contig", "pos", F.round(F.when(~flat, chi), 6).alias("chi"))


@query("log_histogram", "SELECT CAST(least(99, floor(log10(l_extendedprice) * 20)) AS BIGINT) AS x, CAST(floor(log10(l_quantity) * 20) AS BIGINT) AS y, count(*) AS n FROM lineitem WHERE l_extendedprice + l_quantity > 0 AND l_discount < 1 GROUP BY ALL")
def log_histogram(spark, sf):
    line = v.table(spark, sf, "lineitem").where("l_extendedprice + l_quantity > 0 AND l_discount < 1")
    return line.groupBy(F.least(F.lit(99).cast("bigint"), F.floor(F.log10("l_extendedprice") * 20)).alias("x"), F.floor(F.log10("l_quantity") * 20).alias("y")).agg(F.count("*").alias("n"))


@query("duplicate_values", f"WITH {READS} SELECT cigar, count(*) AS n FROM reads GROUP BY cigar HAVING count(*) > 1")
def duplicate_values(spark, sf):
    return v.reads(spark, sf).groupBy("cigar").agg(F.count("*").alias("n")).where("n > 1")


def composition(docs):
    t = F.coalesce("text", F.lit(""))
    n = lambda b: (F.length(t) - F.length(F.replace(F.lower(t), F.lit(b)))).cast("bigint")
    return docs.select("doc_id", n("g").alias("n_g"), n("c").alias("n_c"))


@query("concat_outputs", f"WITH {OBS} SELECT 0 AS part, contig, pos, count(*) AS depth FROM obs WHERE contig IN ('c0', 'c1') GROUP BY contig, pos UNION ALL SELECT 1, contig, pos, count(*) FROM obs WHERE contig NOT IN ('c0', 'c1') GROUP BY contig, pos")
def concat_outputs(spark, sf):
    """Outputs of two runs under each other, the part kept as the order."""
    obs = v.obs(spark, sf)
    part = lambda i, rows: rows.groupBy("contig", "pos").agg(F.count("*").alias("depth")).withColumn("part", F.lit(i))
    first = F.col("contig").isin("c0", "c1")
    return part(0, obs.where(first)).unionByName(part(1, obs.where(~first)))


@query("sample_intersection", "SELECT DISTINCT l_suppkey AS sample FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 40")
def sample_intersection(spark, sf):
    line = v.table(spark, sf, "lineitem")
    return line.where("l_linenumber = 1").select(F.col("l_suppkey").alias("sample")).intersect(line.where("l_linenumber = 7 AND l_quantity > 40").select("l_suppkey"))


@query("split_reads", f"WITH {READS} SELECT CASE WHEN flag & 2 <> 0 THEN 2 ELSE 1 END AS part, contig, count(*) AS n, min(qname) AS first FROM reads GROUP BY ALL")
def split_reads(spark, sf):
    return v.reads(spark, sf).groupBy(F.when(F.col("flag").bitwiseAND(2) != 0, 2).otherwise(1).alias("part"), "contig").agg(F.count("*").alias("n"), F.min("qname").alias("first"))


@query("site_annotation", f"WITH {VARIANTS} SELECT key, contig, pos, array_to_string(alts, ',') AS alts, r_name AS dm FROM variants LEFT JOIN region ON key % 9 = r_regionkey")
def site_annotation(spark, sf):
    return v.variants(spark, sf).join(v.table(spark, sf, "region"), F.col("key") % 9 == F.col("r_regionkey"), "left").select("key", "contig", "pos", F.array_join("alts", ",").alias("alts"), F.col("r_name").alias("dm"))


@query("digests", "SELECT page_id, md5(html) AS md5, base64(encode(url)) AS url64 FROM pages")
def digests(spark, sf):
    """Sums of pages, and their addresses in base 64 on one line: Spark breaks it after 76 characters."""
    return v.table(spark, sf, "pages").select("page_id", F.md5("html").alias("md5"), F.translate(F.base64(F.encode("url", "utf-8")), "\r\n", "").alias("url64"))


@query("json_values", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_values(spark, sf):
    return v.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"))


@query("contig_order", f"WITH {OBS} SELECT contig, pos, depth, row_number() OVER (ORDER BY contig DESC, pos) AS nth FROM (SELECT contig, pos, count(*) AS depth FROM obs GROUP BY contig, pos)")
def contig_order(spark, sf):
    """Sites in the order of a contig table (here c4 to c0): numbers inside a span of a contig, and the spans' counts before it."""
    sites = v.obs(spark, sf).groupBy("contig", "pos").agg(F.count("*").alias("depth")).withColumn("part", F.floor(F.col("pos") / iv.SPAN))
    per = sites.groupBy("contig", "part").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("contig"), "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    ahead = per.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("contig", "part").orderBy("pos"))
    return sites.join(ahead, ["contig", "part"]).select("contig", "pos", "depth", (F.col("ahead") + nth).alias("nth"))
