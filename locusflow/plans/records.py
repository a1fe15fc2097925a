"""Queries over alignments with bases, records of reads and variants, and their fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusflow.functions import published, stats
from locusflow.operators import intervals as iv
from locusflow.operators import observe, reads, variants
from locusflow.plans import views as v
from locusflow.plans.views import READS, VARIANTS
from locusflow.sources import text as text_source

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: What orders the reads of a sample.
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"]


def sequenced(spark, sf):
    """The alignments of ``views.reads`` with bases, qualities, sample and order."""
    n = (F.col("l_linenumber") + F.col("l_quantity").cast("int") + 1 + F.col("l_linenumber") % 2 + 15).cast("int")
    seq = F.substring(F.repeat(F.lit("ACGT"), F.lit(40)), (1 + F.col("l_partkey") % 4).cast("int"), n)
    qual = F.substring(F.repeat(F.lit("".join(chr(53 + i) for i in range(20))), F.lit(8)), F.lit(1), n)
    rows = v.reads(spark, sf, "l_suppkey", "l_partkey", "l_quantity", *ORDER)
    return rows.select("qname", "contig", "pos", "cigar", "mapq", "flag", F.col("l_suppkey").cast("int").alias("sample_idx"), F.struct(*ORDER).alias("nth"), seq.alias("seq"), qual.alias("qual"))


def reference(spark, sf, chunk=1024):
    """Contigs that read CGTACGTA..., as long as the largest position of part asks for, in chunks."""
    size = F.max(F.col("p_partkey") + 200).cast("bigint").alias("n")
    per = v.table(spark, sf, "part").groupBy(F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")).alias("contig")).agg(size)
    return per.select("contig", F.explode(F.sequence(F.lit(1).cast("bigint"), "n", F.lit(chunk).cast("bigint"))).alias("start")).withColumn("seq", F.repeat(F.lit("CGTA"), F.lit(chunk // 4)))


WIDE = READS.replace(" FROM lineitem)", ", l_suppkey, l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax FROM lineitem)")
SAID = """base_at AS (SELECT *, CAST(floor((20 * (s + m + i + 15) + list_sum(list_transform(range(s + m + i + 15), lambda q: q % 20))) / (s + m + i + 15)) AS INT) AS mean FROM reads WHERE mapq >= 10 AND NOT (flag & 1024 <> 0 AND flag & 4 = 0) AND NOT (flag & 512 <> 0 AND flag & 4 = 0)),
 said AS (SELECT *, pos + k AS p, s + k AS q, k AS o, 'M' AS kind FROM (SELECT *, unnest(range(m)) AS k FROM base_at) UNION ALL SELECT *, 0, pos + m - 1, s + m, m, 'I' FROM base_at
 UNION ALL SELECT *, pos + m + k, s + m + i + k, m + 1 + k, 'M' FROM (SELECT *, unnest(range(10)) AS k FROM base_at) UNION ALL SELECT *, 0, pos + m + 9, s + m + i + 10, m + 11, 'D' FROM base_at
 UNION ALL SELECT *, pos + m + 10 + d + k, s + m + i + 10 + k, m + 12 + k, 'M' FROM (SELECT *, unnest(range(5)) AS k FROM base_at)),
 won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig, p, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, o) AS rn FROM said) WHERE rn = 1)"""
_AT = "substr(repeat('ACGT', 50), CAST({} AS INT), CAST({} AS INT))"


@query(
    "read_observations",
    f"""WITH {WIDE}, {SAID} SELECT contig, CAST(p AS INT) AS pos, CAST(l_suppkey AS INT) AS sample_idx, CASE kind WHEN 'M' THEN {_AT.format("1 + (l_partkey + q) % 4", 1)} WHEN 'I' THEN '+' || {_AT.format("1 + p % 4", 1)} || {_AT.format("1 + (l_partkey + q) % 4", "i")}
 ELSE '-' || {_AT.format("1 + p % 4", "1 + d")} END AS base, CAST(CASE kind WHEN 'M' THEN 20 + q % 20 ELSE mean END AS INT) AS qual, mapq, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, CAST(q + 1 AS INT) AS rank, {_AT.format("1 + p % 4", 1)} AS ref_base FROM won""",
)
def read_observations(spark, sf):
    """Observations of alignments: bases, insertions and deletions with their anchors, the first read of a sample first."""
    return observe.observations(sequenced(spark, sf), reference(spark, sf), 10, 1024)


@query("mean_quality", f"WITH {READS}, q AS (SELECT qname, s + m + i + 15 AS n FROM reads) SELECT qname, CAST(floor((20 * n + list_sum(list_transform(range(n), lambda k: k % 20))) / n) AS INT) AS mean_quality FROM q")
def mean_quality(spark, sf):
    return sequenced(spark, sf).select("qname", observe.mean_quality(F.col("qual")).alias("mean_quality"))


@query("read_pairs", f"WITH {READS} SELECT contig, count(*) FILTER (flag & 64 <> 0) AS read1, count(*) FILTER (flag & 128 <> 0) AS read2, count(*) FILTER (flag & 1 <> 0) AS paired FROM reads GROUP BY contig")
def read_pairs(spark, sf):
    f = F.col("flag")
    return v.reads(spark, sf).groupBy("contig").agg(*[F.count_if(reads.has(f, n)).alias(n) for n in ("read1", "read2", "paired")])


@query("read_groups", f"WITH {READS} SELECT qname, CASE WHEN flag % 3 = 0 THEN 'g' || flag % 5 WHEN contains(qname, ':') THEN split_part(qname, ':', 1) END AS read_group FROM reads")
def read_groups(spark, sf):
    tags = F.when(F.col("flag") % 3 == 0, F.create_map(F.lit("RG"), F.concat(F.lit("g"), (F.col("flag") % 5).cast("string")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return v.reads(spark, sf).withColumn("tags", tags).select("qname", reads.read_group(F.col("tags"), F.col("qname")).alias("read_group"))


@query("quality_failures", f"WITH {READS} SELECT qname, CAST(CASE WHEN mapq < 20 AND flag & 4 = 0 THEN flag | 512 ELSE flag END AS INT) AS flag FROM reads")
def quality_failures(spark, sf):
    return v.reads(spark, sf).select("qname", reads.marked_failed(F.col("flag"), F.col("mapq") < 20).alias("flag"))


@query("mapping_quality", f"WITH {READS} SELECT qname, CASE WHEN flag & 4 <> 0 THEN 0 ELSE mapq END AS mapq FROM reads")
def mapping_quality(spark, sf):
    return v.reads(spark, sf).select("qname", reads.mapping_quality(F.col("flag"), F.col("mapq")).alias("mapq"))


@query("edited_tags", f"WITH {READS} SELECT qname, CASE WHEN flag % 3 = 0 THEN 'i:' || mapq WHEN flag % 2 = 0 THEN 'Z:old' END AS nm, CASE WHEN flag % 5 <> 0 THEN 'Z:kept' END AS xx FROM reads")
def edited_tags(spark, sf):
    """Tags set, replaced and removed by condition."""
    none = F.lit(None).cast("string")
    f = F.col("flag")
    start = F.map_from_entries(F.filter(F.array(F.struct(F.lit("NM").alias("k"), F.when(f % 2 == 0, "Z:old").alias("v")), F.struct(F.lit("XX").alias("k"), F.lit("Z:kept").alias("v"))), lambda e: e["v"].isNotNull()))
    rows = v.reads(spark, sf).withColumn("tags", start)
    edited = reads.with_tag(reads.with_tag(F.col("tags"), "NM", F.when(f % 3 == 0, F.concat(F.lit("i:"), F.col("mapq").cast("string"))), f % 3 == 0), "XX", none, f % 5 == 0)
    return rows.select("qname", edited.alias("tags")).select("qname", F.col("tags")["NM"].alias("nm"), F.col("tags")["XX"].alias("xx"))


FIELDS = f"""{VARIANTS}, f AS (SELECT *, len(alts) AS na, list_transform(range(len(alts)), lambda i: CAST(key % 50 + i AS INT)) AS ac, list_transform(range(len(alts) + 1), lambda i: CAST(key % 30 + i AS INT)) AS ad, list_transform(range(CAST((len(alts) + 1) * (len(alts) + 2) / 2 AS INT)), lambda i: CAST(key % 70 + i AS INT)) AS pl, [i FOR i IN range(1, len(alts) + 1) IF (key + i) % 2 = 0] AS used FROM variants)"""


@query(
    "removed_alleles",
    f"""WITH {FIELDS}, k AS (SELECT *, list_concat([0], used) AS kept FROM f) SELECT key, array_to_string([alts[i] FOR i IN used], ',') AS alts, array_to_string([CAST(ac[i] AS VARCHAR) FOR i IN used], ',') AS ac, array_to_string([CAST(ad[i + 1] AS VARCHAR) FOR i IN kept], ',') AS ad,
 array_to_string(flatten([[CAST(pl[CAST(b * (b + 1) / 2 AS INT) + a + 1] AS VARCHAR) FOR a IN kept IF a <= b] FOR b IN kept]), ',') AS pl FROM k""",
)
def removed_alleles(spark, sf):
    """ALTs removed by a condition, with the fields of one value per ALT, per allele and per genotype cut to match."""
    upto = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: i)
    n, key = F.size("alts"), F.col("key")
    rows = v.variants(spark, sf).withColumns({
        "ac": F.transform(upto(n), lambda i: (key % 50 + i).cast("int")), "ad": F.transform(upto(n + 1), lambda i: (key % 30 + i).cast("int")), "pl": F.transform(upto(((n + 1) * (n + 2) / 2).cast("int")), lambda i: (key % 70 + i).cast("int")),
        "used": F.filter(F.sequence(F.lit(1), n), lambda i: (key + i) % 2 == 0),
    })
    used = F.col("used")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("key", text(variants.kept_values(F.col("alts"), used, "A")).alias("alts"), *[text(variants.kept_values(F.col(c), used, k)).alias(c) for c, k in (("ac", "A"), ("ad", "R"), ("pl", "G"))])


@query("updated_info", f"WITH {VARIANTS} SELECT key, array_to_string(list_filter(['AC=' || key % 7, CASE WHEN key % 2 = 0 THEN 'DB' END, CASE WHEN key % 3 <> 0 THEN 'DP=' || CASE WHEN key % 5 = 0 THEN '99' ELSE CAST(key % 11 AS VARCHAR) END END], lambda x: x IS NOT NULL), ';') AS info, array_to_string(CASE WHEN key % 6 = 0 THEN ['q10'] WHEN list_contains(filters, 'q10') THEN filters ELSE list_concat(list_filter(filters, lambda x: x <> 'PASS'), ['q10']) END, ';') AS filters FROM variants")
def updated_info(spark, sf):
    """INFO values set, replaced and removed, a filter added or set."""
    key, none = F.col("key"), F.lit(None).cast("string")
    rows = v.variants(spark, sf).withColumn("info", F.create_map(F.lit("AC"), (key % 7).cast("string"), F.lit("DP"), (key % 11).cast("string")))
    info = variants.with_field(F.col("info"), "DB", F.lit(""), key % 2 == 0)
    info = variants.with_field(variants.with_field(info, "DP", F.lit("99"), key % 5 == 0), "DP", none, key % 3 == 0)
    filters = F.when(key % 6 == 0, F.array(F.lit("q10"))).otherwise(variants.with_filter(F.col("filters"), "q10"))
    return rows.select("key", variants.info_text(info).alias("info"), F.array_join(filters, ";").alias("filters"))


@query("sample_projection", f"WITH {VARIANTS}, g AS (SELECT key, n_nationkey AS sample, CAST((key + n_nationkey) % 3 AS VARCHAR) AS gt FROM variants CROSS JOIN nation) SELECT key, string_agg(gt, ',' ORDER BY sample) FILTER (sample IN (3, 7, 11)) AS kept, count(*) FILTER (sample NOT IN (3, 7, 11)) AS others FROM g GROUP BY key")
def sample_projection(spark, sf):
    """Genotypes of chosen samples, and of all but these."""
    names = [r[0] for r in v.table(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # a header's list of samples
    calls = F.array(*[((F.col("key") + n) % 3).cast("string") for n in names])
    rows = v.variants(spark, sf).withColumn("calls", calls)
    kept, others = (variants.samples_kept(F.col("calls"), [str(n) for n in names], ["3", "7", "11"], invert) for invert in (False, True))
    return rows.select("key", F.array_join(kept, ",").alias("kept"), F.size(others).cast("bigint").alias("others"))


@query("gamma_tails", "SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS x, round(1 - exp(-l_quantity / 10.0), 8) AS p1, round(exp(-l_quantity / 10.0) * (1 + l_quantity / 10.0 + l_quantity * l_quantity / 200.0), 8) AS q3, round(1 - power(1 - l_quantity / 60.0, 3), 8) AS b13 FROM lineitem")
def gamma_tails(spark, sf):
    """Incomplete gamma and beta functions at whole parameters, where they have closed forms."""
    x = v.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x")).distinct()
    return x.select("x", F.round(stats.gamma_lower(F.lit(1.0), F.col("x") / 10), 8).alias("p1"), F.round(stats.gamma_upper(F.lit(3.0), F.col("x") / 10), 8).alias("q3"), F.round(stats.beta_share(F.lit(1.0), F.lit(3.0), F.col("x") / 60), 8).alias("b13"))


@query("contigs_by_length", f"WITH {READS} SELECT contig, CAST(max(pos) AS BIGINT) AS length FROM reads GROUP BY contig HAVING max(pos) >= 100")
def contigs_by_length(spark, sf):
    return v.reads(spark, sf).groupBy("contig").agg(F.max("pos").cast("bigint").alias("length")).where("length >= 100")


SPANS = {
    "pos": "pos AS beg, pos AS e", "record": "pos AS beg, pos + length(ref) - 1 AS e",
    "variant": "pos + list_min(list_transform(alts, lambda a: len(list_filter(range(1, least(length(ref), length(a)) + 1), lambda k: left(ref, k) = left(a, k))))) AS beg, pos + length(ref) - 1 AS e",
}
REGIONS = """regions AS (SELECT DISTINCT 'c' || CAST(c_custkey % 5 AS VARCHAR) AS contig, CAST(c_custkey // 5 * 3 + c_custkey % 2 AS BIGINT) AS beg, CAST(c_custkey // 5 * 3 + c_custkey % 2 + c_custkey % 4 AS BIGINT) AS "end" FROM customer)"""


def regions(spark, sf):
    """Regions of 1 to 4 bases, one per customer, some of them overlapping, with gaps between others."""
    k = F.col("c_custkey")
    beg = F.floor(k / 5).cast("bigint") * 3 + k % 2
    return v.table(spark, sf, "customer").select(F.concat(F.lit("c"), (k % 5).cast("string")).alias("contig"), beg.alias("beg"), (beg + k % 4).alias("end"))


for _mode, _sql in SPANS.items():
    query(f"records_in_regions_{_mode}", f'WITH {VARIANTS}, {REGIONS}, spans AS (SELECT key, contig, pos, {_sql} FROM variants) SELECT key, contig, pos FROM spans s WHERE EXISTS (SELECT 1 FROM regions r WHERE r.contig = s.contig AND r.beg <= s.e AND r."end" >= s.beg)')(
        lambda spark, sf, mode=_mode: iv.overlapping(variants.spanned(v.variants(spark, sf), mode), regions(spark, sf), "key").select("key", "contig", "pos")
    )


@query(
    "site_table",
    """WITH t AS (SELECT 'c' || p_partkey % 5 AS contig, p_partkey AS pos, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['A', 'G'] ELSE ['T'] END) AS alt, unnest(range(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END)) AS i, p_size AS a, p_partkey % 7 AS b, p_partkey % 4 AS c, p_partkey % 3 = 0 AS two FROM part WHERE p_partkey % 10 <> 0)
 SELECT contig, pos, alt, CASE WHEN i = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS freq, a::BIGINT AS central_ref, CASE WHEN i = 0 THEN b ELSE c END::BIGINT AS central_alt, round(b / (a + b + CASE WHEN two THEN c ELSE 0 END), 5) AS central_af, b::BIGINT AS north_ref, c::BIGINT AS north_alt, CASE WHEN b + c * CASE WHEN two THEN 2 ELSE 1 END > 0 THEN round(c / (b + c * CASE WHEN two THEN 2 ELSE 1 END), 5) END AS north_af,
 c::BIGINT AS south_ref, CASE WHEN i = 0 THEN a ELSE b END::BIGINT AS south_alt, round(a / (a + c + CASE WHEN two THEN b ELSE 0 END), 5) AS south_af FROM t""",
)
def site_table(spark, sf):
    """Lines of nine fields made from part, some of them cut short, read back by region."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    two = k % 3 == 0
    a, b, c = text(F.col("p_size")), F.concat(text(k % 7), F.lit(".9")), text(k % 4)
    depths = lambda x, y, z: F.when(two, F.concat_ws(":", x, y, z)).otherwise(F.concat_ws(":", x, y))
    line = F.concat_ws("\t", F.concat(F.lit("c"), text(k % 5)), text(k), F.lit("C"), F.when(two, "a,g").otherwise("t"), F.when(two, "0.25,0.5").otherwise("0.25"), depths(a, b, c), depths(b, c, c), depths(c, a, b), F.when(k % 10 != 0, "x"))
    return text_source.site_table(v.table(spark, sf, "part").select(line.alias("value")))


@query("regional_fisher", """WITH t AS (SELECT DISTINCT l_linenumber AS a, l_quantity::INT % 5 AS b, l_orderkey % 4 AS c FROM lineitem), m AS (SELECT *, a + b + c AS r, 9 AS n1, 8 AS n2, 7 AS n3 FROM t), w AS (SELECT *, lgamma(n1 + 1) + lgamma(n2 + 1) + lgamma(n3 + 1) AS k FROM m),
 each_table AS (SELECT w.*, i.i, j.j FROM w, range(0, 10) i(i), range(0, 9) j(j) WHERE i.i + j.j <= r AND r - i.i - j.j <= n3), p AS (SELECT a, b, c, exp(k - lgamma(i + 1) - lgamma(n1 - i + 1) - lgamma(j + 1) - lgamma(n2 - j + 1) - lgamma(r - i - j + 1) - lgamma(n3 - r + i + j + 1)) AS x, exp(k - lgamma(a + 1) - lgamma(n1 - a + 1) - lgamma(b + 1) - lgamma(n2 - b + 1) - lgamma(c + 1) - lgamma(n3 - c + 1)) AS own FROM each_table)
 SELECT a, b, c, round(sum(CASE WHEN x <= own * (1 + 1e-7) THEN x ELSE 0 END) / sum(x), 8) AS p FROM p GROUP BY a, b, c""")
def regional_fisher(spark, sf):
    """Depths of an allele in three regions of 9, 8 and 7 samples, for every combination that the line items have."""
    t = v.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("a"), (F.col("l_quantity").cast("int") % 5).alias("b"), (F.col("l_orderkey") % 4).alias("c")).distinct()
    return t.withColumn("p", F.round(stats.fisher_2x3([F.col("a"), F.col("b"), F.col("c")], [F.lit(9), F.lit(8), F.lit(7)]), 8))


@query("published_functions", f"WITH {READS} SELECT qname, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, flag & 1024 <> 0 AS dup, CAST(m + 15 + d AS INT) AS ref_length, CAST(s + m + i + 15 AS INT) AS query_length, round(exp(-mapq * ln(10) / 10), 8) AS error FROM reads")
def published_functions(spark, sf):
    """Functions that a session's SQL can call once they are registered."""
    published.register(spark)
    return spark.sql("SELECT qname, strand_of(flag) AS strand, has_flag(flag, 1024) AS dup, reference_length(cigar) AS ref_length, query_length(cigar) AS query_length, round(error_of(mapq), 8) AS error FROM {reads}", reads=v.reads(spark, sf))
