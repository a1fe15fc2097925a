"""Queries over intervals and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusflow.functions import alleles
from locusflow.operators import intervals as iv
from locusflow.operators import reads, variants
from locusflow.plans import views as v
from locusflow.plans.views import INTERVALS, OBS, READS, TARGETS, VARIANTS

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


BOTH = f"WITH {INTERVALS}, {TARGETS}"
MEETS = 't.contig = i.contig AND t.beg <= i."end" AND t."end" >= i.beg'
PAIR = f'SELECT t.tid AS l_tid, i.id AS r_id, t.beg AS l_beg, t."end" AS l_end, i.beg AS r_beg, i."end" AS r_end FROM targets t JOIN intervals i ON {MEETS}'
SHARED = 'least(t."end", i."end") - greatest(t.beg, i.beg) + 1'


def _pairs(spark, sf, **more):
    return iv.overlap_join(v.targets(spark, sf), v.intervals(spark, sf), **more)


PAIR_COLUMNS = ["l_tid", "r_id", "l_beg", "l_end", "r_beg", "r_end"]


@query("region_filter", f"WITH {OBS} SELECT contig, pos, sample_idx, base FROM obs WHERE contig = 'c3' AND pos BETWEEN 100 AND 900")
def region_filter(spark, sf):
    return reads.in_region(v.obs(spark, sf), "c3", 100, 900).select("contig", "pos", "sample_idx", "base")


@query("overlap_join", f"{BOTH} {PAIR}")
def overlap_join(spark, sf):
    return _pairs(spark, sf).select(*PAIR_COLUMNS)


@query("overlap_match", f"{BOTH} {PAIR} AND t.payload = i.payload")
def overlap_match(spark, sf):
    return _pairs(spark, sf, on=["payload"]).select(*PAIR_COLUMNS)


for _of, _sql in (("left", f'{SHARED} >= 0.5 * (t."end" - t.beg + 1)'), ("right", f'{SHARED} >= 0.5 * (i."end" - i.beg + 1)'), ("both", f'{SHARED} >= 0.5 * greatest(t."end" - t.beg + 1, i."end" - i.beg + 1)')):
    query(f"overlap_fraction_{_of}", f"{BOTH} {PAIR} WHERE {_sql}")(lambda spark, sf, of=_of: iv.overlap_fraction(_pairs(spark, sf), 0.5, of).select(*PAIR_COLUMNS))


@query("annotate", f"""{BOTH}, hits AS (SELECT t.*, i.beg AS ib, i."end" AS ie, i.payload AS value, greatest(t.beg, i.beg) AS lo, least(t."end", i."end") AS hi FROM targets t JOIN intervals i ON {MEETS}),
 bases AS (SELECT tid, count(DISTINCT b) AS nbp FROM (SELECT tid, unnest(range(lo, hi + 1)) AS b FROM hits) GROUP BY tid),
 firsts AS (SELECT tid, value, min((ib, ie, value)) AS f FROM hits GROUP BY tid, value), listed AS (SELECT tid, string_agg(value, ',' ORDER BY f) AS vals FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY f) AS rn FROM firsts) WHERE rn <= 3 GROUP BY tid),
 counts AS (SELECT tid, count(*) AS cnt FROM hits GROUP BY tid)
 SELECT t.tid, t.contig, t.beg, t."end", t.payload, coalesce(vals, '.') AS "values", coalesce(cnt, 0) AS cnt, coalesce(nbp, 0) AS nbp, round(coalesce(nbp, 0) / CAST(t."end" - t.beg + 1 AS DOUBLE), 6) AS frac
 FROM targets t LEFT JOIN listed USING (tid) LEFT JOIN counts USING (tid) LEFT JOIN bases USING (tid)""")
def annotate(spark, sf):
    return iv.annotate(v.targets(spark, sf), v.intervals(spark, sf), "tid", "payload", most=3).withColumn("frac", F.round("frac", 6))


@query("region_windows", f"""WITH {OBS}, lens AS (SELECT contig, max(pos) AS len FROM obs GROUP BY contig) SELECT contig, CAST(b AS BIGINT) AS beg, CAST(least(b + 99, len) AS BIGINT) AS "end" FROM (SELECT contig, len, unnest(range(1, len + 1, 100)) AS b FROM lens)""")
def region_windows(spark, sf):
    return iv.windows(v.obs(spark, sf).groupBy("contig").agg(F.max("pos").alias("length")), 100)


@query("region_slices", f"""WITH {INTERVALS} SELECT contig, beg + i * size AS beg, least(beg + i * size + size - 1, "end") AS "end" FROM (SELECT *, CAST(ceil(("end" - beg + 1) / 7.0) AS BIGINT) AS size, unnest(range(7)) AS i FROM intervals) WHERE beg + i * size <= "end" """)
def region_slices(spark, sf):
    return iv.slices(v.intervals(spark, sf), 7)


# The class of an ALT against REF, in SQL: r and t are left of REF and ALT behind what they begin with alike, e is how much of these ends alike.
BEGUN = "len(list_filter(range(1, least(length(ref), length(a)) + 1), lambda k: upper(left(ref, k)) = upper(left(a, k))))"
ENDED = "len(list_filter(range(1, least(length(r), length(t))), lambda k: right(r, k) = right(t, k)))"
CLASS = """CASE WHEN a = '*' THEN 32 WHEN length(ref) = 1 AND length(a) = 1 THEN CASE WHEN a IN ('.', 'X') OR a = ref THEN 0 ELSE 1 END WHEN starts_with(a, '<X>') OR starts_with(a, '<*>') OR a = '<NON_REF>' THEN 0 WHEN starts_with(a, '<') THEN 8
 WHEN left(a, 1) IN ('[', ']') THEN 16 WHEN r = '' AND t = '' THEN 0 WHEN r = '' THEN CASE WHEN right(a, 1) IN ('[', ']') THEN 16 ELSE 68 END WHEN t = '' THEN 132 WHEN nr = 1 AND nt = 1 THEN 1
 WHEN nt = 1 THEN CASE WHEN substr(r, nr, 1) = substr(t, nt, 1) THEN 132 ELSE 8 END WHEN nr = 1 THEN CASE WHEN substr(r, nr, 1) = substr(t, nt, 1) THEN 68 ELSE 8 END WHEN nr = nt THEN 2 ELSE 8 END"""
CHANGED = """CASE WHEN kind IN (0, 16, 32) OR a LIKE '<%' THEN 0 WHEN kind = 1 THEN 1 WHEN r = '' OR t = '' THEN length(a) - length(ref) WHEN nt = 1 THEN 1 - nr WHEN nr = 1 THEN nt - 1 WHEN nr > nt THEN -nr ELSE nt END"""
EACH = f"{VARIANTS}, each_alt AS (SELECT *, unnest(alts) AS a, unnest(range(1, len(alts) + 1)) AS nth FROM variants), cut AS (SELECT *, upper(substr(ref, {BEGUN} + 1)) AS r, upper(substr(a, {BEGUN} + 1)) AS t FROM each_alt), ended AS (SELECT *, length(r) - {ENDED} AS nr, length(t) - {ENDED} AS nt FROM cut), typed AS (SELECT *, {CLASS} AS kind FROM ended), bits AS (SELECT key, bit_or(kind) AS bits FROM typed GROUP BY key)"


@query("variant_types", f"WITH {EACH} SELECT key, CAST(nth AS INT) AS nth, a AS alt, CAST(kind AS INT) AS kind, CAST({CHANGED} AS INT) AS len FROM typed")
def variant_types(spark, sf):
    each = v.variants(spark, sf).select("key", "ref", F.posexplode("alts").alias("nth", "alt"))
    ref, alt = F.col("ref"), F.col("alt")
    return each.select("key", (F.col("nth") + 1).alias("nth"), "alt", alleles.variant_class(ref, alt).alias("kind"), alleles.variant_length(ref, alt).cast("int").alias("len"))


@query("variant_masks", f"WITH {EACH} SELECT key, CAST(bits AS INT) AS bits, bits & 1 <> 0 AS any_snp, (bits & ~129 & ~4) = 0 AND bits & ~4 <> 0 AS only_snp_or_del, (bits & ~192) = 4 AS exactly_indel FROM bits")
def variant_masks(spark, sf):
    b = F.col("bits")
    rows = v.variants(spark, sf).select("key", alleles.classes(F.col("ref"), F.col("alts")).alias("bits"))
    return rows.select("key", "bits", alleles.has_classes(b, alleles.SNP).alias("any_snp"), alleles.has_classes(b, alleles.SNP | alleles.DEL, "subset").alias("only_snp_or_del"), alleles.has_classes(b, alleles.INDEL, "exact").alias("exactly_indel"))


@query("snp_sites", f"WITH {VARIANTS} SELECT key, contig, pos FROM variants WHERE length(ref) = 1 AND len(list_filter(alts, lambda a: NOT (length(a) = 1 AND a <> '*' OR a IN ('<X>', '<*>')))) = 0")
def snp_sites(spark, sf):
    return v.variants(spark, sf).where(alleles.is_snp(F.col("ref"), F.col("alts"))).select("key", "contig", "pos")


@query("filter_membership", f"WITH {VARIANTS} SELECT key, array_to_string(filters, ';') AS filters FROM variants WHERE CASE WHEN len(filters) = 0 THEN true ELSE list_has_any(filters, ['PASS', '.']) END")
def filter_membership(spark, sf):
    return v.variants(spark, sf).where(alleles.has_filter(F.col("filters"), ["PASS", "."])).select("key", F.array_join("filters", ";").alias("filters"))


def _gts(spark, sf):
    return v.variants(spark, sf).join(v.table(spark, sf, "nation").select("n_nationkey"), (F.col("key") + F.col("n_nationkey")) % 5 == 0).select(
        "key", "alts", F.col("n_nationkey").alias("sample"),
        F.when((F.col("key") + F.col("n_nationkey")) % 9 == 0, "./.").otherwise(F.concat(((F.col("key") + F.col("n_nationkey")) % 2).cast("string"), F.lit("|"), ((F.col("key") * F.col("n_nationkey")) % (F.size("alts") + 1)).cast("string"))).alias("gt"),
    )


GTS = f"{VARIANTS}, gts AS (SELECT key, alts, n_nationkey AS sample, CASE WHEN (key + n_nationkey) % 9 = 0 THEN './.' ELSE CAST((key + n_nationkey) % 2 AS VARCHAR) || '|' || CAST((key * n_nationkey) % (len(alts) + 1) AS VARCHAR) END AS gt FROM variants JOIN nation ON (key + n_nationkey) % 5 = 0)"


@query("genotype_classes", f"""WITH {GTS}, parts AS (SELECT *, regexp_split_to_array(gt, '[/|]') AS p FROM gts) SELECT key, sample, gt, CASE WHEN list_contains(p, '.') THEN 'UNKN' WHEN p[1] = '0' AND p[2] = '0' THEN 'HOM_RR' WHEN p[1] = p[2] THEN 'HOM_AA' WHEN p[1] = '0' OR p[2] = '0' THEN 'HET_RA' ELSE 'HET_AA' END AS class FROM parts""")
def genotype_classes(spark, sf):
    return _gts(spark, sf).select("key", "sample", "gt", alleles.genotype_class(F.col("gt")).alias("class"))


@query("allele_counts", f"""WITH {GTS}, each_allele AS (SELECT key, unnest(regexp_split_to_array(gt, '[/|]')) AS a FROM gts) SELECT key, count(*) AS an, count(*) FILTER (a = '1') AS ac1, count(*) FILTER (a = '2') AS ac2 FROM each_allele WHERE a <> '.' GROUP BY key""")
def allele_counts(spark, sf):
    return variants.allele_counts(_gts(spark, sf), ["key"])


@query("trim_alleles", f"""WITH {GTS}, seen AS (SELECT key, any_value(alts) AS alts, list_distinct(flatten(list(regexp_split_to_array(gt, '[/|]')))) AS s FROM gts GROUP BY key) SELECT key, array_to_string(list_transform(list_filter(range(1, len(alts) + 1), lambda i: list_contains(s, CAST(i AS VARCHAR))), lambda i: alts[i]), ',') AS alts FROM seen""")
def trim_alleles(spark, sf):
    per = _gts(spark, sf).groupBy("key", "alts").agg(F.collect_list("gt").alias("gts")).withColumn("used", alleles.used_alleles(F.col("gts"), F.size("alts")))
    return per.select("key", F.array_join(alleles.trimmed(F.col("alts"), F.col("used")), ",").alias("alts"))


EXACT = "ref || '>' || array_to_string(list_sort(alts), ',')"
KEYS = {
    "exact": EXACT, "id": "id", "any": "'*'", "snps": f"CASE WHEN bits & 1 <> 0 THEN 'snp' ELSE {EXACT} END",
    "indels": f"CASE WHEN bits & 4 <> 0 THEN 'indel' ELSE {EXACT} END", "both": f"CASE WHEN bits & 1 <> 0 THEN 'snp' WHEN bits & 4 <> 0 THEN 'indel' ELSE {EXACT} END",
}
for _pairing in variants.PAIRING:
    query(
        f"sync_join_{_pairing}",
        f"""WITH {EACH}, tagged AS (SELECT contig, pos, {KEYS[_pairing]} AS pair, key % 2 AS source, ref || ':' || array_to_string(alts, ',') || ':' || id AS r, (ref, array_to_string(alts, ','), id) AS o FROM variants JOIN bits USING (key))
 SELECT contig, pos, pair, count(DISTINCT source) AS n_sources, coalesce(string_agg(r, ' ' ORDER BY o) FILTER (source = 0), '') AS records_0, coalesce(string_agg(r, ' ' ORDER BY o) FILTER (source = 1), '') AS records_1 FROM tagged GROUP BY contig, pos, pair""",
    )(
        lambda spark, sf, pairing=_pairing: variants.sync_join([v.variants(spark, sf, 0), v.variants(spark, sf, 1)], pairing).select(
            "contig", "pos", "pair", "n_sources", *[F.array_join(F.transform(f"records_{i}", lambda r: F.concat_ws(":", r["ref"], r["alt"], r["id"])), " ").alias(f"records_{i}") for i in (0, 1)]
        )
    )


@query("shared_alleles", f"WITH {VARIANTS} SELECT a.contig, a.pos, a.ref, a.key AS l_key, b.key AS r_key FROM variants a JOIN variants b ON a.contig = b.contig AND a.pos = b.pos AND a.ref = b.ref AND list_has_any(a.alts, b.alts) WHERE a.key % 2 = 0 AND b.key % 2 = 1")
def shared_alleles(spark, sf):
    return variants.shares_allele(v.variants(spark, sf, 0), v.variants(spark, sf, 1))
