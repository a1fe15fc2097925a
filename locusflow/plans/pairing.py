"""Queries over records paired by score, and over regions and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusflow.operators import pairing
from locusflow.plans import views as v
from locusflow.plans.ranges import EACH
from locusflow.plans.records import REGIONS, SPANS, regions
from locusflow.plans.views import VARIANTS

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: The score of two records whose alleles aren't alike: k and m are their kinds.
_BOTH = "CASE WHEN a.k & 2 > 0 AND b.k & 2 > 0 OR a.k & 4 > 0 AND b.k & 4 > 0 THEN 3 ELSE 0 END"
_WITH_REF = {bit: f"CASE WHEN a.k & {bit} > 0 AND b.k & 1 > 0 OR a.k & 1 > 0 AND b.k & {bit} > 0 THEN 2 ELSE 0 END" for bit in (2, 4)}
_ALL = f"greatest({_BOTH}, {_WITH_REF[2]}, {_WITH_REF[4]})"
SCORES = {"exact": "0", "some": "0", "id": "0", "snp_ref": _WITH_REF[2], "indel_ref": _WITH_REF[4], "both_ref": _ALL, "any": f"CASE WHEN bit_count(a.k) = 1 AND bit_count(b.k) = 1 THEN greatest({_ALL}, 1) ELSE 1 END"}


def _paired_sql(logic: str) -> str:
    """Two sources: records equal in both are together; then each other record of the first takes the best one left of the second."""
    alike = "a.k = b.k AND len(a.alts) = len(b.alts) AND length(a.t) = length(b.t) AND list_has_all(b.lower, a.lower)" if logic == "exact" else "a.k & b.k > 0 AND list_has_any(a.lower, b.lower)"
    return f"""WITH RECURSIVE {EACH}, named AS (SELECT contig, pos, key, key % 2 AS source, alts, {"id || ':' || " if logic == "id" else ""}array_to_string(list_transform(alts, lambda x: ref || '>' || x), ',') AS t,
  CASE WHEN bits = 0 THEN 1 ELSE (CASE WHEN bits & 3 > 0 THEN 2 ELSE 0 END) | (bits & 4) | (bits & 8) END AS k FROM variants JOIN bits USING (key)),
 nth AS (SELECT *, string_split(lower(t), ',') AS lower, row_number() OVER (PARTITION BY contig, pos, source, t ORDER BY key) AS copy FROM named),
 equal AS (SELECT a.contig, a.pos, a.key AS key_0, b.key AS key_1 FROM nth a JOIN nth b ON a.contig = b.contig AND a.pos = b.pos AND a.t = b.t AND a.copy = b.copy AND a.source = 0 AND b.source = 1),
 a AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY key) AS r FROM nth WHERE source = 0 AND key NOT IN (SELECT key_0 FROM equal)), b AS (SELECT * FROM nth WHERE source = 1 AND key NOT IN (SELECT key_1 FROM equal)),
 s AS (SELECT * FROM (SELECT a.contig, a.pos, a.key AS ka, b.key AS kb, CASE WHEN {alike} THEN 4 ELSE {SCORES[logic]} END AS score FROM a JOIN b ON a.contig = b.contig AND a.pos = b.pos) WHERE score > 0),
 dp AS (SELECT DISTINCT contig, pos, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS ka, CAST(NULL AS BIGINT) AS kb FROM a UNION ALL
  SELECT contig, pos, r, taken, ka, kb FROM (SELECT a.contig, a.pos, a.r, CASE WHEN s.kb IS NULL THEN dp.taken ELSE list_append(dp.taken, s.kb) END AS taken, a.key AS ka, s.kb, row_number() OVER (PARTITION BY a.contig, a.pos ORDER BY coalesce(s.score, 0) DESC, s.kb) AS best
   FROM dp JOIN a ON a.contig = dp.contig AND a.pos = dp.pos AND a.r = dp.r + 1 LEFT JOIN s ON s.ka = a.key AND NOT list_contains(dp.taken, s.kb)) WHERE best = 1)
 SELECT contig, pos, key_0, key_1 FROM equal UNION ALL SELECT contig, pos, ka, kb FROM dp WHERE r > 0 UNION ALL SELECT contig, pos, NULL, key FROM b WHERE key NOT IN (SELECT kb FROM dp WHERE kb IS NOT NULL)"""


def _key(source: int):
    return F.get(F.filter("records", lambda r: r["source"] == source), F.lit(0))["record"]["order"].alias(f"key_{source}")


for _logic in SCORES:
    query(f"paired_records_{_logic}", _paired_sql(_logic))(
        lambda spark, sf, logic=_logic: pairing.paired([v.variants(spark, sf, 0), v.variants(spark, sf, 1)], logic).select("contig", "pos", _key(0), _key(1))
    )


TARGETS = """targets AS (SELECT 'c' || CAST(s_suppkey % 5 AS VARCHAR) AS contig, CAST(s_suppkey * 7 AS BIGINT) AS beg, CAST(s_suppkey * 7 + s_suppkey % 3 AS BIGINT) AS "end" FROM supplier)"""


def targets(spark, sf):
    k = F.col("s_suppkey")
    return v.table(spark, sf, "supplier").select(F.concat(F.lit("c"), (k % 5).cast("string")).alias("contig"), (k * 7).alias("beg"), (k * 7 + k % 3).alias("end"))


for _mode, _sql in SPANS.items():
    query(f"records_claimed_{_mode}", f'WITH {VARIANTS}, {REGIONS}, spans AS (SELECT key, contig, pos, {_sql} FROM variants), met AS (SELECT key, s.contig, pos, min((r.beg, r."end")) AS first FROM spans s JOIN regions r ON r.contig = s.contig AND r.beg <= s.e AND r."end" >= s.beg GROUP BY ALL) SELECT key, contig, pos, first[1] AS region_beg, first[2] AS region_end FROM met')(
        lambda spark, sf, mode=_mode: pairing.claimed(v.variants(spark, sf), regions(spark, sf), "key", mode).select("key", "contig", "pos", "region_beg", "region_end")
    )

_HIT = 'EXISTS (SELECT 1 FROM {0} x WHERE x.contig = s.contig AND x.beg <= s.{2} AND x."end" >= s.{1})'
for _exclude in (False, True):
    query(f"region_records_{'off' if _exclude else 'on'}_targets", f"WITH {VARIANTS}, {REGIONS}, {TARGETS}, s AS (SELECT key, contig, pos, {SPANS['record']} FROM variants) SELECT key, contig, pos FROM s WHERE {_HIT.format('regions', 'beg', 'e')} AND {'NOT ' if _exclude else ''}{_HIT.format('targets', 'pos', 'pos')}")(
        lambda spark, sf, exclude=_exclude: pairing.on_targets(pairing.claimed(v.variants(spark, sf), regions(spark, sf), "key", "record"), targets(spark, sf), "key", "pos", exclude).select("key", "contig", "pos")
    )
