"""Queries over CIGAR strings and conditions on reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusflow.functions import cigar as cg
from locusflow.functions.terms import average, both, default, exists, length, matching, no, power, root, some, term
from locusflow.operators import pileup
from locusflow.plans import views as v
from locusflow.plans.views import READS

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _blocks(spark, sf):
    return v.reads(spark, sf).withColumn("blocks", cg.blocks(F.col("cigar")))


@query("cigar_blocks", f"""WITH {READS} SELECT qname, CAST(len(b) AS INT) AS n, CAST(b[2] AS INT) AS matched, b2[1] AS first_op FROM (SELECT qname, regexp_extract_all(cigar, '(\\d+)[MIDNSHP=XB]', 1) AS b, regexp_extract_all(cigar, '\\d+([MIDNSHP=XB])', 1) AS b2 FROM reads)""")
def cigar_blocks(spark, sf):
    return _blocks(spark, sf).select("qname", F.size("blocks").alias("n"), F.get("blocks", F.lit(1))["len"].alias("matched"), F.get("blocks", F.lit(0))["op"].alias("first_op"))


@query("align_lengths", f"WITH {READS} SELECT qname, m + 15 AS match_length, CAST(m + 15 + d AS INT) AS ref_length, CAST(s + m + i + 15 AS INT) AS query_length, CAST(pos + m + 15 + d - 1 AS BIGINT) AS end_pos, CAST(i AS INT) AS max_ins, CAST(d AS INT) AS max_del, CAST(s AS INT) AS start, CAST(s + m + i + 15 AS INT) AS stop FROM reads")
def align_lengths(spark, sf):
    b = F.col("blocks")
    return _blocks(spark, sf).select(
        "qname", cg.span(b, cg.MATCH).alias("match_length"), cg.span(b, cg.REFERENCE).alias("ref_length"), cg.span(b, cg.QUERY).alias("query_length"), cg.end_of(F.col("pos"), b).alias("end_pos"),
        cg.longest(b, "I").alias("max_ins"), cg.longest(b, "D").alias("max_del"), cg.clipped_start(b).alias("start"), cg.clipped_end(b).alias("stop"),
    )


@query("alignment_blocks", f"WITH {READS} SELECT qname, pos - 1 AS beg, pos - 1 + m AS \"end\" FROM reads UNION ALL SELECT qname, pos - 1 + m, pos - 1 + m + 10 FROM reads UNION ALL SELECT qname, pos - 1 + m + 10 + d, pos - 1 + m + 15 + d FROM reads")
def alignment_blocks(spark, sf):
    placed = _blocks(spark, sf).withColumn("placed", cg.placed(F.col("blocks")))
    return placed.select("qname", F.explode(cg.alignment_blocks(F.col("pos"), F.col("placed"))).alias("b")).select("qname", "b.beg", "b.end")


PAIRS = """SELECT qname, 'S' AS op, pos, CAST(0 AS INT) AS qpos, CAST(s AS INT) AS n FROM reads UNION ALL SELECT qname, 'M', pos + k, CAST(s + k AS INT), 1 FROM (SELECT *, unnest(range(m)) AS k FROM reads)
 UNION ALL SELECT qname, 'I', pos + m, CAST(s + m AS INT), CAST(i AS INT) FROM reads UNION ALL SELECT qname, 'M', pos + m + k, CAST(s + m + i + k AS INT), 1 FROM (SELECT *, unnest(range(10)) AS k FROM reads)
 UNION ALL SELECT qname, 'D', pos + m + 10, NULL, CAST(d AS INT) FROM reads UNION ALL SELECT qname, 'M', pos + m + 10 + d + k, CAST(s + m + i + 10 + k AS INT), 1 FROM (SELECT *, unnest(range(5)) AS k FROM reads)"""


@query("aligned_pairs", f"WITH {READS} SELECT op, pos, qpos, n, count(*) AS times FROM ({PAIRS}) GROUP BY ALL")
def aligned_pairs(spark, sf):
    return pileup.pair_counts(v.reads(spark, sf))


@query("cigar_coverage", f"WITH {READS} SELECT contig, pos, count(*) FILTER (op = 'M') AS matched, count(*) FILTER (op = 'I') AS insertions, count(*) FILTER (op = 'D') AS deletions, count(*) FILTER (op = 'S') AS clips FROM (SELECT p.*, r.contig FROM ({PAIRS}) p JOIN (SELECT DISTINCT qname, contig FROM reads WHERE flag & 1024 = 0) r USING (qname)) GROUP BY contig, pos")
def cigar_coverage(spark, sf):
    return pileup.cigar_coverage(v.reads(spark, sf).where(F.col("flag").bitwiseAND(1024) == 0))


#: name: (conditions, the same in SQL)
FILTERS = {
    "arithmetic": ([lambda r: r.pos * 2 + r.mapq / 4 - 1 > 900, lambda r: r.pos % 7 != 0], "pos * 2 + mapq / 4.0 - 1 > 900 AND pos % 7 <> 0"),
    "precedence": ([lambda r: both(some(r.mapq > 50, r.has("reverse")), r.pos < 300)], "(mapq > 50 OR flag & 16 <> 0) AND pos < 300"),
    "right_compare": ([lambda r: term(0) < (r.pos < 900)], "0 < CASE WHEN pos < 900 THEN 1 ELSE 0 END"),
    "bits": ([lambda r: (r.flag & 1040) == 16, lambda r: ((r.pos ^ 5) | 2) % 3 == 0], "flag & 1040 = 16 AND (xor(pos, 5) | 2) % 3 = 0"),
    "pattern": ([lambda r: r.cigar.matches("^[12]S"), lambda r: no(r.rname.matches("c[34]"))], "regexp_matches(cigar, '^[12]S') AND NOT regexp_matches(contig, 'c[34]')"),
    "strings": ([lambda r: some(r.rname == "c1", r.rname == 1), lambda r: r.pos > 0], "contig = 'c1' AND pos > 0"),
    "functions": ([lambda r: length(r.cigar) > 13, lambda r: root(r.pos) < power(term(2), 4), lambda r: average(r.rname) > 73], "length(cigar) > 13 AND sqrt(pos) < 16 AND (99 + ascii(substr(contig, 2, 1))) / 2.0 > 73"),
    "undefined": ([lambda r: both(no(term(1) % 0), default(r.pos % 0, r.mapq) > 20), lambda r: exists(r.mapq)], "mapq > 20"),
    "cigar_symbols": ([lambda r: r.qlen - r.sclen > 30, lambda r: r.endpos > 500, lambda r: r.ncigar == 6, lambda r: r.hclen == 0], "m + i + 15 > 30 AND pos + m + 15 + d - 1 > 500"),
    "flags": ([lambda r: no(r.has("dup")), lambda r: ~r.flag & 16], "flag & 1024 = 0 AND (~flag) & 16 <> 0"),
}
for _name, (_conditions, _sql) in FILTERS.items():
    query(f"filter_{_name}", f"WITH {READS} SELECT qname, pos, mapq, flag FROM reads WHERE {_sql}")(lambda spark, sf, conditions=_conditions: matching(v.reads(spark, sf), *conditions).select("qname", "pos", "mapq", "flag"))
