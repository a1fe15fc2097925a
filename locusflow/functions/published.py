"""Functions for use in SQL: expressions that Spark inlines, registered for a session."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: name: (parameters, result, expression)
FUNCTIONS = {
    "error_of": ("quality DOUBLE", "DOUBLE", "exp(-quality * ln(10) / 10)"),
    "phred": ("p DOUBLE", "DOUBLE", "CASE WHEN p IS NULL OR p <= 0 THEN 10000.0D ELSE -10 * log10(p) + 0.0D END"),
    "odds_ratio": ("ref_fwd BIGINT, ref_rev BIGINT, alt_fwd BIGINT, alt_rev BIGINT", "DOUBLE", "CASE WHEN ref_rev * alt_fwd > 0 THEN ref_fwd * alt_rev / CAST(ref_rev * alt_fwd AS DOUBLE) ELSE 10000.0D END"),
    "has_flag": ("flag INT, bit INT", "BOOLEAN", "flag & bit <> 0"),
    "strand_of": ("flag INT", "STRING", "CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END"),
    "overlap_length": ("beg1 BIGINT, end1 BIGINT, beg2 BIGINT, end2 BIGINT", "BIGINT", "greatest(least(end1, end2) - greatest(beg1, beg2) + 1, 0L)"),
    "reference_length": ("cigar STRING", "INT", "aggregate(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), 0, (s, x) -> s + CAST(x AS INT))"),
    "query_length": ("cigar STRING", "INT", "aggregate(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), 0, (s, x) -> s + CAST(x AS INT))"),
}


def register(spark: SparkSession, prefix: str = "") -> None:
    """Make the functions known to the session's SQL, under their names or with a prefix."""
    for name, (parameters, result, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {expression}")


#: Rows (op, pos, qpos, n) of an alignment, as cigar.aligned_pairs has them, in SQL: the blocks with their offsets, and a row for each matched base.
PLACED = r"""aggregate(transform(regexp_extract_all(coalesce(cigar, ''), '(\\d+[MIDNSHP=X])', 1), p -> named_struct('op', right(p, 1), 'len', CAST(left(p, length(p) - 1) AS INT))),
 named_struct('q', 0, 'r', 0, 'out', CAST(array() AS ARRAY<STRUCT<op: STRING, len: INT, qpos: INT, rpos: INT>>)),
 (s, b) -> named_struct('q', s.q + CASE WHEN b.op IN ('M', 'I', 'S', '=', 'X') THEN b.len ELSE 0 END, 'r', s.r + CASE WHEN b.op IN ('M', 'D', 'N', '=', 'X') THEN b.len ELSE 0 END,
  'out', concat(s.out, array(named_struct('op', b.op, 'len', b.len, 'qpos', s.q, 'rpos', s.r)))), s -> s.out)"""
ALIGNED_PAIRS = f"""CASE WHEN pos IS NOT NULL THEN flatten(transform(filter({PLACED}, b -> b.op <> 'H'), b -> CASE
 WHEN b.op NOT IN ('M', '=', 'X') THEN array(named_struct('op', b.op, 'pos', pos + b.rpos, 'qpos', CASE WHEN b.op IN ('I', 'S', 'P') THEN b.qpos END, 'n', b.len))
 WHEN b.len > 0 THEN transform(sequence(0, b.len - 1), i -> named_struct('op', b.op, 'pos', pos + b.rpos + i, 'qpos', b.qpos + i, 'n', 1)) ELSE array() END)) END"""


def rank_sum(value: pd.Series, is_ref: pd.Series) -> float:
    """z of the rank-sum test of the values where is_ref holds against the others: average ranks of ties, no corrections; null where a side is empty."""
    kept = value.notna() & is_ref.notna()
    first = is_ref[kept].astype(bool)
    n1, n2 = int(first.sum()), int((~first).sum())
    if not n1 or not n2:
        return None
    total = value[kept].rank(method="average")[first].sum()
    return float(abs(total - n1 * (n1 + n2 + 1) / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))


def register_python(spark: SparkSession, prefix: str = "") -> None:
    """A table function and an aggregate for the session's SQL: aligned_pairs(pos, cigar) after LATERAL, rank_sum(value, is_ref) over groups.

    The table function is an expression that Spark inlines; no row goes to Python for it. A group's values meet in one Arrow batch, so that rank_sum is for groups that fit a worker; ranksums of
    operators.pileup has no such bound.
    """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}aligned_pairs(pos BIGINT, cigar STRING) RETURNS TABLE(op STRING, pos BIGINT, qpos INT, n INT) RETURN SELECT x.op, x.pos, x.qpos, x.n FROM (SELECT explode({ALIGNED_PAIRS}) AS x)")
    spark.udf.register(f"{prefix}rank_sum", F.pandas_udf(rank_sum, "double", F.PandasUDFType.GROUPED_AGG))
