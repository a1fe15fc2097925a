"""Alignment-like facts derived from the driver's tables, as DataFrames and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators.pileup import first_wins
from locusflow.operators.reads import passing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per line item: sample = supplier, position = part."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    acgt = lambda c: F.substring(F.lit("ACGT"), (1 + c % 4).cast("int"), F.lit(1))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("c"), (F.col("l_partkey") % 5).cast("string")).alias("contig"),
        (F.col("l_partkey") + 1).cast("int").alias("pos"),
        F.col("l_suppkey").cast("int").alias("sample_idx"),
        acgt(F.col("l_linenumber")).alias("base"),
        F.col("l_quantity").cast("int").alias("qual"),
        (F.round(F.col("l_discount") * 100).cast("int") * 6).alias("mapq"),
        F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"),
        (1 + F.col("l_orderkey") % 150).cast("int").alias("rank"),
        (F.when(F.col("l_tax") > 0.07, 1024).otherwise(0) + F.when(F.col("l_linestatus") == "O", 16).otherwise(0)).alias("flag"),
        acgt(F.col("p_size")).alias("ref_base"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("ord"),
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing observations, one per sample and position."""
    return first_wins(passing(obs_raw(spark, sf_dir), 10), ["contig", "pos", "sample_idx"], "ord").drop("ord")


def reads(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One alignment per line item with a CIGAR of six or seven operations, and more columns of the line item."""
    text = lambda c: c.cast("string")
    cigar = F.concat(
        text(F.col("l_linenumber")), F.lit("S"), text(F.col("l_quantity").cast("int")), F.lit("M"), text(1 + F.col("l_linenumber") % 2), F.lit("I10M"), text(1 + F.col("l_orderkey") % 3), F.lit("D5M")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", text(F.col("l_orderkey")), text(F.col("l_linenumber")), text(F.col("l_partkey")), text(F.col("l_suppkey"))).alias("qname"),
        F.concat(F.lit("c"), text(F.col("l_partkey") % 5)).alias("contig"),
        (F.col("l_partkey") + 1).alias("pos"),
        cigar.alias("cigar"),
        (F.round(F.col("l_discount") * 100).cast("int") * 6).alias("mapq"),
        (F.col("l_linenumber") + F.when(F.col("l_linestatus") == "O", 16).otherwise(0) + F.when(F.col("l_tax") > 0.07, 1024).otherwise(0)).cast("int").alias("flag"),
        *more,
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals with a payload: one per part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")).alias("contig"),
        (F.col("p_partkey") + 1).cast("bigint").alias("beg"),
        (F.col("p_partkey") + F.col("p_size")).cast("bigint").alias("end"),
        F.col("p_brand").alias("payload"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals to annotate: one per customer, some of them reversed."""
    c = F.col("c_custkey")
    a, b = c % 2000 + 1, c % 2000 + c % 17 - 3
    return table(spark, sf_dir, "customer").select(
        c.alias("tid"), F.concat(F.lit("c"), (c % 5).cast("string")).alias("contig"), F.least(a, b).cast("bigint").alias("beg"), F.greatest(a, b).cast("bigint").alias("end"), F.concat(F.lit("Brand#"), (11 + c % 5).cast("string")).alias("payload")
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx and the region of its nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").cast("int").alias("sample_idx"), F.col("r_name").alias("group"))


#: Alleles that classes are easily mistaken for.
ODD = ["X", "<X>", "<INS>", "ATGGT]c2:7]", "[c3:9[A", "atg", "GCA", "AG", "TTG", "ACCCG"]


def variants(spark: SparkSession, sf_dir: str, parity: int | None = None) -> DataFrame:
    """A variant per part and part of sites: alleles of several kinds, made from the keys; parity picks one of two sources."""
    k, z = F.col("p_partkey"), F.col("p_size")
    ref = F.when(k % 7 == 0, "AT").when(k % 7 == 1, "ATG").when(k % 7 == 2, "ACTG").otherwise(F.substring(F.lit("ACGT"), (1 + z % 4).cast("int"), F.lit(1)))
    alt = F.when(k % 11 == 0, "A").when(k % 11 == 1, "ATT").when(k % 11 == 2, "<DEL>").when(k % 11 == 3, "*").when(k % 11 == 4, "AT").when(k % 11 == 5, "ACTG").when(k % 11 == 6, F.element_at(F.array(*map(F.lit, ODD)), (1 + k % len(ODD)).cast("int"))).otherwise(F.substring(F.lit("ACGT"), (1 + (z + k) % 4).cast("int"), F.lit(1)))
    second = F.when(k % 3 == 0, F.array(F.lit("G"))).otherwise(F.array().cast("array<string>"))
    out = table(spark, sf_dir, "part").select(
        F.concat(F.lit("c"), (k % 5).cast("string")).alias("contig"), (k / 20).cast("bigint").alias("pos"), F.concat(F.lit("rs"), (k % 900).cast("string")).alias("id"), ref.alias("ref"), F.concat(F.array(alt), second).alias("alts"), k.alias("key"),
        F.when(k % 4 == 0, F.array(F.lit("PASS"))).when(k % 4 == 1, F.array(F.lit("LowQual"), F.lit("q10"))).when(k % 4 == 2, F.array(F.lit("q10"))).otherwise(F.array().cast("array<string>")).alias("filters"),
    )
    return out if parity is None else out.where(k % 2 == parity)


# The same views for the checks.
OBS_RAW = """obs_raw AS (SELECT 'c' || CAST(l_partkey % 5 AS VARCHAR) AS contig, CAST(l_partkey + 1 AS INT) AS pos, CAST(l_suppkey AS INT) AS sample_idx,
 substr('ACGT', CAST(1 + l_linenumber % 4 AS INT), 1) AS base, CAST(l_quantity AS INT) AS qual, CAST(round(l_discount * 100) AS INT) * 6 AS mapq,
 CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, CAST(1 + l_orderkey % 150 AS INT) AS rank,
 CASE WHEN l_tax > 0.07 THEN 1024 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END AS flag,
 substr('ACGT', CAST(1 + p_size % 4 AS INT), 1) AS ref_base, l_shipdate, l_orderkey, l_linenumber
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""
OBS = OBS_RAW + """, obs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos, sample_idx ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn
 FROM obs_raw WHERE mapq >= 10 AND flag & 1536 = 0) WHERE rn = 1)"""
READS = """reads AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS qname, 'c' || CAST(l_partkey % 5 AS VARCHAR) AS contig, l_partkey + 1 AS pos,
 l_linenumber || 'S' || CAST(l_quantity AS INT) || 'M' || (1 + l_linenumber % 2) || 'I10M' || (1 + l_orderkey % 3) || 'D5M' AS cigar,
 CAST(round(l_discount * 100) AS INT) * 6 AS mapq, l_linenumber + CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END + CASE WHEN l_tax > 0.07 THEN 1024 ELSE 0 END AS flag,
 l_linenumber AS s, CAST(l_quantity AS INT) AS m, 1 + l_linenumber % 2 AS i, 1 + l_orderkey % 3 AS d FROM lineitem)"""
INTERVALS = """intervals AS (SELECT p_partkey AS id, 'c' || CAST(p_partkey % 5 AS VARCHAR) AS contig, CAST(p_partkey + 1 AS BIGINT) AS beg, CAST(p_partkey + p_size AS BIGINT) AS "end", p_brand AS payload FROM part)"""
TARGETS = """targets AS (SELECT c_custkey AS tid, 'c' || CAST(c_custkey % 5 AS VARCHAR) AS contig, CAST(least(c_custkey % 2000 + 1, c_custkey % 2000 + c_custkey % 17 - 3) AS BIGINT) AS beg,
 CAST(greatest(c_custkey % 2000 + 1, c_custkey % 2000 + c_custkey % 17 - 3) AS BIGINT) AS "end", 'Brand#' || CAST(11 + c_custkey % 5 AS VARCHAR) AS payload FROM customer)"""
GROUPS = """groups AS (SELECT CAST(s_suppkey AS INT) AS sample_idx, r_name AS "group" FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
VARIANTS = """variants AS (SELECT 'c' || CAST(p_partkey % 5 AS VARCHAR) AS contig, CAST(floor(p_partkey / 20) AS BIGINT) AS pos, 'rs' || CAST(p_partkey % 900 AS VARCHAR) AS id,
 CASE WHEN p_partkey % 7 = 0 THEN 'AT' WHEN p_partkey % 7 = 1 THEN 'ATG' WHEN p_partkey % 7 = 2 THEN 'ACTG' ELSE substr('ACGT', CAST(1 + p_size % 4 AS INT), 1) END AS ref,
 list_concat([CASE p_partkey % 11 WHEN 0 THEN 'A' WHEN 1 THEN 'ATT' WHEN 2 THEN '<DEL>' WHEN 3 THEN '*' WHEN 4 THEN 'AT' WHEN 5 THEN 'ACTG' WHEN 6 THEN """ + str(ODD) + """[1 + p_partkey % """ + str(len(ODD)) + """] ELSE substr('ACGT', CAST(1 + (p_size + p_partkey) % 4 AS INT), 1) END],
  CASE WHEN p_partkey % 3 = 0 THEN ['G'] ELSE CAST([] AS VARCHAR[]) END) AS alts, p_partkey AS key,
 CASE p_partkey % 4 WHEN 0 THEN ['PASS'] WHEN 1 THEN ['LowQual', 'q10'] WHEN 2 THEN ['q10'] ELSE CAST([] AS VARCHAR[]) END AS filters FROM part)"""
