"""Classes and lengths of alleles that simple rules mistake, and Fisher's test against the plain sum."""

from math import comb

import pytest
from pyspark.sql import functions as F

from locusflow.functions import alleles as al
from locusflow.functions import stats

CASES = [
    ("ATG", "ATT", al.SNP, 1), ("GCA", "GTA", al.SNP, 1), ("ATG", "ACTG", al.INDEL | al.INS, 1), ("ACTG", "ATG", al.INDEL | al.DEL, -1), ("A", "<DEL>", al.OTHER, 0), ("A", "X", al.REF, 0),
    ("A", "C", al.SNP, 1), ("A", ".", al.REF, 0), ("A", "*", al.OVERLAP, 0), ("A", "<*>", al.REF, 0), ("A", "<NON_REF>", al.REF, 0), ("G", "G]c2:7]", al.BND, 0), ("G", "]c2:7]G", al.BND, 0),
    ("AT", "GC", al.MNP, 2), ("AT", "ATGG", al.INDEL | al.INS, 2), ("ATGG", "AT", al.INDEL | al.DEL, -2), ("atg", "ATG", al.REF, 0), ("ATGC", "GG", al.OTHER, -4), ("AC", "GTT", al.OTHER, 3), ("TACG", "TT", al.OTHER, -2),
]


def test_classes_and_lengths(spark):
    frame = spark.createDataFrame(CASES, "ref string, alt string, kind int, n int")
    for r in frame.withColumn("k", al.variant_class(F.col("ref"), F.col("alt"))).withColumn("l", al.variant_length(F.col("ref"), F.col("alt"))).collect():
        assert (r.k, r.l) == (r.kind, r.n), r


def test_fisher_against_the_plain_sum(spark):
    tables = [(a, b, c, d) for a in (0, 1, 7) for b in (0, 3, 12) for c in (0, 2, 9) for d in (0, 1, 20)] + [(400, 10, 3, 500), (2000, 1900, 1800, 2100)]
    for r in spark.createDataFrame(tables, "a bigint, b bigint, c bigint, d bigint").withColumn("p", stats.fisher(*map(F.col, "abcd"))).collect():
        rows, columns, n = r.a + r.b, r.a + r.c, r.a + r.b + r.c + r.d
        weight = lambda k: comb(columns, k) * comb(n - columns, rows - k)
        own = weight(r.a)
        want = sum(w for k in range(max(0, rows + columns - n), min(rows, columns) + 1) if (w := weight(k)) <= own) / comb(n, rows)
        assert r.p == pytest.approx(want, rel=1e-6, abs=1e-300)
