"""Fisher's test over three regions at depth, sampled neighbours, tags, and functions published for SQL."""

import math
import random

import pytest
from pyspark.sql import functions as F

from locusflow.functions import alleles, published, stats, tags
from locusflow.plans import calls


def fisher(x, n):
    ways = lambda k: math.prod(math.comb(m, i) for m, i in zip(n, k))
    row, own = sum(x), ways(x)
    every = [ways((i, j, row - i - j)) for i in range(min(n[0], row) + 1) for j in range(min(n[1], row - i) + 1) if row - i - j <= n[2]]
    return sum(w for w in every if w * 10**7 <= own * (10**7 + 1)) / sum(every)


def test_fisher_over_three_regions(spark):
    cases = [((3, 0, 9), (40, 10, 60)), ((0, 0, 0), (5, 5, 5)), ((100, 20, 3), (300, 200, 100)), ((1, 2, 3), (1, 2, 3))]
    rows = spark.createDataFrame([(i, *x, *n) for i, (x, n) in enumerate(cases)], "i int, a bigint, b bigint, c bigint, l bigint, m bigint, n bigint")
    got = {r["i"]: r["p"] for r in rows.select("i", stats.fisher_2x3([F.col(k) for k in "abc"], [F.col(k) for k in "lmn"]).alias("p")).collect()}
    for i, (x, n) in enumerate(cases):
        assert got[i] == pytest.approx(fisher(x, n), rel=1e-6)


def test_sampled_neighbours(spark):
    r = random.Random(3)
    values = [(i, r.choice([0.001, 0.02, 0.5, 40.0, 9000.0]) * (1 + r.random() / 5)) for i in range(120)] + [(200, 0.0), (201, 0.0)]
    f = spark.createDataFrame(values, "key bigint, freq double")
    near = {k: {j for j, w in values if 0.9 * v <= w <= 1.1 * v} for k, v in values}
    one, two = ({(x["key"], x["neighbour"]) for x in calls.sampled_neighbours(f.repartition(n), 7, 5).collect()} for n in (1, 6))
    assert one == two
    for k, own in near.items():
        taken = [j for i, j in one if i == k]
        assert len(taken) == min(7, len(own)) and set(taken) <= own
        if len(own) <= 7:
            assert set(taken) == own


def test_renumbered_keeps_phase(spark):
    rows = spark.createDataFrame([("0|2",), ("2/1",), ("./2",), ("2",), (".",), ("12|0/3",)], "gt string")
    got = [r[0] for r in rows.select(alleles.renumbered(F.col("gt"), F.array(F.lit(2), F.lit(12)))).collect()]
    assert got == ["0|1", "1/.", "./1", "1", ".", "2|0/."]


def test_typed_tags(spark):
    rows = spark.createDataFrame([({"A": "A:x", "I": "i:-5", "F": "f:0.5", "Z": "Z:a:b", "B": "B:c,1,-2", "E": "B:S"},)], "t map<string,string>")
    t = F.col("t")
    got = rows.select(tags.letter(t["A"]), tags.integer(t["I"]), tags.number(t["I"]), tags.number(t["F"]), tags.integer(t["F"]), tags.words(t["Z"]), tags.values(t["B"]), tags.values(t["E"]), tags.values(t["Z"]), tags.words(t["none"])).first()
    assert list(got) == ["x", -5, -5.0, 0.5, None, "a:b", [1.0, -2.0], [], None, None]


def test_functions_for_sql(spark):
    published.register_python(spark, "my_")
    pairs = spark.sql("SELECT p.* FROM VALUES (10L, '1H1S2M1P1I1D1M'), (5L, CAST(NULL AS STRING)) r(pos, cigar), LATERAL my_aligned_pairs(pos, cigar) p").collect()
    assert [tuple(p) for p in pairs] == [("S", 10, 0, 1), ("M", 10, 1, 1), ("M", 11, 2, 1), ("P", 12, 3, 1), ("I", 12, 3, 1), ("D", 12, None, 1), ("M", 13, 4, 1)]
    z = spark.sql("SELECT k, my_rank_sum(v, r) AS z FROM VALUES (1, 3.0D, true), (1, 1.0D, false), (1, 1.0D, false), (2, 1.0D, true), (2, NULL, false) t(k, v, r) GROUP BY k ORDER BY k").collect()
    assert z[0]["z"] == pytest.approx((3 - 2) / math.sqrt(2 * 4 / 12)) and z[1]["z"] is None
