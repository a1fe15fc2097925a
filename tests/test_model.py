import math
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusflow.functions import stats
from locusflow.operators import caller, intervals, pileup
from locusflow.streaming import coverage


def em(rows, freq):
    """The model sample by sample, in plain Python."""
    like = [[1 - e if b == x else e / 3 for x in "ACGT"] for b, q in rows for e in [10 ** (-q / 10)]]

    def step(f):
        joint = [[a * b for a, b in zip(r, f)] for r in like]
        margin = [sum(r) for r in joint]
        return [sum(r[j] / m for r, m in zip(joint, margin)) / len(like) for j in range(4)], [math.log(m) for m in margin]

    freq, logs = step(freq)
    for _ in range(100):
        freq, now = step(freq)
        delta, logs = sum(abs(a - b) for a, b in zip(now, logs)), now
        if delta < 0.001:
            break
    return freq, sum(logs)


def lrt(rows, min_af):
    depth = {b: sum(x == b for x, _ in rows) for b in "ACGT"}
    n = len(rows)
    active = [b for b in "ACGT" if depth[b] and depth[b] / n >= min_af]
    fit = lambda bases: em(rows, [depth[b] / n if b in bases else 0 for b in "ACGT"])
    freq, ll = fit(active)
    chi = 0
    for k in range(len(active) - 1, 0, -1):
        tried = [(c, *fit(c)) for c in combinations(active, k)]
        c, f, own = min(tried, key=lambda t: 2 * (ll - t[2]))
        chi, ll = 2 * (ll - own), own
        if chi >= caller.ACCEPT:
            break
        active, freq = list(c), f
    return active, freq, chi


def test_calls_match_the_plain_model(spark):
    r, rows = random.Random(1), []
    for pos in range(40):
        mix = [0.97, 0.5, 0.8][pos % 3]
        for s in range(5 + pos):
            base = "A" if r.random() < mix else r.choice("CGT" if pos % 2 else "C")
            rows.append(("c1", pos, s, "A" if pos % 5 else "C", base, r.randint(10, 40)))
    obs = spark.createDataFrame(rows, "contig string, pos int, sample_idx int, ref_base string, base string, qual int")
    got = {x.pos: x for x in caller.call(obs).collect()}
    for pos in range(40):
        own = [(b, q) for _, p, _, _, b, q in rows if p == pos]
        ref = "A" if pos % 5 else "C"
        active, freq, chi = lrt(own, 0.01)
        alts = [b for b in active if b != ref]
        assert (pos in got) == bool(alts)
        if alts:
            assert got[pos].alts == alts and np.allclose(got[pos].afs, [freq["ACGT".index(b)] for b in alts], atol=1e-6) and abs(got[pos].chi - chi) < 1e-4


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ACGT"), st.integers(0, 50)), min_size=1, max_size=30))
def test_frequencies_sum_to_one(rows):
    classes = [[{"base": b, "qual": q, "n": 1} for b, q in rows]]
    weight, like, depth = caller._padded(classes)
    freq, _ = caller.expect(weight, like, depth / depth.sum(1)[:, None])
    assert abs(freq.sum() - 1) < 1e-6 or np.isnan(freq).any() or not freq.any() or (min(q for _, q in rows) == 0)


def test_golden_statistics(spark):
    cases = [(345, 455, 260, 345, 0.956677864), (8, 4, 4, 9, 0.115238544), (10, 5, 4, 9, 0.128346121), (3, 4, 4, 5, 1.0), (1, 1, 1, 1, 1.0)]
    frame = spark.createDataFrame(cases, "a bigint, b bigint, c bigint, d bigint, want double")
    for row in frame.select(stats.fisher(*map(F.col, "abcd")).alias("p"), stats.fisher(*map(F.col, "cdab")).alias("q"), "want").collect():
        assert row.p == pytest.approx(row.want, abs=1e-6) and row.q == pytest.approx(row.p, abs=1e-9)
    assert spark.range(1).select(stats.chi2_tail(F.lit(24.0))).first()[0] == pytest.approx(9.63357e-07, rel=1e-5)
    one, two = [1, 5, 3, 10, 3, 3, 4, 5], [6, 7, 2, 2, 8, 9, 10]
    obs = spark.createDataFrame([("c", 1, "A", b, v) for b, x in (("A", one), ("C", two)) for v in x], "contig string, pos int, ref_base string, base string, mapq int")
    assert 10 ** (-pileup.ranksum(obs, "mapq").first().phred / 10) == pytest.approx(0.271588674, abs=1e-6)


def test_slices_and_joins_match_brute_force(spark):
    region = spark.createDataFrame([("chr1", 5, 200)], "contig string, beg bigint, end bigint")
    assert [(r.beg, r.end) for r in intervals.slices(region, 7).orderBy("beg").collect()] == [(5, 32), (33, 60), (61, 88), (89, 116), (117, 144), (145, 172), (173, 200)]
    r = random.Random(3)
    make = lambda n: [(i, r.choice("xy"), b, b + r.choice([0, 3, 70, 400])) for i in range(n) for b in [r.randint(-50, 900)]]
    left, right = make(60), make(60)
    frame = lambda rows: spark.createDataFrame(rows, "id int, contig string, beg bigint, end bigint")
    got = sorted((x.l_id, x.r_id) for x in intervals.overlap_join(frame(left), frame(right), width=32).collect())
    assert got == sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2])


def test_results_do_not_depend_on_partitions(spark):
    r = random.Random(2)
    rows = [("c", r.randint(1, 9), s, r.choice("ACGT"), r.choice("ACGTN"), r.randint(1, 40), r.choice("+-")) for s in range(300)]
    obs = spark.createDataFrame(rows, "contig string, pos int, sample_idx int, ref_base string, base string, qual int, strand string").withColumn("ref_base", F.lit("A"))
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, pileup.coverage(obs.repartition(int(n))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert got[0] == got[1]


def test_streaming_depth_equals_batch(spark, tmp_path):
    rows = [("c", i % 3, "ACGT"[i % 4]) for i in range(40)]
    batch = spark.createDataFrame(rows, "contig string, pos int, base string")
    for k in range(2):
        batch.where(F.col("pos") % 2 == k).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = coverage.running_depth(stream).writeStream.outputMode("complete").format("memory").queryName("depth").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("depth").collect())) == sorted(map(tuple, coverage.running_depth(batch).collect()))
