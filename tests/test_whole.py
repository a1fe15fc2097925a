"""The queries over all rows: none left out, and both verdicts of the semi and anti joins occur."""

from locusflow.operators import caller
from locusflow.plans import catalog
from locusflow.plans import views as v

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def test_genotypes_name_the_called_alternative(spark):
    obs = v.obs(spark, SF).cache()
    alts = {(r["contig"], r["pos"]): r["alts"] for r in caller.call(obs).collect()}
    want = {}
    for r in obs.collect():
        called = alts.get((r["contig"], r["pos"]), [])
        gt = "0/." if r["base"] == r["ref_base"] else f"./{called.index(r['base']) + 1}" if r["base"] in called else "./."
        want[r["contig"], r["pos"], r["sample_idx"]] = f"{gt}:{r['base']}:{r['strand']}"
    got = {(r["contig"], r["pos"], r["sample_idx"]): r["gt"] for r in run(spark, "genotypes")}
    assert got == want and {p % 3 for _, p, _ in got} == {0, 1, 2} and {g[:3] for g in got.values()} >= {"0/.", "./1", "./2"}


def test_genotypes_of_bases_by_hand(spark):
    obs = spark.createDataFrame([("c", 1, i, b, "a") for i, b in enumerate(["A", "C", "T", "G", "N", "+A"])], "contig string, pos int, sample_idx int, base string, ref_base string")
    calls = spark.createDataFrame([("c", 1, ["T", "C"])], "contig string, pos int, alts array<string>")
    assert [r["gt"] for r in caller.genotypes(obs, calls).orderBy("sample_idx").collect()] == ["0/.", "./2", "./1", "./.", "./.", "./."]


def test_no_key_is_left_out(spark):
    n = {t: v.table(spark, SF, t).count() for t in ("part", "customer", "documents")}
    assert len(run(spark, "freq_neighbours")) == n["part"]
    assert len(run(spark, "base_composition")) == n["documents"]
    merged = run(spark, "merge_intervals")
    assert sum(r["n"] for r in merged) == n["part"] and 5 < len(merged) < n["part"]
    semi, anti = run(spark, "overlap_semi"), run(spark, "overlap_anti")
    assert semi and anti and len(semi) + len(anti) == n["customer"]
    assert 0 < len(run(spark, "missed_regions")) < n["part"]
    assert 0 < len(run(spark, "site_except")) < v.obs(spark, SF).select("contig", "pos").distinct().count()
