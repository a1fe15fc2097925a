"""What shows only on larger tables or longer values than the smallest tables have."""

import base64
import hashlib

from pyspark.sql import functions as F

from locusflow.functions import cigar as cg
from locusflow.functions import published
from locusflow.operators import caller, modifications, pileup, realign, report
from locusflow.operators import intervals as iv
from locusflow.plans import calls, catalog


def test_equal_intervals_merge_as_one(spark):
    """Fifty islands of seven equal intervals each, whichever of them a sort puts first."""
    df = spark.createDataFrame([("c", 100 * i, 100 * i + 5) for i in range(50) for _ in range(7)], "contig string, beg bigint, end bigint").repartition(5)
    for span in (1000, iv.SPAN):
        assert sorted((r["beg"], r["end"], r["n"]) for r in iv.merge(df, span).collect()) == [(100 * i, 100 * i + 5, 7) for i in range(50)]


def test_long_addresses_stay_on_one_line(spark, tmp_path):
    """Base 64 of more than 76 characters."""
    urls = ["http://a.example/" + "x" * n for n in (10, 40, 41, 200)] + ["http://é.example/ü", "", None]
    spark.createDataFrame([(i, u, u) for i, u in enumerate(urls)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["md5"], r["url64"]) for r in catalog.QUERIES["digests"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if u is None else (hashlib.md5(u.encode()).hexdigest(), base64.b64encode(u.encode()).decode()) for i, u in enumerate(urls)}


def test_sampled_neighbours_carry_their_frequency(spark):
    """The table of frequencies is read for the ranks alone: joined back to them, it was broadcast whole."""
    f = spark.createDataFrame([(i, float((i + 1) ** 2)) for i in range(200)], "key bigint, freq double")
    drawn = calls.sampled_neighbours(f, 3)
    marks = calls.ranked_bounds(f)
    relations = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert relations(drawn) == 2 * relations(marks)
    rows = drawn.collect()
    assert {r["key"] for r in rows} == set(range(200)) and all(r["freq"] == (r["key"] + 1) ** 2 and r["neighbour_freq"] == (r["neighbour"] + 1) ** 2 for r in rows)


def test_lines_of_samples_that_none_observes(spark):
    """Samples in runs before, between and behind the observed ones, and one that isn't listed; a cell costs no look at the observations."""
    obs = spark.createDataFrame([("c", 1, s, b, 30, 20, "+", 5, "A") for s, b in [(3, "A"), (4, "T"), (5, "T"), (900, "T"), (996, "A"), (5000, "T")]], "contig string, pos int, sample_idx int, base string, qual int, mapq int, strand string, rank int, ref_base string")
    groups, samples = spark.createDataFrame([], "sample_idx int, group string"), spark.range(1000).select(F.col("id").cast("int").alias("sample_idx"))
    found = report.variant_lines(obs, caller.call(obs), groups, samples)
    assert "element_at" not in found._jdf.queryExecution().optimizedPlan().toString()
    cells = found.collect()[0]["line"].split("\t")[9:]
    assert len(cells) == 1000 and {i: x[:5] for i, x in enumerate(cells) if x != "./."} == {3: "0/.:A", 4: "./1:T", 5: "./1:T", 900: "./1:T", 996: "0/.:A"}


READS = [("a", "c", 4090, "1H2S4M2I1P3M2D1N5M1S"), ("b", "c", 4095, "3M"), ("c", "c", 4096, "2D3M1I4=1X"), ("d", "c", 4090, "1H2S4M2I1P3M2D1N5M1S"), ("e", "d", 1, "9000M"), ("f", "c", 7, "*"), ("g", "c", 7, None), ("h", "d", 20000, "5I"), ("i", "d", 4097, "1M2N1M")]


def test_sums_without_a_row_for_each_base(spark):
    """Running sums over blocks against the entries and pairs one by one; no explode over the bases of a block comes before the exchange."""
    reads = spark.createDataFrame(READS, "qname string, contig string, pos bigint, cigar string")
    placed = reads.withColumn("placed", cg.placed(cg.blocks(F.col("cigar"))))
    e = placed.select("contig", F.explode(cg.pileup_entries(F.col("pos"), F.col("placed"))).alias("e")).select("contig", "e.*")
    want = e.groupBy("contig", "pos").agg(F.count("*").alias("depth"), F.sum("qpos").alias("qpos"), F.sum("indel").alias("indel"), F.count_if("is_del").alias("dels"), F.count_if("is_head").alias("heads"), F.count_if("is_tail").alias("tails"))
    assert sorted(map(tuple, pileup.entry_sums(reads).collect())) == sorted(map(tuple, want.collect()))
    each = placed.select(F.explode(cg.aligned_pairs(F.col("pos"), F.col("placed"))).alias("p")).select("p.*").groupBy("op", "pos", "qpos", "n").agg(F.count("*").alias("times"))
    assert sorted(map(repr, pileup.pair_counts(reads).collect())) == sorted(map(repr, each.collect()))


def test_pairs_for_sql_stay_in_the_jvm(spark):
    published.register_python(spark, "its_")
    reads = spark.createDataFrame([*READS, ("j", "c", None, "3M")], "qname string, contig string, pos bigint, cigar string")
    got = spark.sql("SELECT r.qname, p.* FROM {reads} r, LATERAL its_aligned_pairs(r.pos, r.cigar) p", reads=reads)
    assert "Python" not in got._jdf.queryExecution().optimizedPlan().toString()
    placed = reads.where("pos is not null").withColumn("placed", cg.placed(cg.blocks(F.col("cigar"))))
    want = placed.select("qname", F.explode(cg.aligned_pairs(F.col("pos"), F.col("placed"))).alias("p")).select("qname", "p.*")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_reference_of_reads_without_an_exchange_by_key(spark):
    """Reads on one chunk, on two and on more, before and beyond the reference; equal reads near the contig's start and far from it."""
    text = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(500))
    reference = spark.createDataFrame([("c", i + 1, text[i : i + 64]) for i in range(0, 500, 64)], "contig string, start bigint, seq string")
    rows = [(i, c, p, f"{n}M") for i, (c, p, n) in enumerate([("c", 1, 5), ("c", 60, 10), ("c", 64, 65), ("c", 2, 300), ("c", 490, 30), ("c", 900, 5), ("x", 1, 5), (None, None, 3), ("c", 130, 62), ("c", 129, 128)])]
    near = realign.with_reference(spark.createDataFrame(rows, "key int, contig string, pos bigint, cigar string"), reference, "key", 1, 64)
    assert "__start" in near._jdf.queryExecution().optimizedPlan().toString()  # of the chunk and the next one; only long reads are grouped by key
    want = {i: "" if c != "c" else text[max(1, p - 1) - 1 : p + int(g[:-1])] for i, c, p, g in rows}
    assert {r["key"]: r["ref"] for r in near.collect()} == want


def test_equal_reads_are_aligned_once(spark):
    reads = [(p, p, 0, "2S8M1I9M", "ACGTACGTACGTACGTACGT"[:20], "I" * 20) for p in (1, 3, 40, 44, 48, 400)] + [(9, 9, 4, "20M", "A" * 20, "I" * 20), (10, 10, 0, "20M", "A" * 20, None)]
    reference = spark.createDataFrame([("c", 1, "CGTA" * 256)], "contig string, start bigint, seq string")
    df = spark.createDataFrame([(*r, "c") for r in reads], "key int, pos bigint, flag int, cigar string, seq string, qual string, contig string").coalesce(1)
    near = realign.with_reference(df, reference, "key", realign.margin(), 1024)
    got = {r["key"]: (r["bq"], r["left"]) for r in realign.with_base_alignment(near).coalesce(1).collect()}
    for r in near.collect():
        ops = [(op, int(n)) for n, op in realign.OPERATION.findall(r["cigar"])]
        (bq,) = realign.base_alignment([(r["flag"], r["pos"], ops, r["seq"], r["qual"], r["ref"], r["ref_beg"])])
        assert got[r["key"]][0] == bq and (bq is None) == (r["key"] in (9, 10))
    assert got[400] == got[48] == got[44]


def test_places_of_equal_short_reads_are_found_once():
    modifications._held_places.cache_clear()
    for seq in ("ACGCc" * 4, "ACGCc" * 4, "ACGCC" * 400):
        assert [x[0] for x in modifications.called(seq, False, "C+m,1,2;")] == [3, 8]
        assert [x[0] for x in modifications.called(seq, True, "C+m,0;")] == [len(seq) - 3]
    assert modifications._held_places.cache_info().misses == 2 and modifications._held_places.cache_info().hits == 2
