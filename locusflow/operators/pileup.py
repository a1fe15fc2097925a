"""Observations by position: first read wins, depths, strand counts, the coverage report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions import cigar as cg
from locusflow.functions import stats

BASES = ("A", "C", "G", "T")
SITE = ["contig", "pos"]


def first_wins(obs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by the order column. A partial minimum runs before the exchange; no sort."""
    rest = [c for c in obs.columns if c not in keys]
    return obs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__first")).select(*keys, "__first.*").select(*obs.columns)


def is_base(base: Column) -> Column:
    return base.isin(*BASES)


def base_depth(obs: DataFrame) -> DataFrame:
    """Covered samples, depth of A, C, G and T, and the indels as allele|n,... or '.', by position."""
    counts = obs.groupBy(*SITE, "ref_base", "base").agg(F.count("*").alias("n"))
    indel = ~is_base(F.col("base")) & (F.col("base") != "N")
    listed = F.array_join(F.array_sort(F.collect_list(F.when(indel, F.concat("base", F.lit("|"), F.col("n").cast("string"))))), ",")
    return counts.groupBy(*SITE, "ref_base").agg(
        F.sum(F.when(F.col("base") != "N", F.col("n")).otherwise(0)).alias("covered"),
        *[F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).alias(f"depth_{b}") for b in BASES],
        F.when(listed == "", ".").otherwise(listed).alias("indels"),
    )


def strand_counts(obs: DataFrame) -> DataFrame:
    """Reference and other bases by strand; the depth is that of the four bases."""
    ref, fwd = F.col("base") == F.upper("ref_base"), F.col("strand") == "+"
    n = lambda c: F.count_if(c)
    return obs.where(is_base(F.col("base"))).groupBy(*SITE, "ref_base").agg(
        F.count("*").alias("depth"), n(ref & fwd).alias("ref_fwd"), n(ref & ~fwd).alias("ref_rev"), n(~ref & fwd).alias("alt_fwd"), n(~ref & ~fwd).alias("alt_rev")
    )


def coverage(obs: DataFrame) -> DataFrame:
    """The coverage report: depths, indels, strand counts, FS and SOR of every position with a base; one pass over obs."""
    fwd = F.count_if(F.col("strand") == "+")
    counts = obs.groupBy(*SITE, "ref_base", "base").agg(F.count("*").alias("n"), fwd.alias("fwd"))
    base, four_bases = F.col("base"), is_base(F.col("base"))
    ref = four_bases & (base == F.upper("ref_base"))
    sum_if = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    indel = ~four_bases & (base != "N")
    listed = F.array_join(F.array_sort(F.collect_list(F.when(indel, F.concat("base", F.lit("|"), F.col("n").cast("string"))))), ",")
    n, plus, minus = F.col("n"), F.col("fwd"), F.col("n") - F.col("fwd")
    sites = counts.groupBy(*SITE, "ref_base").agg(
        sum_if(base != "N", n).alias("covered"), *[sum_if(base == b, n).alias(f"depth_{b}") for b in BASES], F.when(listed == "", ".").otherwise(listed).alias("indels"), sum_if(four_bases, n).alias("depth"),
        sum_if(ref, plus).alias("ref_fwd"), sum_if(ref, minus).alias("ref_rev"), sum_if(four_bases & ~ref, plus).alias("alt_fwd"), sum_if(four_bases & ~ref, minus).alias("alt_rev"),
    )
    four = [F.col(c) for c in ("ref_fwd", "ref_rev", "alt_fwd", "alt_rev")]
    return sites.where("depth > 0").withColumn("fs", stats.fisher_phred(*four)).withColumn("sor", stats.odds_ratio(*four))


def ranksum(obs: DataFrame, value: str) -> DataFrame:
    """Phred-scaled rank-sum p of a value, reference against other bases: average ranks of ties, no corrections."""
    return ranksums(obs.withColumn("__value", F.col(value)), {"": "__value"}).drop("name")


def ranksums(obs: DataFrame, values: dict[str, str]) -> DataFrame:
    """The same for several whole-numbered values, one row for each and position; observations are read once and count by value before they are exchanged."""
    keys = [*SITE, "name"]
    rows = obs.where(is_base(F.col("base"))).withColumn("is_ref", F.col("base") == F.upper("ref_base"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in values.items()])).alias("v")
    rows, value = rows.select("contig", "pos", "is_ref", each).select("contig", "pos", "is_ref", "v.*"), "value"
    by_value = rows.groupBy(*keys, value).agg(F.count_if("is_ref").alias("r"), F.count_if(~F.col("is_ref")).alias("a"))
    above = Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.col("r") + F.col("a")).over(above), F.lit(0))
    ranked = by_value.withColumn("rank", ahead + (F.col("r") + F.col("a") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("r").alias("n1"), F.sum("a").alias("n2"), F.sum(F.col("r") * F.col("rank")).alias("r1"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    z = F.abs(F.col("r1") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    # Columns of their own, as the expressions that follow use them many times.
    tested = sums.withColumn("z", F.when((n1 > 0) & (n2 > 0), z)).withColumn("p", 2 * stats.normal_tail(F.col("z")))
    return tested.select(*keys, n1.alias("n1"), n2.alias("n2"), stats.phred(F.col("p")).alias("phred"))


def collected(obs: DataFrame) -> DataFrame:
    """One row per position with its observations in sample order."""
    item = F.struct("sample_idx", "base", "qual", "mapq", "rank", "strand")
    return obs.groupBy(*SITE, "ref_base").agg(F.array_sort(F.collect_list(item)).alias("observations"))


#: Reference bases of a stretch whose running depth is summed in one task.
STRETCH = 4096


def cigar_coverage(reads: DataFrame) -> DataFrame:
    """contig, pos, and how many alignments match there, insert or clip before it, or delete from it on.

    No row is made for a base under an alignment: a matched block is a step up where it begins and a step down behind
    its end. Steps are summed by place before the exchange; the depth is their running sum inside a stretch of the
    reference, with the steps of earlier stretches added, and lasts up to the next step.
    """
    b = F.explode(cg.placed(cg.blocks(F.col("cigar")))).alias("b")
    placed = reads.select("contig", "pos", b).select("contig", (F.col("pos") + F.col("b.rpos")).cast("bigint").alias("pos"), F.col("b.op").alias("op"), F.col("b.len").alias("len"))
    match = F.col("op").isin(*cg.MATCH)
    event = lambda at, step, kind: F.struct(at.alias("pos"), F.lit(step).alias("step"), kind.alias("kind"))
    none = F.lit(None).cast("string")
    two = F.array(event(F.col("pos"), 1, none), event(F.col("pos") + F.col("len"), -1, none))
    events = placed.where(match | F.col("op").isin("I", "D", "S")).select("contig", F.explode(F.when(match, two).otherwise(F.array(event(F.col("pos"), 0, F.col("op"))))).alias("e")).select("contig", "e.*")
    n = lambda op: F.count_if(F.col("kind") == op)
    places = events.groupBy("contig", "pos").agg(F.sum("step").alias("step"), n("I").alias("insertions"), n("D").alias("deletions"), n("S").alias("clips"))
    places = places.withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    # One row for each stretch: the depth that its earlier ones leave, and a place at its start to carry it.
    ends = Window.partitionBy("contig").orderBy("stretch")
    per = places.groupBy("contig", "stretch").agg(F.sum("step").alias("gain"))
    per = per.withColumn("left", F.sum("gain").over(ends.rowsBetween(Window.unboundedPreceding, 0))).withColumn("upto", F.coalesce(F.lead("stretch").over(ends), F.col("stretch")))
    zero = F.lit(0).cast("bigint")
    carried = per.where("left > 0").select("contig", F.explode(F.sequence(F.col("stretch") + 1, F.col("upto"))).alias("stretch"), F.col("left").alias("step"))
    carried = carried.where(F.col("stretch").isNotNull()).select("contig", (F.col("stretch") * STRETCH).alias("pos"), "step", zero.alias("insertions"), zero.alias("deletions"), zero.alias("clips"), "stretch")
    inside = Window.partitionBy("contig", "stretch").orderBy("pos", "carried")
    steps = places.withColumn("carried", F.lit(1)).unionByName(carried.withColumn("carried", F.lit(0)))
    steps = steps.withColumn("matched", F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.coalesce(F.lead("pos").over(inside), (F.col("stretch") + 1) * STRETCH))
    first = F.struct(F.col("pos").alias("pos"), F.when(F.col("until") > F.col("pos"), F.col("matched")).otherwise(0).alias("matched"), "insertions", "deletions", "clips")
    later = F.when((F.col("matched") > 0) & (F.col("until") > F.col("pos") + 1), F.transform(F.sequence(F.col("pos") + 1, F.col("until") - 1), lambda p: F.struct(p.alias("pos"), F.col("matched").alias("matched"), zero.alias("insertions"), zero.alias("deletions"), zero.alias("clips"))))
    rows = steps.select("contig", F.explode(F.concat(F.array(first), F.coalesce(later, F.array()))).alias("r")).select("contig", "r.*")
    # A place where a stretch begins can stand twice: what was carried, and its own events.
    return rows.groupBy("contig", "pos").agg(*[F.sum(c).alias(c) for c in ("matched", "insertions", "deletions", "clips")]).where("matched + insertions + deletions + clips > 0")


def pair_counts(reads: DataFrame) -> DataFrame:
    """op, pos, qpos, n and times: how many alignments have each row of cigar.aligned_pairs.

    No row is made for a matched base: a block keeps pos - qpos, so that among the blocks of one such difference it is a
    step up where it begins in the query and a step down behind its end. Steps are summed by place before the exchange.
    """
    b = F.explode(cg.placed(cg.blocks(F.col("cigar")))).alias("b")
    own = reads.select("pos", b).select(F.col("b.op").alias("op"), (F.col("pos") + F.col("b.rpos")).cast("bigint").alias("pos"), F.col("b.qpos").alias("qpos"), F.col("b.len").alias("n")).where("op <> 'H'")
    match = F.col("op").isin(*cg.MATCH)
    event = lambda ahead, at, n, step: F.struct(ahead.alias("ahead"), at.alias("at"), n.alias("n"), F.lit(step).alias("step"))
    ahead, one = F.col("pos") - F.col("qpos"), F.lit(1)
    two = F.array(event(ahead, F.col("qpos"), one, 1), event(ahead, F.col("qpos") + F.col("n"), one, -1))
    other = F.array(event(F.col("pos"), F.when(F.col("op").isin(*cg.QUERY, "P"), F.col("qpos")), F.col("n"), 1))
    steps = own.where(~match | (F.col("n") > 0)).select("op", F.explode(F.when(match, two).otherwise(other)).alias("e")).groupBy("op", "e.ahead", "e.at", "e.n").agg(F.sum("e.step").alias("step"))
    line = Window.partitionBy("op", "ahead").orderBy("at")
    runs = steps.withColumn("sum", F.sum("step").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("at").over(line))
    runs = runs.where(~match | (F.col("sum") > 0)).withColumn("qpos", F.when(match, F.sequence(F.col("at"), F.col("until") - 1)).otherwise(F.array("at")))
    each = runs.select("op", "ahead", F.explode("qpos").alias("qpos"), "n", F.when(match, F.col("sum")).otherwise(F.col("step")).alias("times"))
    return each.select("op", F.when(match, F.col("ahead") + F.col("qpos")).otherwise(F.col("ahead")).alias("pos"), "qpos", "n", "times")


def entry_sums(reads: DataFrame) -> DataFrame:
    """contig, pos, and over the entries there (cigar.pileup_entries): depth, sums of qpos and indel, deletions, heads and tails.

    No row is made for an entry: between the places where blocks begin or end, the depth stays and the sum of qpos is a
    line over pos. What these change by is summed by place before the exchange; running sums inside a stretch of the
    reference, with the changes of earlier stretches added, give the entries' sums.
    """
    steps, points = ["depth", "slope", "level", "dels"], ["indel", "heads", "tails"]
    on = F.filter(cg.placed(cg.blocks(F.col("cigar"))), lambda b: b["op"].isin(*cg.REFERENCE, "I"))
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  each value is computed once

    def followed(v: Column) -> Column:
        def with_next(b: Column, i: Column) -> Column:
            return bound(F.get(v["on"], i + 1), lambda after: F.struct(b["op"].alias("op"), b["len"].alias("len"), b["qpos"].alias("qpos"), b["rpos"].alias("rpos"), v["last"].alias("last"), F.when(after["op"] == "I", after["len"]).when(after["op"] == "D", -after["len"]).otherwise(0).alias("step")))

        return F.transform(v["on"], with_next)

    blocks = bound(bound(on, lambda o: F.struct(o.alias("on"), (cg.span(o, cg.REFERENCE) - 1).alias("last"))), followed)
    own = reads.select("contig", "pos", F.explode(blocks).alias("b")).where(F.col("b.op").isin(*cg.REFERENCE) & (F.col("b.len") > 0))
    match, whole = F.col("b.op").isin(*cg.MATCH), lambda x: (F.lit(x) if isinstance(x, int) else x).cast("bigint")
    own = own.select(
        "contig", whole(F.col("pos") + F.col("b.rpos")).alias("at"), F.col("b.len").alias("len"), whole(match).alias("slope"), F.col("b.qpos").alias("qpos"), whole(F.col("b.op") == "D").alias("dels"),
        whole(F.when(match, F.col("b.step")).otherwise(0)).alias("indel"), whole(F.col("b.rpos") == 0).alias("heads"), whole(F.col("b.rpos") + F.col("b.len") - 1 == F.col("b.last")).alias("tails"),
    )
    level = F.col("qpos") - F.col("slope") * F.col("at")
    event = lambda at, sign, *points: F.struct(at.alias("pos"), *[whole(x * sign).alias(n) for n, x in zip(steps, (F.lit(1), F.col("slope"), level, F.col("dels")))], *[whole(x).alias(n) for n, x in zip(("indel", "heads", "tails"), points)])
    end = F.col("at") + F.col("len")
    three = F.array(event(F.col("at"), 1, 0, F.col("heads"), 0), event(end, -1, 0, 0, 0), F.when((F.col("indel") != 0) | (F.col("tails") > 0), event(end - 1, 0, F.col("indel"), 0, F.col("tails"))))
    events = own.select("contig", F.explode(three).alias("e")).where("e is not null").select("contig", "e.*")
    places = events.groupBy("contig", "pos").agg(*[F.sum(c).alias(c) for c in steps + points]).withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    # One row for each stretch: what its earlier ones leave, and a place at its start to carry it.
    ends = Window.partitionBy("contig").orderBy("stretch")
    per = places.groupBy("contig", "stretch").agg(*[F.sum(c).alias(c) for c in steps])
    per = per.select("contig", F.coalesce(F.lead("stretch").over(ends), F.col("stretch")).alias("upto"), "stretch", *[F.sum(c).over(ends.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in steps])
    carried = per.where("depth > 0").select("contig", F.explode(F.sequence(F.col("stretch") + 1, F.col("upto"))).alias("stretch"), *steps)
    carried = carried.select("contig", (F.col("stretch") * STRETCH).alias("pos"), *steps, *[whole(0).alias(c) for c in points], "stretch")
    inside = Window.partitionBy("contig", "stretch").orderBy("pos", "own")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = places.withColumn("own", F.lit(1)).unionByName(carried.withColumn("own", F.lit(0)))
    rows = rows.select("contig", "pos", *[F.sum(c).over(upto).alias(c) for c in steps], *points, F.coalesce(F.lead("pos").over(inside), (F.col("stretch") + 1) * STRETCH).alias("until"))
    # A stretch's start can stand twice, what was carried and its own events: the first has no places then.
    rows = rows.where("depth > 0 AND until > pos").select("contig", "pos", F.explode(F.sequence(F.col("pos"), F.col("until") - 1)).alias("p"), *steps, *points)
    first = lambda c: F.when(F.col("p") == F.col("pos"), F.col(c)).otherwise(whole(0)).alias(c)
    return rows.select("contig", F.col("p").alias("pos"), "depth", (F.col("level") + F.col("slope") * F.col("p")).alias("qpos"), first("indel"), "dels", first("heads"), first("tails"))
