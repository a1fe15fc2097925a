"""Closed intervals: overlap joins by bins, merging, semi and anti joins, annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the finest bins, and how many times as wide those of the next level are.
BIN, STEP = 64, 8
#: Reference bases of a span that one task merges.
SPAN = 1 << 20


def normalised(df: DataFrame, beg: str = "beg", end: str = "end") -> DataFrame:
    """Reversed intervals are turned round."""
    return df.withColumns({beg: F.least(beg, end), end: F.greatest(beg, end)})


def overlap_length(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(b1, b2) + 1, F.lit(0))


def _level(df: DataFrame, width: int) -> Column:
    """The finest level whose bins are at least as wide as the interval is long; bins of a level are STEP times as wide as those of the level below."""
    size = F.greatest(F.col("end") - F.col("beg") + 1, F.lit(1))
    return F.greatest(F.ceil(F.log(size / F.lit(float(width))) / F.log(F.lit(float(STEP)))), F.lit(0)).cast("int")


def _on(level: int):
    return lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin"))


def _binned(df: DataFrame, width: int, own: list[int], other: list[int]) -> DataFrame:
    """A row for each of the few bins that an interval meets on its own level and on the coarser levels that the other side has."""
    cells = []
    for level in sorted({*own, *other}):
        size = width * STEP**level
        used = (F.col("__level") == level) if level not in other else (F.col("__level") <= level)
        bins = F.sequence(F.floor(F.col("beg") / size), F.floor(F.col("end") / size))
        cells.append(F.when(used, F.transform(bins, _on(level))))
    every = F.flatten(F.filter(F.array(*cells), lambda c: c.isNotNull()))
    return df.withColumn("__cell", F.explode(every))


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN, on: list[str] | None = None) -> DataFrame:
    """All overlapping pairs of (contig, beg, end) intervals, each once: left columns as l_*, right as r_*.

    An equi-join on contig, level and bin: an interval meets two or three bins of its level however long it is, and a
    pair meets on the coarser level of its two. A pair belongs to the later of the two first bins, so no distinct is
    needed. Which levels there are is asked of both sides first, a handful of numbers. All that a long interval meets
    shares its coarse bins: large partitions of them are split by the adaptive skew join, which may repeat the few long ones.
    on: further columns that must be equal.
    """
    left, right = left.withColumn("__level", _level(left, width)), right.withColumn("__level", _level(right, width))
    found = left.select(F.lit(0), "__level").union(right.select(F.lit(1), "__level")).distinct().collect()  # one job, a number for each level
    levels = [[level for side, level in found if side == k] for k in (0, 1)]
    named = lambda df, p, *sides: _binned(df, width, *sides).select(F.col("__cell.level").alias(f"{p}level"), F.col("__cell.bin").alias(f"{p}bin"), F.col("__level").alias(f"{p}own"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "__level"])
    l, r = named(left, "l", levels[0], levels[1]), named(right, "r", levels[1], levels[0])  # noqa: E741
    same = (F.col("l_contig") == F.col("r_contig")) & (F.col("llevel") == F.col("rlevel")) & (F.col("lbin") == F.col("rbin"))
    for c in on or []:
        same = same & (F.col(f"l_{c}") == F.col(f"r_{c}"))
    meets = (F.col("l_beg") <= F.col("r_end")) & (F.col("l_end") >= F.col("r_beg")) & (F.col("llevel") == F.greatest("lown", "rown"))
    wide = F.lit(width) * F.pow(F.lit(float(STEP)), F.col("llevel")).cast("bigint")
    owner = F.col("lbin") == F.floor(F.greatest("l_beg", "r_beg") / wide)
    return l.join(r, same & meets & owner).drop("llevel", "rlevel", "lbin", "rbin", "lown", "rown")


def merge(df: DataFrame, span: int = SPAN) -> DataFrame:
    """Overlapping or touching intervals of a contig as one, with the number merged.

    A contig is cut into spans by where intervals begin. Each span's task needs two numbers from the spans before it:
    how far their intervals reach, and how many islands they begin; both come from a row for each span.
    Equal intervals are counted as one row first: which of them stands first would differ from one sort to the next.
    """
    rows = df.groupBy("contig", "beg", "end").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("beg") / span))
    earlier = Window.partitionBy("contig").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy("contig", "part").agg(F.max("end").alias("far")).withColumn("reach", F.max("far").over(earlier)).drop("far")
    inside = Window.partitionBy("contig", "part").orderBy("beg", "end")
    before = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("reach"))  # greatest passes over nulls
    flagged = rows.join(reach, ["contig", "part"]).withColumn("fresh", F.when(F.col("beg") <= before + 1, 0).otherwise(1))
    begun = flagged.groupBy("contig", "part").agg(F.sum("fresh").alias("own")).withColumn("begun", F.coalesce(F.sum("own").over(earlier), F.lit(0))).drop("own")
    island = F.col("begun") + F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.join(begun, ["contig", "part"]).select("contig", "beg", "end", "n", island.alias("island")).groupBy("contig", "island").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("island")


def overlapping(left: DataFrame, right: DataFrame, key: str, keep: bool = True, width: int = BIN) -> DataFrame:
    """left's rows that overlap some interval of right, or none. key identifies a row of left."""
    hit = overlap_join(left.select(key, "contig", "beg", "end"), right.select("contig", "beg", "end"), width).select(F.col(f"l_{key}").alias(key)).distinct()
    return left.join(hit, key, "left_semi" if keep else "left_anti")


def not_overlapping(left: DataFrame, right: DataFrame, key: str, width: int = BIN) -> DataFrame:
    return overlapping(left, right, key, False, width)


def overlap_fraction(pairs: DataFrame, least: float, of: str = "either") -> DataFrame:
    """Pairs whose overlap is at least a share of the left interval, the right one, either or both."""
    shared = overlap_length(F.col("l_beg"), F.col("l_end"), F.col("r_beg"), F.col("r_end"))
    ok = {s: shared >= least * (F.col(f"{s}_end") - F.col(f"{s}_beg") + 1) for s in "lr"}
    return pairs.where({"left": ok["l"], "right": ok["r"], "either": ok["l"] | ok["r"], "both": ok["l"] & ok["r"]}[of])


def annotate(targets: DataFrame, source: DataFrame, key: str, column: str, match: list[str] | None = None, most: int | None = None, repeats: bool = False, empty: str = ".") -> DataFrame:
    """targets with the source column's values over it, in source order, joined by commas; the count, the bases covered and their share.

    The bases covered are those of the union of the overlaps.
    """
    pairs = overlap_join(targets, source, on=match)
    lo, hi = F.greatest("l_beg", "r_beg"), F.least("l_end", "r_end")
    clipped = pairs.select(F.col(f"l_{key}").alias(key), lo.alias("lo"), hi.alias("hi"), F.col("r_beg"), F.col("r_end"), F.col(f"r_{column}").alias("value"))
    w = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(w) + 1, F.col("lo"))) + 1)
    values = F.transform(F.array_sort(F.collect_list(F.struct("r_beg", "r_end", "value"))), lambda x: x["value"])
    values = values if repeats else F.array_distinct(values)
    values = F.slice(values, 1, most) if most else values
    per = clipped.withColumn("fresh", fresh).groupBy(key).agg(F.array_join(values, ",").alias("values"), F.count("*").alias("cnt"), F.sum("fresh").alias("nbp"))
    joined = targets.join(per, key, "left")
    return joined.withColumns({"values": F.coalesce("values", F.lit(empty)), "cnt": F.coalesce("cnt", F.lit(0)), "nbp": F.coalesce("nbp", F.lit(0))}).withColumn("frac", F.col("nbp") / (F.col("end") - F.col("beg") + 1))


def windows(contigs: DataFrame, step: int) -> DataFrame:
    """Fixed windows of step bases over (contig, length)."""
    start = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("length").cast("bigint"), F.lit(step).cast("bigint")))
    return contigs.select("contig", "length", start.alias("beg")).select("contig", "beg", F.least(F.col("beg") + step - 1, F.col("length").cast("bigint")).alias("end"))


def slices(regions: DataFrame, n: int) -> DataFrame:
    """Each region cut into n parts of equal length, the last one shorter if need be."""
    size = F.ceil((F.col("end") - F.col("beg") + 1) / n)
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cut = regions.select("contig", "beg", "end", size.alias("size"), i.alias("i"))
    beg = F.col("beg") + F.col("i") * F.col("size")
    return cut.select("contig", beg.alias("beg"), F.least(beg + F.col("size") - 1, F.col("end")).alias("end")).where("beg <= end")
