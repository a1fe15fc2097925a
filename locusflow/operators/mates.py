"""Overlapping mates, sources that must agree, and records picked for targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions import alleles


def settle_mates(obs: DataFrame, template: list[str], order: str, choice: Column, most: int = 200) -> DataFrame:
    """Qualities where the two reads of a template cover one position: only one of them keeps some.

    Equal bases: the one that choice picks (true: the first in order) gets the sum, at most ``most``. Different bases: the better
    one keeps four fifths; choice decides between equals. Positions with one read, or more than two, stay as they are.
    """
    keys = [*template, "contig", "pos"]
    w = Window.partitionBy(*keys)
    nth = F.row_number().over(w.orderBy(order))
    rows = obs.withColumns({"__n": F.count("*").over(w), "__nth": nth})
    ordered = w.orderBy(order)
    other = lambda c: F.when(F.col("__nth") == 1, F.lead(c).over(ordered)).otherwise(F.lag(c).over(ordered))
    rows = rows.withColumns({"__q": other("qual"), "__b": other("base")})
    chosen = F.when(F.col("__nth") == 1, choice).otherwise(~choice)
    same = F.when(chosen, F.least(F.col("qual") + F.col("__q"), F.lit(most))).otherwise(0)
    better = (F.col("qual") > F.col("__q")) | ((F.col("qual") == F.col("__q")) & chosen)
    settled = F.when(F.col("base") == F.col("__b"), same).otherwise(F.when(better, F.floor(F.col("qual") * 4 / 5)).otherwise(0))
    return rows.withColumn("qual", F.when(F.col("__n") == 2, settled.cast("int")).otherwise(F.col("qual"))).drop("__n", "__nth", "__q", "__b")


def disagreements(sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Keys at which the sources hold different values, with those values."""
    rows = reduce(DataFrame.unionByName, [s.select(*keys, value) for s in sources])
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def pick_for_targets(records: DataFrame, targets: DataFrame) -> DataFrame:
    """One record per target at its position: the first whose being an indel agrees, or else the last."""
    indel = lambda alts: F.exists(alts, lambda a: F.length(a) > 1)
    t = targets.select("contig", "pos", F.col("key").alias("target"), (indel(F.col("alts")) | (F.length("ref") > 1)).alias("want"))
    r = records.select("contig", "pos", "key", (alleles.classes(F.col("ref"), F.col("alts")).bitwiseAND(alleles.INDEL) != 0).alias("is"))
    met = t.join(r, ["contig", "pos"]).groupBy("contig", "pos", "target").agg(F.min(F.when(F.col("want") == F.col("is"), F.col("key"))).alias("agrees"), F.max("key").alias("last"))
    return met.select("contig", "pos", "target", F.coalesce("agrees", "last").alias("record"), F.col("agrees").isNotNull().alias("matched"))
