"""Mixing sources to target weights by pivotal dependent rounding through a reduction tree.

A source's target divided by its size is the expected number of copies of each of its documents. The whole
part is taken outright; the fraction is a probability that the pivotal method rounds: two documents trade
mass, in proportion to their sizes, until one of them is settled at 0 or 1 and the other carries on. A group
of documents is one fold that ends with at most one unsettled document; those meet in groups of the next
level until one per source is left. The mass of a source is kept in every trade, so that its taken words
miss the target by less than one document.

Only DataFrame expressions are used. Groups hold about FAN documents however large a source is; the number of
levels grows with the logarithm of the largest source. Random numbers are hashes of the row, so reruns agree.

All is decided on a narrow table: a row is known by two 64-bit hashes of its text and of what it carries, and rows
that agree in both are a number. Texts are read twice, exchanged once, to meet what was decided, and never written.

Defined results: a null text has size 0 and takes 0 words; the null source is a source of its own, last in
order; repeated rows are documents of their own; a source without words has target 0; an empty table gives an
empty result; other columns, whatever their names and types, aren't read unless they are carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.common import forget, table, words, written

WEIGHTS = (3, 1, 2)
SHARE = (150, 100)
CAP = 2
FAN = 48


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, n, target for a table of (source, size, times), times equal rows each; a null source counts as one.

    One row per source is ordered and summed; documents don't meet here.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(every) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long"))
    # Water filling: in order of the level at which a source is full, it stops at its cap if the level without it reaches that far.
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    goal = F.sum("source_size").over(whole) * share[0] / share[1]
    level = (goal - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("__level", level).withColumn("__full", cap * F.col("source_size") <= F.col("weight") * F.col("__level"))
    per = per.withColumn("__open", F.max(F.when(~F.col("__full"), F.col("__level"))).over(whole))
    return per.select("source", "source_size", "n", F.when(F.col("__full"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("__open")).alias("target"))


def _draw(seed: int, level: int, a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), a, b), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _trade(seed: int, level: int):
    """The fold's step: the carried document trades with the next one; whichever is settled goes out."""
    item = lambda key, a, p: F.struct(key.alias("key"), a.alias("a"), p.alias("p"))

    def step(state: Column, it: Column) -> Column:
        c = state["carry"]
        ratio = it["a"] / c["a"]
        up, down = F.least(1 - c["p"], it["p"] * ratio), F.least(c["p"], (1 - it["p"]) * ratio)
        rise = _draw(seed, level, c["key"], it["key"]) * (up + down) < down
        first = F.when(rise, 1 - c["p"] <= it["p"] * ratio).otherwise(c["p"] <= (1 - it["p"]) * ratio)  # the carried one is settled
        settled = F.when(first, item(c["key"], c["a"], F.when(rise, 1.0).otherwise(0.0))).otherwise(item(it["key"], it["a"], F.when(rise, 0.0).otherwise(1.0)))
        left = F.when(first, item(it["key"], it["a"], F.when(rise, it["p"] - up / ratio).otherwise(it["p"] + down / ratio))).otherwise(item(c["key"], c["a"], F.when(rise, c["p"] + up).otherwise(c["p"] - down)))
        clean = item(left["key"], left["a"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), left["p"])))
        return F.when(c.isNull(), F.struct(it.alias("carry"), state["out"].alias("out"))).otherwise(F.struct(clean.alias("carry"), F.concat(state["out"], F.array(settled)).alias("out")))

    return step


def round_pivotally(items: DataFrame, largest: int, seed: int = 0, fan: int = FAN) -> tuple[DataFrame, list[DataFrame]]:
    """(source, key, copies) for items (source, n, key, a, p), a the weight and p in [0, 1] the probability to round; and the tables it is read from.

    n is the number of the source's items, largest the greatest n; key identifies an item within its source.
    """
    kind = f"struct<key: {items.schema['key'].dataType.simpleString()}, a: double, p: double>"
    settled, tables, level, left = [], [], 0, largest
    while True:
        last = left <= fan
        groups = F.lit(0) if last else F.pmod(F.xxhash64(F.lit(seed), F.lit(-1 - level), "key"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(fan) ** (level + 1))).cast("int")))
        start = F.struct(F.lit(None).cast(kind).alias("carry"), F.array().cast(f"array<{kind}>").alias("out"))
        folded = (
            items.groupBy("source", "n", groups.alias("group"))
            .agg(F.array_sort(F.collect_list(F.struct("key", "a", "p"))).alias("items"))
            .select("source", "n", F.aggregate("items", start, _trade(seed, level)).alias("end"))
        )
        folded = written(folded, f"pivot{level}")
        tables.append(folded)
        settled.append(folded.select("source", F.explode("end.out").alias("i")).select("source", "i.key", F.col("i.p").alias("copies")))
        items = folded.where("end.carry is not null").select("source", "n", "end.carry.*")
        if last:
            final = F.when(_draw(seed, level + 1, F.col("key"), F.lit(0)) < F.col("p"), 1.0).otherwise(0.0)
            settled.append(items.select("source", "key", final.alias("copies")))
            return reduce(DataFrame.union, settled), tables
        left, level = -(-left // fan), level + 1


def _hashed(seed: int, kinds: dict[str, T.DataType]) -> Column:
    """A hash of columns, and of which of them are null; maps and variants by their JSON."""
    deep = lambda kind: any(x in kind.simpleString() for x in ("map<", "variant"))
    values = [F.to_json(F.struct(F.col(c).alias("v"))) if deep(kind) else F.col(c) for c, kind in kinds.items()]
    return F.xxhash64(F.lit(seed), *values, *[F.col(c).isNull() for c in kinds])


def mix(docs: DataFrame, carry: list[str], text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """carry columns of docs with size, source_size, target, copies and taken: every row once."""
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    carried = [f"c_{i}" for i in range(len(carry))]
    rows = docs.select(*[named(c).alias(x) for x, c in zip(carried, carry)], named(source).alias("source"), named(text).alias("text"))
    kinds = {c: rows.schema[c].dataType for c in rows.columns}
    rows = rows.withColumn("key", _hashed(1, kinds)).withColumn("other", _hashed(2, dict(reversed(kinds.items()))))
    size = F.size(words(F.col("text"))).cast("long").alias("size")
    sizes = written(rows.select("key", "other", "source", size).groupBy("key", "other", "source", "size").agg(F.count("*").alias("times")), "sizes")
    goals = written(targets(sizes), "targets")
    joined = sizes.join(F.broadcast(goals) if goals.count() <= 100_000 else goals, sizes["source"].eqNullSafe(goals["source"]), "left").drop(goals["source"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("base", F.floor(each)).withColumn("p", each - F.floor(each))
    # Equal rows are documents of their own under a running number.
    open_ = joined.where("size > 0 and p > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    one = F.struct("key", "other", "nth").alias("key")
    largest = goals.agg(F.max("n")).first()[0] or 0
    rounded, levels = round_pivotally(open_.select("source", "n", one, F.col("size").cast("double").alias("a"), "p"), largest, seed)
    extra = rounded.groupBy("key.key", "key.other").agg(F.sum("copies").cast("long").alias("extra"))
    decided = joined.join(extra, ["key", "other"], "left").select(
        "key", "other", "size", "times", "base", F.coalesce("extra", F.lit(0)).alias("extra"), F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target")
    )
    decided = written(decided, "decided")
    forget(sizes, goals, *levels)

    def met(condition: str) -> DataFrame:
        return rows.select(*carried, "key", "other").join(decided.where(condition).hint("shuffle_hash"), ["key", "other"])

    done = met("times = 1").withColumn("nth", F.lit(1))
    if not decided.where("times > 1").isEmpty():
        # Rows that are alike in all that is carried: one of them stands for all.
        kept = decided.columns[2:]
        first = met("times > 1").groupBy("key", "other").agg(F.any_value(F.struct(*carried, *kept)).alias("row")).select("key", "other", "row.*")
        again = first.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        done = done.unionByName(again)
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("nth") <= F.col("extra")).cast("long")).otherwise(F.lit(0)).cast("long")
    done = done.withColumn("copies", copies)
    return done.select(*[F.col(x).alias(c) for x, c in zip(carried, carry)], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: how many words the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
