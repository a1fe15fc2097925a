"""Divergence of sources: how the terms of each source of a lang are spread, against each other source and the lang.

CountVectorizer learns each lang's vocabulary (terms in at least MIN_DOCS of its documents, vocabSize at the largest
integer, so that none is cut off) and turns documents into exact sparse vectors; their sums by (lang, source) are
sparse too, and pairs of sources are evaluated from what is in the sums. A term bears its lang in front, so that one
fit serves all langs and counts each lang's documents apart.

A task folds the documents of a group that it holds together before they are counted: a term of d of them stands in
min(d, MIN_DOCS) rows, and each row says how often its terms count. Rows with a term are MIN_DOCS or more where documents
with it are, and the rows' vectors, each taken so often, have the documents' sums.

The driver and the executors hold the vocabulary of a fit. Its size is therefore bounded: terms are dealt by hash into
shards, and shards of TERMS distinct terms in all share a fit over their own terms of every document; larger ones are split. Shards share
no term, so the sums are the same, and no shard's vocabulary grows with the input.

All arithmetic is of integers. A share is p = 1 + floor(10^9 * (count + smooth) / (N + smooth * V)), by long division
in thousands, so that nothing overflows below 9 * 10^15 words. Of two sources most terms are in neither: with the
shares p0, q0 of terms that don't occur, the sum over all V terms of f(p, q) = floor((p - q)^2 / q) is
V f(p0, q0) + sum over terms of the first of (f(p, q0) - f(p0, q0)) + the same of the second
+ sum over terms of both of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).
The middle sums need only how often a source has each share; the last is counted term by term, in numpy, by tasks that
send one sum per pair of sources and batch.

Defined results: null text, lang and source are read as ''; repeated rows are documents of their own; every occurring
(lang, source) has a row for each other source of its lang, 0 where the lang keeps no term, and no ``term`` rows
without a term above the lang's share; a lang of one source has no pairs; an empty table gives an empty result; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.llm.common import BATCH, BATCH_BYTES, forget, settings_for_a_while, shared_dir, table, written

GAP = 32
#: By byte of a text: terms are runs of A-Z, a-z and whatever lies above U+007F.
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else GAP for c in range(256)], dtype=np.uint8)
#: Odd factors for the bytes of a term, by their place.
MIX = np.random.Generator(np.random.Philox(13)).integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIN_DOCS = 3
VOCABULARY = 2**31 - 1
SMOOTH = 1
TOP = 200
#: Distinct terms of one fit, the shards that terms are dealt to from the start, and into how many more a shard is split at a time.
TERMS, PARTS, FAN = 1 << 20, 4, 16
#: One in so many terms, by their hash, is counted to tell how many there are.
SAMPLE = 64
#: Pairs of sources that numpy holds at a time.
PAIRS = 1 << 20
#: Batches with fewer bytes of text are put together before they are folded, which takes some 30 bytes of memory a byte.
FOLDED = 1 << 21
#: Entries of vectors that numpy sums at a time, and the cells of a table of sums for each of them.
ENTRIES, DENSE = 1 << 20, 8


def terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, terms, times, shard): documents folded by group, their terms dealt to shards by a hash, A-Z in lower case, each behind its lang and a NUL.

    A row has a term once, and it counts ``times`` times. Of a term's documents, up to min_docs have a row each, so that
    counts of rows tell whether min_docs documents have the term; a term is in one shard. Shards below 0 hold a sample of
    the distinct terms of the shards -1 - shard.
    """
    held = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.coalesce(text, F.lit("")).alias("text"))
    return held.mapInArrow(_dealt(max(1, min_docs)), "lang string, source string, terms array<string>, times bigint, shard int")


def _cut(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all terms in order, A-Z in lower case; where each term begins in them, and the end; the text of each term)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = LETTERS[np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]]] if held is not None else np.zeros(0, dtype=np.uint8)
    letter, at = data != GAP, offsets - offsets[0]
    begins = letter & np.r_[True, ~letter[:-1]][: len(letter)]
    firsts = at[:-1][at[:-1] < len(data)]
    begins[firsts] = letter[firsts]  # a text's first letter begins a term, whatever the text before ends with
    places = np.flatnonzero(begins)
    return data[letter], np.r_[np.cumsum(letter)[places] - 1, letter.sum()], np.searchsorted(at, places, "right") - 1


def _hashes(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each term's bytes and their places."""
    if len(bounds) < 2:
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(letters)) - np.repeat(bounds[:-1], np.diff(bounds))
    h = np.add.reduceat(letters * MIX[place % len(MIX)], bounds[:-1])
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have FOLDED bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= FOLDED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _folded(group: np.ndarray, term: np.ndarray, row: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, term, slot, times) of min(d, min_docs) entries for each term of d rows of a group: the last has all occurrences that the others, with one each, leave."""
    terms, rows = int(term.max()) + 1, int(row.max()) + 1
    key = np.sort((group * terms + term) * rows + row)
    pair = key // rows
    heads = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    docs = np.add.reduceat(np.r_[True, key[1:] != key[:-1]].astype(np.int64), heads)
    count, pair = np.diff(np.r_[heads, len(key)]), pair[heads]
    most = np.minimum(docs, min_docs)
    of = np.repeat(np.arange(len(pair)), most)
    slot = np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most)
    return pair[of] // terms, pair[of] % terms, slot, np.where(slot + 1 == most[of], count[of] - slot, 1)


def _dealt(min_docs: int):
    def rows(lang: pa.Array, source: pa.Array, named: pa.Array, times: np.ndarray, part: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
        texts = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(named)], pa.int32()), named)
        return pa.RecordBatch.from_arrays([lang, source, texts, pa.array(times), pa.array(part, pa.int32())], ["lang", "source", "terms", "times", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            letters, bounds, row = _cut(batch.column("text"))
            if not len(row):
                continue
            found = pa.StringArray.from_buffers(len(row), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(letters)).dictionary_encode()
            known = found.dictionary
            ends = np.frombuffer(known.buffers()[1], np.int32)[: len(known) + 1].astype(np.int64)
            h = _hashes(np.frombuffer(known.buffers()[2], np.uint8)[: ends[-1]], ends)
            lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            sources = len(source.dictionary)
            groups, group = np.unique(np.asarray(lang.indices, dtype=np.int64) * sources + np.asarray(source.indices), return_inverse=True)
            group, term, slot, times = _folded(group[row], np.asarray(found.indices, dtype=np.int64), row, min_docs)
            part = (h % np.uint64(PARTS)).astype(np.int64)[term]
            key = ((part * len(groups) + group) * (int(slot.max()) + 1) + slot) * (int(times.max()) + 1) + times
            order = np.argsort(key, kind="stable")
            key, group, term, times, part = key[order], group[order], term[order], times[order], part[order]
            langs = groups // sources
            named = pc.binary_join_element_wise(lang.dictionary.take(pa.array(langs[group])), known.take(pa.array(term)), "\0")
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            of = groups[group[begins]]
            yield rows(lang.dictionary.take(pa.array(of // sources)), source.dictionary.take(pa.array(of % sources)), named, times[begins], part[begins], begins)
            drawn = np.flatnonzero(((h >> np.uint64(20)) % np.uint64(SAMPLE) == 0)[term])
            if len(drawn):
                _, first = np.unique(langs[group[drawn]] * len(known) + term[drawn], return_index=True)
                drawn = drawn[first]
                none = pa.nulls(len(drawn), pa.string())
                yield rows(none, none, named.take(pa.array(drawn)), np.zeros(len(drawn), np.int64), -1 - part[drawn], np.arange(len(drawn)))

    return run


def fits(held: DataFrame, bound: int) -> Iterator[DataFrame]:
    """The tables of the fits: shards together as long as they have bound distinct terms or so, larger ones split."""
    drawn = held.where("shard < 0").select((-1 - F.col("shard")).alias("shard"), F.explode("terms").alias("t")).distinct()
    sizes = {r["shard"]: r["n"] * SAMPLE for r in drawn.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each of PARTS
    held = held.where("shard >= 0")
    together, total = [], 0
    for shard in range(PARTS):
        n = sizes.get(shard, 0)
        if n > bound:
            yield from shards(held.where(F.col("shard") == shard).drop("shard"), -(-n // bound))
            continue
        if together and total + n > bound:
            yield held.where(F.col("shard").isin(together)).drop("shard")
            together, total = [], 0
        together, total = [*together, shard], total + n
    if together:
        yield held.where(F.col("shard").isin(together)).drop("shard")


def shards(held: DataFrame, n: int, seed: int = 0) -> Iterator[DataFrame]:
    """held as n tables or more, each with all of every row's terms that a hash deals to it; FAN at a time, however many there are."""
    if n <= 1:
        yield held
        return
    k = min(n, FAN)
    own = F.filter("terms", lambda t: F.pmod(F.xxhash64(F.lit(seed), t), F.lit(k)) == F.col("shard"))
    dealt = held.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("lang", "source", own.alias("terms"), "times", "shard")
    dealt = written(dealt.where(F.size("terms") > 0), "terms", by="shard")
    for i in range(k):
        yield from shards(dealt.where(f"shard = {i}").drop("shard"), -(-n // k), seed + 1)
    forget(dealt)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, place, n): the sums of vectors (group, indices, values) by group, ENTRIES or so at a time."""
    held, size = [], 0

    def summed() -> pa.RecordBatch:
        group, sizes, place, value = (np.concatenate(x) for x in zip(*held))
        groups, of = np.unique(group, return_inverse=True)
        width = int(place.max(initial=0)) + 1
        key = np.repeat(of, sizes) * width + place
        if len(groups) * width <= DENSE * ENTRIES:
            sums = np.bincount(key, value)
            keys = np.flatnonzero(sums)
            sums = sums[keys]
        else:
            by = np.argsort(key)
            key = key[by]
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
            keys, sums = key[begins], np.add.reduceat(value[by], begins) if len(key) else value
        return pa.RecordBatch.from_arrays([pa.array(groups[keys // width]), pa.array((keys % width).astype(np.int32)), pa.array(sums.astype(np.int64))], ["group", "place", "n"])

    for batch in batches:
        indices, values = batch.column("indices"), batch.column("values")
        held.append((batch.column("group").to_numpy(), indices.value_lengths().to_numpy(), indices.flatten().to_numpy(), values.flatten().to_numpy()))
        size += len(held[-1][2])
        if size >= ENTRIES:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of vectors that count ``times`` times each."""

    def taken(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column("values")
        sizes = values.value_lengths().to_numpy()
        often = values.flatten().to_numpy() * np.repeat(batch.column("times").to_numpy(), sizes)
        values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(often))
        return pa.RecordBatch.from_arrays([batch.column("group"), batch.column("indices"), values], ["group", "indices", "values"])

    return _counted(taken(b) for b in batches)


def group_sums(held: DataFrame, groups: DataFrame, bound: int = TERMS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(group, lang, term, n) for the kept terms that a group of groups (lang, source, group) has, and (lang, term) for all kept terms.

    group is a number, so that the sums over documents have keys of fixed width.
    """
    spark, sums = held.sparkSession, f"{shared_dir(held.sparkSession)}/sums-{uuid.uuid4().hex}"
    for i, shard in enumerate(fits(held, bound)):
        # A vocabulary mustn't be empty: '' is in three rows more and stays out of what follows.
        shown = shard.select("terms").union(spark.range(min_docs).select(F.array(F.lit(""))))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=VOCABULARY).fit(shown)
        model.write().save(f"{sums}-model/{i}")
        vocabulary = _vocabulary(spark, f"{sums}-model/{i}/data")
        vectors = model.transform(shard.join(groups.select("lang", "source", "group"), ["lang", "source"]).select("group", "times", "terms")).select("group", "times", F.unwrap_udt("vector").alias("v"))
        cells = vectors.select("group", "times", "v.indices", "v.values").mapInArrow(_weighed, "group bigint, place int, n bigint").groupBy("group", "place").agg(F.sum("n").alias("n"))
        with settings_for_a_while(spark, {BATCH: BATCH_BYTES}):
            # At most bound terms or so, by the choice of the fits.
            cells.join(F.broadcast(vocabulary.select("place", "lang", "term")), "place").select("group", "lang", "term", "n").write.parquet(f"{sums}/part={i}")
    kept = _vocabulary(spark, f"{sums}-model/*/data").where("place_of <> ''").select("lang", "term")
    return spark.read.parquet(sums).drop("part"), kept


def _vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(place, place_of, lang, term) of saved models."""
    rows = spark.read.schema("vocabulary array<string>").parquet(path).select(F.posexplode("vocabulary").alias("place", "place_of"))
    term = F.substring_index("place_of", "\0", -1)
    return rows.select("place", "place_of", F.col("place_of").substr(F.lit(1), F.length("place_of") - F.length(term) - 1).alias("lang"), term.alias("term"))


def share(n: Column, every: Column, smooth: int = SMOOTH) -> Column:
    """1 + floor(10^9 * (n + smooth) / every), exact: three steps of three digits each. every: at least 1."""
    left, digits = n + F.lit(smooth), F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        digits, left = digits * 1000 + F.call_function("div", left, every), left % every
    return digits + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): what terms that both of a pair have add beyond the sums of either, summed over a batch."""
    for batch in batches:
        langs, lists = batch.column("lang").to_pylist(), batch.column("sources")
        sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
        flat = lists.flatten()
        s, p, p0 = (np.asarray(flat.field(k), dtype=np.int64) for k in range(3))
        names, most = sorted(set(langs)), int(s.max(initial=0)) + 1
        number = {x: i for i, x in enumerate(names)}
        lang = np.repeat(np.array([number[x] for x in langs], dtype=np.int64), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)  # of the term that an entry belongs to
        fan, done = np.repeat(sizes, sizes), 0  # an entry meets all entries of its term
        upto = np.cumsum(fan)
        while done < len(s):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, "right")))
            times = fan[done:end]
            a = np.repeat(np.arange(done, end), times)
            b = np.repeat(first[done:end], times) + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
            a, b = a[s[a] != s[b]], b[s[a] != s[b]]
            value = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
            pair = (lang[a] * most + s[a]) * most + s[b]
            if len(names) * most * most <= 4 * PAIRS:
                keys = np.flatnonzero(np.bincount(pair))
                sums = np.zeros(len(names) * most * most, dtype=np.int64)
                np.add.at(sums, pair, value)
                sums = sums[keys]
            else:
                keys, place = np.unique(pair, return_inverse=True)
                sums = np.zeros(len(keys), dtype=np.int64)
                np.add.at(sums, place, value)
            of = pa.array(names, pa.string()).take(pa.array(keys // (most * most)))
            yield pa.RecordBatch.from_arrays([of, pa.array(keys // most % most), pa.array(keys % most), pa.array(sums)], ["lang", "a", "b", "value"])
            done = end


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, bound: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` against each other source, ``term`` the terms above the lang's share."""
    held = written(terms(docs, text, lang, source, min_docs), "terms", by="shard")
    groups = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    groups = written(groups.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")).withColumn("group", F.monotonically_increasing_id()), "groups")
    sums, kept = group_sums(held, groups, bound, min_docs)
    of_lang = sums.groupBy("lang").agg(F.sum("n").alias("all_n")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "right")
    of_group = sums.groupBy("group").agg(F.sum("n").alias("own_n"))
    # A row per group, with what its shares divide by.
    stats = groups.join(of_group, "group", "left").join(of_lang, "lang", "left").fillna(0, ["own_n", "all_n", "v"])
    stats = stats.select("lang", "source", "group", "id", "v", (F.col("own_n") + SMOOTH * F.col("v")).alias("own"), (F.col("all_n") + SMOOTH * F.col("v")).alias("all"))
    stats = written(stats.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.greatest("own", F.lit(1))))), "groups")
    each = sums.join(stats.drop("lang"), "group").select("lang", "term", "id", "n", "all", share(F.col("n"), F.col("own")).alias("p"), "p0")
    # At most one entry per source of the lang.
    by_term = each.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "p0")).alias("sources"), F.sum("n").alias("n"), F.first("all").alias("all"))
    by_term = written(by_term.select("lang", "term", "sources", share(F.col("n"), F.col("all")).alias("q")), "by_term")
    cells = by_term.select("lang", "term", "q", F.explode("sources").alias("s")).select("lang", "term", "q", "s.*")

    best = Window.partitionBy("lang", "id").orderBy(F.desc("value"), "item")
    above = cells.where("p > q").select("lang", "id", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # How often a group has each share: few values, as most counts are small.
    shares = cells.groupBy("lang", "id", "p").agg(F.count("*").alias("n")).groupBy("lang", "id").agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    sides = stats.join(shares, ["lang", "id"], "left").select("lang", "id", "source", "v", "p0", F.coalesce("shares", F.array().cast("array<struct<p: bigint, n: bigint>>")).alias("shares"))
    sides = written(sides, "shares")
    a, b = (sides.select("lang", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "source", "p0", "shares")], *(["v"] if x == "a" else [])) for x in "ab")
    both = by_term.where(F.size("sources") > 1).select("lang", "sources").mapInArrow(shared_terms, "lang string, a bigint, b bigint, value bigint")
    both = both.groupBy("lang", F.col("a").alias("a_id"), F.col("b").alias("b_id")).agg(F.sum("value").alias("both"))
    p0, q0, none = F.col("a_p0"), F.col("b_p0"), F.lit(0).cast("long")
    one = F.aggregate("a_shares", none, lambda s, x: s + x["n"] * (distance(x["p"], q0) - distance(p0, q0)))
    other = F.aggregate("b_shares", none, lambda s, x: s + x["n"] * (distance(p0, x["p"]) - distance(p0, q0)))
    # The result has a row for every pair of a lang's sources, by its definition.
    pairs = a.join(b, "lang").where("a_id <> b_id").join(both, ["lang", "a_id", "b_id"], "left")
    pairs = pairs.select("lang", F.col("a_id").alias("id"), F.col("b_source").alias("item"), F.when(F.col("v") > 0, F.col("v") * distance(p0, q0) + one + other + F.coalesce("both", none)).otherwise(none).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    out = pairs.unionByName(above).join(stats.select("lang", "id", "source"), ["lang", "id"])
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the audit of documents."""
    return audit(table(spark, sf_dir, "documents"))
