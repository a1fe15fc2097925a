"""N-gram Jaccard self-join with vertical partitioning, and the components of its links.

A document's set is its distinct runs of GRAM words; a set is known by a 64-bit signature and its size, and
documents with equal sets are one set to all that follows. Grams have one global order, the estimated count first and
the hash second. Two sets whose Jaccard similarity is at least 3/4 share a gram among the first quarter (and one) of
either, so that they meet in the groups of those leading grams. The counts come from a sketch of CELLS counters,
summed over all tasks: its size is fixed, and the order that it gives affects cost alone, never the result. With
common grams last, groups are those of rare grams.

A pair is verified by fragments: the same global order is cut into pieces that hold about as many grams each, each
piece of one set meets the same piece of the other and counts its own overlap, and the counts are summed per pair.

Groups aren't expanded into pairs. A task joins the members of a group that it holds itself to their most central
one, the one with the fewest rarer grams; those central ones alone meet in the group's own task, which joins them in
the same way, so that a group of any size sends at most a few rows per task. Of these proposals a set keeps the
one that most of its groups make, and in large groups a few more, drawn by hashes. The components of the links found
tell which groups are settled: all members in one component. Only where a group spans several components are pairs
across them formed, by length and place of the shared gram, large groups in cells of two blocks of members, and verified
in further rounds. Bit maps of the sets turn most pairs away before any round: a bit says whether an odd number of
a set's grams falls on it, so that two sets differ by at least as many grams as their maps differ by bits. A cell with
more pairs left than a few per member sends a spanning forest of them alone, over its components, the nearest pairs
first; what they link makes most of the others needless. Rounds go on for the groups of such cells, with twice as many
pairs per member each time, until every cell has sent all its pairs. So no link between components is missed, and a large group of near copies
costs a few pairs per copy.

Of a round's texts only those of documents in its pairs are exchanged. Verification compares 48 bits of a gram's hash.

Defined results: null and wordless texts have an empty set, are linked with nothing and are their own component;
texts of fewer than GRAM words have one gram, the whole; rows that share a doc_id are one node of the link graph; rows
without doc_id share one node, whose component is null unless it links further, and null counts as smallest; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import forget, shuffle_partitions, table, written
from locusflow.llm.components import components
from locusflow.llm.grams import mix, ngrams, words_of

GRAM = 5
PART, WHOLE = 75, 100
#: Pieces of the global order in which overlaps are counted apart.
FRAGMENTS = 4
#: Counters of the sketch, by the leading bits of a gram's hash, and the blocks of them that are summed apart.
CELL_BITS, BLOCK_BITS = 22, 16
FLUSH = 1 << 18
#: Bits of the filter that keeps documents without candidates out of the exchange of texts: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
#: Bytes of a gram's hash that verification compares, besides its fragment.
KEPT = 6
#: Bits of the maps that turn pairs away where they meet.
MAP_BITS = 1024
#: Sets that a set of a large group is compared with besides its hub, and the members from which a group is large.
TRIES, MANY = 3, 8
#: Rows of a group whose pairs are looked at one by one where it is formed.
SMALL = 16
#: Members of a group of several components that are compared in one cell, from either side.
BLOCK = 4096
#: Pairs per member up to which a cell of more than SMALL members sends all of them in the first round across components.
TIMES = 2
LOWEST = -(1 << 63)

PAIR = ["a", "n_a", "b", "n_b"]


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct gram hashes) of each text."""
    for first, offsets, hashes in words_of(column, lower=True):
        grams = ngrams(hashes, GRAM)
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if b - a >= GRAM:
                yield first + i, np.unique(grams[a : b - GRAM + 1])
            else:
                yield first + i, ngrams(hashes[a:b], b - a) if b > a else hashes[:0]


def signature(grams: np.ndarray) -> int:
    """A 64-bit hash of a set, its size included."""
    return int(mix(mix(grams ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(grams))).view(np.int64)[0])


def needed(n):
    """The overlap that a set of n grams needs with any set it links to."""
    return -(-PART * n // WHOLE)


def parities(grams: np.ndarray) -> bytes:
    """Two to four bits a gram, MAP_BITS at least: whether an odd number of grams falls on each."""
    size = max(MAP_BITS, 1 << (2 * len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """How many grams at least are in one of two sets only; the longer map is folded to the length of the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    fold = np.bitwise_xor.reduce(a.reshape(-1, size)) ^ np.bitwise_xor.reduce(b.reshape(-1, size))
    return int(np.bitwise_count(fold).sum())


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, n, sig, bits) of each text, bits for the first text of a set; at the end (block, cells, counts), the task's share of the sketch.

    Each distinct set of a task is counted once. A block with few filled cells names them; another has all its counts.
    """
    counts, held, size, seen = np.zeros(1 << CELL_BITS, np.uint32), [], 0, set()
    names = ["doc", "n", "sig", "bits", "block", "cells", "counts"]

    def count() -> None:
        cells, times = np.unique(_cells(np.concatenate(held)), return_counts=True)
        counts[cells] += times.astype(np.uint32)

    for batch in batches:
        k = batch.num_rows
        n, sig, bits = np.zeros(k, np.int64), np.zeros(k, np.int64), [None] * k
        for i, grams in sets_of(batch.column("text")):
            n[i], sig[i] = len(grams), signature(grams)
            if len(grams) and sig[i] not in seen:
                seen.add(int(sig[i]))
                bits[i] = parities(grams)
                held.append(grams)
                size += len(grams)
            if size >= FLUSH:
                count()
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n), pa.array(sig), pa.array(bits, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)
    if held:
        count()
    if seen:
        rows = []
        for block, part in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            some = np.flatnonzero(part)
            if len(some) * 3 < len(part):
                rows.append((block, some.astype(np.uint16).tobytes(), part[some].astype("<u4").tobytes()))
            elif part.max() < 256:
                rows.append((block, None, part.astype(np.uint8).tobytes()))
            else:
                rows.append((block, None, part.astype("<u4").tobytes()))
        block, cells, times = zip(*rows)
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(rows), pa.binary()), pa.array(block, pa.int32()), pa.array(cells, pa.binary()), pa.array(times, pa.binary())], names=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells, times in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "counts"))):
            own = total.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint64))
            if cells is not None:
                own[np.frombuffer(cells, np.uint16)] += np.frombuffer(times, "<u4")
            else:
                own += np.frombuffer(times, np.uint8 if len(times) == len(own) else "<u4")
    # The order needs the scale of a count alone: two steps for each doubling.
    for block, own in total.items():
        level = np.floor(2 * np.log2(np.maximum(own, 1))).astype(np.uint8)
        weight = np.bincount(level, own.astype(np.float64), 256)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([weight.tolist()], pa.list_(pa.float64()))], names=["block", "levels", "weight"])


def gram_order(sketch: DataFrame, fragments: int = FRAGMENTS) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The level of every cell (2**CELL_BITS bytes, whatever the input), and where the order is cut: (level, hash) at which a fragment begins."""
    parts = shuffle_partitions(sketch.sparkSession)
    # One row for each of 2**(CELL_BITS - BLOCK_BITS) blocks comes to the driver.
    rows = sketch.repartition(parts, "block").mapInArrow(_summed, "block int, levels binary, weight array<double>").collect()
    levels, weight = np.zeros((1 << (CELL_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8), np.zeros(256)
    for r in rows:
        levels[r["block"]] = np.frombuffer(r["levels"], np.uint8)
        weight += np.array(r["weight"])
    upto, cuts = np.cumsum(weight), []
    for i in range(1, fragments):
        at = upto[-1] * i / fragments
        level = int(np.searchsorted(upto, at, "right")) if upto[-1] else 0
        inside = (at - (upto[level] - weight[level])) / max(weight[level], 1.0) if upto[-1] else 0
        cuts.append((level, min((1 << 64) - 1, int(inside * 2.0**64))))
    return levels.reshape(-1), cuts


def _fits(n1, place1, n2, place2):
    """Sizes and places of the first shared gram that allow a link: the overlap needed is at most what is left from there on."""
    need = -(-PART * (n1 + n2) // (PART + WHOLE))
    return np.minimum(n1 - place1, n2 - place2) >= need


SENT = "bucket int, known boolean, gram binary, sig binary, n binary, place binary, many binary, hub binary, hub_n binary"


def _leads(order, buckets: int):
    """Packs of the grams that lead a set in the global order, one set of a task each.

    A gram's most central set in a task goes to the gram's bucket; the others (known) already have a hub and go
    anywhere: to the bucket that their pack's first gram happens to name.
    """

    def packs(held: list[tuple]) -> pa.RecordBatch:
        gram, sig, n, place = (np.concatenate(x) for x in zip(*held))
        # Inside a bucket 32 bits tell grams apart well enough: two that fall together only propose pairs in vain.
        gram = ((gram % np.uint64(buckets)) << np.uint64(32) | gram >> np.uint64(32)).astype(np.int64)
        by = np.lexsort((sig, place, gram))
        gram, sig, n, place = gram[by], sig[by], n[by], place[by]
        new = np.append(True, gram[1:] != gram[:-1])
        heads = np.flatnonzero(new)
        many = (np.diff(np.append(heads, len(gram))) > 1).astype(np.uint8)
        bucket = (gram[heads] >> 32).astype(np.int32)
        parts = np.split(heads, np.flatnonzero(np.diff(bucket)) + 1)
        many = np.split(many, np.flatnonzero(np.diff(bucket)) + 1)
        rows = [(int(gram[p[0]] >> 32), False, (gram[p] & 0xFFFFFFFF).astype(np.uint32).tobytes(), sig[p].tobytes(), n[p].tobytes(), place[p].tobytes(), m.tobytes(), None, None) for p, m in zip(parts, many)]
        rest, head = np.flatnonzero(~new), heads[np.cumsum(new) - 1]
        for at in range(0, len(rest), 1 << 15):
            p = rest[at : at + (1 << 15)]
            h = head[p]
            hub_n = np.where(_fits(n[h].astype(np.int64), place[h], n[p].astype(np.int64), place[p]), n[h], 0).astype(np.int32)
            rows.append((int(gram[p[0]] >> 32), True, gram[p].tobytes(), sig[p].tobytes(), n[p].tobytes(), place[p].tobytes(), None, sig[h].tobytes(), hub_n.tobytes()))
        kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, _ = order.value
        held, size, seen = [], 0, set()
        for batch in batches:
            for _, grams in sets_of(batch.column("text")):
                s, n = signature(grams), len(grams)
                if not n or s in seen:
                    continue
                seen.add(s)
                key = levels[_cells(grams)].astype(np.uint64) << np.uint64(56) | grams >> np.uint64(8)
                lead = grams[np.argsort(key, kind="stable")[: n - needed(n) + 1]]
                held.append((lead, np.full(len(lead), s, np.int64), np.full(len(lead), n, np.int32), np.arange(len(lead), dtype=np.int32)))
                size += len(lead)
                if size >= FLUSH:
                    yield packs(held)
                    held, size = [], 0
        if held:
            yield packs(held)

    return run


GROUPS = "gram bigint, sig bigint, n int, place int, hub bigint, hub_n int"


def _entries(gram, sig, n, place, hub, hub_n) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(gram), 1 << 17):
        cut = slice(at, at + (1 << 17))
        none = hub_n[cut] == 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram[cut]), pa.array(sig[cut]), pa.array(n[cut]), pa.array(place[cut]), pa.array(hub[cut], mask=none), pa.array(hub_n[cut], mask=none)],
            names=[x.split()[0] for x in GROUPS.split(", ")],
        )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of groups of two sets or more, each with a hub if one fits: what tasks knew is passed on, the central sets of the tasks get the most central of them."""
    held: list[list] = [[], [], [], [], []]
    raw = lambda v, kind: np.frombuffer(v.as_buffer(), kind)
    for batch in batches:
        column = {c: batch.column(c) for c in batch.schema.names}
        for i, (bucket, known) in enumerate(zip(column["bucket"].to_pylist(), column["known"].to_pylist())):
            sig, n, place = (raw(column[c][i], k) for c, k in (("sig", np.int64), ("n", np.int32), ("place", np.int32)))
            if known:
                yield from _entries(raw(column["gram"][i], np.int64), sig, n, place, raw(column["hub"][i], np.int64), raw(column["hub_n"][i], np.int32))
            else:
                gram = (bucket << 32) | raw(column["gram"][i], np.uint32).astype(np.int64)
                for x, v in zip(held, (gram, sig, n, place, raw(column["many"][i], np.uint8))):
                    x.append(v)
    if not held[0]:
        return
    gram, sig, n, place, many = (np.concatenate(x) for x in held)
    held.clear()
    by = np.lexsort((sig, place, gram))
    gram, sig, n, place, many = gram[by], sig[by], n[by], place[by], many[by]
    new = np.append(True, gram[1:] != gram[:-1])
    once = new | np.append(True, sig[1:] != sig[:-1])  # a set that several tasks hold counts once
    heads = np.flatnonzero(new)
    at = np.cumsum(new) - 1
    size = np.add.reduceat(once.astype(np.int64), heads) + np.maximum.reduceat(many, heads)
    head = heads[at]
    keep = once & (size[at] > 1)
    # In a small group that this task holds whole, a set stays if it can link to another whose first shared gram this is.
    few = (np.diff(np.append(heads, len(gram))) <= SMALL) & (np.maximum.reduceat(many, heads) == 0)
    able, rows = np.zeros(len(gram), bool), np.flatnonzero(few[at])
    for k in range(1, SMALL):
        rows = rows[rows + k < len(gram)]
        rows = rows[at[rows] == at[rows + k]]
        x = rows[(sig[rows] != sig[rows + k]) & _fits(n[rows].astype(np.int64), place[rows], n[rows + k].astype(np.int64), place[rows + k])]
        able[x] = able[x + k] = True
    keep &= able | ~few[at]
    fits = _fits(n[head].astype(np.int64), place[head], n.astype(np.int64), place) & (sig != sig[head])
    hub_n = np.where(fits, n[head], 0).astype(np.int32)
    yield from _entries(gram[keep], sig[keep], n[keep], place[keep], sig[head][keep], hub_n[keep])


PIECES = "sig bigint, n bigint, fragment int, grams binary"


def _pieces(order, held):
    """A set as rows (sig, n, fragment, grams): the fragments cut the global order; grams are the low bytes of their hashes.

    Only texts of documents whose three bits (columns bit0 to bit2) are all set in the filter are cut.
    """

    def pack(out: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["sig", "n", "fragment", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (levels, cuts), words = order.value, held.value
        seen, out = set(), ([], [], [], [])
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i in range(3):
                bit = batch.column(f"bit{i}").to_numpy()
                keep &= (words[bit >> 6] >> (bit & 63)) & 1 == 1
            for _, grams in sets_of(batch.column("text").filter(pa.array(keep))):
                s = signature(grams)
                if not len(grams) or s in seen:
                    continue
                seen.add(s)
                level, fragment = levels[_cells(grams)], np.zeros(len(grams), np.int8)
                for cut, start in cuts:
                    fragment += (level > cut) | ((level == cut) & (grams >= np.uint64(start)))
                for f in range(len(cuts) + 1):
                    part = grams[fragment == f]
                    if len(part):
                        for x, v in zip(out, (s, len(grams), f, part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes())):
                            x.append(v)
                if len(out[0]) >= 1024:
                    yield pack(out)
                    out = ([], [], [], [])
        yield pack(out)

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = np.empty(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column("left_grams"), batch.column("right_grams"))):
            short = np.frombuffer(x.as_buffer().to_pybytes() + y.as_buffer().to_pybytes(), np.uint8).reshape(-1, KEPT)
            both = np.zeros((len(short), 8), np.uint8)
            both[:, :KEPT] = short
            both = both.reshape(-1).view("<u8")
            both.sort()
            shared[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*PAIR, "fragment")), pa.array(shared)], names=[*PAIR, "fragment", "shared"])


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit filter of fixed size over the doc ids, three bits each, put together from 64-bit words."""
    bits = F.explode(F.array(*[F.pmod(F.xxhash64("doc", F.lit(i)), F.lit(FILTER_BITS)) for i in range(3)]))
    words = ids.select(bits.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _cut(rows: DataFrame, pairs: DataFrame, firsts: DataFrame, order) -> DataFrame:
    """The pieces of the sets in pairs, from one document each. A bit filter over the documents keeps most others from being cut; the join with the sets is exact."""
    ends = written(pairs.select(F.col("a").alias("sig"), F.col("n_a").alias("n")).union(pairs.select("b", "n_b")).distinct(), "ends")
    held = rows.sparkSession.sparkContext.broadcast(_filter(ends.join(firsts, ["sig", "n"]).select("doc").distinct()))
    bits = rows.select("text", *[F.pmod(F.xxhash64("doc", F.lit(i)), F.lit(FILTER_BITS)).alias(f"bit{i}") for i in range(3)])
    pieces = written(bits.mapInArrow(_pieces(order, held), PIECES).join(ends, ["sig", "n"]), "pieces")
    forget(ends)
    held.destroy()  # the driver's copy goes as well
    return pieces


def verified(pairs: DataFrame, pieces: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """The pairs whose similarity is high enough: overlaps are counted by fragment and summed.

    b should be the side with fewer sets: its pieces alone are exchanged again, by fragment. A piece that stands twice
    in pieces counts once.
    """
    side = lambda x, grams: pieces.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), "fragment", F.col("grams").alias(grams))
    left = pairs.join(side("a", "left_grams"), ["a", "n_a"])
    right = side("b", "right_grams").join(pairs.select("b", "n_b").distinct(), ["b", "n_b"], "left_semi")
    both = left.join(right, ["b", "n_b", "fragment"])
    counted = both.select(*PAIR, "fragment", "left_grams", "right_grams").mapInArrow(_overlaps, "a bigint, n_a bigint, b bigint, n_b bigint, fragment int, shared bigint")
    each = [F.max(F.when(F.col("fragment") == f, F.col("shared")).otherwise(0)).alias(f"shared{f}") for f in range(fragments)]
    total = counted.groupBy(*PAIR).agg(*each).withColumn("shared", sum((F.col(f"shared{f}") for f in range(fragments)), F.lit(0)))
    return total.where(WHOLE * F.col("shared") >= PART * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select(*PAIR)


def _forest(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Places of the edges of the least spanning forest; edges (u, v) come in order of weight. Each node takes its first edge, and what these join is one node."""
    left, label, kept = np.arange(len(u)), np.arange(nodes), []
    while True:
        left = left[label[u[left]] != label[v[left]]]
        if not len(left):
            return np.sort(np.concatenate(kept)) if kept else left
        first = np.full(nodes, len(u))
        for end in (u, v):
            np.minimum.at(first, label[end[left]], left)
        own = np.flatnonzero(first < len(u))
        kept.append(np.unique(first[own]))
        parent = np.arange(nodes)
        parent[own] = label[u[first[own]]] + label[v[first[own]]] - own
        parent = np.where((parent[parent] == np.arange(nodes)) & (np.arange(nodes) < parent), np.arange(nodes), parent)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]


def _across(times: int):
    """Pairs of one group and cell in different components whose sizes, places and maps allow a link, each once for a task.

    In a group and cell members are sorted by size; each round compares every member with the k-th one after it, as
    long as that isn't too large. Of a cell with more than SMALL members and ``times`` pairs per member only a spanning
    forest of its components stays, the nearest pairs first; a row (gram, null, null, null) tells of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        gram, cell, block, sig, n, place, comp = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("gram", "cell", "block", "sig", "n", "place", "component"))
        maps = np.concatenate([np.frombuffer(b"".join(b.column("map").to_pylist()), np.uint64) for b in held]).reshape(-1, MAP_BITS // 64)
        by = np.lexsort((sig, n, cell, gram))
        gram, cell, block, sig, n, place, comp, maps = gram[by], cell[by], block[by], sig[by], n[by].astype(np.int64), place[by], comp[by], maps[by]
        group = np.cumsum(np.append(False, (gram[1:] != gram[:-1]) | (cell[1:] != cell[:-1])))
        most = np.bincount(group)
        most *= np.where(most > SMALL, times, SMALL)
        cut = np.zeros(len(most), bool)
        by = np.lexsort((comp, group))
        node = np.empty(len(gram), np.int64)
        node[by] = np.cumsum(np.append(False, (group[by][1:] != group[by][:-1]) | (comp[by][1:] != comp[by][:-1])))
        diagonal = (cell >> 32) == (cell & 0xFFFFFFFF)

        def fewer(made: list[tuple]) -> list[tuple]:
            """The pairs found so far, a forest of them where there are too many; what forests leave out stays out whatever comes."""
            a, b, least = (np.concatenate(x) for x in zip(*made))
            cut[np.bincount(group[a], minlength=len(most)) > most] = True
            over = np.flatnonzero(cut[group[a]])
            over = over[np.lexsort((sig[b[over]], sig[a[over]], least[over] / (n[a[over]] + n[b[over]])))]
            keep = ~cut[group[a]]
            keep[over[_forest(node[a[over]], node[b[over]], int(node.max()) + 1)]] = True
            return [(a[keep], b[keep], least[keep])]

        at, k, made, size = np.arange(len(gram)), 1, [], 0
        while True:
            at = at[at + k < len(gram)]
            at = at[(group[at] == group[at + k]) & (needed(n[at + k]) <= n[at])]
            if not len(at):
                break
            x = at[(comp[at] != comp[at + k]) & (sig[at] != sig[at + k]) & (diagonal[at] | (block[at] != block[at + k])) & _fits(n[at], place[at], n[at + k], place[at + k])]
            if len(x):
                least = np.bitwise_count(maps[x] ^ maps[x + k]).sum(1, np.int64)
                near = _near(n[x], n[x + k], least)
                made.append((x[near], x[near] + k, least[near]))
                size += len(made[-1][0])
            if size >= FLUSH:
                made, size = fewer(made), 0
            k += 1
        if not made:
            return
        a, b, _ = fewer(made)[0]
        swap = sig[a] < sig[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        by = np.lexsort((sig[b], sig[a]))
        a, b = a[by], b[by]
        new = np.append(True, (sig[a][1:] != sig[a][:-1]) | (sig[b][1:] != sig[b][:-1]))[: len(a)]
        a, b = a[new], b[new]
        yield pa.RecordBatch.from_arrays([pa.array(sig[a]), pa.array(n[a]), pa.array(sig[b]), pa.array(n[b])], names=PAIR)
        some = pa.array(np.unique(gram[cut[group]]))
        yield pa.RecordBatch.from_arrays([some, *[pa.nulls(len(some), pa.int64())] * 3], names=PAIR)

    return run


def _placed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members (gram, sig, n, place) of groups that span several components, with component and the group's size."""
    placed = written(members.select("gram", "sig", F.col("n").cast("bigint").alias("n"), "place").join(classes, ["sig", "n"]), "placed")
    mixed = placed.groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("members")).where("least < most").select("gram", "members")
    out = written(placed.join(mixed, "gram"), "members")
    forget(placed)
    return out


def _drawn(groups: DataFrame, tries: int = TRIES) -> DataFrame:
    """For each set in groups of MANY or more up to ``tries`` others: what hashes with as many seeds put first in a group, and most groups of the set so."""
    first = [F.min_by(F.struct("sig", "n"), F.xxhash64("sig", F.lit(seed))) for seed in range(tries)]
    drawn = groups.groupBy("gram").agg(F.count("*").alias("members"), F.array(*[F.struct(F.lit(seed).alias("seed"), x.alias("hub")) for seed, x in enumerate(first)]).alias("drawn")).where(F.col("members") >= MANY)
    need = F.ceil(F.greatest(F.col("d.hub.n"), F.col("n")) * PART / WHOLE)
    met = groups.join(drawn.select("gram", "drawn"), "gram").select("sig", "n", F.explode("drawn").alias("d")).where((F.col("d.hub.sig") != F.col("sig")) & (need <= F.least("d.hub.n", "n")))
    best = met.groupBy("sig", "n", "d.seed", "d.hub").count().groupBy("sig", "n", "seed").agg(F.max_by("hub", F.struct("count", "hub.sig")).alias("hub"))
    return best.select(*[F.col(c).cast("bigint").alias(name) for c, name in zip(("sig", "n", "hub.sig", "hub.n"), PAIR)])


def _unsettled(members: DataFrame, maps: DataFrame, parts: int, times: int = TIMES) -> DataFrame:
    """Pairs across the components that meet in a group; and a row (gram, null, null, null) for each group that keeps some back, as a cell has more than ``times`` per member."""
    blocks = members.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("sig", "n"), "blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = blocks.withColumn("other", other).withColumn("cell", F.shiftleft(F.least("block", "other"), 32).bitwiseOR(F.greatest("block", "other")))
    folded = maps.mapInArrow(_folded, "sig bigint, n bigint, map binary")
    dealt = cells.join(folded, ["sig", "n"]).select("gram", "cell", "block", "sig", "n", "place", "component", "map").repartition(parts, "gram", "cell")
    return dealt.mapInArrow(_across(times), "a bigint, n_a bigint, b bigint, n_b bigint").distinct()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, MAP_BITS // 8)).tobytes() for x in batch.column("bits").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("n"), pa.array(maps, pa.binary())], names=["sig", "n", "map"])


def _near(n1, n2, least):
    """Whether sets that differ by that many grams at least may link: n1 + n2 - least are twice what they share at most, and as many with least added twice are twice their union."""
    return WHOLE * (n1 + n2 - least) >= PART * (n1 + n2 + least)


def _possible_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = np.array([apart(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())], np.int64)
        yield batch.select(PAIR).filter(pa.array(_near(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), least)))


def _possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs whose maps, in their full length, allow a link."""
    side = lambda x: maps.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), ["a", "n_a"]).join(side("b"), ["b", "n_b"]).mapInArrow(_possible_rows, "a bigint, n_a bigint, b bigint, n_b bigint")


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fragments: int = FRAGMENTS) -> tuple[DataFrame, DataFrame]:
    """(doc, n, sig) of every row, and (node, component) of the documents with links: written tables, which ``forget`` takes."""
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LOWEST)).alias("doc"), F.col(text).alias("text"))
    first = written(rows.mapInArrow(_sizes, "doc bigint, n bigint, sig bigint, bits binary, block int, cells binary, counts binary"), "sizes")
    sizes = written(first.where("block is null").select("doc", "n", "sig"), "signatures")
    order = spark.sparkContext.broadcast(gram_order(first.where("block is not null").select("block", "cells", "counts"), fragments))
    # Equal sets: each document links to the smallest of its set.
    firsts = written(sizes.where("n > 0").groupBy("sig", "n").agg(F.min("doc").alias("doc")), "firsts")
    same = sizes.where("n > 0").join(firsts.withColumnRenamed("doc", "b"), ["sig", "n"]).select(F.col("doc").alias("a"), "b").where("a != b")
    groups = written(rows.mapInArrow(_leads(order, n), SENT).repartitionById(n, "bucket").mapInArrow(_groups, GROUPS), "groups")
    need = lambda n: F.ceil(F.col(n) * PART / WHOLE)
    # Two linked sets share at least so many leading grams; half of them will do, as other groups may have other hubs.
    least: Column = F.ceil((F.col("n") + F.col("hub_n")) * PART / (PART + WHOLE)) - F.greatest(need("n"), need("hub_n")) + 1
    votes = groups.where("hub is not null and hub != sig").groupBy("sig", "n", "hub", "hub_n").count().where(2 * F.col("count") >= least)
    best = votes.groupBy("sig", "n").agg(F.max_by(F.struct("hub", "hub_n"), F.struct("count", "hub")).alias("best"))
    best = best.select(*[F.col(c).cast("bigint").alias(name) for c, name in zip(("sig", "n", "best.hub", "best.hub_n"), PAIR)])
    grouped = groups.select("sig", F.col("n").cast("bigint").alias("n")).distinct()
    maps = written(first.where("bits is not null").select("sig", "n", "bits").join(grouped, ["sig", "n"]).groupBy("sig", "n").agg(F.any_value("bits").alias("bits")), "maps")
    forget(first)

    def in_documents(pairs: DataFrame) -> DataFrame:
        ends = [firsts.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("doc").alias(f"doc_{x}")) for x in "ab"]
        return pairs.join(ends[0], ["a", "n_a"]).join(ends[1], ["b", "n_b"]).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))

    def joined(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """The components of the links among pairs and of those known, a written table."""
        pairs = written(_possible(pairs, maps), "pairs")
        pieces = _cut(rows, pairs, firsts, order)
        links = written(in_documents(verified(pairs, pieces, fragments)).union(known), "links")
        forget(pieces, pairs)
        out = components(links)
        forget(links)
        return out

    found, times = joined(best.union(_drawn(groups)).distinct(), same), TIMES
    held, read = groups, [groups]
    while True:
        classes = firsts.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("sig", "n", F.coalesce("component", "doc").alias("component"))
        members = _placed(held, classes)
        forget(*read)
        across = written(_unsettled(members, maps, n, times), "across")
        whole = joined(across.where("b is not null"), found.select("node", "component"))
        forget(found)
        found, times, read = whole, 2 * times, [members, across]
        kept_back = across.where("b is null").select(F.col("a").alias("gram"))
        if kept_back.isEmpty():
            break
        # The other groups have sent all their pairs.
        held = members.join(kept_back, "gram", "left_semi")
    forget(*read, maps, firsts)
    order.destroy()
    return sizes, found


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    sizes, found = linked(docs, doc_id, text)
    real = lambda c: F.when(c != LOWEST, c)
    placed = sizes.join(found.withColumnRenamed("node", "doc"), "doc", "left")
    return placed.select(real(F.col("doc")).alias(doc_id), F.col("n").alias("n_shingles"), real(F.coalesce("component", "doc")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the link class of every document."""
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
