"""CIGAR strings as Column expressions: blocks, lengths, ends, aligned pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that use up query and reference bases.
QUERY, REFERENCE, MATCH = "MIS=X", "MDN=X", "M=X"
SHAPE = "array<struct<op: string, len: int, qpos: int, rpos: int>>"


def _in(op: Column, ops: str) -> Column:
    return op.isin(*ops)


def blocks(cigar: Column) -> Column:
    """[(op, len)] of a CIGAR text; '*' and null have none."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+[MIDNSHP=XB])"), 1)
    return F.transform(parts, lambda p: F.struct(F.substring(p, F.length(p), F.lit(1)).alias("op"), F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("len")))


def span(blocks: Column, ops: str) -> Column:
    """The total length of the given operations."""
    return F.aggregate(blocks, F.lit(0), lambda s, b: s + F.when(_in(b["op"], ops), b["len"]).otherwise(0))


def longest(blocks: Column, op: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(blocks, lambda b: b["op"] == op), lambda b: b["len"])), F.lit(0))


def end_of(pos: Column, blocks: Column) -> Column:
    """The last reference base; an alignment without reference bases counts as one."""
    return pos + F.greatest(span(blocks, REFERENCE), F.lit(1)) - 1


def clipped_start(blocks: Column) -> Column:
    """Query bases clipped softly before the alignment."""
    first = F.get(F.filter(blocks, lambda b: b["op"] != "H"), F.lit(0))
    return F.when(first["op"] == "S", first["len"]).otherwise(0)


def clipped_end(blocks: Column) -> Column:
    """The query place after the last base that isn't clipped."""
    own = F.filter(blocks, lambda b: b["op"] != "H")
    last = F.element_at(own, -1)
    return span(blocks, QUERY) - F.when((last["op"] == "S") & (F.size(own) > 1), last["len"]).otherwise(0)


def placed(blocks: Column) -> Column:
    """[(op, len, qpos, rpos)]: blocks with their offsets in the query and from the alignment's start."""
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast(SHAPE).alias("out"))

    def step(s: Column, b: Column) -> Column:
        here = F.struct(b["op"].alias("op"), b["len"].alias("len"), s["q"].alias("qpos"), s["r"].alias("rpos"))
        return F.struct((s["q"] + F.when(_in(b["op"], QUERY), b["len"]).otherwise(0)).alias("q"), (s["r"] + F.when(_in(b["op"], REFERENCE), b["len"]).otherwise(0)).alias("r"), F.concat(s["out"], F.array(here)).alias("out"))

    return F.aggregate(blocks, start, step, lambda s: s["out"])


def alignment_blocks(pos: Column, placed: Column) -> Column:
    """Gapless stretches as [(beg, end)], half-open from 0; pos counts from 1."""
    return F.transform(F.filter(placed, lambda b: _in(b["op"], MATCH)), lambda b: F.struct((pos - 1 + b["rpos"]).alias("beg"), (pos - 1 + b["rpos"] + b["len"]).alias("end")))


def aligned_pairs(pos: Column, placed: Column) -> Column:
    """[(op, pos, qpos, n)]: a row for each matched base, one for each insertion, clip, pad, deletion and skip; H has none.

    qpos is null where no query base is used, pos the place of the next reference base where none is.
    """
    row = lambda op, p, q, n: F.struct(op.alias("op"), p.cast("bigint").alias("pos"), q.alias("qpos"), n.alias("n"))

    def rows(b: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), b["len"] - 1), lambda i: row(b["op"], pos + b["rpos"] + i, b["qpos"] + i, F.lit(1)))
        one = F.array(row(b["op"], pos + b["rpos"], F.when(_in(b["op"], QUERY + "P"), b["qpos"]), b["len"]))
        return F.when(_in(b["op"], MATCH), each).otherwise(one)

    return F.flatten(F.transform(F.filter(placed, lambda b: b["op"] != "H"), rows))


def pileup_entries(pos: Column, placed: Column) -> Column:
    """[(pos, qpos, indel, is_del, is_refskip, is_head, is_tail)] for each reference base under the alignment.

    indel is the length of an insertion (positive) or deletion (negative) that follows the base.
    """
    on = F.filter(placed, lambda b: _in(b["op"], REFERENCE + "I"))
    last = span(placed, REFERENCE) - 1

    def entries(b: Column, k: Column) -> Column:
        after = F.get(on, k + 1)
        step = F.when(after["op"] == "I", after["len"]).when(after["op"] == "D", -after["len"]).otherwise(0)

        def entry(i: Column) -> Column:
            gone = ~_in(b["op"], MATCH)
            return F.struct(
                (pos + b["rpos"] + i).cast("bigint").alias("pos"), (b["qpos"] + F.when(gone, 0).otherwise(i)).alias("qpos"), F.when(~gone & (i == b["len"] - 1), step).otherwise(0).alias("indel"),
                (b["op"] == "D").alias("is_del"), (b["op"] == "N").alias("is_refskip"), (b["rpos"] + i == 0).alias("is_head"), (b["rpos"] + i == last).alias("is_tail"),
            )

        return F.when(_in(b["op"], REFERENCE), F.transform(F.sequence(F.lit(0), b["len"] - 1), entry)).otherwise(F.array())

    return F.flatten(F.transform(on, entries))
