"""Modified bases of reads from their MM, ML and MN tags.

MM lists, for a canonical base and strand, how many of that base to skip before each modified one, counted in the order
in which the read was sequenced: for a read aligned in reverse, from its end, over complements. ML has a probability (0
to 255) for each, MN the length that the read had. A list that ends its codes with ``?`` says nothing about the bases
that it skips; any other says that they aren't modified.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions import cigar as cg

REVERSE = 16
#: Fixed values of the format.
COMPLEMENT = dict(zip("ACGTN", "TGCAN"))
GROUP = re.compile(r"([ACGTUN])([+-])([A-Za-z]+|\d+)([.?]?)((?:,\d+)*);")
MOST_CODES = 256
#: Reads whose places a worker holds at a time, and the longest that it holds.
SEEN, SHORT = 4096, 512


def _places(seq: str, base: str) -> list[int]:
    """Where a base stands in a read, from 0, whatever its case."""
    return np.flatnonzero(np.frombuffer(seq.upper().encode("ascii", "replace"), dtype=np.uint8) == ord(base)).tolist()


_held_places = lru_cache(SEEN)(_places)


def called(seq: str, reverse: bool, mm: str, ml: list[int] | None = None, length: int | None = None, states: bool = False) -> list[tuple]:
    """(qpos, canonical, strand, code, likelihood, state) in order of qpos, from 0; ValueError for tags that don't fit the read.

    state is modified; with states, the bases that a list skips are there as well: unmodified, or unchecked where the
    list is explicit. likelihood is None where it isn't known.
    """
    if length is not None and seq and length != len(seq):
        raise ValueError("the tags are of a read of another length")
    out, at, used, codes_seen = [], 0, 0, 0
    while at < len(mm):
        m = GROUP.match(mm, at)
        if not m:
            raise ValueError(f"no list of modifications at {at}")
        at = m.end()
        base, strand, named, mark, skips = m[1].replace("U", "T"), m[2], m[3], m[4], m[5]
        codes = [named] if named.isdigit() else list(named)
        codes_seen += len(codes)
        if codes_seen > MOST_CODES:
            raise ValueError("too many codes")
        wanted = COMPLEMENT[base] if reverse else base
        places = range(len(seq)) if base == "N" else (_held_places if len(seq) <= SHORT else _places)(seq, wanted)
        places = places[::-1] if reverse else places
        hits = [n - 1 for n in accumulate(int(x) + 1 for x in skips.split(",")[1:])] if skips else []
        if len(hits) and hits[-1] >= len(places):
            raise ValueError("more bases are skipped than there are")
        if ml is not None and used + len(hits) * len(codes) > len(ml):
            raise ValueError("too few likelihoods")
        for k, hit in enumerate(hits):
            for c, code in enumerate(codes):
                out.append((int(places[hit]), base, strand, code, None if ml is None else ml[used + k * len(codes) + c], "modified"))
        if states:
            skipped = sorted(set(range(len(places))).difference(hits))
            out += [(int(places[i]), base, strand, code, None, "unchecked" if mark == "?" else "unmodified") for i in skipped for code in codes]
        used += len(hits) * len(codes)
    if ml is not None and used != len(ml):
        raise ValueError("too many likelihoods")
    return sorted(out, key=lambda x: x[0])  # those of one base stay in the tag's order


CALLS = "array<struct<qpos: int, canonical: string, strand: string, code: string, likelihood: int, state: string>>"


def with_modifications(reads: DataFrame, states: bool = False) -> DataFrame:
    """reads with mods and fault: what is wrong with a read's tags, which then give none. Reads without an MM tag have none.

    reads have seq, flag and tags by name as 'type:value'. Only these three columns go to Python, under a number of the row.
    """
    tag = lambda *names: F.coalesce(*[F.col("tags")[n] for n in names])
    held = reads.withColumn("__in", F.when(tag("MM", "Mm").isNotNull(), F.struct(F.coalesce("seq", F.lit("")).alias("seq"), F.col("flag").bitwiseAND(REVERSE).alias("reverse"), tag("MM", "Mm").alias("mm"), tag("ML", "Ml").alias("ml"), tag("MN").alias("mn"))))

    @F.arrow_udf("struct<mods: " + CALLS + ", fault: string>")
    def read_mods(given: pa.Array) -> pa.Array:
        there, offsets, flat, faults = given.is_valid().to_pylist(), [0], [], []
        for known, *r in zip(there, *(c.to_pylist() for c in given.flatten())):
            fault = None
            if known:
                try:
                    flat += _read(*r, states)
                except ValueError as e:
                    fault = str(e)
            offsets.append(len(flat))
            faults.append(fault)
        columns = zip(*flat) if flat else [()] * len(NAMES)
        calls = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CALL)], fields=CALL)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), calls), pa.array(faults, pa.string())], fields=list(KIND))

    return held.withColumn("__out", read_mods("__in")).select(*reads.columns, F.col("__out.mods").alias("mods"), F.col("__out.fault").alias("fault"))


NAMES = ("qpos", "canonical", "strand", "code", "likelihood", "state")
CALL = [pa.field("qpos", pa.int32()), *(pa.field(k, pa.string()) for k in NAMES[1:4]), pa.field("likelihood", pa.int32()), pa.field("state", pa.string())]
KIND = pa.struct([("mods", pa.list_(pa.struct(CALL))), ("fault", pa.string())])


def _read(seq: str, reverse: int, mm: str, ml: str | None, mn: str | None, states: bool) -> list[tuple]:
    if not mm.startswith("Z:"):
        raise ValueError("MM isn't text")
    likely = None
    if ml is not None:
        if not ml.startswith("B:C"):
            raise ValueError("ML isn't an array of bytes")
        likely = [int(x) for x in ml.split(",")[1:]]
    if mn is not None and not re.fullmatch(r"i:\d+", mn):
        raise ValueError("MN isn't a number")
    return called(seq, bool(reverse), mm[2:], likely, int(mn[2:]) if mn is not None else None, states)


def modified_positions(reads: DataFrame, states: bool = False) -> DataFrame:
    """contig, pos, qname and the call for each modified base that stands on a reference base: a pileup of modifications."""
    done = with_modifications(reads, states).withColumn("placed", cg.placed(cg.blocks(F.col("cigar"))))
    each = done.select("qname", "contig", "pos", "placed", F.explode("mods").alias("m"))
    own = F.get(F.filter("placed", lambda b: b["op"].isin(*cg.MATCH) & (F.col("m.qpos") >= b["qpos"]) & (F.col("m.qpos") < b["qpos"] + b["len"])), F.lit(0))
    return each.withColumn("b", own).where("b is not null").select("contig", (F.col("pos") + F.col("b.rpos") + F.col("m.qpos") - F.col("b.qpos")).cast("bigint").alias("pos"), "qname", "m.*")


def by_position(reads: DataFrame) -> DataFrame:
    """For each position, strand and code: reads modified there, and the sum of their likelihoods."""
    calls = modified_positions(reads).where("state = 'modified'")
    return calls.groupBy("contig", "pos", "canonical", "strand", "code").agg(F.count("*").alias("n"), F.sum("likelihood").alias("likelihood"))
