"""Which records of one position belong together across sources, by what their alleles are; regions and targets.

Records are told apart by their alleles; equal ones of several sources are together from the start, and the n-th copy
in one source goes with the n-th copy in another. Sets of records then grow greedily: the one that most sources have
takes the best-scoring other that shares no source with it, until none is left to take, and is a row of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions import alleles
from locusflow.operators import intervals, variants

#: What a record changes; several may hold.
REF, SNP, INDEL, OTHER = 1, 2, 4, 8
#: The kinds that may pair besides shared alleles; ``any`` lets all others pair too, at a lower score.
LOGICS: dict[str, tuple[tuple[int, int], ...]] = {
    "exact": (), "some": (), "id": (), "snps": ((SNP, SNP),), "indels": ((INDEL, INDEL),), "snp_ref": ((SNP, REF),), "indel_ref": ((INDEL, REF),),
    "both": ((SNP, SNP), (INDEL, INDEL)), "both_ref": ((SNP, SNP), (INDEL, INDEL), (SNP, REF), (INDEL, REF)), "any": ((SNP, SNP), (INDEL, INDEL), (SNP, REF), (INDEL, REF)),
}
SAME = 4  # alleles in common beat every pair of kinds


def kinds(ref: Column, alts: Column) -> Column:
    """The kinds of a record; several bases changed count as a SNP, and what has none of the kinds is 0."""
    bits = alleles.classes(ref, alts)
    of = lambda mask, kind: F.when(bits.bitwiseAND(mask) != 0, kind).otherwise(0)
    return F.when(bits == 0, REF).otherwise(of(alleles.SNP | alleles.MNP, SNP) + of(alleles.INDEL, INDEL) + of(alleles.OTHER, OTHER))


def allele_text(ref: Column, alts: Column, end: Column | None = None) -> Column:
    """``ref>alt`` of each ALT, by commas; a symbolic one with the record's end, where that is known."""
    after = F.lit("") if end is None else F.coalesce(F.concat(F.lit("/"), end.cast("string")), F.lit(""))
    each = F.transform(alts, lambda a: F.concat(ref, F.lit(">"), a, F.when(a.startswith("<"), after).otherwise("")))
    return F.when(F.size(alts) == 0, F.concat(ref, F.lit(">."))).otherwise(F.array_join(each, ","))


def kind_scores(logic: str) -> dict[tuple[int, int], int]:
    """Score of each pair of kinds, 0 left out: 3 for two alike, 2 for one and REF; mixed kinds score as their best pair, under ``any`` 1 like all others."""
    base = {p: 3 if p[0] == p[1] else 2 for a, b in LOGICS[logic] for p in ((a, b), (b, a))}
    if logic == "any":
        return {(a, b): base.get((a, b), 1) for a in range(16) for b in range(16)}
    best = {(a, b): max((s for (x, y), s in base.items() if x & a and y & b), default=0) for a in range(16) for b in range(16)}
    return {p: s for p, s in best.items() if s}


def _alike(a: dict, b: dict, logic: str) -> bool:
    if logic != "exact":
        return a["text"] == b["text"] and a["kind"] == b["kind"] or bool(a["kind"] & b["kind"] and a["alleles"] & b["alleles"])
    return a["kind"] == b["kind"] and (a["text"] == b["text"] or a["n"] == b["n"] and len(a["text"]) == len(b["text"]) and a["alleles"] <= b["alleles"])


def _score(a: list[dict], b: list[dict], logic: str, scores: dict) -> int:
    """Of two sets: SAME if two members are alike; else the least of all pairs, 0 as soon as one may not pair."""
    least = SAME
    for x in a:
        for y in b:
            if _alike(x, y, logic):
                return SAME
            if logic != "exact":
                s = scores.get((x["kind"], y["kind"]), 0)
                if not s:
                    return 0
                least = min(least, s)
    return 0 if logic == "exact" else least


def rows_of(records: list[tuple[int, str, int]], logic: str, scores: dict | None = None) -> list[list[int]]:
    """The rows, as places in records: (source, allele text, kinds) by source and order within it."""
    scores = kind_scores(logic) if scores is None else scores
    known: dict[tuple, dict] = {}
    copies: Counter = Counter()
    for place, (source, text, kind) in enumerate(records):
        name = text, copies[source, text]
        copies[source, text] += 1
        made = known.setdefault(name, {"text": text, "kind": kind, "n": text.count(",") + 1, "alleles": set(text.lower().split(",")), "places": [], "sources": set()})
        made["places"].append(place)
        made["sources"].add(source)
    left = [([v], set(v["sources"])) for v in known.values()]
    out = []
    while left:
        first = max(range(len(left)), key=lambda i: len(left[i][1]))
        members, sources = left[first]
        offers = [(i, _score(members, left[i][0], logic, scores)) for i in range(len(left)) if not sources & left[i][1]]
        worth = lambda o: (o[1], SAME > o[1] and sum(len(v["places"]) for v in left[o[0]][0]))  # noqa: E731  more records break a tie of kinds
        best = max((o for o in offers if o[1]), key=worth, default=None)
        if best is None:
            out.append(sorted(p for v in members for p in v["places"]))
            del left[first]
        else:
            keep, gone = sorted((first, best[0]))
            left[keep] = (left[keep][0] + left[gone][0], left[keep][1] | left[gone][1])
            del left[gone]
    return out


def paired(sources: list[DataFrame], logic: str = "some", order: str = "key") -> DataFrame:
    """A row per set of paired records: contig, pos, nth (from 0), n_sources, records (source, then ref, alts, id and order).

    sources have contig, pos, ref, alts, id and the column ``order``, which says how a source's records of a position
    come; a column ``end`` tells symbolic alleles of one position apart. One exchange over the union of all; positions
    of one source never leave the JVM.
    """
    text = lambda s: allele_text(F.col("ref"), F.col("alts"), F.col("end") if "end" in s.columns else None)
    named = lambda s: F.concat("id", F.lit(":"), text(s)) if logic == "id" else text(s)
    record = F.struct("ref", "alts", "id", F.col(order).alias("order"))
    tagged = [s.select("contig", "pos", F.struct(F.lit(i).alias("source"), F.col(order).alias("at"), named(s).alias("text"), kinds(F.col("ref"), F.col("alts")).alias("kind"), record.alias("record")).alias("r")) for i, s in enumerate(sources)]
    held = reduce(DataFrame.union, tagged).groupBy("contig", "pos").agg(F.array_sort(F.collect_list("r")).alias("r"))
    several = F.exists("r", lambda r: r["source"] != F.get("r", F.lit(0))["source"])
    scores = kind_scores(logic)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rows_of(list(zip(s, t, k)), logic, scores) for s, t, k in zip(*(batch.column(c).to_pylist() for c in ("sources", "texts", "kinds")))]
            kept = [batch.column(c) for c in ("contig", "pos", "records")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.list_(pa.int32())))], ["contig", "pos", "records", "rows"])

    parts = held.select("contig", "pos", several.alias("several"), F.col("r.source").alias("sources"), F.col("r.text").alias("texts"), F.col("r.kind").alias("kinds"), F.transform("r", lambda r: F.struct(r["source"].alias("source"), r["record"].alias("record"))).alias("records"))
    kind = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    alone = parts.where(~F.col("several")).select("contig", "pos", F.posexplode("records").alias("nth", "r")).select("contig", "pos", "nth", F.array("r").alias("records"))
    joined = parts.where("several").mapInArrow(pair, f"contig {kind['contig']}, pos {kind['pos']}, records {kind['records']}, rows array<array<int>>")
    joined = joined.select("contig", "pos", "records", F.posexplode("rows").alias("nth", "row")).select("contig", "pos", "nth", F.transform("row", lambda i: F.get("records", i)).alias("records"))
    return alone.unionByName(joined).select("contig", "pos", "nth", F.size("records").alias("n_sources"), "records")


def claimed(records: DataFrame, regions: DataFrame, key: str, mode: str = "pos") -> DataFrame:
    """records that meet a region, once each, with region_beg and region_end of the first that they meet.

    Regions are read one after the other, and a record that reached into an earlier one isn't read again.
    """
    spans = variants.spanned(records, mode).select(key, "contig", "beg", "end")
    met = intervals.overlap_join(spans, regions.select("contig", "beg", "end").distinct())
    first = met.groupBy(F.col(f"l_{key}").alias("__key")).agg(F.min(F.struct(F.col("r_beg").alias("beg"), F.col("r_end").alias("end"))).alias("__region"))
    return records.join(first, records[key] == F.col("__key")).select(*[records[c] for c in records.columns], F.col("__region.beg").alias("region_beg"), F.col("__region.end").alias("region_end"))


def on_targets(records: DataFrame, targets: DataFrame, key: str, mode: str = "pos", exclude: bool = False) -> DataFrame:
    """records that meet a target, or with exclude those that meet none. Regions say what is read, targets what is kept of it."""
    spans = variants.spanned(records, mode)
    return (intervals.not_overlapping if exclude else intervals.overlapping)(spans, targets, key).select(*records.columns)
