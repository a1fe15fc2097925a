"""Substring dedup by hashed windows: documents are held against all that stands before them.

Window hashes stand in for relative Lempel-Ziv parsing: no longest match is taken and no factor has a reference
position. Every earlier match of SPAN words or more is a union of windows that occur earlier, so the words are the same.

The reference is the corpus itself, indexed in blocks. An index entry is an anchor: in every window of SPAN words
the run of ANCHOR words with the smallest hash, so that two equal windows have the same anchor. Documents probe
the index; anchors found nowhere else end there. Where an anchor is shared, the document's windows are
looked up whole, among them those across the bounds of factors: the earliest occurrence is the reference, and
every later one extends a factor of its document. Factors, runs of such windows, have at least SPAN words.

Two exchanges carry hashes, packed by bucket in numpy arrays: the anchors (about a seventh of the words) and the
windows around shared anchors. A task sends one entry per distinct hash, however often it occurs in the
task, so that a passage in every document is one entry per task. The texts are exchanged once, by row; both
joins use that exchange.

Defined results: null and empty texts have no words and lose none; doc_id orders the documents, null first; rows
that share a doc_id are ordered by a hash of their text, and rows equal in both count as one document, so that
copies under one doc_id stay; an empty table gives an empty result; other columns pass through ``clean`` and aren't
read by ``factors``; a column named as an output is refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.common import shuffle_partitions, table
from locusflow.llm.grams import SECOND, ngrams, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPAN, ANCHOR = 20, 8
CHOICE = SPAN - ANCHOR + 1
AT_ONCE = 1 << 18
FLUSH = 2_000_000  # entries that a task holds before it packs them
PACKED = "bucket int, first binary, second binary, doc binary, row binary, pos binary, known boolean"
FOUND = "row bigint, start int, words int"


def row_key(doc_id: Column, text: Column) -> Column:
    """A row's identity: its document and its text."""
    return F.xxhash64(doc_id, text)


def _anchors(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window starts that lie in one text, the place of each window's anchor, and the hashes of all anchors."""
    count = np.diff(offsets)
    starts = np.concatenate([np.arange(o, o + c - SPAN + 1) for o, c in zip(offsets, count) if c >= SPAN] or [np.zeros(0, np.int64)])
    grams = ngrams(hashes, ANCHOR)
    if not len(starts):
        return starts, starts, grams
    views = np.lib.stride_tricks.sliding_window_view(grams, CHOICE)
    places = np.concatenate([views[part].argmin(1) + part for part in np.split(starts, range(AT_ONCE, len(starts), AT_ONCE))])
    return starts, places, grams


def _pack(first, second, doc, row, pos, known: bool, buckets: int) -> Iterator[dict]:
    """Entries by bucket, the partition of their hash; those already settled by that of their row. Without a second hash half of the first is sent."""
    place = ((row.astype(np.uint64) if known else first) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    if first is not None and second is None:
        first = (first >> np.uint64(32)).astype(np.uint32)
    for part in np.split(order, cuts) if len(order) else []:
        raw = lambda x: x[part].tobytes() if x is not None else b""
        yield {"bucket": int(place[part[0]]), "first": raw(first), "second": raw(second), "doc": raw(doc), "row": raw(row), "pos": raw(pos), "known": known}


ARROW = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n in ("first", "second", "doc", "row", "pos")], ("known", pa.bool_())])
ARROW_FOUND = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("words", pa.int32())])


def _later(first, second, doc, row, pos) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by hash and then by occurrence; in it, which entries come after another place of their hash, and which are the first of it."""
    order = np.lexsort((pos, row, doc, second, first))
    f, s, d, r, p = first[order], second[order], doc[order], row[order], pos[order]
    new = np.ones(len(order), bool)
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, ~((d == d[head]) & (r == r[head]) & (p == p[head])), new


def _shared(new: np.ndarray) -> np.ndarray:
    """Which entries are not alone, where ``new`` marks the first of each hash."""
    return (np.diff(np.append(np.flatnonzero(new), len(new))) > 1)[np.cumsum(new) - 1]


def _settle(held: list[tuple], buckets: int, anchors: bool) -> pa.RecordBatch:
    """A task's entries: one of each hash goes on; what the task's own entries tell of the others is settled here."""
    first, second, doc, row, pos = (np.concatenate(x) for x in zip(*held))
    order, later, new = _later(first, second, doc, row, pos)
    ask, done = order[new], order[_shared(new) if anchors else later]
    out = [*_pack(first[ask], None if anchors else second[ask], None if anchors else doc[ask], row[ask], pos[ask], False, buckets), *_pack(None, None, None, row[done], pos[done], True, buckets)]
    return pa.RecordBatch.from_pylist(out, ARROW)


def _send(buckets: int, doc_id: str, text: str, anchors: bool):
    """Entries of the anchors of texts, or of the windows whose anchors are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            docs = batch.column(doc_id).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()
            keys, marks = batch.column("__row").to_numpy(), None if anchors else batch.column("__marks")
            for at, offsets, hashes in words_of(batch.column(text)):
                starts, places, grams = _anchors(hashes, offsets)
                if not len(starts):
                    continue
                if anchors:
                    use = np.unique(places)
                    first, second = grams[use], np.zeros(len(use), np.uint32)
                else:
                    good = np.zeros(len(hashes), bool)
                    for i, o in enumerate(offsets[:-1]):
                        if marks[at + i].is_valid:
                            good[o + marks[at + i].values.to_numpy()] = True
                    use = starts[good[places]]
                    first, second = ngrams(hashes, SPAN)[use], (ngrams(hashes, SPAN, SECOND)[use] >> np.uint64(32)).astype(np.uint32)
                own = np.searchsorted(offsets, use, "right") - 1
                held.append((first, second, docs[at + own], keys[at + own], (use - offsets[own]).astype(np.int32)))
                size += len(use)
                if size >= FLUSH:
                    yield _settle(held, buckets, anchors)
                    held, size = [], 0
        if size:
            yield _settle(held, buckets, anchors)

    return run


def _meet(anchors: bool):
    """The entries of a partition: for anchors every occurrence of a shared hash, for windows all but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: list[list] = [[], [], [], [], []]
        for batch in batches:
            for r in batch.to_pylist():
                row, pos = np.frombuffer(r["row"], np.int64), np.frombuffer(r["pos"], np.int32)
                if not r["known"]:
                    if anchors:  # 32 bits inside a bucket: anchors that fall together only have windows looked up in vain
                        held = ((np.uint64(r["bucket"]) << np.uint64(32)) | np.frombuffer(r["first"], np.uint32), np.zeros(len(row), np.uint32), np.zeros(len(row), np.int64))
                    else:
                        held = (np.frombuffer(r["first"], np.uint64), np.frombuffer(r["second"], np.uint32), np.frombuffer(r["doc"], np.int64))
                    for x, v in zip(asks, (*held, row, pos)):
                        x.append(v)
                    continue
                order = np.lexsort((pos, row))
                row, pos = row[order], pos[order]
                cut = np.ones(len(row), bool)  # windows that overlap or meet are one run
                cut[1:] = (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + (0 if anchors else SPAN))
                head = np.flatnonzero(cut)
                long = pos[np.append(head[1:], len(pos)) - 1] - pos[head] + SPAN
                yield pa.RecordBatch.from_arrays([pa.array(row[head]), pa.array(pos[head]), pa.array(long.astype(np.int32))], schema=ARROW_FOUND)
        if asks[0]:
            first, second, doc, row, pos = (np.concatenate(x) for x in asks)
            order, later, new = _later(first, second, doc, row, pos)
            hit = order[_shared(new) if anchors else later]
            yield pa.RecordBatch.from_arrays([pa.array(row[hit]), pa.array(pos[hit]), pa.array(np.full(len(hit), SPAN, np.int32))], schema=ARROW_FOUND)

    return run


def factors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (see row_key), start, words: runs of words whose every window of SPAN starts earlier somewhere. They may overlap."""
    n = shuffle_partitions(docs.sparkSession)
    keyed = docs.withColumn("__row", row_key(F.col(doc_id), F.col(text)))

    def looked_up(df: DataFrame, anchors: bool) -> DataFrame:
        sent = df.mapInArrow(_send(n, doc_id, text, anchors), PACKED)
        return sent.repartitionById(n, "bucket").mapInArrow(_meet(anchors), FOUND)

    marks = looked_up(keyed.select(doc_id, text, "__row"), True).groupBy("row").agg(F.collect_set("start").alias("__marks"))
    probed = keyed.join(marks.withColumnRenamed("row", "__row").hint("shuffle_hash"), "__row", "left").where(F.col("__marks").isNotNull())
    return looked_up(probed, False)


CLEAN = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept, the words left joined by one space."""
    if clash := set(docs.columns) & {"n_words", "n_removed", "kept", "__row", "__spans", "__marks"}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    spans = factors(docs, doc_id, text).groupBy("row").agg(F.collect_list(F.struct("start", "words")).alias("__spans")).withColumnRenamed("row", "__row")
    joined = docs.withColumn("__row", row_key(F.col(doc_id), F.col(text))).join(spans.hint("shuffle_hash"), "__row", "left").drop("__row")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = ([], [], [])
            for t, spans in zip(batch.column(text), batch.column("__spans")):
                own = WORD.findall(t.as_py() or "")
                gone = np.zeros(len(own), bool)
                if spans.is_valid:
                    found = spans.values
                    for s, w in zip(found.field("start").to_numpy(), found.field("words").to_numpy()):
                        gone[s : s + w] = True
                left = [w for w, g in zip(own, gone.tolist()) if not g] if gone.any() else own
                for x, v in zip(made, (len(own), len(own) - len(left), " ".join(left))):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *CLEAN]))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: what every document loses and keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
