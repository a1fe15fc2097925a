"""Token counts by a finite-state transducer compiled from a byte-level BPE.

The transducer reads bytes. After a prefix of a piece, only two things matter for what may follow: the prefix's
encoding ends with one certain token, and some of its endings may still grow into a longer token. A state is
the list of those endings, each with its place in the vocabulary's trie, the last token of the encoding before it
and that encoding's length relative to the whole prefix's. A transition is annotated with the change of the
number of tokens. A token may follow another if the two bytes strings together encode to just the two; exactly
one candidate fits, so the transducer is deterministic. States and transitions are compiled when first met and
kept for the worker's later batches; beyond STATES the table starts anew.

Texts are cut into chunks, which are run side by side, one byte of each at a time. Most chunks begin at a piece, where
the transducer is back in its start state: their state map has one entry. A piece longer than LONG bytes is cut inside
as well. Such a chunk's state map is made for the states that may reach it: first the one that the bytes before it lead
to from the start state, then whatever the maps of the chunk before it lead to, until each chunk has all that its
predecessor's map gives. A parallel prefix scan composes the maps of a piece's chunks, counts added, so that each
chunk's own entry is known and a document's count is a difference of two sums.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of special tokens are ordinary text or
special as the library's default has it (they are looked up before splitting and count as one); repeated rows stay;
an empty table gives an empty result; carried columns pass through, and one that bears the name of an output
column is refused with a ValueError.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.common import table
from locusflow.llm.pretoken import starts

CHUNK = 192
#: Bytes from which a piece is cut inside, those read ahead of such a chunk to guess its state, and rounds after which only the true states are followed.
LONG, AHEAD, ROUNDS = 4 * CHUNK, 64, 16
PIECE_BYTES = 4 << 20
STATES = 1_500_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: printable Latin-1 as itself, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The counting transducer of merges [(left, right)] in order of rank; tokens are byte strings."""

    def __init__(self, merges: list[tuple[bytes, bytes]], specials: list[str]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[bytes | None] = [None]
        for t in tokens:
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            self.ends[node] = t
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [((0, b"", 0),)]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.slots = 22
        self.keys = np.full(1 << self.slots, -1, np.int64)
        self.targets, self.counts, self.used = np.zeros(1 << self.slots, np.int32), np.zeros(1 << self.slots, np.int8), 0

    def encode(self, raw: bytes) -> list[bytes]:
        """The merges applied one by one, lowest rank first and leftmost of equal ones."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, left: bytes, right: bytes) -> bool:
        if not left:
            return True
        held = self.fits.get((left, right))
        if held is None:
            held = self.fits[left, right] = self.encode(left + right) == [left, right]
        return held

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the number of tokens."""
        grown, last, more = [], None, 0
        for node, token, extra in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            end = self.ends[child]
            if last is None and end is not None and self.may_follow(token, end):  # longest first
                last, more = end, extra + 1
            if self.children[child]:
                grown.append((child, token, extra))
        key = (*[(node, token, extra - more) for node, token, extra in grown], (0, last, 0))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        return number, more

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or that of the free place where it belongs."""
        at = self._slot(keys)
        held = self.keys[at]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.slots) - 1)
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return at

    def compile(self, keys: np.ndarray) -> None:
        made = [self.step(key >> 8, key & 255) for key in keys.tolist()]
        targets, counts = (np.array(x) for x in zip(*made))
        self.used += len(keys)
        left = np.arange(len(keys))
        while len(left):  # of keys that belong in the same free place one takes it, the others look on
            at, own = np.unique(self.find(keys[left]), return_index=True)
            put = left[own]
            self.keys[at], self.targets[at], self.counts[at] = keys[put], targets[put], counts[put]
            left = np.delete(left, own)

    def lanes(self, raw: np.ndarray, first: np.ndarray, at: np.ndarray, lengths: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The end state and the tokens of stretches of raw, each from its own start state; first marks the bytes that begin pieces."""
        order = np.argsort(-lengths, kind="stable")  # long ones first: those still running are a prefix
        at, left, state, total = at[order], lengths[order], start[order].astype(np.int64), np.zeros(len(at), np.int64)
        running = len(at)
        for step in range(int(left[0]) if len(left) else 0):
            while running and left[running - 1] <= step:
                running -= 1
            here = at[:running] + step
            key = np.where(first[here], 0, state[:running]) << 8 | raw[here]
            slot = self.find(key)
            if (missing := self.keys[slot] < 0).any():
                self.compile(np.unique(key[missing]))
                slot = self.find(key)
            state[:running] = self.targets[slot]
            total[:running] += self.counts[slot]
        ends, out = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        ends[order], out[order] = state, total
        return ends, out

    def run(self, raw: np.ndarray, first: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens in each chunk raw[bounds[i]:bounds[i + 1]]. Chunks that don't begin at a piece continue that of the chunk before."""
        if len(self.states) > STATES or self.used > (1 << self.slots) // 2:
            self.clear()
        at, lengths = bounds[:-1], np.diff(bounds)
        inside = np.flatnonzero(~first[at])
        start = np.zeros(len(at), np.int64)
        if len(inside):
            start[inside], _ = self.lanes(raw, first, at[inside] - AHEAD, np.full(len(inside), AHEAD), start[inside])
        ends, total = self.lanes(raw, first, at, lengths, start)
        if not len(inside):
            return total
        maps = [{int(s): (int(e), int(n))} for s, e, n in zip(start, ends, total)]
        for _ in range(ROUNDS):
            lacking = [(i, s) for i in inside.tolist() for s in {e for e, _ in maps[i - 1].values()} - maps[i].keys()]
            if not lacking:
                break
            chunk, state = np.array(lacking, np.int64).T
            for (i, s), e, n in zip(lacking, *self.lanes(raw, first, at[chunk], lengths[chunk], state)):
                maps[i][s] = (int(e), int(n))
        # A chunk's function: which entry of its map each entry of the map before leads to; the last column stands for unknown.
        wide = max(map(len, maps))
        leads = np.zeros((len(maps), wide + 1), np.int64)
        for i in inside.tolist():
            place = {s: k for k, s in enumerate(maps[i])}
            leads[i] = wide
            leads[i, : len(maps[i - 1])] = [place.get(e, wide) for e, _ in maps[i - 1].values()]
        reach = 1
        while reach < len(maps):  # prefix scan: each round composes with what lies twice as far back
            leads[reach:] = np.take_along_axis(leads[reach:], leads[:-reach], 1)
            reach *= 2
        for i in inside.tolist():
            entries, k = list(maps[i].values()), int(leads[i, 0])
            if k < wide:
                ends[i], total[i] = entries[k]
            else:  # beyond ROUNDS the true state alone is followed, chunk after chunk
                state = int(ends[i - 1])
                if state not in maps[i]:
                    e, n = self.lanes(raw, first, at[i : i + 1], lengths[i : i + 1], np.array([state]))
                    maps[i][state] = (int(e[0]), int(n[0]))
                ends[i], total[i] = maps[i][state]
        return total

    def count(self, texts: list[bytes]) -> np.ndarray:
        """The number of tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        if self.special:
            parts, owners = [], []
            for i, t in enumerate(texts):
                pieces = [t]
                if b"<|" in t:
                    whole = t.decode("utf-8")
                    extra[i] = len(self.special.findall(whole))
                    pieces = [p.encode("utf-8") for p in self.special.split(whole)]
                parts += pieces
                owners += [i] * len(pieces)
        else:
            parts, owners = texts, range(len(texts))
        ends = np.cumsum([0, *map(len, parts)])
        whole = b"".join(parts)
        raw = np.frombuffer(whole, np.uint8)
        heads = starts(whole, ends[:-1][np.diff(ends) > 0])
        first = np.zeros(len(raw) + 1, bool)
        first[heads] = True
        # Chunks of at least CHUNK bytes that begin at pieces and end with their text at the latest.
        cut = np.zeros(len(heads), bool)
        if len(heads):
            grid = heads // CHUNK
            cut[0], cut[1:] = True, grid[1:] != grid[:-1]
            cut |= np.isin(heads, ends)
            size = np.diff(np.append(heads, len(raw)))
            cut |= size > LONG
            cut[1:] |= size[:-1] > LONG
        more = [np.arange(h + CHUNK, h + n - AHEAD, CHUNK) for h, n in zip(heads[size > LONG].tolist(), size[size > LONG].tolist())] if len(heads) else []
        bounds = np.sort(np.concatenate([heads[cut], *more, [len(raw)]]))
        sums = np.concatenate([[0], np.cumsum(self.run(raw, first, bounds))])
        per = sums[np.searchsorted(bounds, ends[1:])] - sums[np.searchsorted(bounds, ends[:-1])]
        np.add.at(extra, np.asarray(owners, np.int64), per)
        return extra


@lru_cache(2)
def load(spec: str) -> Transducer:
    """The transducer of a tokenizers file's content."""
    held = json.loads(spec)
    to_byte = byte_symbols()
    raw = lambda s: bytes(to_byte[c] for c in s)
    merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in held["model"]["merges"]]
    return Transducer(merges, [a["content"] for a in held["added_tokens"]])


FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]


def counted(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with n_bytes and n_tokens, in place of the text. vocabulary: a tokenizers file at the driver; its content is broadcast (a few MB)."""
    kept = [f for f in docs.schema.fields if f.name != text]
    if clash := {f.name for f in kept} & {f.name for f in FIELDS}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    with open(vocabulary, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = load(content.value)
        for batch in batches:
            column, sizes, counts, held, size = batch.column(text), [], [], [], 0
            for i in range(batch.num_rows):
                held.append((column[i].as_buffer() or pa.py_buffer(b"")).to_pybytes())
                size += len(held[-1])
                if size >= PIECE_BYTES or i + 1 == batch.num_rows:
                    sizes += map(len, held)
                    counts.append(transducer.count(held))
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(sizes, pa.int64()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=[*[f.name for f in kept], "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*kept, *FIELDS]))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the token count of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)
