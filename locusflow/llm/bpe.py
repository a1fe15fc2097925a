"""Byte-level BPE encoding and decoding by folding ranked merges over the distinct pieces of many texts at once.

Texts are split by the vocabulary's pattern. The distinct pieces that a batch brings are laid out as one array of byte
tokens; each round of the fold looks up the rank of every neighbouring pair in the rank table and merges, in each
piece, the pairs of its lowest rank from the left. Rounds go on for the pieces that still have a mergeable pair.
Frequent pieces stay in a bounded table. Decoding concatenates the tokens' byte strings.

Spark's higher-order functions over a literal rank map were tried first; see the README for the figures.

Defined results: null and empty texts have no ids; strings of special tokens are ordinary text; ids outside the
vocabulary are an error on decoding; repeated rows stay; an empty table gives an empty result; carried columns pass
through, and one that bears the name of an output column is refused with a ValueError.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.common import table

KEPT = 250_000
AT_ONCE = 400_000
BATCH_BYTES = 4 << 20


class Vocabulary:
    """Ranks of byte strings: a pair of tokens merges if its bytes together are a token, whose rank is its priority."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.ranks = regex.compile(pattern), ranks
        self.size = max(ranks.values()) + 1
        self.pieces = [b""] * self.size
        for b, r in ranks.items():
            self.pieces[r] = b
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.slots = (4 * len(pairs)).bit_length()
        self.keys, self.values = np.full(1 << self.slots, -1, np.int64), np.full(1 << self.slots, self.size, np.int64)
        for key, rank in pairs.items():
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.slots)
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.slots) - 1)
            self.keys[at], self.values[at] = key, rank
        self.known: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; the vocabulary's size where there is none."""
        key = left << 20 | right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots)).astype(np.int64)
        held = self.keys[at]
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.slots) - 1)
            held = self.keys[at[open_]]
            open_ = open_[(held != key[open_]) & (held >= 0)]
        return self.values[at]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list = [b""] * len(pieces)
        token = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        while len(token):
            same = np.append(owner[1:] == owner[:-1], False)
            rank = np.full(len(token), self.size, np.int64)
            rank[same] = self.rank_of(token[:-1][same[:-1]], token[1:][same[:-1]])
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, heads)
            count = np.diff(np.append(heads, len(token)))
            done = least == self.size
            if done.any():
                for h, n in zip(heads[done].tolist(), count[done].tolist()):
                    out[owner[h]] = token[h : h + n].astype("<u4").tobytes()
                left = ~np.repeat(done, count)
                token, owner, rank, least, count = token[left], owner[left], rank[left], least[~done], count[~done]
                if not len(token):
                    break
            merge = rank == np.repeat(least, count)
            # Of pairs that overlap, the first, third, ... of each run merge.
            at = np.flatnonzero(merge)
            run = np.append(True, np.diff(at) > 1)
            odd = (at - at[np.flatnonzero(run)[np.cumsum(run) - 1]]) % 2 == 1
            at = at[~odd]
            token[at] = rank[at]
            stay = np.ones(len(token), bool)
            stay[at + 1] = False
            token, owner = token[stay], owner[stay]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out, held, owners = [[] for _ in texts], [], []

        def flush() -> None:
            new = [p for p in dict.fromkeys(held) if p not in self.known]
            made = dict(zip(new, self.encode([p.encode("utf-8") for p in new])))
            for i, piece in zip(owners, held):
                out[i].append(self.known.get(piece) or made[piece])
            for p in islice(new, max(0, KEPT - len(self.known))):
                if len(p) <= 32:
                    self.known[p] = made[p]
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            if len(text) <= BATCH_BYTES:
                found = self.pattern.findall(text)
                held += found
                owners += [i] * len(found)
                if len(held) >= AT_ONCE:
                    flush()
            else:
                pieces = (m[0] for m in self.pattern.finditer(text))
                while part := list(islice(pieces, AT_ONCE)):
                    held += part
                    owners += [i] * len(part)
                    flush()
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(2)
def load(content: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file's content: lines of a base64 byte string and its rank."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}, pattern)


def _mapped(docs: DataFrame, vocabulary: str, pattern: str, source: str, names: list[str], make) -> DataFrame:
    """docs with binary columns; make turns a vocabulary and some values of source into their values."""
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    with open(vocabulary, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(content.value, pattern)
        for batch in batches:
            column, start, held, size = batch.column(source), 0, [], 0
            for i in range(batch.num_rows):
                held.append(column[i].as_py())
                size += len(held[-1] or "")
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.binary()) for x in make(words, held))], names=[*part.schema.names, *names])
                    start, held, size = i + 1, [], 0

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.BinaryType()) for n in names)]))


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with ids, the tokens of the text as little-endian unsigned 32-bit integers. The file's content is broadcast (about 1 MB)."""
    return _mapped(docs, vocabulary, pattern, text, [ids], lambda words, held: [words.ids([t or "" for t in held])])


def decoded(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """docs with decoded, the bytes of the ids; a null for null ids."""
    return _mapped(docs, vocabulary, pattern, ids, [raw], lambda words, held: [[None if x is None else words.decode(x) for x in held]])


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """docs with ids and what they decode to, in one Python worker a task."""

    def make(words: Vocabulary, held: list[str | None]) -> list[list[bytes]]:
        made = words.ids([t or "" for t in held])
        return [made, [words.decode(x) for x in made]]

    return _mapped(docs, vocabulary, pattern, text, [ids, raw], make)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: digests of every document's ids and of what they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    back = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
