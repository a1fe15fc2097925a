"""Toxicity by compression distance: which dictionary makes a window of text shorter?

Two zstandard dictionaries are made of labelled documents. The ordinary one is trained on all windows of ordinary
documents. The toxic one holds the stretches of toxic documents that set them apart: runs of SEED bytes that occur in
toxic text, in many surroundings, far more often than in ordinary text, grown to the left and right as long as most of
their occurrences go on alike, the most frequent first. Behind them it ends as the ordinary one does, so that common
text costs the same in both and lengths differ by what is special alone: with a toxic dictionary trained as the
ordinary one is, the chance differences of common text hide the few toxic words of a window. On the
held-out fold at sf0.1, learned from all other labelled documents, with the same windows and search, the AUC is 0.74
and 0.66 for dictionaries of 4 and 16 KB trained alike, and 0.97 for these.

Every window of WINDOW words is compressed with either dictionary. The bytes that the toxic one saves, as the largest,
the mean of the three largest, mean, deviation, and how often they reach each of some bounds, go through logistic
thresholds; classes weigh the same in their fit. They are fitted to documents that the dictionaries didn't see: each
fold is measured with dictionaries of the others. Whole texts are scored, row by row, without a shuffle.

The fit reads a bounded sample: at most ``per_class`` labelled documents of each class, none longer than ``max_chars``,
which ones is settled by a hash of the id; of several texts with one id the one whose hash is least. Documents whose
crc32(id) mod 5 is 0 are held out from all of it.

Defined results: null and empty texts have one empty window and get the calibrated score of that; equal texts
get equal scores; labels that are null, or whose document is missing, aren't used; without labels of both
classes in every fold, or where nothing sets toxic documents apart, every score is the share of toxic labels seen
(0 without labels); repeated rows stay; carried columns pass through, and one that bears the name of an output column
is refused with a ValueError.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.common import table
from locusflow.llm.grams import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of a window that is scored, and of one that the ordinary dictionary is trained on.
WINDOW, SAMPLE = 3, 8
TOXIC_BYTES, ORDINARY_BYTES = 1024, 4096
#: The search finds matches of 4 bytes; the levels' own settings for small inputs miss many of them.
SEARCH = {"window_log": 15, "chain_log": 15, "hash_log": 15, "search_log": 7, "min_match": 4, "strategy": zs.STRATEGY_LAZY}
#: Bytes of a run; in what share of the toxic documents and how many times as often as in ordinary text it occurs at least; of what share of a stretch's best run the others are; what share of the occurrences goes on alike; bytes of a stretch.
SEED, SHARE, TIMES, EDGE, ALIKE, LONGEST = 5, 0.02, 6, 0.3, 0.6, 24
BOUNDS = (2, 3, 4, 5, 6, 8)
#: Stands before every window and at the end of both dictionaries: one sure match, so that no window is stored raw.
ANCHOR = b"|#0123456789-abcdefghij-0123456789#|"
PER_CLASS = 2000
MAX_CHARS = 20_000
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """Dictionaries and logistic weights. Its size is bounded by the dictionary sizes."""

    toxic: bytes
    ordinary: bytes
    mean: tuple
    scale: tuple
    weights: tuple
    base: float


def windows(text: str, size: int = SAMPLE) -> list[bytes]:
    w = WORD.findall(text.lower())
    return [ANCHOR + (" " + " ".join(w[i : i + size]) + " ").encode("utf-8", "replace") for i in range(0, len(w), size)] or [ANCHOR]


@lru_cache(16)
def _compressor(content: bytes) -> zs.ZstdCompressor:
    settings = zs.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
    held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=settings)
    return zs.ZstdCompressor(compression_params=settings, dict_data=held)


def _lengths(content: bytes, parts: list[bytes]) -> np.ndarray:
    packed = _compressor(content).multi_compress_to_buffer(parts, threads=0) if len(parts) > 1 else [_compressor(content).compress(parts[0])]
    return np.array([len(packed[i]) for i in range(len(packed))], np.float64)


def savings(model: Model, text: str) -> list[float]:
    """Statistics of the bytes that the toxic dictionary saves, over the windows of a text."""
    parts = windows(text, WINDOW)
    saved = np.sort(_lengths(model.ordinary + ANCHOR, parts) - _lengths(model.toxic + model.ordinary + ANCHOR, parts))[::-1]
    many = [int((saved >= k).sum()) for k in BOUNDS]
    return [saved[0], saved[:3].mean(), saved.mean(), saved.std(), np.log(len(parts)), *(k / len(parts) for k in many), *np.log1p(many)]


def _train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train, their own last bytes."""
    whole = b"".join(samples)
    if len(samples) >= 16 and len(whole) >= 2 * size:
        try:
            return zs.train_dictionary(size, samples, k=32, d=6).as_bytes()
        except zs.ZstdError:
            pass
    return whole[-size:]


def _runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's bytes with one space between words and eight around all; where its runs start, their values, and hashes of the eight bytes before and behind."""
    raw = np.frombuffer(" ".join([" " * 7, *WORD.findall(text.lower()), " " * 7]).encode("utf-8", "replace"), np.uint8)
    eight = np.zeros(len(raw) - 7, np.uint64)
    for j in range(8):
        eight = eight << np.uint64(8) | raw[j : len(raw) - 7 + j]
    at = np.arange(7, len(raw) - SEED - 6)
    around = mix(eight[np.maximum(at - 8, 0)] * np.uint64(0x9E3779B97F4A7C15) + eight[np.minimum(at + SEED, len(eight) - 1)])
    return raw, at, eight[at] >> np.uint64(64 - 8 * SEED), around


def _surroundings(pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of (run, surroundings), and in how many different surroundings each occurs: copies of a passage count once."""
    run, around = np.concatenate([np.zeros((2, 0), np.uint64), *pairs], axis=1)
    order = np.lexsort((around, run))
    run, around = run[order], around[order]
    new = np.append(True, (run[1:] != run[:-1]) | (around[1:] != around[:-1]))[: len(run)]
    return np.unique(run[new], return_counts=True)


def _value(runs: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of runs among the sorted known ones, 0 for others."""
    if not len(known):
        return np.zeros(len(runs))
    at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
    return np.where(known[at] == runs, values[at], 0)


def _grown(core: bytes, whole: bytes) -> bytes:
    """A stretch with what follows and precedes most of its occurrences, up to the next space and that included."""
    places = [m.start() for m in re.finditer(re.escape(core), whole)]
    for ahead in (True, False):
        while len(core) < LONGEST and places:
            beside = [p + len(core) if ahead else p - 1 for p in places]
            byte, times = Counter(whole[p] for p in beside if 0 <= p < len(whole)).most_common(1)[0]
            if times < ALIKE * len(places) or byte == 10:
                break
            places = [p if ahead else q for p, q in zip(places, beside) if 0 <= q < len(whole) and whole[q] == byte]
            core = core + bytes([byte]) if ahead else bytes([byte]) + core
            if byte == 32:
                break
    return core


def _apart(toxic: list[str], ordinary: list[str], size: int = TOXIC_BYTES) -> bytes:
    """The stretches that set toxic texts apart, at most ``size`` bytes of them, the most frequent last, where matches cost least."""
    least = max(4, int(np.ceil(SHARE * len(toxic))))
    found, slots = np.zeros(1 << 22, np.int32), lambda run: (mix(run.copy()) >> np.uint64(42)).astype(np.int64)
    for t in toxic:
        found[np.unique(slots(_runs(t)[2]))] += 1
    pairs, toxic_bytes, ordinary_bytes = [], 0, 0
    for t in toxic:
        _, _, run, around = _runs(t)
        often = found[slots(run)] >= least
        pairs.append(np.stack([run[often], around[often]]))
        toxic_bytes += len(run)
    runs, times = _surroundings(pairs)
    runs, times = runs[times >= least], times[times >= least]
    pairs = []
    for t in ordinary:
        _, _, run, around = _runs(t)
        known = _value(run, runs, np.ones(len(runs))) > 0
        pairs.append(np.stack([run[known], around[known]]))
        ordinary_bytes += len(run)
    plain = _value(runs, *_surroundings(pairs))
    good = times * ordinary_bytes >= TIMES * (plain + 1) * toxic_bytes
    runs, times = runs[good], (times - plain * toxic_bytes / max(1, ordinary_bytes))[good]
    cores: Counter = Counter()
    for t in toxic:
        raw, at, run, _ = _runs(t)
        value = _value(run, runs, times)
        bounds = np.flatnonzero(np.diff(np.concatenate([[0], (value > 0).astype(np.int8), [0]])))
        for lo, hi in zip(bounds[::2], bounds[1::2]):
            strong = np.flatnonzero(value[lo:hi] >= EDGE * value[lo:hi].max())
            for part in np.split(strong, np.flatnonzero(np.diff(strong) > 1) + 1):
                cores[raw[at[lo + part[0]] : at[lo + part[-1]] + SEED].tobytes()] += 1
    inside = lambda x: [int.from_bytes(x[j : j + SEED], "big") for j in range(len(x) - SEED + 1)]
    whole, left, out = b"\n".join(_runs(t)[0].tobytes() for t in toxic), set(runs.tolist()), []
    for core in sorted(cores, key=lambda x: (-cores[x], x)):
        own = inside(core)
        if cores[core] < 2 or 2 * sum(x in left for x in own) < len(own):
            continue
        stretch = _grown(core, whole)
        if sum(map(len, out)) + len(stretch) > size:
            break
        out.append(stretch)
        left.difference_update(own, inside(stretch))
    return b"".join(reversed(out))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and weights; both classes weigh the same."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-6, *[1.0] * x.shape[1]])
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (share * (y - p)) - ridge @ w)
    return mean, scale, w


def _dictionaries(rows: list[tuple[int, int, str]], base: float) -> Model:
    texts = [list(dict.fromkeys(t for _, y, t in rows if y == k)) for k in (0, 1)]
    return Model(_apart(texts[1], texts[0]), _train(ORDINARY_BYTES, [w[len(ANCHOR) :] for t in texts[0] for w in windows(t)]), (), (), (), base)


def learn(rows: list[tuple[int, int, str]]) -> Model:
    """The model of rows (fold, toxic, text)."""
    folds, base = sorted({f for f, _, _ in rows}), float(np.mean([y for _, y, _ in rows])) if rows else 0.0
    if len(folds) < 2 or any(len({y for f, y, _ in rows if (f == k) == own}) < 2 for k in folds for own in (True, False)):
        return Model(b"", b"", (), (), (), base)
    x, y = [], []
    for k in folds:
        seen = _dictionaries([r for r in rows if r[0] != k], base)
        x += [savings(seen, t) for f, _, t in rows if f == k]
        y += [label for f, label, _ in rows if f == k]
    model = _dictionaries(rows, base)
    if not model.toxic:
        return Model(b"", b"", (), (), (), base)
    mean, scale, weights = _logistic(np.array(x), np.array(y, float))
    return Model(model.toxic, model.ordinary, tuple(mean), tuple(scale), tuple(weights), base)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != 0)
    chosen = [known.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # At most 2 * per_class ids: small enough to broadcast by construction; one text for each.
    rows = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).withColumn("fold", fold).collect()
    return learn([(r["fold"], r["toxic"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0)."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if clash := set(docs.columns) & {f.name for f in added}:
        raise ValueError(f"columns {sorted(clash)} exist already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.weights:
                x = np.array([savings(model, t or "") for t in batch.column(text).to_pylist()]).reshape(-1, len(model.mean))
                z = (x - np.array(model.mean)) / np.array(model.scale)
                p = 1 / (1 + np.exp(-np.clip(model.weights[0] + z @ np.array(model.weights[1:]), -30, 30)))
            else:
                p = np.full(batch.num_rows, model.base)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
