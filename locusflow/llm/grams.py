"""Words and word n-grams of Arrow text columns as 64-bit hashes, in numpy.

Texts are taken from the column's own buffers and worked on in pieces of bounded size. Hashes are the same in
every task: polynomial sums modulo 2**64 over fixed tables, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
MASK = (1 << 64) - 1


def _stream(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


BYTES = _stream(1, 256)
LOWER = BYTES[[i + 32 if 65 <= i <= 90 else i for i in range(256)]]
BASE, SECOND = (int(x) for x in _stream(2, 2))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        held = _powers[base] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, inverse))
    return held[0][:n], held[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _piece_words(raw: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of raw; a text starts at each of breaks."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    edge[breaks] = True
    before = np.concatenate([[True], gap])
    starts = np.flatnonzero(~gap & (before[:-1] | edge[:-1]))
    ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1
    up, down = powers(BASE, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[:-1], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def words_of(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, hashes): the words of rows first + i are hashes[offsets[i]:offsets[i + 1]].

    Rows come in order and whole, together about PIECE bytes unless one text is longer; that one is read in pieces.
    Nulls have no words. With lower, A-Z count as a-z.
    """
    table = LOWER if lower else BYTES
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if last == row + 1 and hi - lo > PIECE:
            parts, at = [], lo
            while at < hi:
                cut = min(hi, at + PIECE)
                while cut < hi and not (raw[cut] == 32 or 9 <= raw[cut] <= 13):
                    cut += 1
                parts.append(_piece_words(raw[at:cut], np.zeros(0, np.int64), table)[1])
                at = cut
            hashes = np.concatenate(parts)
            yield row, np.array([0, len(hashes)]), hashes
        else:
            starts, hashes = _piece_words(raw[lo:hi], offsets[row:last] - lo, table) if hi > lo else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            yield row, np.searchsorted(starts, offsets[row : last + 1] - lo), hashes
        row = last


def ngrams(hashes: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """The hash of each run of n words, as if there were no bounds between texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])
