"""Where the pieces of a byte-level BPE begin: the splitting pattern as comparisons of neighbouring characters.

The pattern (fixed, as public byte-level vocabularies use it) is
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE, GAP = 0, 1, 2, 3, 4
SHORT = {ord(c): 1 for c in "stmd"}
LONG = ("re", "ve", "ll")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    every, out = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", GAP), (" ", SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def starts(raw: bytes, breaks: np.ndarray) -> np.ndarray:
    """Byte places at which pieces begin. A text begins at each of breaks, byte places of whole characters."""
    code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    place = np.zeros(n, np.int64)
    np.cumsum((1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000))[:-1], out=place[1:])
    kind = classes()[code]
    fresh = np.zeros(n + 1, bool)
    fresh[0] = fresh[n] = True
    fresh[np.searchsorted(place, breaks)] = True
    gap = kind >= SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[fresh[:n]] = 9
    after_gap = np.append(gap[1:], True) | fresh[1:]  # the next character is white space, or there is none
    first = np.where(gap, (before < SPACE) | (before == 9) | ~after_gap, (before != kind) & (before != SPACE))
    for i in np.flatnonzero((code == 39) & first).tolist():  # contractions
        end = i + 1
        while end < n and end < i + 3 and not fresh[end]:
            end += 1
        tail = "".join(map(chr, code[i + 1 : end]))
        k = 1 if tail and ord(tail[0]) in SHORT else 2 if tail in LONG else 0
        if k:
            first[i + 1] = False
            if i + 1 + k < n:
                first[i + 1 + k] = True
    return place[first]
