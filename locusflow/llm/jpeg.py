"""Progressive JPEG in numpy: coefficients in, scans out, and back to full-resolution RGB.

``encode`` stores one byte per quantised coefficient. A byte b becomes the coefficient b (128 to 255) or
b - 255 (0 to 127): every coefficient then has size category 8, so the Huffman tables need one symbol each and
a scan has a constant width per coefficient. The file is an ordinary progressive JPEG with 4:2:0 chroma: DC
scans, two spectral bands at half precision, and a refinement scan for each component.

``decode`` reads any progressive or spectral-selection JPEG with Huffman coding: scans accumulate in one
coefficient array per component. Scans whose table holds a single symbol are reshaped at once; all others go
through the bit reader.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np

# Fixed values of the format: the zigzag order and the markers.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE
BANDS = ((1, 31), (32, 63))
BLOCKS_AT_ONCE = 1 << 15


def _basis() -> np.ndarray:
    """Coefficient in zigzag order to pixel: the inverse transform of an 8 x 8 block as one matrix."""
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.einsum("uy,vx->uvyx", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()
#: The coefficient whose value bits are a byte, at full precision and without its last bit.
FULL = np.array([b if b >= 128 else b - 255 for b in range(256)], np.int16)
HALF = np.array([2 * b if b >= 64 else 2 * (b - 127) for b in range(128)] * 2, np.int16)


def layout(n: int) -> tuple[int, int]:
    """Block rows and columns of the luma plane, both even, that hold n blocks with 4:2:0 chroma."""
    wide = 2 * max(1, int(np.ceil(np.sqrt(n / 6))))
    return 2 * max(1, -(-n // (3 * wide))), wide


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, place: int, symbol: int) -> bytes:
    """A Huffman table whose one symbol has the code 0."""
    return _segment(DHT, bytes([kind << 4 | place, 1, *[0] * 15, symbol]))


def _dc(b: np.ndarray) -> list[bytes]:
    """A restart after every block resets the prediction, so that the coefficient itself is coded. b: files x blocks."""
    out = np.empty((*b.shape, 5), np.uint8)
    out[..., 0], out[..., 1], out[..., 2], out[..., 3], out[..., 4] = b >> 1, b << 7 | 0x7F, 0, 0xFF, 0xD0 + np.arange(b.shape[1]) % 8
    use = np.ones(out.shape, bool)
    use[..., 2] = b & 1
    use[:, -1, 3:] = False
    flat, ends = out[use].tobytes(), np.concatenate([[0], np.cumsum(use.sum((1, 2)))])
    return [flat[i:j] for i, j in pairwise(ends.tolist())]


@lru_cache(4096)
def _heads(high: int, wide: int) -> tuple[bytes, list[bytes]]:
    """What comes before the scans, but for the comment, and the head of each scan."""
    first = [
        _segment(DQT, bytes([0, *[1] * 64])),
        _segment(SOF2, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0, 0, 8), _table(1, 0, 7), _table(1, 1, 0), _segment(DRI, b"\0\1"),
    ]
    head = lambda component, tables, *script: _segment(SOS, bytes([1, component, tables, *script]))
    scans = [head(c, 0x00, 0, 0, 0x00) for c in (1, 2, 3)]
    scans += [head(c, 0x00, start, end, 0x01) for start, end in BANDS for c in (1, 2, 3)]
    scans += [head(c, 0x01, 1, 63, 0x10) for c in (1, 2, 3)]
    scans[3] = _segment(DRI, b"\0\0") + scans[3]
    return b"".join(first), scans


def _encode_alike(payloads: list[bytes], high: int, wide: int) -> list[bytes]:
    files, room, luma, quarter = len(payloads), high * wide * 3 // 2, high * wide, high * wide // 4
    blocks = np.zeros((files, room * 64), np.uint8)
    for row, x in zip(blocks, payloads):
        row[: len(x)] = np.frombuffer(x, np.uint8)
    blocks = blocks.reshape(files, room, 64)
    planes = [blocks[:, :luma], blocks[:, luma : luma + quarter], blocks[:, luma + quarter :]]
    scans = [_dc(p[..., 0]) for p in planes]
    for start, end in BANDS:
        scans += [[x.tobytes() for x in p[..., start : end + 1] >> 1] for p in planes]
    for p in planes:
        low = (p ^ (p < 128)) & 1  # the last bit of the magnitude
        low[..., 0] = 0  # in its place the code of the end of band
        scans.append([x.tobytes().replace(b"\xff", b"\xff\0") for x in np.packbits(low, axis=2)])
    first, heads = _heads(high, wide)
    out = []
    for i, x in enumerate(payloads):
        parts = [b"\xff\xd8", _segment(COM, b"blocks=%d" % (len(x) // 64)), first]
        for head, scan in zip(heads, scans):
            parts += (head, scan[i])
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def _by(keys: list, members: list) -> dict:
    groups = defaultdict(list)
    for k, m in zip(keys, members):
        groups[k].append(m)
    return groups


def encode(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files of payloads whose lengths are positive multiples of 64; those of one layout are made together."""
    out: list = [None] * len(payloads)
    for (high, wide), members in _by([layout(len(x) // 64) for x in payloads], list(range(len(payloads)))).items():
        for i, media in zip(members, _encode_alike([payloads[i] for i in members], high, wide)):
            out[i] = media
    return out


@dataclass
class Component:
    name: int
    h: int
    v: int
    quant: int
    rows: int = 0
    cols: int = 0  # blocks in scans of this component alone
    stride: int = 0  # blocks in a row of the array, filled up to whole units
    all_rows: int = 0
    pred: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))


class Bits:
    """The bits of one restart interval."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, k: int) -> int:
        """The next k bits; zeros stand behind the end."""
        first, self.at = self.at >> 3, self.at + k
        size = ((self.at + 7) >> 3) - first
        held = int.from_bytes(self.data[first : first + size].ljust(size, b"\0"), "big")
        return held >> (-self.at & 7) & ((1 << k) - 1)

    def symbol(self, table: dict) -> int:
        code, width = 0, 0
        while width < 16:
            code, width = code << 1 | self.take(1), width + 1
            if (width, code) in table:
                return table[width, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        if not size:
            return 0
        x = self.take(size)
        return x if x >> (size - 1) else x - (1 << size) + 1


@lru_cache(256)
def _read_tables(body: bytes) -> dict[int, dict]:
    """Class and place to codes: (width, code) to symbol."""
    tables = {}
    while body:
        counts, at, code, codes = body[1:17], 17, 0, {}
        for width in range(1, 17):
            for _ in range(counts[width - 1]):
                codes[width, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        tables[body[0]], body = codes, body[at:]
    return tables


def _refine(bits: Bits, row: np.ndarray, k: int, end: int, zeros: int, step: int) -> int:
    """Correct known coefficients from k on until ``zeros`` unknown ones are passed; the place of the next unknown one."""
    while k <= end:
        if row[k]:
            if bits.take(1) and not row[k] & step:
                row[k] += step if row[k] > 0 else -step
        elif zeros == 0:
            return k
        else:
            zeros -= 1
        k += 1
    return k


def _slow(parts: list[bytes], every: int, units: list, dc: list, ac: dict, start: int, end: int, high: int, low: int) -> None:
    """One scan by the bit reader. units: for each unit of the scan its (component, block index, table place)."""
    bits, run = Bits(b""), 0
    for u, unit in enumerate(units):
        if u % every == 0:
            bits, run = Bits(parts[u // every]), 0
            for comp, _, _ in unit:
                comp.pred = 0
        for comp, block, place in unit:
            row = comp.coef[block]
            if start == 0:
                if high:
                    row[0] |= bits.take(1) << low
                else:
                    comp.pred += bits.value(bits.symbol(dc[place]))
                    row[0] = comp.pred << low
            if end == 0:
                continue
            k = max(start, 1)
            if run:
                run -= 1
                if high:
                    _refine(bits, row, k, end, 1 << 30, 1 << low)
                continue
            while k <= end:
                zeros, size = divmod(bits.symbol(ac), 16)
                if size == 0 and zeros < 15:
                    run = (1 << zeros) + bits.take(zeros) - 1
                    if high:
                        _refine(bits, row, k, end, 1 << 30, 1 << low)
                    break
                if high:
                    sign = (1 if bits.take(1) else -1) if size else 0
                    k = _refine(bits, row, k, end, zeros, 1 << low)
                    if size and k <= end:
                        row[k] = sign * (1 << low)
                else:
                    k += zeros
                    if size:
                        row[k] = bits.value(size) * (1 << low)
                k += 1


def _uniform(coef: np.ndarray, data: list[bytes], start: int, end: int, high: int) -> None:
    """One scan, of constant width per coefficient, of files x blocks x 64 coefficients."""
    files, n = coef.shape[:2]
    if end == 0:
        raw = np.frombuffer(b"".join(data), np.uint8)
        heads = np.cumsum([0, *map(len, data)])[:-1]
        at = np.sort(np.concatenate([heads, np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0)) + 2]))
        coef[..., 0] = FULL[(raw[at] << 1) | (raw[at + 1] >> 7)].reshape(files, n)
    elif not high:
        coef[..., start : end + 1] = HALF[np.frombuffer(b"".join(data), np.uint8)].reshape(files, n, -1)
    else:
        raw = b"".join([x.replace(b"\xff\0", b"\xff") for x in data])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(files, n, 64)  # the first is the code
        sign = coef >> 15
        sign[..., 0] = 0
        coef += (bits ^ sign) - sign


def _intervals(data: bytes) -> list[bytes]:
    """The restart intervals without stuffed bytes."""
    out, at, i = [], 0, data.find(b"\xff")
    while i >= 0:
        if data[i + 1] != 0:
            out.append(data[at:i])
            at = i + 2
        i = data.find(b"\xff", i + 2)
    return [p.replace(b"\xff\0", b"\xff") for p in [*out, data[at:]]]


@dataclass
class Scan:
    chosen: list[tuple[int, int]]  # component's place, tables
    start: int
    end: int
    high: int
    low: int
    every: int
    dc: list
    ac: dict
    data: bytes

    def script(self) -> tuple | None:
        """What is alike in scans that ``_uniform`` reads together; None if it can't."""
        if len(self.chosen) > 1:
            return None
        codes = self.dc[0] if self.end == 0 else self.ac
        symbol = next(iter(codes.values())) if codes and len(codes) == 1 else None
        kinds = {(8, 0, 0, 0, 0, 1): None, (0, 1, 63, 1, 0, 0): None}
        kind = (symbol, self.start, self.end, self.high, self.low, self.every)
        if kind in kinds or symbol == 7 and self.start and (self.high, self.low, self.every) == (0, 1, 0):
            return self.chosen[0][0], self.start, self.end, self.high
        return None


@dataclass
class Picture:
    frame: bytes
    quants: dict[int, bytes]
    scans: list[Scan]
    comment: bytes

    def components(self) -> tuple[list[Component], int, int]:
        _, height, width, n = struct.unpack_from(">BHHB", self.frame)
        f = self.frame
        comps = [Component(f[6 + 3 * i], f[7 + 3 * i] >> 4, f[7 + 3 * i] & 15, f[8 + 3 * i]) for i in range(n)]
        most_h, most_v = max(c.h for c in comps), max(c.v for c in comps)
        across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        for c in comps:
            c.cols, c.rows = -(-(-(-width * c.h // most_h)) // 8), -(-(-(-height * c.v // most_v)) // 8)
            c.stride, c.all_rows = across * c.h, down * c.v
        return comps, height, width


def parse(media: bytes) -> Picture:
    """The segments of a file; the scans' data is cut out, not yet read."""
    raw = np.frombuffer(media, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0) & ((raw[1:] & 0xF8) != 0xD0)).tolist()
    at, tables, every, out, names = 2, {}, 0, Picture(b"", {}, [], b""), []
    while at < len(media):
        marker = media[at + 1]
        if marker == EOI:
            break
        size = media[at + 2] << 8 | media[at + 3]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == SOS:
            n = body[0]
            chosen = [(names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            k = bisect_left(marks, at)
            stop = marks[k] if k < len(marks) else len(media)
            start, end, last = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            out.scans.append(Scan(chosen, start, end, last >> 4, last & 15, every, [tables.get(p >> 4) for _, p in chosen], tables.get(16 | chosen[0][1] & 15), media[at:stop]))
            at = stop
        elif marker == COM:
            out.comment = body
        elif marker == DQT:
            while body:
                wide = 1 + (body[0] >> 4)
                out.quants[body[0] & 15], body = body[1 : 1 + 64 * wide], body[1 + 64 * wide :]
        elif marker == DHT:
            tables |= _read_tables(body)
        elif marker == DRI:
            every = body[0] << 8 | body[1]
        elif marker in (0xC0, 0xC1, SOF2):
            out.frame, names = body, [body[6 + 3 * i] for i in range(body[5])]
    return out


def _units(comps: list[Component], chosen: list[int]) -> list:
    """The units of a scan in order, each a list of (component, block index, place in the scan)."""
    if len(chosen) == 1:
        c = comps[chosen[0]]
        return [[(c, r * c.stride + x, 0)] for r in range(c.rows) for x in range(c.cols)]
    across, down = comps[0].stride // comps[0].h, comps[0].all_rows // comps[0].v
    members = [(comps[i], k) for k, i in enumerate(chosen)]
    return [[(c, (y * c.v + j) * c.stride + x * c.h + i, k) for c, k in members for j in range(c.v) for i in range(c.h)] for y in range(down) for x in range(across)]


def _read_alike(pictures: list[Picture]) -> tuple[list[Component], int, int]:
    """Components whose coef is files x blocks x 64, for files of one frame and one scan script."""
    comps, height, width = pictures[0].components()
    for c in comps:
        c.coef = np.zeros((len(pictures), c.all_rows * c.stride, 64), np.int16)
    for k, scan in enumerate(pictures[0].scans):
        script = scan.script()
        comp = comps[scan.chosen[0][0]]
        whole = (comp.rows, comp.cols) == (comp.all_rows, comp.stride)
        if script and whole and not (scan.high and not comp.coef[..., 1:].all()):
            _uniform(comp.coef, [p.scans[k].data for p in pictures], scan.start, scan.end, scan.high)
            continue
        units = _units(comps, [i for i, _ in scan.chosen])
        stacks = [c.coef for c in comps]
        for f, p in enumerate(pictures):
            for c, stack in zip(comps, stacks):
                c.coef = stack[f]
            s = p.scans[k]
            _slow(_intervals(s.data), s.every or len(units), units, s.dc, s.ac, s.start, s.end, s.high, s.low)
        for c, stack in zip(comps, stacks):
            c.coef = stack
    return comps, height, width


def _payloads(comps: list[Component], comments: list[bytes]) -> list[bytes]:
    """The bytes that ``encode`` stored; b"" for files of other makers."""
    whole = np.concatenate([(c.coef + (c.coef >> 15)).astype(np.uint8).reshape(len(c.coef), -1) for c in comps], axis=1)  # negative ones lie 255 below their byte
    return [x[: 64 * int(c[7:])].tobytes() if c.startswith(b"blocks=") else b"" for x, c in zip(whole, comments)]


def _plane(c: Component, quant: np.ndarray) -> np.ndarray:
    """The samples of a component around 0, files x rows x columns, from whole blocks."""
    coef = c.coef.reshape(-1, 64)
    out, flat = np.empty(coef.shape, np.int16), (quant == 1).all()
    for i in range(0, len(out), BLOCKS_AT_ONCE):
        part = coef[i : i + BLOCKS_AT_ONCE].astype(np.float32)
        pixels = np.matmul(part if flat else part * quant.astype(np.float32), BASIS)
        np.rint(pixels, out=pixels)
        np.maximum(pixels, np.float32(-128), out=pixels)
        out[i : i + BLOCKS_AT_ONCE] = np.minimum(pixels, np.float32(127), out=pixels)
    return out.reshape(len(c.coef), -1, c.stride, 8, 8).swapaxes(2, 3).reshape(len(c.coef), -1, c.stride * 8)


def _rgb(comps: list[Component], height: int, width: int, quants: dict[int, bytes]) -> np.ndarray:
    """Pictures as an array files x 3 x height x width of bytes: chroma is upsampled to full resolution."""
    most_h, most_v = max(c.h for c in comps), max(c.v for c in comps)

    def whole(c: Component, p: np.ndarray) -> np.ndarray:
        p = p.repeat(most_h // c.h, 2) if most_h > c.h else p
        return (p.repeat(most_v // c.v, 1) if most_v > c.v else p)[:, :height, :width]

    table = {k: np.frombuffer(q, np.uint8 if len(q) == 64 else ">u2") for k, q in quants.items()}
    planes = [_plane(c, table[c.quant]) for c in comps]
    out = np.empty((len(planes[0]), 3, height, width), np.uint8)
    y = whole(comps[0], planes[0]) + np.int16(128)
    if len(planes) == 1:
        out[:] = y[:, None]
        return out
    (_, b, r), (_, cb, cr) = comps, planes
    # Fixed values of the format: the shares of chroma, in 1/64, added at chroma resolution and then upsampled.
    red, blue = whole(r, (90 * cr + 32) >> 6), whole(b, (113 * cb + 32) >> 6)
    green = whole(b, -((22 * cb + 46 * cr + 32) >> 6)) if cb.shape == cr.shape else -((22 * whole(b, cb) + 46 * whole(r, cr) + 32) >> 6)
    for i, x in enumerate((red, green, blue)):
        x = y + x
        np.maximum(x, np.int16(0), out=x)
        out[:, i] = np.minimum(x, np.int16(255), out=x)
    return out


def decode(medias: list[bytes]) -> list[tuple[bytes, int, int, bytes]]:
    """(payload, height, width, rgb as 3 x height x width bytes) of each file; files of one frame and script are read together."""
    pictures = [parse(m) for m in medias]

    def alike(i: int) -> tuple:
        scripts = tuple(s.script() for s in pictures[i].scans)
        return (pictures[i].frame, *pictures[i].quants.items(), *scripts, i if None in scripts else -1)

    out: list = [None] * len(medias)
    for members in _by([alike(i) for i in range(len(medias))], list(range(len(medias)))).values():
        own = [pictures[i] for i in members]
        comps, height, width = _read_alike(own)
        rgb = _rgb(comps, height, width, own[0].quants)
        for i, payload, x in zip(members, _payloads(comps, [p.comment for p in own]), rgb):
            out[i] = payload, height, width, x.tobytes()
    return out
