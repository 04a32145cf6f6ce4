"""Lossless WebP (VP8L) in numpy: decoder for all of the format, encoder, and a column operator that stores texts as images.

Decoder: prefix codes, back-references, colour cache, entropy images; then the predictor, cross-colour, subtract-green
and palette transforms are inverted. An image of one code group without a cache is decoded by arrays: the length of the
token that would start at every bit position is looked up at once, then the chain of real positions is followed, literals
are put in place together and references copied in order. All others go token by token.

Texts are stored a byte a pixel, as the green sample: repeats within a block as references, the rest as literals under
one of a few fixed codes, after a palette (by frequency, packed where it is small) or a predictor wherever that is smaller.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
# Fixed values of the format: order of code length codes, and the cache's hash multiplier.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
#: Near distances in the format's order: pixels above or to the left, by Euclidean distance, then by column.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if (y or x > 0)), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
#: Largest width or height.
MOST = 1 << 14
#: Bits that one array pass of the decoder covers.
SPAN = 1 << 18
#: Texts are searched for repeats in blocks of this many bytes; shorter repeats than LEAST stay literals, longer ones than LONGEST (the format's bound) go in parts.
BLOCK, LEAST, LONGEST = 1 << 18, 6, 4096


class Bits:
    """Reader of little-endian bits; reading past the end is an error."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        at, stop = self.at, self.at + n
        if stop > 8 * len(self.data):
            raise ValueError("image data end early")
        self.at = stop
        return (int.from_bytes(self.data[at >> 3 : (stop + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        at = self.at
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


class Code:
    """A prefix code: table of 2**15 entries, length | symbol << 4, indexed by the next bits."""

    def __init__(self, lengths: np.ndarray, only: int | None = None):
        self.lengths = lengths
        self.most = only if only is not None else int(np.flatnonzero(lengths)[-1]) if lengths.any() else 0
        if only is not None:
            self.table = np.full(1 << 15, only << 4, np.uint16)
            return
        held = np.flatnonzero(lengths)
        if len(held) == 0 or (2.0 ** -lengths[held].astype(float)).sum() != 1:
            raise ValueError("not a full prefix code")
        table = np.zeros(1 << 15, np.uint16)
        for symbol, code in canonical(lengths).items():
            n = int(lengths[symbol])
            table[code :: 1 << n] = (symbol << 4) | n
        self.table = table

    def read(self, bits: Bits) -> int:
        entry = int(self.table[bits.peek(15)])
        bits.at += entry & 15
        if bits.at > 8 * len(bits.data):
            raise ValueError("image data end early")
        return entry >> 4


def canonical(lengths: np.ndarray) -> dict[int, int]:
    """Symbol -> its code as it stands in the stream, first bit lowest."""
    out, code, last = {}, 0, 0
    for n, symbol in sorted((int(lengths[s]), int(s)) for s in np.flatnonzero(lengths)):
        code <<= n - last
        last = n
        out[symbol] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]
        lengths = np.zeros(size, np.uint8)
        if max(symbols) >= size:
            raise ValueError("symbol beyond its alphabet")
        if len(set(symbols)) == 1:
            return Code(lengths, symbols[0])
        lengths[symbols] = 1
        return Code(lengths)
    meta = np.zeros(19, np.uint8)
    for k in range(4 + bits.read(4)):
        meta[LENGTH_ORDER[k]] = bits.read(3)
    own = Code(meta, int(np.flatnonzero(meta)[0])) if np.count_nonzero(meta) == 1 else Code(meta)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, at, before = np.zeros(size, np.uint8), 0, 8
    while at < size and left:
        left -= 1
        symbol = own.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            before = symbol or before
            at += 1
            continue
        value, n = (before, 3 + bits.read(2)) if symbol == 16 else (0, 3 + bits.read(3)) if symbol == 17 else (0, 11 + bits.read(7))
        if at + n > size:
            raise ValueError("code lengths beyond their alphabet")
        lengths[at : at + n] = value
        at += n
    if np.count_nonzero(lengths) == 1:
        return Code(lengths, int(np.flatnonzero(lengths)[0]))
    return Code(lengths)


_GROUPS: dict[tuple[int, int, bytes], tuple[int, int, list[Code]]] = {}


def _read_group(bits: Bits, cache_bits: int) -> list[Code]:
    """The five codes of a group. Groups met before are known by their bits (the first 16 bytes find them, all must agree)."""
    start = bits.at
    key = (start & 7, cache_bits, bits.data[start >> 3 : (start >> 3) + 16])
    if known := _GROUPS.get(key):
        n, value, codes = known
        if bits.peek(n) == value:
            bits.at += n
            return codes
    codes = [_read_code(bits, size) for size in (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)]
    for k in (1, 2, 3):  # equal codes share a table
        for j in range(k):
            if np.array_equal(codes[j].table, codes[k].table):
                codes[k].table = codes[j].table
                break
    n, bits.at = bits.at - start, start
    if len(_GROUPS) > 64:
        _GROUPS.clear()
    _GROUPS[key] = n, bits.peek(n), codes
    bits.at = start + n
    return codes


def _number(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels (height, width) of one entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    place, groups = None, 1
    if main and bits.read(1):
        step = bits.read(3) + 2
        meta = (_read_image(bits, -(-width >> step), -(-height >> step), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
        place = np.repeat(np.repeat(meta, 1 << step, 0)[:height], 1 << step, 1)[:, :width].ravel().tolist()
    codes = [_read_group(bits, cache_bits) for _ in range(groups)]
    if place is None and not cache_bits:
        return _spans(bits, codes[0], width, height)
    return _tokens(bits, codes, place, width, height, cache_bits)


#: Extra bits of a length or distance by its prefix.
EXTRA = np.array([0, 0, 0, 0, *((p - 2) >> 1 for p in range(4, 40))], np.int32)


def _values(prefix: np.ndarray, whole: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lengths or distance codes from their prefixes and the extra bits at bit positions `at`; whole: the 24 bits from each byte on."""
    extra = EXTRA[prefix]
    byte = at >> 3
    bits = (whole[byte].astype(np.int64) | (whole[np.minimum(byte + 2, len(whole) - 1)].astype(np.int64) >> 8 << 24)) >> (at & 7)
    base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return base + (bits & ((1 << extra.astype(np.int64)) - 1)) + 1


def _spans(bits: Bits, codes: list[Code], width: int, height: int) -> np.ndarray:
    """Pixels of an image of one group without a cache; spans of the stream are looked up whole."""
    n = width * height
    green, red, blue, alpha, far = (c.table for c in codes)
    same = green is red and green is blue and green is alpha
    refers = codes[0].most >= 256
    if not any(t[0] & 15 for t in (green, red, blue, alpha)) and all(c.most == c.table[0] >> 4 for c in codes[:4]) and not refers:  # one colour takes no bits
        return np.full((height, width), (int(alpha[0]) >> 4 << 24) | (int(red[0]) >> 4 << 16) | (int(green[0]) >> 4 << 8) | int(blue[0]) >> 4, np.uint32)
    flat = [t if t[0] & 15 or c.most != t[0] >> 4 else None for c, t in zip(codes[:4], (green, red, blue, alpha), strict=True)]  # None: one symbol without bits
    near = np.array([max(1, x + y * width) for x, y in NEAR], np.int64)
    data = np.frombuffer(bits.data, np.uint8)
    out, made = np.empty(n, np.uint32), 0
    while made < n:
        first = bits.at >> 3
        have = min(len(data) - first, SPAN // 8 + 16, (n - made) * 10 + 16)
        if have <= 0:
            raise ValueError("image data end early")
        own = np.zeros(have + 16, np.uint32)
        own[:have] = data[first : first + have]
        whole = own[:-2] | (own[1:-1] << np.uint32(8)) | (own[2:] << np.uint32(16))
        window = ((whole[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0x7FFF)).ravel()
        here = np.arange(len(window), dtype=np.int32)
        limit = np.int32(len(window) - 1)
        entry, step = [], []
        for t in flat:
            if same and entry:
                entry.append(entry[0]), step.append(step[0])
            elif t is None:
                entry.append(None), step.append(None)
            else:
                entry.append(t[window])
                step.append(np.minimum(here + (entry[-1] & 15), limit))
        lit = here
        for s in step:
            lit = lit if s is None else s if lit is here else s[lit]
        jump = lit
        if refers:
            symbol = (entry[0] >> 4).astype(np.int32) - 256
            starts = np.flatnonzero(symbol >= 0).astype(np.int32)
            prefix = symbol[starts]
            extra_at = step[0][starts]
            far_at = np.minimum(extra_at + EXTRA[prefix], limit)
            far_entry = far[window[far_at]]
            jump = lit.copy() if lit is here or lit is step[0] else lit
            jump[starts] = np.minimum(far_at + (far_entry & 15) + EXTRA[np.minimum(far_entry >> 4, 39)], limit)
        chain, at, stop = memoryview(np.ascontiguousarray(jump)), bits.at & 7, min(SPAN, 8 * have - 1)
        places: list[int] = []
        put = places.append
        for _ in range(n - made):
            if at > stop:
                break
            put(at)
            at = chain[at]
        p = np.array(places, np.int32)
        size = np.ones(len(p), np.int64)
        ref = np.zeros(0, np.int64)
        if refers:
            ref = np.flatnonzero(symbol[p] >= 0)
            size[ref] = _values(symbol[p[ref]], whole, step[0][p[ref]])
        ends = np.cumsum(size)
        if len(p) and ends[-1] > n - made:  # what follows the image
            count = int(np.searchsorted(ends, n - made)) + 1
            if ends[count - 1] > n - made:
                raise ValueError("reference outside the image")
            at = places[count] if count < len(places) else at
            p, size, ends, ref = p[:count], size[:count], ends[:count], ref[ref < count]
        if not len(p) or (at > 8 * have and have == len(data) - first):
            raise ValueError("image data end early")
        begin = made + ends - size
        plain = np.ones(len(p), bool)
        plain[ref] = False
        q, value = p[plain], np.zeros(int(plain.sum()), np.uint32)
        for e, s, t, shift in zip(entry, step, (green, red, blue, alpha), (8, 16, 0, 24), strict=True):
            value |= ((e[q] >> 4).astype(np.uint32) if e is not None else np.uint32(int(t[0]) >> 4)) << np.uint32(shift)
            q = q if s is None else s[q]
        out[begin[plain]] = value
        if len(ref):
            where = np.minimum(step[0][p[ref]] + EXTRA[symbol[p[ref]]], limit)
            code = far[window[where]]
            if (code >> 4).max() > 39:
                raise ValueError("symbol beyond its alphabet")
            d = _values((code >> 4).astype(np.int32), whole, np.minimum(where + (code & 15), limit))
            d = np.where(d > 120, d - 120, near[np.minimum(d, 120) - 1])
            _copy(out, begin[ref], size[ref], d)
        made += int(ends[-1])
        bits.at = 8 * first + at
        if bits.at > 8 * len(data):
            raise ValueError("image data end early")
    return out.reshape(height, width)


def _copy(out: np.ndarray, begin: np.ndarray, size: np.ndarray, d: np.ndarray) -> None:
    """References in order: each pixel is the one d before it."""
    if (d > begin).any():
        raise ValueError("reference outside the image")
    for o, m, back in zip(begin.tolist(), size.tolist(), d.tolist(), strict=True):
        if back >= m:
            out[o : o + m] = out[o - back : o - back + m]
        else:
            out[o : o + m] = np.resize(out[o - back : o], m)


def _tokens(bits: Bits, codes: list[list[Code]], place: list[int] | None, width: int, height: int, cache_bits: int) -> np.ndarray:
    n = width * height
    out: list[int] = []
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    filed = 0
    while len(out) < n:
        group = codes[place[len(out)] if place else 0]
        symbol = group[0].read(bits)
        if symbol < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append((a << 24) | (r << 16) | (symbol << 8) | b)
        elif symbol < 280:
            length = _number(bits, symbol - 256)
            d = _number(bits, group[4].read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > len(out) or len(out) + length > n:
                raise ValueError("reference outside the image")
            for _ in range(length):
                out.append(out[-d])
        else:
            while filed < len(out):
                cache[(CACHE_FACTOR * out[filed] & 0xFFFFFFFF) >> shift] = out[filed]
                filed += 1
            out.append(cache[symbol - 280])
    return np.array(out, np.uint32).reshape(height, width)


def _split(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) int32 channels: alpha, red, green, blue."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _join(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return (c[..., 0] << 24) | (c[..., 1] << 16) | (c[..., 2] << 8) | c[..., 3]


def _predict(mode: int, left, top, right, corner):
    """Prediction from the four known neighbours, each a channel array."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = mean(left, top)
        return np.clip(m + np.trunc((m - corner) / 2).astype(np.int32), 0, 255)
    simple = {1: left, 2: top, 3: right, 4: corner, 6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}
    if mode in simple:
        found = simple[mode]
        return mean(*found) if isinstance(found, tuple) else found
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    return np.array([255, 0, 0, 0], np.int32)


def predictor(pixels: np.ndarray, modes: np.ndarray, step: int, undo: bool) -> np.ndarray:
    """Adds (undo) or takes away the predictions; modes by blocks of 2**step pixels."""
    height, width = pixels.shape
    if len(used := np.unique(modes)) == 1 and used[0] in (1, 2):
        return _one_way(pixels, int(used[0]), undo)
    given = _split(pixels).reshape(-1, 4)
    known = given.copy() if undo else given
    out = np.empty_like(given)
    for i in range(height * width):
        y, x = divmod(i, width)
        if i == 0:
            p = np.array([255, 0, 0, 0], np.int32)
        elif y == 0:
            p = known[i - 1]
        elif x == 0:
            p = known[i - width]
        else:
            p = _predict(int(modes[y >> step, x >> step]), known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        out[i] = (given[i] + p if undo else given[i] - p) & 255
        if undo:
            known[i] = out[i]
    return _join(out).reshape(height, width)


def _one_way(pixels: np.ndarray, mode: int, undo: bool) -> np.ndarray:
    """predictor() where all blocks predict from the left (1) or from above (2): sums or differences along rows and columns, channel by channel."""
    out = np.zeros(pixels.shape, np.uint32)
    for shift in (0, 8, 16, 24):
        c = ((pixels >> np.uint32(shift)) & np.uint32(255)).astype(np.uint8)
        black = np.uint8(255 if shift == 24 else 0)
        if undo:
            c[0, 0] += black
            if mode == 1:
                c[:, 0] = np.cumsum(c[:, 0], dtype=np.uint8)
                c = np.cumsum(c, 1, dtype=np.uint8)
            else:
                c[0] = np.cumsum(c[0], dtype=np.uint8)
                c = np.cumsum(c, 0, dtype=np.uint8)
        else:
            given = c.copy()
            if mode == 1:
                c[:, 1:] -= given[:, :-1]
                c[1:, 0] -= given[:-1, 0]
            else:
                c[1:] -= given[:-1]
                c[0, 1:] -= given[0, :-1]
            c[0, 0] -= black
        out |= c.astype(np.uint32) << np.uint32(shift)
    return out


def cross_colour(pixels: np.ndarray, factors: np.ndarray, step: int, undo: bool) -> np.ndarray:
    height, width = pixels.shape
    f = np.repeat(np.repeat(_split(factors), 1 << step, 0)[:height], 1 << step, 1)[:, :width]
    signed = lambda v: ((v & 255) ^ 128) - 128
    part = lambda t, c: (signed(t) * signed(c)) >> 5
    c = _split(pixels)
    sign = 1 if undo else -1
    red = c[..., 1] + sign * part(f[..., 3], c[..., 2])
    base = red if undo else c[..., 1]
    c[..., 3] += sign * (part(f[..., 2], c[..., 2]) + part(f[..., 1], base))
    c[..., 1] = red
    return _join(c)


def subtract_green(pixels: np.ndarray, undo: bool) -> np.ndarray:
    c = _split(pixels)
    c[..., (1, 3)] += c[..., 2:3] if undo else -c[..., 2:3]
    return _join(c)


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _unpack(indices: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Colours by index, several to a pixel where the palette is small; rows go in blocks."""
    bits = _palette_bits(len(table))
    per = 8 >> bits
    colours = np.append(table, np.zeros(256 - len(table), np.uint32)).astype(np.uint32)  # an index beyond the palette is transparent black
    out = np.empty((len(indices), width), np.uint32)
    rows = max(1, (1 << 20) // max(1, width))
    for lo in range(0, len(indices), rows):
        green = ((indices[lo : lo + rows] >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
        if bits:
            green = ((green[:, :, None] >> (np.arange(1 << bits, dtype=np.uint8) * np.uint8(per))) & np.uint8((1 << per) - 1)).reshape(len(green), -1)
        out[lo : lo + rows] = colours[green[:, :width]]
    return out


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file -> (height, width) uint32 ARGB. Raises ValueError where it isn't one."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25 or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")], 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    seen = set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("transform given twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            step = bits.read(3) + 2
            undo.append((kind, step, _read_image(bits, -(-inner >> step), -(-height >> step), False), inner))
        elif kind == PALETTE:
            table = _read_image(bits, bits.read(8) + 1, 1, False)
            table = _join(np.cumsum(_split(table[0]), 0))
            undo.append((kind, 0, table, inner))
            inner = -(-inner >> _palette_bits(len(table)))
        else:
            undo.append((kind, 0, None, inner))
    pixels = _read_image(bits, inner, height, True)
    for kind, step, extra, wide in reversed(undo):
        if kind == PREDICTOR:
            pixels = predictor(pixels, (extra >> np.uint32(8)) & np.uint32(15), step, True)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, extra, step, True)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, True)
        else:
            pixels = _unpack(pixels, extra, wide)
    return pixels


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) >> 3, "little")


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most `most` bits (flattens the counts until they fit); a single symbol gets length 1."""
    held = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(held) < 2:
        out[held] = 1
        return out
    weight = counts[held].astype(np.float64)
    while True:
        heap = [(w, i, (i,)) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        depth, serial = np.zeros(len(held), np.int64), len(held)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            depth[[*a[2], *b[2]]] += 1
            heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
            serial += 1
        if depth.max() <= most:
            out[held] = depth
            return out
        weight = np.maximum(weight, weight.max() / 2 ** (most - 2)) ** 0.9


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    held = np.flatnonzero(lengths)
    if len(held) <= 1 and (not len(held) or held[0] < 256):
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(int(held[0]) if len(held) else 0, 8)
        return
    if len(held) == 1:  # one symbol beyond a byte: give it a partner that is not used
        lengths = lengths.copy()
        lengths[0] = 1
    w.put(0, 1)
    size = len(lengths)
    lengths = lengths[: int(np.flatnonzero(lengths)[-1]) + 1]
    meta = code_lengths(np.bincount(lengths, minlength=19), 7)
    order = [int(meta[k]) for k in LENGTH_ORDER]
    w.put(15, 4)
    for x in order:
        w.put(x, 3)
    shorter = len(lengths) < size  # then how many lengths are given (two symbols are held, so 2 at least)
    w.put(shorter, 1)
    if shorter:
        wide = max(0, (len(lengths) - 2).bit_length() - 1) // 2
        w.put(wide, 3), w.put(len(lengths) - 2, 2 + 2 * wide)
    codes = canonical(meta)
    single = np.count_nonzero(meta) == 1
    for n in lengths.tolist():
        w.put(0 if single else codes[n], 0 if single else int(meta[n]))


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their value) of a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, high - 1, v - ((2 + second) << (high - 1))


def _put_image(w: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, groups: int = 1) -> None:
    """One entropy-coded image; references: runs and repeats seen through a table of pixel pairs; groups > 1 deals blocks of 4 pixels over code groups."""
    height, width = pixels.shape
    flat = pixels.ravel().tolist()
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    step = 2
    meta = None
    if main:
        w.put(groups > 1, 1)
        if groups > 1:
            w.put(step - 2, 3)
            meta = np.add.outer(np.arange(-(-height >> step)), np.arange(-(-width >> step))) % groups
            groups = int(meta.max()) + 1
            _put_image(w, (meta.astype(np.uint32) << 8), False)
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}
    cache, tokens, at, last = [0] * (1 << cache_bits), [], 0, {}
    hashed = lambda p: (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(flat):
        length, start = 0, at
        if references and at + 1 < len(flat):
            for back in {last.get((flat[at], flat[at + 1])), at - 1} - {None, -1}:
                n = 0
                while at + n < len(flat) and flat[back + n] == flat[at + n] and n < 4096:
                    n += 1
                if n > max(2, length):
                    length, start = n, back
        if length:
            d = near.get(at - start, at - start + 120)
            tokens.append((at, 256 + _prefix(length)[0], _prefix(length), _prefix(d)))
        elif cache_bits and cache[hashed(flat[at])] == flat[at]:
            tokens.append((at, 280 + hashed(flat[at]), None, None))
            length = 1
        else:
            tokens.append((at, None, None, None))
            length = 1
        for k in range(at, at + length):
            if cache_bits:
                cache[hashed(flat[k])] = flat[k]
            if k + 1 < len(flat):
                last[(flat[k], flat[k + 1])] = k
        at += length
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    group_of = (lambda i: int(meta[(i // width) >> step, (i % width) >> step])) if meta is not None else (lambda i: 0)
    counts = defaultdict(lambda: [np.zeros(n, np.int64) for n in sizes])
    for g in range(groups):
        counts[g]
    parts = lambda p: ((p >> 8) & 255, (p >> 16) & 255, p & 255, p >> 24)
    for i, symbol, length, d in tokens:
        c = counts[group_of(i)]
        if symbol is None:
            for k, v in enumerate(parts(flat[i])):
                c[k][v] += 1
        else:
            c[0][symbol] += 1
            if d:
                c[4][d[0]] += 1
    codes = {}
    for g in range(groups):
        own = []
        for c in counts[g]:
            lengths = code_lengths(c)
            _put_code(w, lengths)
            one = np.count_nonzero(lengths) == 1
            if one and np.flatnonzero(lengths)[0] >= 256:
                lengths[0] = 1
                one = False
            own.append(({s: (0, 0) for s in np.flatnonzero(lengths).tolist()} if one else {s: (x, int(lengths[s])) for s, x in canonical(lengths).items()}))
        codes[g] = own
    for i, symbol, length, d in tokens:
        c = codes[group_of(i)]
        if symbol is None:
            for k, v in enumerate(parts(flat[i])):
                w.put(*c[k][v])
        else:
            w.put(*c[0][symbol])
            if d:
                w.put(length[2], length[1])
                w.put(*c[4][d[0]])
                w.put(d[2], d[1])


def _file(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(stream) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + pad


def _head(width: int, height: int) -> Writer:
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    return w


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), mode: int = 11, cache_bits: int = 0, references: bool = False, groups: int = 1) -> bytes:
    """(height, width) uint32 ARGB -> a lossless WebP file, with the transforms in the given order (a palette needs at most 256 colours)."""
    height, width = pixels.shape
    w, step = _head(width, height), 2
    for kind in transforms:
        w.put(1, 1), w.put(kind, 2)
        blocks = (-(-pixels.shape[0] >> step), -(-pixels.shape[1] >> step))
        if kind == PREDICTOR:
            modes = (np.arange(blocks[0] * blocks[1]).reshape(blocks) + mode) % 14
            w.put(step - 2, 3)
            _put_image(w, (modes.astype(np.uint32) << 8), False)
            pixels = predictor(pixels, modes, step, False)
        elif kind == CROSS_COLOUR:
            factors = ((np.arange(blocks[0] * blocks[1], dtype=np.uint32).reshape(blocks) * np.uint32(0x10305)) & np.uint32(0xFFFFFF)) | np.uint32(0xFF000000)
            w.put(step - 2, 3)
            _put_image(w, factors, False)
            pixels = cross_colour(pixels, factors, step, False)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, False)
        else:
            table, at = np.unique(pixels, return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            w.put(len(table) - 1, 8)
            deltas = _split(table)
            deltas[1:] -= deltas[:-1].copy()
            _put_image(w, _join(deltas)[None, :], False)
            bits = _palette_bits(len(table))
            own = np.zeros((height, -(-pixels.shape[1] >> bits) << bits), np.uint32)
            own[:, : pixels.shape[1]] = at.reshape(pixels.shape)
            per = 8 >> bits
            packed = (own.reshape(height, -1, 1 << bits) << (np.arange(1 << bits, dtype=np.uint32) * np.uint32(per))).sum(-1)
            pixels = (packed.astype(np.uint32) << 8) | np.uint32(0xFF000000)
    w.put(0, 1)
    _put_image(w, pixels, True, cache_bits, references, groups)
    return _file(w.bytes())


def _weights(kind: str) -> np.ndarray:
    """Weights of the 256 literals, from a rule. text: letters by rank of use, then capitals and marks, lead and trail bytes of accented letters, then all others; rank: places of a palette by frequency; rest: small differences."""
    if kind == "rank":
        return 1 / (np.arange(256) + 3.0) ** 1.1
    if kind == "rest":
        return 1 / (1.0 + np.minimum(np.arange(256), 256 - np.arange(256)))
    weight = np.full(256, 2e-4)
    weight[33:127] = 6e-4
    weight[[195, *range(160, 192)]] = 1.5e-3
    weight[[10, 44, 46]] = 1e-2
    for c in b"mfgpbvwyk":
        weight[c] = 1e-2
    for rank, c in enumerate(b"etnahoirsdluc"):
        weight[c] = 0.2 / (rank + 2)
    weight[32] = 0.16
    return weight


#: Weights of the length prefixes beside all literals, and of the distance prefixes, by a rule.
LENGTHS = 0.25 / (1 + np.abs(np.arange(24) - 5.0)) ** 1.5
DISTANCES = 1 / (1 + np.abs(np.arange(40) - 22.0))


def _codes_by(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths), np.int64)
    for symbol, code in canonical(lengths).items():
        out[symbol] = code
    return out


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix() of arrays."""
    v = value - 1
    high = np.maximum(2, np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1)
    second = (v >> (high - 1)) & 1
    large = v >= 4
    return np.where(large, 2 * high + second, v), np.where(large, high - 1, 0), np.where(large, v - ((2 + second) << (high - 1)), 0)


def repeats(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, distance) of a block's references, in order and apart: from the first byte on, each place that begins like its last earlier one takes as much as agrees."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3
    if n < 2 * LEAST:
        return none
    padded = np.append(data, np.zeros(8, np.uint8))
    gram = np.ndarray((n - LEAST + 1,), "<u8", padded.data, 0, (1,)) & np.uint64((1 << 8 * LEAST) - 1)
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    same = np.flatnonzero(gram[1:] == gram[:-1])
    if not len(same):
        return none
    back = np.zeros(n, np.int32)
    back[order[same + 1]] = order[same + 1] - order[same]
    turn = np.flatnonzero(back[1:] != back[:-1]) + 1
    edges = np.concatenate([[0], turn, [n]])
    agree = np.repeat(edges[1:], np.diff(edges)) - np.arange(n) + LEAST - 1
    length = np.minimum(np.where(back > 0, agree, 0), LONGEST).astype(np.int32)
    held = np.flatnonzero(back)
    after = memoryview(np.append(held, n)[np.searchsorted(held, np.arange(n + 1))].astype(np.int32))
    size, found, at = memoryview(length), [], after[0]
    put = found.append
    while at < n:
        put(at)
        at = after[at + size[at]]
    where = np.array(found, np.int64)
    return where, length[where].astype(np.int64), back[where].astype(np.int64)


class TextImages:
    """Encoder of payloads as images, a byte a pixel in the green channel."""

    def __init__(self):
        self.lengths, self.codes, self.heads = {}, {}, {}
        self.far = code_lengths(DISTANCES * 1e9, 12)
        self.far_codes = _codes_by(self.far)
        for kind in ("text", "rank", "rest"):
            weight = _weights(kind)
            own = code_lengths(np.append(weight / weight.sum(), LENGTHS / LENGTHS.sum() * 0.25) * 1e9, 13)
            head = Writer()
            head.put(0, 1), head.put(0, 1)  # no cache, one group
            _put_code(head, own)
            for value in (0, 0, 255) if kind != "rest" else (0, 0, 0):
                head.put(1, 1), head.put(0, 1), head.put(1, 1), head.put(value, 8)
            _put_code(head, self.far)
            self.lengths[kind], self.codes[kind], self.heads[kind] = own, _codes_by(own), head
        self.near: dict[int, np.ndarray] = {}
        w, flat = Writer(), np.full(256, 8, np.uint8)  # a palette's start, without its size
        w.put(1, 1), w.put(PALETTE, 2), w.put(0, 8), w.put(0, 1)
        _put_code(w, np.append(flat, np.zeros(24, np.uint8)))
        for symbols in ((0,), (0,), (0, 255), (0,)):  # alpha: 255, then no difference
            w.put(1, 1), w.put(len(symbols) - 1, 1), w.put(1, 1)
            for x in symbols:
                w.put(x, 8)
        self.palette, self.bytes = w, canonical(flat)

    def _tokens(self, data: np.ndarray, width: int) -> list[tuple]:
        """Of each block (literal bytes, token starts, whether each is a reference, prefixes, extra bits and values of lengths and distances)."""
        if width not in self.near:
            table = np.zeros(8 * width + 9, np.int64)
            for i, (x, y) in reversed(list(enumerate(NEAR))):
                table[max(1, x + y * width)] = i + 1
            self.near = {width: table}
        near, out = self.near[width], []
        for lo in range(0, len(data), BLOCK):
            own = data[lo : lo + BLOCK]
            where, length, back = repeats(own)
            cover = np.zeros(len(own) + 1, np.int8)
            cover[where] += 1
            np.subtract.at(cover, where + length, 1)
            starts = np.cumsum(cover[:-1]) == 0
            starts[where] = True
            starts = np.flatnonzero(starts)
            ref = np.zeros(len(own), bool)
            ref[where] = True
            code = near[np.minimum(back, len(near) - 1)]
            code = np.where((back < len(near)) & (code > 0), code, back + 120)
            out.append((own[starts], ref[starts], _prefixes(length), _prefixes(code)))
        return out

    def _size(self, tokens: list[tuple], kind: str, place: np.ndarray | None = None) -> int:
        """Bits of the tokens under a code; place: palette index of each byte."""
        own, total = self.lengths[kind], self.heads[kind].n
        for literal, ref, (a, more, _), (b, further, _) in tokens:
            seen = np.bincount(literal[~ref], minlength=256)
            total += int((seen * (own[:256] if place is None else own[place])).sum() + own[256 + a].sum() + more.sum() + self.far[b].sum() + further.sum())
        return total

    def _write(self, head: Writer, tokens: list[tuple], kind: str, place: np.ndarray | None = None) -> bytes:
        head.put(self.heads[kind].value, self.heads[kind].n)
        lengths, codes = self.lengths[kind], self.codes[kind]
        out, carry, used = [head.bytes()[: head.n >> 3]], head.value >> (head.n & ~7), head.n & 7
        for literal, ref, (a, more, what), (b, further, which) in tokens:
            symbol = literal.astype(np.int64) if place is None else place[literal]
            symbol[ref] = 256 + a
            field, size = np.zeros((len(symbol), 5), np.int64), np.zeros((len(symbol), 5), np.int64)
            field[:, 0], size[:, 0] = codes[symbol], lengths[symbol]
            field[ref, 1], size[ref, 1] = what, more
            field[ref, 2], size[ref, 2] = self.far_codes[b], self.far[b]
            field[ref, 3], size[ref, 3] = which & 0xFFF, np.minimum(further, 12)
            field[ref, 4], size[ref, 4] = which >> 12, np.maximum(0, further - 12)
            if ref.any():
                live = size.ravel() > 0
                field, size = field.ravel()[live], size.ravel()[live]
            else:
                field, size = field[:, 0], size[:, 0]
            ends = np.cumsum(size) + used
            at = ends - size
            value, byte, n = field << (at & 7), at >> 3, (int(ends[-1]) >> 3) + 4 if len(ends) else 4
            stream = sum(np.bincount(byte + k, (value >> 8 * k) & 255, n) for k in range(3)).astype(np.int64)
            stream[0] += carry
            last = int(ends[-1])
            carry, used = int(stream[last >> 3]), last & 7
            out.append(stream[: last >> 3].astype(np.uint8).tobytes())
        if used:
            out.append(bytes([carry]))
        return _file(b"".join(out))

    def encode(self, payload: np.ndarray, width: int, height: int) -> bytes:
        """The smallest of: as it is, through a palette by frequency, and, where differences are less spread than bytes, through a predictor."""
        tokens = self._tokens(payload, width)
        seen = np.bincount(payload, minlength=256)
        order = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
        place = np.zeros(256, np.int64)
        place[order] = np.arange(len(order))
        options = [(self._size(tokens, "text"), 0, lambda: self._write(self._head(width, height), tokens, "text"))]
        bits = _palette_bits(len(order))
        packed, few = tokens, place
        if bits:
            index = place[payload].astype(np.uint8).reshape(height, -1, 1 << bits) << (np.arange(1 << bits, dtype=np.uint8) * np.uint8(8 >> bits))
            packed, few = self._tokens(np.bitwise_or.reduce(index, 2).ravel(), width >> bits), None
        options.append((self._size(packed, "rank", few) + self.palette.n + 9 * len(order), 1, lambda: self._write(self._head(width, height, self._palette(order)), packed, "rank", few)))
        pixels = payload.reshape(height, width)
        for mode in (1, 2):
            rest = pixels.copy()
            if mode == 1:
                rest[:, 1:] -= pixels[:, :-1]
                rest[1:, 0] -= pixels[:-1, 0]
            else:
                rest[1:] -= pixels[:-1]
                rest[0, 1:] -= pixels[0, :-1]
            if _spread(np.bincount(rest.ravel(), minlength=256)) < _spread(seen):
                other = self._tokens(rest.ravel(), width)
                given = self._mode(mode, width, height)
                options.append((self._size(other, "rest") + given.n, 1 + mode, lambda other=other, given=given: self._write(self._head(width, height, given), other, "rest")))
        return min(options, key=lambda o: o[:2])[2]()

    def _head(self, width: int, height: int, transform: Writer | None = None) -> Writer:
        head = _head(width, height)
        if transform:
            head.put(transform.value, transform.n)
        head.put(0, 1)
        return head

    def _palette(self, order: np.ndarray) -> Writer:
        """The palette transform: green values of the colours by 8 bits each, as differences."""
        w = Writer()
        w.put(self.palette.value | (len(order) - 1 << 3), self.palette.n)
        for k, value in enumerate(np.diff(order, prepend=0).tolist()):
            w.put(self.bytes[value & 255], 8), w.put(k == 0, 1)
        return w

    def _mode(self, mode: int, width: int, height: int) -> Writer:
        """The predictor transform with one mode for all blocks of 512 pixels: an image of one colour, which takes no bits."""
        w = Writer()
        w.put(1, 1), w.put(PREDICTOR, 2), w.put(7, 3), w.put(0, 1)
        for value in (mode, 0, 0, 0, 0):
            w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(value, 8)
        return w


def _spread(counts: np.ndarray) -> float:
    """Entropy of counts, in bits."""
    n = counts[counts > 0].astype(np.float64)
    return float((n * np.log2(n.sum() / n)).sum())


def shape_of(n_pixels: int) -> tuple[int, int]:
    """Width and height for a multiple of 64 pixels; pixels beyond them (zero) only where one column of blocks isn't enough."""
    blocks = n_pixels // 64
    wide = -(-blocks // MOST)
    if wide * 64 > MOST:
        raise ValueError("payload too long for one image")
    return 64 * wide, -(-blocks // wide)


def payload_of(text: bytes) -> np.ndarray:
    """The text with zero bytes up to a positive multiple of 64."""
    return np.frombuffer(text.ljust(max(64, -(-len(text) // 64) * 64), b"\0"), np.uint8)


def payload_in(pixels: np.ndarray, n: int) -> np.ndarray:
    return ((pixels.ravel()[:n] >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)


def feature_of(pixels: np.ndarray) -> str:
    """Shape, mean of each channel (alpha, red, green, blue) and a 64-bit average hash over 8 x 8 cells of the green channel."""
    flat = pixels.ravel()
    means = "/".join(f"{((flat >> np.uint32(s)) & np.uint32(255)).mean():.3f}" for s in (24, 16, 8, 0))
    green = ((flat >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
    edges = np.arange(64) * len(green) // 64
    cells = np.add.reduceat(green, edges, dtype=np.int64) / np.diff(np.append(edges, len(green)))
    mark = int.from_bytes(np.packbits(cells > cells.mean()).tobytes(), "big")
    return f"{pixels.shape[1]}x{pixels.shape[0]};mean={means};hash={mark:016x}"


def _store(keep: bool):
    def run(batches):
        images = TextImages()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            out: list[list] = [[] for _ in range(8)]
            pending = 0
            rows = 0
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                raw = (text.as_py() or "").encode()
                payload = payload_of(raw)
                width, height = shape_of(len(payload))
                full = payload if width * height == len(payload) else np.append(payload, np.zeros(width * height - len(payload), np.uint8))
                stored = images.encode(full, width, height)
                pixels = decode(stored)
                back = payload_in(pixels, len(payload)).tobytes()
                values = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(pixels), stored if keep else None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                pending += len(stored) if keep else 0
                if pending > 32_000_000 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(rows, i + 1 - rows), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True))][: 9 if keep else 8], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"][: 9 if keep else 8])
                    out, pending, rows = [[] for _ in range(8)], 0, i + 1

    return run


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media]), one row per input row.

    Each text's UTF-8 bytes, padded by zeros to a positive multiple of 64, become one lossless WebP image; digests and
    features are of the pixels read back from it. Null counts as empty; equal texts give equal values; a null doc_id is
    kept. A text over 268 MB has no image and is an error. Other columns are ignored. Each row stands alone: no shuffle.
    """
    need(docs, "doc_id", "text")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_store(keep_media)), schema)
