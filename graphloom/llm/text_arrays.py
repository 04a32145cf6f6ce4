"""numpy primitives over whole Arrow string columns: no Python string is made for a document.

Texts arrive as one UTF-8 buffer with offsets. Words are runs of bytes outside the separators; their 64-bit hashes come
from prefix sums of a polynomial over random byte values, so a batch costs a few array passes whatever its word count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
#: Bytes of texts that one pass takes where many arrays, or rows, are made of each word: what a worker holds follows it, and no result does.
PASS = 1 << 18
_SEED = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes 0x20 and 0x09 to 0x0D part words.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: For terms: letters, digits and all bytes over 0x7F make words, the rest parts them.
OTHER = np.ones(256, bool)
OTHER[48:58] = OTHER[65:91] = OTHER[97:123] = OTHER[128:] = False
#: Kinds of bytes for word and punctuation tokens: 0 parts tokens, and a token holds bytes of one kind only.
KINDS = np.where(WHITE, 0, np.where(OTHER, 2, 1)).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = ((n >> 16) + 1) << 16
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls (null counts as empty), offsets of 32 or 64 bits."""
    array = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(array, "") if array.null_count else array


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its len+1 offsets into them."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at * 0
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive document ranges [a, b) of at most `most` bytes, or of a single longer document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def _hash_range(data: np.ndarray, starts_at: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of one byte range; starts_at: positions where a document begins."""
    n = len(data)
    kind = (~parts).view(np.uint8)[data] if parts.dtype == bool else parts[data]
    turn = np.empty(n + 1, bool)  # where a run of one kind begins; documents part runs too
    turn[0] = turn[n] = True
    np.not_equal(kind[1:], kind[:-1], out=turn[1:n])
    turn[starts_at] = True
    inside = kind > 0
    first = np.flatnonzero(turn[:n] & inside)
    last = np.flatnonzero(turn[1:] & inside) + 1
    up, down = _powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[LOWER[data]] * up[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)), first


def prefixes(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first k bytes of every word longer than k, for each k of lengths, and the document of each; for data of a few chunks."""
    kind = ~parts[data]
    begin = kind.copy()
    begin[1:] &= ~kind[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = kind[heads]
    first = np.flatnonzero(begin)
    doc = np.searchsorted(offsets, first, "right") - 1
    value = np.concatenate([_VALUES[LOWER[data]], np.zeros(max(lengths) + 1, np.uint64)])
    inside = np.concatenate([kind, np.zeros(max(lengths) + 1, bool)])
    ends = offsets[doc + 1]
    hashes, docs = [], []
    total, alive = np.zeros(len(first), np.uint64), np.ones(len(first), bool)
    for k in range(max(lengths)):
        total = total * _BASE + value[first + k]
        alive &= inside[first + k] & (first + k < ends)
        if k + 1 in lengths:
            longer = alive & inside[first + k + 1] & (first + k + 1 < ends)
            hashes.append(mix(total[longer] + np.uint64(k + 1)))
            docs.append(doc[longer])
    return np.concatenate(hashes), np.concatenate(docs)


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) word hashes of documents, in order, and how many words each document has."""
    total = len(offsets) - 1
    counts = np.zeros(total, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), counts
    if len(data) <= 4 * CHUNK:
        begins = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        hashes, first = _hash_range(data, begins, parts)
        edges = np.searchsorted(first, offsets)
        return hashes, np.diff(edges)
    out = []  # one long document, or many: cut where words end, so that no array is larger than a chunk
    for d in range(total):
        a, end = int(offsets[d]), int(offsets[d + 1])
        while a < end:
            b = min(end, a + CHUNK)
            gap = parts if parts.dtype == bool else parts == 0
            while b < end and not gap[data[b]]:
                stop = np.flatnonzero(gap[data[b : min(end, b + CHUNK)]])
                b = b + int(stop[0]) if len(stop) else min(end, b + CHUNK)
            hashes, _ = _hash_range(data[a:b], np.zeros(1, np.int64), parts)
            out.append(hashes)
            counts[d] += len(hashes)
            a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its word n-grams; a shorter document is one n-gram as a whole."""
    n = len(hashes)
    gram = np.zeros(n, np.uint64)
    for k in range(width):
        gram[: max(0, n - k)] += hashes[k:] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & (2**64 - 1) | 1)
    gram = mix(gram)
    at = 0
    for m in counts.tolist():
        if m >= width:
            yield np.unique(gram[at : at + m - width + 1])
        elif m:
            whole = np.array([m], np.uint64)
            for h in hashes[at : at + m]:
                whole = mix(whole * np.uint64(0x100000001B3) + h)
            yield whole
        else:
            yield gram[:0]
        at += m


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 seen as Spark's long."""
    return x.view(np.int64)
