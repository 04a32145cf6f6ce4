"""Exact Jaccard self-join of documents on word n-grams with PartEnum signatures (Arasu, Ganti, Kaushik: VLDB 2006).

Sets are dealt into size bands; for the pairs whose larger set lies in band j, similarity >= t bounds the symmetric
difference by k_j. PartEnum splits the hash domain into n1 parts and each of those into n2 pieces: at least one part
differs in at most k2 elements, so some choice of n2-k2 of its pieces is equal in both sets. Each such choice is one
signature, hence every similar pair shares one: candidates are complete, and an exact intersection follows.

A bucket of one signature may hold a large group, so its pairs are never listed. Small buckets are looked through by
sketches. Members of large ones go by a second filter: of two similar sets the rarest elements meet, so that unlike sets
which share a common passage part. What still is a large bucket is a group of near copies. Each set is compared with its
bucket's leader; two others that the leader doesn't link already must share some of the rarest of what they change in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as T
from .common import cut, lean, need, spilled
from .components import components

#: Width of a size band; the widest step at which a set meets at most two bands.
RATIO = 1.4
#: A table of ids is broadcast up to this many rows (8 bytes each); beyond it a shuffled join does the same.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Band:
    """One PartEnum instance: sets up to `upper` elements, larger one over `lower`, at most k elements apart."""

    index: int
    lower: int
    upper: int
    k: int
    n1: int
    n2: int
    k2: int
    slack: int

    @property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.n2), self.n2 - self.k2))


@lru_cache(maxsize=None)
def band(index: int, percent: int) -> Band:
    """Band 0 holds the sizes whose similar sets are all equal; each further one is RATIO as wide.

    slack: parts beyond those that the pigeonhole needs, so that 1 + slack parts qualify; see signatures().
    """
    upper = 0
    while 2 * (upper + 1) * (100 - percent) < 100 + percent:
        upper += 1
    lower = 0
    for _ in range(index):
        lower, upper = upper, max(upper + 1, int(upper * RATIO))
    k = 2 * upper * (100 - percent) // (100 + percent)
    if k <= 2:
        return Band(index, lower, upper, k, 1, k + 2, k, 0)
    base, slack = k // 2 + 1, 0
    while base >= 8:  # parts that have an empty choice of pieces, of the band's smallest sets: the mean and two deviations
        n1 = base + slack
        mean = n1 * (1 - (1 - exp(-(lower + 1) * 0.92 / n1 * 2 / 3)) ** 3)
        if ceil(mean + 2 * sqrt(mean)) <= slack or slack > base // 2:
            break
        slack += 1
    return Band(index, lower, upper, k, base + slack, 3, 1, slack)


def bands_of(n: int, percent: int) -> list[Band]:
    """The instances a set of n elements takes part in: its own band, and any above that holds a size it can link to."""
    i = 0
    while band(i, percent).upper < n:
        i += 1
    out = []
    while 100 * n >= percent * (band(i, percent).lower + 1):
        if band(i, percent).k:
            out.append(band(i, percent))
        i += 1
    return out


#: Common shingles: those that as many sets of a sample share. Which ones they are changes no result.
SAMPLE_DOCS, COMMON_IN, COMMON_MOST = 4_000, 4, 200_000
#: Sets with at most this share of common shingles, and those that can be similar to them, leave them out.
COMMON_SHARE = 0.25


def all_signatures(items: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """Signatures of a set with or without the common shingles, or both.

    Without a fixed group of elements two sets differ in no more elements than before, so the bound k holds and only
    the bands go by the whole sizes. A signature of common shingles alone, which unlike sets share, is then an empty
    one. If one of a similar pair has a share of at most COMMON_SHARE, the other has at most (COMMON_SHARE + 1 - t) / t,
    and both leave them out; else both keep them.
    """
    if not len(common):
        return signatures(items, percent, len(items), 0)
    hit = common[np.minimum(np.searchsorted(common, items), len(common) - 1)] == items
    share = hit.mean()
    out = []
    if share <= (COMMON_SHARE + 1 - percent / 100) / (percent / 100) + 1e-9:
        out.append(signatures(items[~hit], percent, len(items), 1))
    if share > COMMON_SHARE:
        out.append(signatures(items, percent, len(items), 0))
    return np.concatenate(out)


def signatures(items: np.ndarray, percent: int, size: int, kind: int) -> np.ndarray:
    """PartEnum signatures of sorted distinct uint64 elements, those that count of a set of `size`; kinds don't meet.

    Of a similar pair at least 1 + slack parts qualify. A set with at most `slack` parts that have an empty choice of
    pieces leaves those choices out: one qualifying part is still without any, and shares a full signature. A set
    with more keeps them all. So a pair is missed in no case, and empty choices seldom meet.
    """
    out = []
    for b in bands_of(size, percent):
        spread = T.mix(items + np.uint64(0x632BE59BD9B4E019 * (b.index + 1) & (2**64 - 1)))
        part = ((spread >> np.uint64(40)) % np.uint64(b.n1)).astype(np.int64) * b.n2 + ((spread >> np.uint64(8)) % np.uint64(b.n2)).astype(np.int64)
        total = np.zeros(b.n1 * b.n2, np.uint64)
        np.add.at(total, part, spread)
        held = np.bincount(part, minlength=b.n1 * b.n2).reshape(b.n1, b.n2)
        total = total.reshape(b.n1, b.n2)
        place = np.arange(b.n1, dtype=np.uint64)
        made, full = [], []
        for c, chosen in enumerate(b.subsets):
            key = place * np.uint64(1024) + np.uint64(c) + np.uint64((b.index << 44) + (kind << 60))
            for q in chosen:
                key = T.mix(key + total[:, q])
            made.append(key)
            full.append(held[:, chosen].sum(1) > 0)
        full = np.array(full)
        if b.slack and (~full).any(0).sum() <= b.slack:
            out.append(np.array(made)[full])
        else:
            out.append(np.concatenate(made))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_id(items: np.ndarray) -> np.uint64:
    """64-bit id of a set (0 is kept for the empty one)."""
    return T.mix(np.array([np.add.reduce(T.mix(items)) + np.uint64(len(items))], np.uint64))[0] | np.uint64(1)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    data, offsets = T.buffer_of(T.column(batch, "text"))
    for a, b in T.groups(offsets, T.PASS):
        yield from T.shingles(*T.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), width)


def _classes(width: int):
    def run(batches):
        for batch in batches:
            sizes, ids = [], []
            for items in _sets(batch, width):
                sizes.append(len(items))
                ids.append(int(set_id(items).view(np.int64)) if len(items) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "n_shingles", "sid"])

    return run


def _common(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of common shingles from a sample of about SAMPLE_DOCS documents, chosen by a hash of the id."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE_DOCS)
    sets = sample.select("text").mapInArrow(lean(_arrays(width)), ARRAYS)
    counts = sets.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_IN)
    found = counts.orderBy(F.col("n").desc(), "item").limit(COMMON_MOST).select("item").toArrow()["item"].to_numpy()
    return np.sort(found.view(np.uint64))


#: Ids or names that a task keeps to leave out what it has met before.
SEEN = 200_000
#: Rows, or elements of lists, after which a batch goes out: texts give many times their bytes, which both sides of the pipe would hold.
ROWS_OUT = 1 << 17


def _signatures(width: int, percent: int, shared):
    """(sig, rank, sid) rows of a task's documents; copies within it give them once, as far as memory is set aside for it."""

    def rows(made: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        sids = np.repeat(np.array(ids, np.int64), [len(x) for x in made])
        return pa.RecordBatch.from_arrays([pa.array(T.signed(np.concatenate([np.zeros(0, np.uint64), *made]))), pa.array(np.zeros(len(sids), np.int32)), pa.array(sids)], ["sig", "rank", "sid"])

    def run(batches):
        seen: set[int] = set()
        common = shared.value
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            made, ids, held = [], [], 0
            for items in _sets(batch, width):
                sid = int(set_id(items).view(np.int64)) if len(items) else 0
                if sid and sid not in seen:
                    made.append(all_signatures(items, percent, common))
                    ids.append(sid)
                    seen.add(sid)
                    held += len(made[-1])
                if held >= ROWS_OUT:
                    yield rows(made, ids)
                    made, ids, held = [], [], 0
            yield rows(made, ids)

    return run


def sketch(items: np.ndarray) -> np.ndarray:
    """Parity sketch: for each bucket of the hash, whether an odd number of elements falls into it, as longs. Two sets' sketches differ in no more bits than the sets in elements; a longer one folds to a shorter one by xor of its halves."""
    bits = 512  # unlike sets differ in about half of the bits, which must be more than similar ones may
    while bits < 0.6 * len(items) and bits < 1 << 16:
        bits *= 2
    odd = np.bincount((T.mix(items) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(rows: list[np.ndarray]) -> np.ndarray:
    """Sketches as a matrix of the shortest one's width."""
    least = min(map(len, rows))
    out = []
    for r in rows:
        while len(r) > least:
            r = r[: len(r) // 2] ^ r[len(r) // 2 :]
        out.append(r)
    return np.array(out).view(np.uint64)


def _mark(long: np.ndarray) -> np.ndarray:
    """A sketch folded to 512 bits."""
    while len(long) > 8:
        long = long[: len(long) // 2] ^ long[len(long) // 2 :]
    return long


#: Buckets up to this size are looked through by sketches.
LOOKED = 256


def _promising(percent: int):
    """Rows (bucket, sid, n, sketch) in order of bucket, of at most LOOKED each -> (first, sid): groups of sets that may be similar by their sketches, each under the one that may be similar to most."""

    def near(n: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
        """Which sets (a symmetric matrix) may be similar: their sizes and sketches, folded to the smaller set's width, allow it."""
        order = np.argsort(n, kind="stable")
        size, width = n[order], np.array([len(sketches[i]) for i in order])
        reach = np.searchsorted(size, size * 100 // percent, "right")
        out = np.zeros((len(n), len(n)), bool)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)  # a run, as larger sets have wider sketches
            a, b = rows[0], rows[-1] + 1
            m = _folded([sketches[i] for i in order[a : reach[b - 1]]])
            for i in range(a, b):
                j = reach[i]
                apart = np.bitwise_count(m[i + 1 - a : j - a] ^ m[i - a]).sum(1, dtype=np.int64)
                met = order[i + 1 : j][_similar(apart, size[i + 1 : j] + size[i], percent)]
                out[order[i], met] = out[met, order[i]] = True
        return out

    def groups(sid: np.ndarray, linked: np.ndarray) -> Iterator[tuple[np.int64, np.ndarray]]:
        """Of each group that the matrix connects, the set that is linked to most, and the others."""
        others = linked.sum(1)
        left = others > 0
        order = np.lexsort((sid, -others))
        while left.any():
            lead = order[left[order]][0]
            seen = linked[lead].copy()
            seen[lead] = True
            while np.count_nonzero(seen) < np.count_nonzero(left):
                new = linked[seen].any(0) & ~seen
                if not new.any():
                    break
                seen |= new
            left &= ~seen
            seen[lead] = False
            yield sid[lead], sid[seen]

    def run(batches):
        held: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        for batch in _and_end(batches):
            if batch is not None:
                lists = batch.column(3)
                edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                own = [values[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
                held = (*(np.concatenate([held[k], batch.column(k).to_numpy()]) for k in range(3)), held[3] + own)
            bucket, sid, n, sketches = held
            if not len(bucket):
                continue
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            stop = len(bucket) if batch is None else starts[-1]
            first, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
                if x < stop and y - x > 1:
                    for lead, own in groups(sid[x:y], near(n[x:y], sketches[x:y])):
                        first.append(np.full(len(own), lead))
                        kept.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(kept))], ["first", "sid"])
            held = (bucket[stop:], sid[stop:], n[stop:], sketches[stop:])

    return run


ARRAYS = "sid long, n long, sketch array<long>, mark array<long>, items array<long>"


def _arrays(width: int):
    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        counts = np.array([len(x) for x in found], np.int32)
        values = T.signed(np.concatenate(found)) if counts.any() else np.zeros(0, np.int64)
        made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
        longs = [sketch(x) for x in found]
        sketches, marks = (pa.array(x, pa.list_(pa.int64())) for x in (longs, [_mark(x) for x in longs]))
        ids = np.array([int(set_id(x).view(np.int64)) if len(x) else 0 for x in found], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts.astype(np.int64)), sketches, marks, made], ["sid", "n", "sketch", "mark", "items"])

    def run(batches):
        for batch in batches:
            found, held = [], 0
            for items in _sets(batch, width):
                found.append(items)
                held += len(items)
                if held >= ROWS_OUT:
                    yield rows(found)
                    found, held = [], 0
            yield rows(found)

    return run


def _buckets(batches):
    """Rows (sig, rank, sid) in order -> (bucket, sid, first), the members of buckets with two sets or more.

    Streams: it holds one batch and the members of an open bucket up to LOOKED. Signatures with the same members are one
    bucket, named by a hash of them; first is 0. Of a larger bucket first is the first member, with which the others stand.
    """
    seen: set[int] = set()
    sig, sid, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in _and_end(batches):
        if batch is not None:
            sig, sid = np.concatenate([sig, batch.column(0).to_numpy()]), np.concatenate([sid, batch.column(2).to_numpy()])
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
        sig, sid = sig[new], sid[new]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        out = []
        if large is not None and sig[0] == large[0]:
            stop = starts[1] if len(starts) > 1 else len(sig)
            out.append((np.full(stop, large[0]), sid[:stop], np.full(stop, large[1])))
            sig, sid, starts = sig[stop:], sid[stop:], starts[1:] - stop
        if len(starts):
            large = None
            stop = len(sig) if batch is None else starts[-1]  # the last bucket may go on
            whole = starts[starts < stop]
            if len(whole):
                sizes = np.diff(np.append(whole, stop))
                name = T.signed(T.mix(np.add.reduceat(T.mix(sid[:stop].view(np.uint64)), whole) + sizes.astype(np.uint64)))
                keep = sizes > 1
                for i in np.flatnonzero(keep):
                    if (x := int(name[i])) in seen:
                        keep[i] = False
                    else:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen.add(x)
                lead = np.where(sizes > LOOKED, sid[whole], 0)
                rows = np.repeat(keep, sizes)
                out.append((np.repeat(name, sizes)[rows], sid[:stop][rows], np.repeat(lead, sizes)[rows]))
            sig, sid = sig[stop:], sid[stop:]
            if len(sig) > LOOKED:
                large = int(sig[0]), int(sid[0])
                out.append((sig, sid, np.full(len(sig), sid[0])))
                sig, sid = sig[:0], sid[:0]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(3)], ["bucket", "sid", "first"])


BUCKETS = "bucket long, sid long, first long"
#: Bits of the number of counters that tell rare elements from frequent ones. Elements may share a counter: their order is another one then, and any gives the same links.
COUNTERS = 20


def _counter(items: np.ndarray) -> np.ndarray:
    return (T.mix(items) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values, as uint64, of a column of lists of longs without nulls."""
    lists = batch.column(batch.schema.get_field_index(name))
    edges = lists.offsets.to_numpy()
    return edges - edges[0], lists.values.to_numpy()[edges[0] : edges[-1]].view(np.uint64)


def _parts(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lists of that column have ROWS_OUT elements together at most, or of a single longer row."""
    edges, _ = _lists(batch, name)
    for a, b in T.groups(edges, ROWS_OUT):
        yield batch.slice(a, b - a)


def _tally(elements):
    """Occurrences by counter of one task's rows; elements(batch) gives the hashes."""

    def run(batches):
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(_counter(elements(batch)), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["counter", "n"])

    return run


def _counted(rows: DataFrame, elements) -> np.ndarray:
    """How often each counter is met in all rows; the driver gets 2**COUNTERS numbers at most."""
    found = rows.mapInArrow(lean(_tally(elements)), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << COUNTERS, np.int32)
    total[found["counter"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**31 - 1)
    return total


def _items_of(batch: pa.RecordBatch) -> np.ndarray:
    return _lists(batch, "items")[1]


def _rarest(percent: int, shared):
    """Rows (sid, items) -> (sig, rank, sid): of each set the rarest elements, so many that two similar sets share one; not those that no other set holds. rank: how many such there are, few in a group's original."""

    def run(batches):
        total = shared.value
        for batch in batches:
            edges, values = _lists(batch, "items")
            sids, out = batch.column(0).to_numpy(), []
            for sid, x, y in zip(sids, edges[:-1], edges[1:], strict=True):
                items = values[x:y]
                times = total[_counter(items)]
                n = len(items) - -(-len(items) * percent // 100) + 1
                head = np.lexsort((items, times))[:n]
                head = head[times[head] > 1]
                out.append((T.signed(items[head]), np.full(len(head), n - len(head), np.int32), np.full(len(head), sid)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *(o[k] for o in out)])) for k, t in enumerate((np.int64, np.int32, np.int64))], ["sig", "rank", "sid"])

    return run


def _and_end(batches):
    yield from batches
    yield None


def _similar(d, total, percent: int):
    """Exact test by integers: a symmetric difference of d between sets of `total` elements together."""
    return d * (100 + percent) <= total * (100 - percent)


def _only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets whose id is among ids(sid): what a join ships is only what it needs."""
    ids = cut(ids.distinct())
    return sets.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "sid", "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose sets pass the exact test. Both joins are equi-joins on a set id."""
    pairs = cut(pairs)
    left = _only(sets, pairs.select(F.col("a").alias("sid"))).select(F.col("sid").alias("a"), F.col("items").alias("ia"))
    right = _only(sets, pairs.select(F.col("b").alias("sid"))).select(F.col("sid").alias("b"), F.col("items").alias("ib"))
    both = pairs.join(right, "b").join(left, "a")
    total = F.size("ia") + F.size("ib")
    return both.where(_similar(total - 2 * F.size(F.array_intersect("ia", "ib")), total, percent)).select("a", "b")


def _differences(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(first, sid, n, d, linked, mark, diff): how each set differs from its leader; only leaders with two members or more need diff."""
    stars = cut(stars)
    stars = stars.join(stars.groupBy("first").agg(F.count("*").alias("members")), "first")
    bases = _only(sets, stars.select(F.col("first").alias("sid"))).select(F.col("sid").alias("first"), F.col("items").alias("base"))
    whole = stars.join(sets.select("sid", "mark", "items"), "sid").join(bases, "first")
    own = whole.select("first", "sid", "members", "mark", F.size("items").alias("n"), F.size("base").alias("nf"), F.concat(F.array_except("items", "base"), F.array_except("base", "items")).alias("diff"))
    own = own.withColumn("d", F.size("diff")).withColumn("linked", _similar(F.col("d"), F.col("n") + F.col("nf"), percent))
    return own.select("first", "sid", "n", "d", "linked", "mark", F.when(F.col("members") > 1, F.col("diff")).alias("diff"))


def _star_items(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of a leader's difference elements, other ones for each leader."""
    edges, values = _lists(batch, "diff")
    first = batch.column(batch.schema.get_field_index("first")).to_numpy().view(np.uint64)
    return T.mix(np.repeat(T.mix(first), np.diff(edges)) + values)


def _heads(percent: int, shared):
    """Rows of own (see _candidates) -> (item, side, first, sid, root, n, d, after, mark): the rarest differences of each set, for either side of the join."""

    def run(batches):
        total = shared.value
        for batch in (part for whole in batches for part in _parts(whole, "diff")):
            edges, _ = _lists(batch, "diff")
            items = _star_items(batch)
            n, d, d_any, d_away = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("n", "d", "d_any", "d_away"))
            away = batch.column(batch.schema.get_field_index("away")).to_numpy(zero_copy_only=False)
            k_most = (n + n * 100 // percent) * (100 - percent) // (100 + percent)
            half = lambda x: -(-x // 2)
            short = np.maximum(1, half(d + d_away - k_most))
            long = np.maximum(np.maximum(1, d - k_most), half(d + d_any - k_most))
            out, row, side, after = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                times = total[_counter(items[x:y])]
                order = np.lexsort((items[x:y], times))
                for kind, t in ((0, short[i]), (1, long[i]))[: 2 if away[i] else 1]:
                    head = order[: max(0, y - x - t + 1)]
                    head = head[times[head] > 1]
                    out.append(items[x:y][head])
                    row.append(np.full(len(head), i))
                    side.append(np.full(len(head), kind, np.int32))
                    after.append(np.full(len(head), min(t, y - x + 1) - 1))
            at = pa.array(np.concatenate(row))
            taken = [batch.column(batch.schema.get_field_index(c)).take(at) for c in ("first", "sid", "root", "n", "d", "mark")]
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(np.concatenate(out))), pa.array(np.concatenate(side)), pa.array(np.concatenate(after)), *taken], ["item", "side", "after", "first", "sid", "root", "n", "d", "mark"])

    return run


HEADS = "item long, side int, after long, first long, sid long, root long, n long, d long, mark array<long>"


def _candidates(told: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs(a, b) of one leader, not connected so far, that may be similar.

    Of two sets o, m of a leader f, not connected, say o isn't connected with f. With D their differences to f, o and m link only
    if D(o) and D(m) differ in size by k(o, m) at most and share t >= (|D(o)| + |D(m)| - k(o, m)) / 2 elements, and
    t >= 1. Under one order of elements (the rarest among the leader's sets first) the first |D(o)| - t + 1 of the one and
    |D(m)| - t + 1 of the other then share an element; t is bounded below by the smallest differences of the leader's
    sets. What the leader alone lacks or holds, all its sets share, and it comes last. Pairs that meet this way are turned
    down by their marks, or counted: up to where one list ends all shared elements are seen, so at most what follows that end can be missing.
    """
    few = roots.count() <= BROADCAST_ROWS
    named = lambda node, root: (F.broadcast if few else lambda x: x)(roots.select(F.col("node").alias(node), F.col("root").alias(root)))
    own = told.where("diff IS NOT NULL").join(named("sid", "root"), "sid", "left").join(named("first", "home"), "first", "left")
    own = own.withColumns({"root": F.coalesce("root", "sid"), "home": F.coalesce("home", "first")}).withColumn("away", F.col("root") != F.col("home"))
    least = own.groupBy("first").agg(F.min("d").cast("long").alias("d_any"), F.min(F.when(F.col("away"), F.col("d"))).cast("long").alias("d_away")).where("d_away IS NOT NULL")
    least = cut(least)
    own = own.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, "first")
    own = spilled(own.select("first", "sid", "root", F.col("n").cast("long").alias("n"), F.col("d").cast("long").alias("d"), "d_any", "d_away", "away", "mark", "diff"), "open")
    shared = own.sparkSession.sparkContext.broadcast(_counted(own, _star_items))
    heads = spilled(own.mapInArrow(lean(_heads(percent, shared)), HEADS), "heads")
    side = lambda x, k: heads.where(F.col("side") == k).select("item", F.col("first").alias(f"f{x}"), F.col("sid").alias(x), *(F.col(c).alias(c[0] + x if c != "after" else f"after_{x}") for c in ("root", "n", "d", "mark", "after")))
    one, two = side("b", 0), side("a", 1)
    most = F.floor((F.col("na") + F.col("nb")) * F.lit(100 - percent) / F.lit(100 + percent))
    apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = (F.col("ra") != F.col("rb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.abs(F.col("da") - F.col("db")) <= most) & _similar(apart, F.col("na") + F.col("nb"), percent)
    met = two.join(one, (two["item"] == one["item"]) & (F.col("fa") == F.col("fb")) & near)
    needed = F.ceil((F.col("da") + F.col("db") - most) / 2)
    enough = met.groupBy("fa", "a", "b").agg(F.count("*").alias("common"), F.max(needed - F.greatest("after_a", "after_b")).alias("least")).where("common >= least")
    return enough.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(first, sid): the sets that a bucket's leader is to be compared with. Members of large buckets meet again by their rarest elements."""
    small, crowded = buckets.where("first = 0").select("bucket", "sid"), buckets.where("first != 0").select("sid").distinct()
    stars = None
    if not buckets.where("first != 0").isEmpty():
        own = spilled(_only(sets, crowded).select("sid", "items"), "crowded")
        shared = own.sparkSession.sparkContext.broadcast(_counted(own, _items_of))
        again = own.mapInArrow(lean(_rarest(percent, shared)), "sig long, rank int, sid long").repartition("sig").sortWithinPartitions("sig", "rank", "sid")
        again = spilled(again.mapInArrow(lean(_buckets), BUCKETS), "again")
        stars = again.where("first != 0 AND first != sid").select("first", "sid").distinct()
        small = small.unionByName(again.where("first = 0").select("bucket", "sid"))
    # a long text is in thousands of buckets: it comes to the join as one row
    small = small.groupBy("sid").agg(F.collect_set("bucket").alias("buckets"))
    ranged = small.join(sets.select("sid", "n", "sketch"), "sid").select(F.explode("buckets").alias("bucket"), "sid", "n", "sketch").repartition("bucket").sortWithinPartitions("bucket")
    found = ranged.mapInArrow(lean(_promising(percent)), "first long, sid long")
    return (found if stars is None else found.unionByName(stars)).distinct()


def _sets_of(only: DataFrame, table: DataFrame, buckets: DataFrame, width: int) -> DataFrame:
    """(sid, n, sketch, mark, items), once for each set of a bucket, from the texts of the smallest id that holds it. Ids that repeat, or are missing, bring further texts; each is known by its own set."""
    wanted = cut(buckets.select("sid").distinct())
    few = wanted.count() <= BROADCAST_ROWS
    reps = table.where("sid != 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    ids = reps.join(F.broadcast(wanted) if few else wanted, "sid", "left_semi").select(F.col("doc_id").alias("rep")).distinct()
    text = only.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = spilled(_only(text.select("text").mapInArrow(lean(_arrays(width)), ARRAYS), wanted), "sets")
    return spilled(sets.dropDuplicates(["sid"]), "sets") if sets.count() > wanted.count() else sets


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, keep_links: bool = False):
    """documents(doc_id, text, ...) -> (doc_id, n_shingles, component_id).

    Words are runs outside bytes 0x20 and 0x09-0x0D, A-Z lowered; a set holds the distinct `width`-word shingles (64-bit
    hashes), or the whole sequence where there are fewer words. Documents link when 100*|A & B| >= percent*|A | B|;
    component_id is the smallest doc_id reachable. Null, empty and white texts have n_shingles 0 and their own id.
    Repeated texts form one class before any join. A null doc_id is kept, with a null component unless it links.
    Other columns, whatever their names, are ignored. An empty table gives an empty result.
    With keep_links the verified links between set ids are returned as well: (result, links(a, b)).
    """
    need(docs, "doc_id", "text")
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = spilled(only.mapInArrow(lean(_classes(width)), "doc_id long, n_shingles long, sid long"), "classes")
    shared = docs.sparkSession.sparkContext.broadcast(_common(only, width))
    rows = only.select("text").mapInArrow(lean(_signatures(width, percent, shared)), "sig long, rank int, sid long").repartition("sig").sortWithinPartitions("sig", "sid")
    met = rows.mapInArrow(lean(_buckets), BUCKETS)
    buckets = spilled(met.select(F.when(F.col("first") == 0, F.col("bucket")).otherwise(0).alias("bucket"), "sid", F.when(F.col("first") == 0, 0).otherwise(1).cast("long").alias("first")).distinct(), "buckets")
    links, roots = [], None
    if not buckets.isEmpty():
        sets = _sets_of(only, table, buckets, width)
        told = spilled(_differences(_stars(buckets, sets, percent), sets, percent), "differences")
        direct = told.where("linked").select(F.col("first").alias("a"), F.col("sid").alias("b"))
        roots = cut(components(direct.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        pairs = _candidates(told, roots, percent)
        found = cut(_linked(pairs, sets, percent))
        links = [direct, found]
        if not found.isEmpty():
            every = links[0].unionByName(found)
            roots = cut(components(every.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    plain = table.select("doc_id", "n_shingles", "sid")
    if roots is not None:
        plain = plain.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("sid", F.coalesce("root", "sid")).drop("root")
    least = plain.where("sid != 0").groupBy("sid").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    result = plain.join(least, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if keep_links:
        every = None
        for x in links:
            every = x if every is None else every.unionByName(x)
        return result, every
    return result
