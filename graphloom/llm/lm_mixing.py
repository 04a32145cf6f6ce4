"""Language-model scoring by logistic context mixing of hashed bit predictors.

A byte is coded as binary decisions along a Huffman tree. For each decision, predictors of orders 0 to 5 look up, by a
hash of the preceding bytes and the tree node, how often the bit was 0 or 1 in the training text. A mixer adds their
logits with weights of a gate (how much the longest contexts have seen), learned by a few Newton steps; a probability
map then refines the mixed probability by tree node. Bit counts, mixer and map are all gathered from all training text:
of a decision its own bit is left out of the counts. Scoring applies the learned state, the same
for every document, so that scores don't depend on the order or the placing of rows; its result for a six-byte context
is kept in a table, as most contexts recur.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as T
from .common import cut, id_bucket, lean, need, spilled

#: Bits of the slot number of each order's predictors (0: no context).
SLOT_BITS = (9, 16, 18, 20, 21, 21)
ORDERS = len(SLOT_BITS)
BASES = np.cumsum([0, *(1 << b for b in SLOT_BITS)])
#: This byte ends a text; UTF-8 has no such byte.
END = 0xFF
GATES = 5 * 5 * 3
MAP_STEPS = 33
#: Newton steps of the mixer, each a pass over the gram table; a last pass makes the map.
PASSES = 3
#: Bits of the number of entries of a worker's table of contexts, for counting and for scoring.
TABLE_BITS = 20
SCORE_BITS = 22
#: Words whose counts are looked up in memory, the most frequent (16 bytes each); others are looked up by a join.
LOOKUP_WORDS = 3_000_000


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path lengths (256,), nodes (256, depth), bits (256, depth)) of a Huffman tree over smoothed byte counts, at most 24 deep."""
    weights = np.maximum(counts.astype(np.float64), counts.sum() / 2**20 + 1)
    heap = [(w, i, None) for i, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    serial = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], serial, (a, b)))
        serial += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    stack = [(heap[0], [])]
    while stack:
        (_, name, sides), path = stack.pop()
        if sides is None:
            paths[name] = path
        else:
            for bit, side in enumerate(sides):
                stack.append((side, [*path, (name - 256, bit)]))
    depth = max(map(len, paths.values()))
    lengths, nodes, bits = np.zeros(256, np.int64), np.zeros((256, depth), np.int64), np.zeros((256, depth), np.int64)
    for byte, path in paths.items():
        lengths[byte] = len(path)
        for k, (node, bit) in enumerate(path):
            nodes[byte, k], bits[byte, k] = node, bit
    return lengths, nodes, bits


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each document, and its end, the byte with the five before it (zero before a start) as one uint64; and the document of each."""
    sizes = np.diff(offsets)
    n = len(data) + len(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    ends = offsets[1:] + np.arange(len(sizes))
    stream = np.empty(n, np.uint64)
    body = np.ones(n, bool)
    body[ends] = False
    stream[body] = data
    stream[ends] = END
    key = stream.copy()
    begins = offsets[:-1] + np.arange(len(sizes))
    place = np.arange(n) - np.repeat(begins, sizes + 1)
    for k in range(1, ORDERS):
        key[k:] |= np.where(place[k:] >= k, stream[:-k] << np.uint64(8 * k), np.uint64(0))
    return key | np.uint64(1 << 62), doc  # never 0, which marks a free place in a table


def _slots(key: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
    """Predictor of an order for contexts (grams) and tree nodes."""
    context = (key >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    hashed = T.mix(context * np.uint64(0x2545F4914F6CDD1D) + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order))
    return (hashed >> np.uint64(64 - SLOT_BITS[order])).astype(np.int64) + BASES[order]


class Contexts:
    """A direct-mapped table from grams to places; grams that meet a taken place are left over."""

    def __init__(self, bits: int = TABLE_BITS):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)

    def place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        return at, self.keys[at] == key


@dataclass
class Mixture:
    """Bit counts by predictor (2, slots), the tree, mixer weights by gate, and the adaptive map by node."""

    counts: np.ndarray
    tree: tuple[np.ndarray, np.ndarray, np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, ORDERS + 1), 0.3, np.float64))
    refine: np.ndarray | None = None

    def inputs(self, key: np.ndarray, node: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits (n, orders + 1 with a constant) and gates. own: bits that were counted and are left out again, for training."""
        x = np.empty((len(key), ORDERS + 1))
        x[:, ORDERS] = 0.4
        seen = []
        for order in range(ORDERS):
            at = _slots(key, node, order)
            n0, n1 = self.counts[0][at].astype(np.float64), self.counts[1][at].astype(np.float64)
            if own is not None:
                n0 = np.maximum(0, n0 - (own == 0))
                n1 = np.maximum(0, n1 - own)
            x[:, order] = np.log((n1 + 0.4) / (n0 + 0.4))
            seen.append(n0 + n1)
        level = lambda n: np.minimum(4, np.log2(n + 1) / 2.5).astype(np.int64)
        return np.clip(x, -12, 12), (level(seen[5]) * 5 + level(seen[4])) * 3 + np.minimum(2, np.log2(seen[3] + 1) / 4).astype(np.int64)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((self.weights[gate] * x).sum(1), -14, 14)

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mean of the mixed one and what the map holds between its two nearest steps."""
        p = 1 / (1 + np.exp(-z))
        if self.refine is not None:
            at = (z + 14) * (MAP_STEPS - 1) / 28
            low = np.minimum(at.astype(np.int64), MAP_STEPS - 2)
            share = at - low
            p = 0.5 * p + 0.5 * (self.refine[node, low] * (1 - share) + self.refine[node, low + 1] * share)
        return np.clip(p, 1e-6, 1 - 1e-6)

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        lengths, nodes, bits = self.tree
        byte = (key & np.uint64(255)).astype(np.int64)
        total = np.zeros(len(key))
        for k in range(nodes.shape[1]):
            live = np.flatnonzero(lengths[byte] > k)
            if not len(live):
                break
            node, bit = nodes[byte[live], k], bits[byte[live], k]
            x, gate = self.inputs(key[live], node)
            p = self.refined(self.mixed(x, gate), node)
            total[live] += np.log10(np.where(bit == 1, p, 1 - p))
        return total

    def sums(self, key: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What learning adds up over grams that occur so many times: by gate slopes and curvatures of the log loss, by node and step of the map decisions and ones."""
        lengths, nodes, bits = self.tree
        total = np.zeros(SUMS)
        slope, curve, n, ones = _parts(total)
        for lo in range(0, len(key), 50_000):
            own, count = key[lo : lo + 50_000], times[lo : lo + 50_000].astype(np.float64)
            byte = (own & np.uint64(255)).astype(np.int64)
            for k in range(nodes.shape[1]):
                live = np.flatnonzero(lengths[byte] > k)
                if not len(live):
                    break
                node, bit, c = nodes[byte[live], k], bits[byte[live], k], count[live]
                x, gate = self.inputs(own[live], node, bit)
                z = self.mixed(x, gate)
                p = 1 / (1 + np.exp(-z))
                order = np.argsort(gate.astype(np.uint8), kind="stable")
                edges = np.searchsorted(gate[order], np.arange(GATES + 1))
                x, d, h = x[order], (c * (bit - p))[order], (c * p * (1 - p))[order]
                for g in np.flatnonzero(np.diff(edges)):
                    part = slice(edges[g], edges[g + 1])
                    slope[g] += d[part] @ x[part]
                    curve[g] += x[part].T @ (x[part] * h[part, None])
                at = node * MAP_STEPS + np.rint((z + 14) * (MAP_STEPS - 1) / 28).astype(np.int64)
                n += np.bincount(at, c, len(n))
                ones += np.bincount(at, c * bit, len(n))
        return total

    def step(self, total: np.ndarray) -> None:
        """A Newton step of the weights, held to their start as by ten decisions."""
        slope, curve, _, _ = _parts(total)
        move = np.linalg.solve(curve + 10 * np.eye(ORDERS + 1), (slope - 10 * (self.weights - 0.3))[..., None])[..., 0]
        self.weights = self.weights + np.clip(move, -0.5, 0.5)

    def chart(self, total: np.ndarray) -> None:
        """The map: share of ones at each node and step, beside fifty decisions as mixed."""
        _, _, n, ones = _parts(total)
        mixed = 1 / (1 + np.exp(-np.linspace(-14, 14, MAP_STEPS)))
        self.refine = (ones.reshape(256, -1) + 50 * mixed) / (n.reshape(256, -1) + 50)

    def learn(self, key: np.ndarray) -> None:
        """Weights and map from the grams of a text, in memory."""
        unique, times = np.unique(key, return_counts=True)
        for _ in range(PASSES):
            self.step(self.sums(unique, times))
        self.chart(self.sums(unique, times))


SUMS = GATES * (ORDERS + 1) * (ORDERS + 2) + 2 * 256 * MAP_STEPS


def _parts(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Views of sums(): slopes, curvatures, decisions, ones."""
    wide, square = GATES * (ORDERS + 1), GATES * (ORDERS + 1) ** 2
    n, ones = total[wide + square :].reshape(2, -1)
    return total[:wide].reshape(GATES, -1), total[wide : wide + square].reshape(GATES, ORDERS + 1, ORDERS + 1), n, ones


def _count_bytes(batches):
    total = np.zeros(256, np.int64)
    for batch in batches:
        data, offsets = T.buffer_of(T.column(batch, "text"))
        for a, b in T.groups(offsets):
            total += np.bincount(data[offsets[a] : offsets[b]], minlength=256)
        total[END] += len(offsets) - 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])


def _rows(kind: int, ids: np.ndarray, n: np.ndarray):
    for lo in range(0, len(ids), 100_000):
        own = slice(lo, lo + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids[own]), kind, np.int64)), pa.array(T.signed(ids[own])), pa.array(n[own])], ["kind", "id", "n"])


def _gather(batches):
    """How often each gram (kind 0) and each word hash (kind 1) occurs in one task's training texts; summed here as far as memory is set aside for it, by the shuffle for the rest."""
    table = Contexts()
    times = np.zeros(len(table.keys), np.int64)
    words: list[tuple[np.ndarray, np.ndarray]] = []
    pending = 0

    def summed():
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        every, at = np.unique(np.concatenate([w for w, _ in words]), return_inverse=True)
        return every, np.bincount(at, np.concatenate([c for _, c in words])).astype(np.int64)

    for batch in batches:
        data, offsets = T.buffer_of(T.column(batch, "text"))
        for a, b in T.groups(offsets, 1 << 20):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            words.append(np.unique(T.words(own, at)[0], return_counts=True))
            pending += len(words[-1][0])
            if pending > 800_000:
                words[:] = [summed()]
                pending = len(words[0][0])
                if pending > 400_000:  # more words than a task should hold: pass them on
                    yield from _rows(1, *words.pop())
                    pending = 0
            key, _ = grams(own, at)
            place, hit = table.place(key)
            np.add.at(times, place[hit], 1)
            if hit.all():
                continue
            new, n = np.unique(key[~hit], return_counts=True)
            where, _ = table.place(new)
            free = np.flatnonzero(table.keys[where] == 0)
            taken = free[np.unique(where[free], return_index=True)[1]]
            table.keys[where[taken]] = new[taken]
            times[where[taken]] += n[taken]
            rest = np.ones(len(new), bool)
            rest[taken] = False
            yield from _rows(0, new[rest], n[rest])
    yield from _rows(1, *summed())
    full = np.flatnonzero(table.keys)
    yield from _rows(0, table.keys[full], times[full])


def _predictors(tree):
    """Bit counts by predictor slot, of one task's grams."""

    def run(batches):
        counts = np.zeros((2, BASES[-1]), np.int64)
        lengths, nodes, bits = tree
        for batch in batches:
            key, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            byte = (key & np.uint64(255)).astype(np.int64)
            for k in range(nodes.shape[1]):
                live = np.flatnonzero(lengths[byte] > k)
                if not len(live):
                    break
                node, bit = nodes[byte[live], k], bits[byte[live], k]
                for order in range(ORDERS):
                    np.add.at(counts.reshape(-1), _slots(key[live], node, order) + bit * BASES[-1], n[live])
        used = np.flatnonzero(counts.any(0))
        for lo in range(0, len(used), 100_000):
            own = used[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[0][own]), pa.array(counts[1][own])], ["slot", "n", "m"])

    return run


def _learning(shared, weights: np.ndarray):
    """Mixture.sums of one task's grams."""

    def run(batches):
        mixture = Mixture(*shared.value, weights=weights)
        total = np.zeros(SUMS)
        for batch in batches:
            total += mixture.sums(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["place", "value"])

    return run


def halved(n: str, m: str) -> list:
    """Two long counts as ints below 2**16, halved until they fit, both alike: only their ratio and rough size matter."""
    times = f"greatest(0, length(bin(greatest({n}, {m}))) - 16)"
    return [F.expr(f"cast(shiftright({c}, cast({times} as int)) as int)").alias(c) for c in (n, m)]


def fit(docs: DataFrame) -> tuple[Mixture, DataFrame, int, int]:
    """(mixture, word counts (word, n), N, V) of the training texts: those whose fold (crc32 of the id, modulo 10) is not 0.

    Counts cover all of them. Each task sums its own first; the driver gets at most sum(2**SLOT_BITS) predictor rows.
    """
    training = docs.where(F.coalesce(id_bucket("doc_id", 10) != 0, F.lit(True))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = np.zeros(256, np.int64)
    for r in training.select("text").mapInArrow(lean(_count_bytes), "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        total[r["byte"]] = r["n"]
    tree = huffman(total)
    rows = training.select("text").mapInArrow(lean(_gather), "kind long, id long, n long")
    sums = spilled(rows.groupBy("kind", "id").agg(F.sum("n").alias("n")), "counts")
    counts = np.zeros((2, BASES[-1]), np.uint16)
    seen = sums.where("kind = 0").select("id", "n").mapInArrow(lean(_predictors(tree)), "slot long, n long, m long")
    found = seen.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    found = found.select(F.col("slot").cast("int"), *halved("n", "m")).toArrow()
    for side, name in enumerate("nm"):
        counts[side][found["slot"].to_numpy()] = found[name].to_numpy()
    words = sums.where("kind = 1").select(F.col("id").alias("word"), "n")
    number, distinct = words.agg(F.sum("n"), F.count("*")).first()
    mixture = Mixture(counts, tree)
    if total.any():
        shared = training.sparkSession.sparkContext.broadcast((counts, tree))
        for turn in range(PASSES + 1):
            added = np.zeros(SUMS)
            found = sums.where("kind = 0").select("id", "n").mapInArrow(lean(_learning(shared, mixture.weights)), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
            added[found["place"].to_numpy()] = found["value"].to_numpy()
            mixture.step(added) if turn < PASSES else mixture.chart(added)
        shared.destroy()
    return mixture, words, int(number or 0) + docs_count(training), int(distinct) + (1 if total[END] else 0)


def docs_count(df: DataFrame) -> int:
    return df.select("doc_id").count()


class Scorer:
    """log10 of grams, by way of a table of those met before."""

    def __init__(self, mixture: Mixture):
        self.mixture, self.table = mixture, Contexts(SCORE_BITS)
        self.values = np.zeros(len(self.table.keys), np.float32)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        place, hit = self.table.place(key)
        out = self.values[place]
        missed = np.flatnonzero(~hit)
        if len(missed):
            new, at = np.unique(key[missed], return_inverse=True)
            value = np.concatenate([self.mixture.log10(new[lo : lo + 50_000]) for lo in range(0, len(new), 50_000)])
            out[missed] = value[at]
            where, _ = self.table.place(new)
            self.table.keys[where] = new
            # of several grams for one place the last wins for keys and values alike
            self.values[where] = value
        return out


_SCORERS: dict[str, Scorer] = {}


@dataclass
class Words:
    """Values of the words that occur at least `least` times in training text, by sorted hash; what other values there are.

    Where least is 1 a word that isn't here is new. Where it is 2 such a word occurs once if its document was learned
    from; else, and for a larger least, it must be looked up in the table of counts.
    """

    hashes: np.ndarray
    values: np.ndarray
    least: int
    unseen: float
    once: float
    end: float
    end_known: int
    starts: np.ndarray | None = None

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and whether it is there, of each word: hashes are spread evenly, so those of equal leading bits are few and are compared in turn."""
        if self.starts is None:
            self.starts = np.searchsorted(self.hashes, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        at = self.starts[(words >> np.uint64(44)).astype(np.int64)]
        hit = np.zeros(len(words), bool)
        left = np.flatnonzero(at < len(self.hashes))
        while len(left):
            there = self.hashes[at[left]]
            hit[left[there == words[left]]] = True
            left = left[there < words[left]]
            at[left] += 1
            left = left[at[left] < len(self.hashes)]
        return np.minimum(at, len(self.hashes) - 1), hit


def _score(shared, name: str):
    def run(batches):
        from pyspark import TaskContext

        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value[0])
        scorer, known = _SCORERS[name], shared.value[1]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = T.buffer_of(T.column(batch, "text"))
            held = batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            score, tokens, seen, base = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            rare, edges = [np.zeros(0, np.uint64)], np.zeros(n, np.int64)
            for a, b in T.groups(offsets, 1 << 20):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, counts = T.words(own, at)
                tokens[a:b] = counts + 1
                doc = np.repeat(np.arange(b - a), counts)
                value, hit = np.zeros(len(hashes)), np.zeros(len(hashes), bool)
                if len(known.hashes):
                    index, hit = known.find(hashes)
                    value = np.where(hit, known.values[index], 0.0)
                if known.least == 1:
                    value[~hit] = known.unseen
                else:
                    once = ~hit & ~held[a:b][doc] if known.least == 2 else np.zeros(len(hashes), bool)
                    value[once] = known.once
                    hit |= once
                    rare.append(hashes[~hit])
                    edges[a:b] = np.bincount(doc[~hit], minlength=b - a)
                seen[a:b] = np.bincount(doc, hit, b - a).astype(np.int64) + known.end_known
                base[a:b] = np.bincount(doc, value, b - a) + known.end
                key, doc = grams(own, at)
                score[a:b] = np.bincount(doc, scorer(key), b - a)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(edges)]).astype(np.int32)), pa.array(T.signed(np.concatenate(rare))))
            arrays = [*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out")), *map(pa.array, (tokens, np.diff(offsets), score, seen, base)), lists, pa.array(np.arange(row, row + n))]
            row += n
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_bytes", "score", "n_known", "base_score", "rare", "row"])

    return run


def score_texts(docs: DataFrame, lookup_words: int = LOOKUP_WORDS) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per input row.

    held_out: crc32 of the id modulo 10 is 0; the other rows are learned from (a null id counts as one of them). Tokens:
    words between bytes 0x20 and 0x09-0x0D, A-Z lowered, then one end. base_score: add-0.1 unigram log10 probability;
    score: the mixture's, of all bytes and the end. Null and empty texts consist of their end. Repeated rows score
    alike. Other columns are ignored; an empty table gives no rows. Of the word counts at most lookup_words are
    broadcast, the most frequent; rarer words of documents join the others, with one result.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    mixture, words, number, distinct = fit(docs)
    ends = docs_count(docs.where(F.coalesce(id_bucket("doc_id", 10) != 0, F.lit(True))))
    below = number + 0.1 * (distinct + 1)
    log = lambda n: np.log10((n + 0.1) / below)
    # The smallest power of two such that the words that occur so often fit into memory.
    levels = sorted(((r["e"], r["k"]) for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, held = 1 << (levels[0][0] + 1 if levels else 0), 0
    for e, k in levels:
        if held + k > lookup_words:
            break
        held, least = held + k, 1 << e
    least = 1 if held == distinct - (ends > 0) else least
    table = words.where(F.col("n") >= least).toArrow()
    hashes = table["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    known = Words(hashes[order], log(table["n"].to_numpy()[order]), least, float(log(0)), float(log(1)), float(log(ends)), int(ends > 0))
    shared = spark.sparkContext.broadcast((mixture, known))
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_bucket("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "text")
    scored = ready.mapInArrow(lean(_score(shared, uuid.uuid4().hex)), "doc_id long, held_out boolean, n_tokens long, n_bytes long, score double, n_known long, base_score double, rare array<long>, row long")
    if least > 1:
        scored = spilled(scored, "scored")
        pairs = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times")).join(words.where(F.col("n") < least), "word", "left")
        value = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(below)) * F.col("times")
        sums = pairs.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(value).alias("v"))
        scored = scored.drop("rare").join(sums, "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("k", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("v", F.lit(0.0))})
    bits = -F.col("score") / F.lit(float(np.log10(2))) / F.greatest(F.col("n_bytes"), F.lit(1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(number).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
