"""Toxicity scoring by a factorization machine (Rendle, 2010) over hashed terms.

Terms are runs of letters, digits and non-ASCII bytes, A-Z lowered, and their first bytes, hashed into 2**22 buckets; a
document's features are its distinct buckets. The score adds linear weights and all pairwise interactions of learned factors, so a pair such as
an insult with a group mention can weigh what neither term weighs alone.

Which buckets become features is told by tests on the sample, over all of them, at a bounded rate of false discoveries:
those that depend on the label, and those that do beside another term (the strongest and the most frequent ones).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as T
from .common import bounded_by_class, cut, id_bucket, lean, need, spilled

BITS = 22
#: A term gives its first so many bytes as further terms, so that inflected forms share one.
PREFIXES = (4, 5)
#: Bound of training: labelled documents of each class.
DOCS_PER_CLASS = 4_000
#: Documents of the sample that must hold a term, or a pair, before it is tested; share of false discoveries among features.
LEAST, FALSE = 3, 0.1
#: Terms beside which others are tested: the strongest, and as many of the most frequent.
BASES = 32
#: Squared deviates below this are no discovery at any number of tests; they don't go to the driver.
WEAK = 10.0
FACTORS = 8
#: Least number of gradient steps, however few rows there are.
STEPS = 600


@dataclass
class FactorizationMachine:
    """buckets: the sorted feature buckets; bias, linear (n,), factors (n, k)."""

    buckets: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, feature: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Of documents given as (feature, document) pairs without repeats."""
        z = np.bincount(doc, self.linear[feature], docs) + self.bias
        for k in range(self.factors.shape[1]):
            own = self.factors[feature, k]
            z += 0.5 * (np.bincount(doc, own, docs) ** 2 - np.bincount(doc, own * own, docs))
        return z


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = T.words(data, offsets, T.OTHER)
    heads, doc = T.prefixes(data, offsets, T.OTHER, PREFIXES)
    return (np.concatenate([hashes, heads]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([np.repeat(np.arange(len(counts)), counts), doc])


def _distinct(bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc << BITS) | bucket)
    return key & ((1 << BITS) - 1), key >> BITS


def _features(batches):
    for batch in batches:
        data, offsets = T.buffer_of(T.column(batch, "text"))
        label = batch.column(batch.schema.get_field_index("toxic"))
        for a, b in T.groups(offsets):
            bucket, doc = _distinct(*_terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            edges = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([label.slice(a, b - a), pa.ListArray.from_arrays(pa.array(edges), pa.array(bucket.astype(np.int32)))], ["toxic", "terms"])


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, offsets and terms of a batch of _features."""
    lists = batch.column(1)
    edges = lists.offsets.to_numpy()
    return batch.column(0).to_numpy().astype(np.int64), edges - edges[0], lists.values.to_numpy()[edges[0] : edges[-1]]


def _occurrences(batches):
    """By term: documents, and those of label 1."""
    for batch in batches:
        label, edges, terms = _rows(batch)
        held, at = np.unique(terms, return_inverse=True)
        rows = np.repeat(label, np.diff(edges))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.bincount(at, minlength=len(held))), pa.array(np.bincount(at, rows, len(held)).astype(np.int64))], ["term", "n", "n1"])


def _beside(bases: list[int], known: np.ndarray):
    """By base and term: documents that hold both, and those of label 1. known: the sorted terms that enough documents hold; no pair of others does."""

    def run(batches):
        for batch in batches:
            label, edges, terms = _rows(batch)
            doc = np.repeat(np.arange(len(label)), np.diff(edges))
            often = known[np.minimum(np.searchsorted(known, terms), len(known) - 1)] == terms
            doc, terms = doc[often], terms[often]
            for base in bases:
                has = np.zeros(len(label), bool)
                has[doc[terms == base]] = True
                own = has[doc] & (terms != base)
                held, at = np.unique(terms[own], return_inverse=True)
                n1 = np.bincount(at, label[doc[own]], len(held)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), base, np.int32)), pa.array(held), pa.array(np.bincount(at, minlength=len(held))), pa.array(n1)], ["base", "term", "n", "n1"])

    return run


def _indexed(buckets: np.ndarray):
    """Documents as places among the kept buckets."""

    def run(batches):
        for batch in batches:
            label, edges, terms = _rows(batch)
            at = np.minimum(np.searchsorted(buckets, terms), max(0, len(buckets) - 1))
            hit = buckets[at] == terms if len(buckets) else np.zeros(len(terms), bool)
            ends = np.concatenate([[0], np.cumsum(hit)])[edges].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))], ["toxic", "terms"])

    return run


def deviates(n, n1, total, total1, root):
    """Sizes of normal deviates, by the hypergeometric variance and with continuity, of n1 ones among n draws from total rows with total1 ones."""
    mean = n * total1 / total
    variance = mean * (total - total1) / total * (total - n) / (total - 1)
    return (root((n1 - mean) * (n1 - mean)) - 0.5) / root(variance)


def discoveries(z: np.ndarray, tests: int, rate: float = FALSE) -> np.ndarray:
    """Which deviates count at a rate of false discoveries (Benjamini and Hochberg, 1995), of so many tests in all, the others weaker."""
    p = np.array([erfc(x / sqrt(2)) for x in np.maximum(z, 0)])
    order = np.argsort(p, kind="stable")
    good = np.flatnonzero(p[order] <= rate * (np.arange(len(p)) + 1) / max(1, tests))
    out = np.zeros(len(p), bool)
    out[order[: good[-1] + 1 if len(good) else 0]] = True
    return out


def choose(sample: DataFrame) -> np.ndarray:
    """Sorted feature buckets of a sample (toxic, terms). Counts are summed on executors; the driver gets a row for each bucket that LEAST documents hold, then the pairs that deviate."""
    total, total1 = (int(x or 0) for x in sample.agg(F.count("*"), F.sum("toxic")).first())
    if total1 in (0, total):
        return np.zeros(0, np.int64)
    sums = lambda run, keys, schema: sample.mapInArrow(lean(run), schema + ", n long, n1 long").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= LEAST)
    found = sums(_occurrences, ["term"], "term int").toArrow()
    term, n, n1 = (found[c].to_numpy().astype(np.int64) for c in ("term", "n", "n1"))
    if not len(term):
        return np.zeros(0, np.int64)
    order = np.argsort(term)
    term, n, n1 = term[order], n[order], n1[order]
    z = deviates(n, n1, total, total1, lambda v: np.sqrt(np.maximum(v, 1e-9)))
    own = discoveries(z, len(z))
    bases = np.union1d(term[np.argsort(-z, kind="stable")[:BASES]], term[np.argsort(-n, kind="stable")[:BASES]])
    held = {int(t): (int(a), int(b)) for t, a, b in zip(term, n, n1, strict=True)}
    sizes = sample.sparkSession.createDataFrame([(int(b), *held[int(b)]) for b in bases], "base int, total long, total1 long")
    pairs = sums(_beside(bases.tolist(), term.astype(np.int32)), ["base", "term"], "base int, term int").join(F.broadcast(sizes), "base").where("total1 > 0 AND total1 < total AND n < total")
    pairs = cut(pairs.select("term", deviates(F.col("n"), F.col("n1"), F.col("total"), F.col("total1"), F.sqrt).alias("z")))
    strong = pairs.where((F.col("z") > 0) & (F.col("z") * F.col("z") > WEAK)).groupBy("term").agg(F.max("z").alias("z")).toArrow()
    beside = strong["term"].to_numpy()[discoveries(strong["z"].to_numpy(), pairs.count())] if strong.num_rows else np.zeros(0, np.int64)
    mates = bases if len(beside) else bases[:0]
    return np.unique(np.concatenate([term[own], beside, mates]).astype(np.int64))


def train(terms: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, prior: float, factors: int = FACTORS, epochs: int = 25, seed: int = 3) -> FactorizationMachine:
    """Adam on logistic loss with L2. terms: places among the feature buckets, by document.

    prior: the share of label 1 outside the sample; the bias is set for it. Result does not depend on the row order if rows are sorted.
    """
    y = labels.astype(np.float64)
    share = y.mean()
    rng = np.random.default_rng(seed)
    n = len(buckets)
    w, v, b = np.zeros(n, np.float32), rng.normal(0, 0.02, (n, factors)).astype(np.float32), np.zeros(1, np.float32)
    params = [w, v, b]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, decay = 0, (5e-4, 1e-3, 0)
    epochs = max(epochs, -(-STEPS // max(1, -(-len(terms) // 256))))
    for epoch in range(epochs):
        order = rng.permutation(len(terms))
        for lo in range(0, len(order), 256):
            own = order[lo : lo + 256]
            xb = np.zeros((len(own), n), np.float32)
            for i, k in enumerate(own):
                xb[i, terms[k]] = 1
            s = xb @ v
            z = xb @ w + b + 0.5 * (s * s - xb @ (v * v)).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)).astype(np.float32)
            gw = xb.T @ g
            grads = [gw + decay[0] * w, xb.T @ (s * g[:, None]) - v * gw[:, None] + decay[1] * v, np.array([g.sum()], np.float32)]
            step += 1
            rate = 0.02 * (1 - 0.95 * epoch / epochs)
            for p, q, m, u in zip(params, grads, first, second, strict=True):
                m += 0.1 * (q - m)
                u += 0.01 * (q * q - u)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-6)
    odds = lambda p: np.log(p / (1 - p))
    shift = odds(min(max(prior, 1e-6), 1 - 1e-6)) - odds(min(max(share, 1e-6), 1 - 1e-6))
    return FactorizationMachine(buckets, float(b[0] + shift), w.astype(np.float64), v.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = DOCS_PER_CLASS) -> FactorizationMachine | None:
    """Learns from labels.toxic of documents whose fold (crc32 of the id, modulo 5) is not 0: about per_class documents of each class (the bound). None without labels."""
    own = labels.where((id_bucket("doc_id", 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rates = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not rates:
        return None
    chosen = cut(bounded_by_class(own, "doc_id", "toxic", per_class))
    text = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = spilled(text.mapInArrow(lean(_features), "toxic int, terms array<int>"), "terms")
    if sample.isEmpty():
        return None
    buckets = choose(sample)
    rows = sample.mapInArrow(lean(_indexed(buckets)), "toxic int, terms array<int>").toArrow().combine_chunks()
    lists = rows["terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    edges, values, label = lists.offsets.to_numpy(), lists.values.to_numpy(), rows["toxic"].to_numpy()
    terms = [values[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    order = sorted(range(len(terms)), key=lambda i: (label[i], len(terms[i]), terms[i].tobytes()))
    return train([terms[i] for i in order], label[order], buckets, rates.get(1, 0) / sum(rates.values()))


def _predict(model: FactorizationMachine | None):
    def run(batches):
        slot = np.full(1 << BITS, -1, np.int32)
        if model:
            slot[model.buckets] = np.arange(len(model.buckets), dtype=np.int32)
        for batch in batches:
            n = batch.num_rows
            score = np.zeros(n)
            if model:
                data, offsets = T.buffer_of(T.column(batch, "text"))
                for a, b in T.groups(offsets):
                    bucket, doc = _terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    feature = slot[bucket]
                    known = feature >= 0
                    feature, doc = _distinct(feature[known].astype(np.int64), doc[known])
                    score[a:b] = 1 / (1 + np.exp(-np.clip(model.logits(feature, doc, b - a), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def predict(docs: DataFrame, model: FactorizationMachine | None) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, score, predicted), one row per input row.

    Null, empty and term-less texts score the model's bias. Where nothing could be learned every score is 0. Repeated
    rows and equal texts score alike; a null doc_id is kept (held_out false). Other columns are ignored.
    """
    need(docs, "doc_id", "text")
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return ready.mapInArrow(lean(_predict(model)), "doc_id long, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fit() on the labels, then predict() for every document."""
    need(labels, "doc_id", "toxic")
    return predict(docs, fit(docs, labels))
