"""Quality selection by data importance resampling (Xie et al., 2023) on hashed n-grams.

Two bag-of-n-gram generative models over hashed buckets are counted: one of target text (labelled good), one of all raw
text. A document's importance weight is the ratio of its likelihoods; adding Gumbel noise to the log weights and taking
the k largest draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as T
from .common import bounded_by_class, cut, lean, need

BUCKETS = 1 << 14
#: Pseudo-count of the target model, spread as raw text is: buckets that a small target sample says little about stay near a ratio of 1.
PRIOR = 8.0 * BUCKETS
#: Standard errors by which negative log ratios are raised, up to 0; words come in bursts, so few counts say less than they seem to.
DOUBT = 2.0
#: Bound of the labelled target sample (documents); counts of raw text cover every document.
TARGET_DOCS = 20_000


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word or punctuation token and each pair of neighbours, and the document of each."""
    hashes, counts = T.words(data, offsets, T.KINDS)
    doc = np.repeat(np.arange(len(counts)), counts)
    pair = T.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) if len(hashes) else hashes
    same = doc[:-1] == doc[1:]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([hashes >> shift, pair[same] >> shift]).astype(np.int64), np.concatenate([doc, doc[1:][same]])


def _chunks(batch: pa.RecordBatch):
    data, offsets = T.buffer_of(T.column(batch, "text"))
    for a, b in T.groups(offsets, T.PASS):
        yield a, b, *_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _count(batches):
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        target = batch.column(batch.schema.get_field_index("target")).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, bucket, doc in _chunks(batch):
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket, weights=target[a:b][doc], minlength=BUCKETS).astype(np.int64)
    kind, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(bucket), pa.array(total[kind, bucket])], ["kind", "bucket", "n"])


def fit(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Log ratios by bucket. docs(doc_id, text): raw text, all of it counted; good(doc_id): the ids of target documents, at most a bounded sample.

    Counts are summed per task, then by bucket; the driver receives 2 * BUCKETS rows at most.
    """
    flagged = docs.select("doc_id", "text").join(F.broadcast(good.select("doc_id").distinct().withColumn("target", F.lit(True))), "doc_id", "left")
    rows = flagged.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(lean(_count), "kind long, bucket long, n long")
    total = np.zeros((2, BUCKETS))
    for r in rows.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        total[r["kind"], r["bucket"]] = r["n"]
    if not total[1].any():
        return np.zeros(BUCKETS)
    raw = (total[0] + 0.5) / (total[0] + 0.5).sum()
    ratio = np.log((total[1] + PRIOR * raw) / (total[1].sum() + PRIOR)) - np.log(raw)
    error = np.sqrt(1 / (total[1] + PRIOR * raw) + 1 / (total[0] + 0.5))
    return np.where(ratio < 0, np.minimum(0, ratio + DOUBT * error), ratio)  # what chance may explain doesn't count against a text


def target_sample(labels: DataFrame, bound: int = TARGET_DOCS) -> DataFrame:
    """About `bound` ids of documents labelled of good quality, chosen by a hash of the id."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    return bounded_by_class(good, "doc_id", "quality", bound).select("doc_id")


def _weigh(batch: pa.RecordBatch, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, log weights, Gumbel keys, and the keys as longs in the same order, of a batch's documents."""
    n = batch.num_rows
    weight, terms, content = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for a, b, bucket, doc in _chunks(batch):
        weight[a:b] = np.bincount(doc, ratio[bucket], b - a)
        terms[a:b] = np.bincount(doc, minlength=b - a)
        np.add.at(content[a:b], doc, T.mix(bucket.astype(np.uint64)))
    own = pc.fill_null(batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), -1).to_numpy().view(np.uint64)
    unit = ((T.mix(T.mix(own + np.uint64(seed)) + content) >> np.uint64(12)).astype(np.float64) + 0.5) / 2**52
    key = weight - np.log(-np.log(unit))
    bits = key.view(np.int64)
    return terms, weight, key, np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _score(ratio: np.ndarray, seed: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, _weigh(batch, ratio, seed))], ["doc_id", "n_terms", "log_weight", "gumbel_key", "bits"])

    return run


def _keep(ratio: np.ndarray, seed: int, least: int):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_weigh(batch, ratio, seed)[3] >= least))

    return run


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The exact k-th largest long: four counts by 16-bit digits, each of at most 65,536 rows; no sort, and no rows to the driver."""
    prefix = None
    for level in range(4):
        shift = 48 - 16 * level
        left = df if prefix is None else df.where(F.shiftright(F.col(column), shift + 16) == prefix)
        counts = left.groupBy(F.shiftright(F.col(column), shift).alias("digit")).agg(F.count("*").alias("n")).collect()
        for digit, n in sorted(((r["digit"], r["n"]) for r in counts), reverse=True):
            if k <= n:
                prefix = digit
                break
            k -= n
        else:
            return None
    return prefix


def resample(docs: DataFrame, ratio: np.ndarray, k: int | None = None, cutoff: float = 0.0, seed: int = 1) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_terms, log_weight, gumbel_key, selected), one row per input row.

    selected marks the k largest keys log_weight + Gumbel noise. Without k, k is the number of rows whose log weight is
    at least `cutoff` (0: as likely under the target model as under the raw one). The noise comes from a hash of seed,
    doc_id and text, so it repeats. Null, empty and white texts weigh 0; rows that tie with the k-th key (repeated
    rows) are selected together; k of 0 selects none. A null doc_id is kept. Other columns are ignored.
    """
    need(docs, "doc_id", "text")
    scored, least = _threshold(docs, ratio, k, cutoff, seed)
    return scored.select("doc_id", "n_terms", "log_weight", "gumbel_key", (F.col("bits") >= F.lit(least)).alias("selected"))


def _threshold(docs: DataFrame, ratio: np.ndarray, k: int | None, cutoff: float, seed: int) -> tuple[DataFrame, int]:
    """Scores by row, cut, and the smallest long key that is selected."""
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = cut(only.mapInArrow(lean(_score(ratio, seed)), "doc_id long, n_terms long, log_weight double, gumbel_key double, bits long"))
    total, above = scored.agg(F.count("*"), F.count(F.when(F.col("log_weight") >= cutoff, 1))).first()
    k = above if k is None else k
    return scored, 2**63 - 1 if k <= 0 else -(2**63) if k >= total else kth_largest(scored, "bits", k)


def keep_selected(docs: DataFrame, ratio: np.ndarray, k: int | None = None, cutoff: float = 0.0, seed: int = 1) -> DataFrame:
    """The rows of docs, all columns, that resample() selects; they are weighed once more, so that no text is shuffled."""
    need(docs, "doc_id", "text")
    return docs.mapInArrow(lean(_keep(ratio, seed, _threshold(docs, ratio, k, cutoff, seed)[1])), docs.schema)


def select_quality(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """fit() on the labelled target sample and all raw text, then resample()."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    return resample(docs, fit(docs, cut(target_sample(labels))), k)
