"""Language identification by a byte convolutional network, trained and applied in numpy.

Network: byte embedding, filters of widths 2, 3 and 4, max pooling over a fixed-length window, ReLU, softmax. A document
is cut into windows; its prediction is the mean of their probabilities, weighted by window length. For inference the
embedding and the filters fold into tables over byte pairs, so a filter bank is one or two row gathers per byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as T
from .common import bounded_by_class, id_bucket, lean, need

WINDOW = 192
WIDTHS = (2, 3, 4)
#: Windows that one numpy pass holds, time-major: a pass stays in the processor's cache.
LANES = 96
#: Training sample: documents of each label, chosen by a hash of the id, and windows of each document, spread evenly.
DOCS_PER_LABEL = 500
WINDOWS_PER_DOC = 4
UNKNOWN = "und"


@dataclass
class ByteConvNet:
    """labels, byte embedding (256, d), filters by width (width, d, f), their biases, and the dense layer."""

    labels: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width: a table over byte pairs for each two taps, and one over bytes for an odd last tap."""
        out = []
        for w in self.filters:
            taps = [(self.embedding @ w[k]).astype(np.float32) for k in range(len(w))]
            made = [(taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(taps) - 1, 2)]
            out.append([*made, *([taps[-1]] if len(taps) % 2 else [])])
        return out

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """windows (WINDOW, n) of bytes, time-major -> (n, labels)."""
        steps, n = windows.shape
        single = windows.astype(np.intp)
        pairs = (single[:-1] << 8) | single[1:]
        pooled = []
        for width, bias, parts in zip(WIDTHS, self.biases, tables, strict=True):
            span = steps - width + 1
            total = parts[0][pairs[:span].ravel()]
            for j, table in enumerate(parts[1:], 1):
                at = pairs if len(table) > 256 else single
                total += table[at[2 * j : 2 * j + span].ravel()]
            pooled.append(total.reshape(span, -1).max(0).reshape(n, -1) + bias)
        z = np.maximum(np.concatenate(pooled, 1), 0) @ self.dense + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of every window; the last one of a document may be shorter, none is left out."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[doc] + nth * WINDOW
    return start, np.minimum(WINDOW, offsets[doc + 1] - start), doc


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Windows as a (WINDOW, n) byte array; zero bytes follow a shorter one."""
    at = np.arange(WINDOW)[:, None]
    return np.where(at < length, data[np.minimum(start + at, len(data) - 1)], 0).astype(np.uint8)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = 6, d: int = 8, f: int = 12, seed: int = 5) -> ByteConvNet:
    """Adam on cross-entropy; windows (n, WINDOW) bytes. Gradients flow through the pooled positions only."""
    rng = np.random.default_rng(seed)
    net = ByteConvNet(names, rng.normal(0, 0.5, (256, d)), [rng.normal(0, 1 / np.sqrt(w * d), (w, d, f)) for w in WIDTHS], [np.zeros(f) for _ in WIDTHS], rng.normal(0, 0.1, (f * len(WIDTHS), len(names))), np.zeros(len(names)))
    net.embedding[0] = 0
    params = [net.embedding, *net.filters, *net.biases, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 64):
            own = order[lo : lo + 64]
            x, y, n = windows[own].astype(np.intp), labels[own], len(own)
            e = net.embedding[x]
            pooled, where = [], []
            for w, b in zip(net.filters, net.biases, strict=True):
                span = WINDOW - len(w) + 1
                z = sum(e[:, k : k + span] @ w[k] for k in range(len(w)))
                at = z.argmax(1)
                where.append(at)
                pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + b)
            h = np.concatenate(pooled, 1)
            a = np.maximum(h, 0)
            z = a @ net.dense + net.offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            back = (p @ net.dense.T) * (h > 0)
            grads = [np.zeros_like(net.embedding)]
            bias_grads = []
            for i, w in enumerate(net.filters):
                g = back[:, i * f : (i + 1) * f]
                gw = np.zeros_like(w)
                for k in range(len(w)):
                    byte = np.take_along_axis(x, where[i] + k, 1)
                    gw[k] = np.einsum("nfd,nf->df", net.embedding[byte], g)
                    np.add.at(grads[0], byte.ravel(), (g[:, :, None] * w[k].T[None]).reshape(-1, d))
                grads.append(gw)
                bias_grads.append(g.sum(0))
            grads[0][0] = 0
            grads += [*bias_grads, a.T @ p, p.sum(0)]
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _sample_windows(batches):
    for batch in batches:
        data, offsets = T.buffer_of(T.column(batch, "text"))
        start, length, doc = cut_windows(data, offsets)
        counts = np.bincount(doc, minlength=len(offsets) - 1)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        every = np.maximum(1, -(-counts // WINDOWS_PER_DOC))
        keep = (nth % every[doc] == 0) & (length >= 4) if len(doc) else np.zeros(0, bool)
        start, length, doc = start[keep], length[keep], doc[keep]
        block = gather(data, start, length).T if len(start) else np.zeros((0, WINDOW), np.uint8)
        lang = batch.column(batch.schema.get_field_index("lang"))
        yield pa.RecordBatch.from_arrays([lang.take(pa.array(doc)), pa.array([bytes(x) for x in block], pa.binary())], ["lang", "bytes"])


def fit(docs: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> ByteConvNet | None:
    """Trains on documents whose fold (crc32 of the id, modulo 4) is not 2 and whose lang is set: about docs_per_label of each label (the bound). None without any."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("doc_id").isNull() | (id_bucket("doc_id", 4) != 2))).select("doc_id", "text", "lang")
    rows = bounded_by_class(own, "doc_id", "lang", docs_per_label).select("text", "lang").mapInArrow(lean(_sample_windows), "lang string, bytes binary").toArrow()
    if not rows.num_rows:
        return None
    lang = rows["lang"].to_pylist()
    names = sorted(set(lang))
    place = {x: i for i, x in enumerate(names)}
    found = sorted(zip(lang, rows["bytes"].to_pylist(), strict=True))  # rows come in any order; training must not depend on it
    windows = np.frombuffer(b"".join(x for _, x in found), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([place[x] for x, _ in found]), names)


def _labels(net: ByteConvNet | None, tables: list, batch: pa.RecordBatch, flag: str) -> tuple[list[str], np.ndarray]:
    """Label and score of each text of a batch; flag: the column that says whether a text has a letter."""
    data, offsets = T.buffer_of(T.column(batch, "text"))
    n = len(offsets) - 1
    names, score = [UNKNOWN] * n, np.zeros(n)
    letters = batch.column(batch.schema.get_field_index(flag)).to_numpy(zero_copy_only=False)
    if net and len(data):
        start, length, doc = cut_windows(data, offsets)
        total = np.zeros((n, len(net.labels)))
        for lo in range(0, len(start), LANES):
            part = slice(lo, lo + LANES)
            p = net.probabilities(gather(data, start[part], length[part]), tables) * length[part, None]
            begins = np.flatnonzero(np.diff(doc[part], prepend=-1))
            total[doc[part][begins]] += np.add.reduceat(p, begins, axis=0)
        total /= np.maximum(1, np.diff(offsets))[:, None]
        best = total.argmax(1)
        for i in np.flatnonzero(letters):
            names[i], score[i] = net.labels[best[i]], min(1.0, total[i, best[i]])
    return names, score


def _predict(net: ByteConvNet | None):
    def run(batches):
        tables = net.tables() if net else []
        for batch in batches:
            names, score = _labels(net, tables, batch, "has_letter")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _identified(net: ByteConvNet | None, flag: str, least: float):
    """The rows whose language is told well enough, without the flag."""

    def run(batches):
        tables = net.tables() if net else []
        for batch in batches:
            names, score = _labels(net, tables, batch, flag)
            yield batch.drop_columns([flag]).filter(pa.array((np.array(names, object) != UNKNOWN) & (score >= least)))

    return run


def _has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, lang_pred, score), one row per input row.

    Null text, and text without a letter, is `und` with score 0; so is every row where nothing could be learned. Ties go
    to the first label in order. A null doc_id is kept (held_out false). Other columns are ignored.
    """
    need(docs, "doc_id", "text")
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text", _has_letter().alias("has_letter"))
    return ready.mapInArrow(lean(_predict(net)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteConvNet | None, least: float) -> DataFrame:
    """The rows of docs, all columns, whose language is predicted with a score of at least `least`: one pass, no join."""
    need(docs, "text")
    flag = "has_letter"
    while flag in docs.columns:
        flag += "_"
    return docs.select("*", _has_letter().alias(flag)).mapInArrow(lean(_identified(net, flag, least)), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """fit() and predict() on the same table: documents(doc_id, text, lang)."""
    need(docs, "doc_id", "text", "lang")
    return predict(docs, fit(docs))
