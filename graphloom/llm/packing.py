"""Sequence packing by best-fit decreasing.

Each document's ids are cut into full windows and one rest. Rests are dealt over partitions; within each, in decreasing
length, a segment tree indexed by remaining capacity finds the open window that leaves the least room.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need

WINDOW = 2048
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def tokenizer(name: str):
    """The byte-level BPE of a JSON vocabulary, with its added tokens, from the ranks file beside it, which gives the same ids several times faster."""
    import public_tokenizers
    import tiktoken

    path = Path(name if "/" in name else public_tokenizers.path(name))
    with path.open(encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with path.with_suffix(".tiktoken").open("rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


class OpenWindows:
    """Windows by remaining capacity; best(n) is the tightest that takes n. A segment tree counts the windows below each node."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.held[room].append(window)
            self._add(room, 1)

    def best(self, need: int) -> tuple[int, int] | None:
        """Takes out the open window of the smallest room >= need: climb from the leaf until a right sibling holds one, then descend to its first."""
        tree, at = self.tree, need + self.size
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.held[room].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; lengths must not increase."""
    open_, windows, offsets, made = OpenWindows(capacity), [], [], 0
    for n in lengths:
        found = open_.best(n)
        if found is None:
            room, window = capacity, made
            made += 1
        else:
            room, window = found
        windows.append(window)
        offsets.append(capacity - room)
        open_.put(room - n, window)
    return windows, offsets


def _pieces(vocabulary: str, window: int, end: int, keep_ids: bool):
    def run(batches):
        code = tokenizer(vocabulary)
        serial = 0
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            texts = batch.column(batch.schema.get_field_index("text"))
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(ids, texts, strict=True):
                tokens = np.append(code.encode_to_numpy(text.as_py() or "", allowed_special="all"), np.uint32(end)).astype("<u4")
                for lo in range(0, len(tokens), window):
                    own = tokens[lo : lo + window]
                    serial += 1
                    for column, value in zip(out, (doc, lo, len(own), zlib.crc32(own.tobytes()), len(tokens), serial, own if keep_ids else None), strict=True):
                        column.append(value)
            arrays = [pa.array(x, pa.int64()) for x in out[:6]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "serial"]
            if keep_ids:
                arrays.append(pa.array(out[6], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _pack(window: int):
    def run(batches):
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        length, start = table["length"].to_numpy(), table["start"].to_numpy()
        doc = table["doc_id"].fill_null(-(2**63)).to_numpy()
        order = np.lexsort((table["serial"].to_numpy(), table["ids_crc32"].to_numpy(), start, doc, -length))
        windows, offsets = best_fit(length[order].tolist(), window)
        first = np.int64(TaskContext.get().partitionId()) << 32
        table = table.take(pa.array(order)).drop_columns(["serial"])
        table = table.append_column("sequence_id", pa.array(np.array(windows, np.int64) + first)).append_column("offset", pa.array(np.array(offsets, np.int64)))
        yield from table.to_batches(max_chunksize=10_000)

    return run


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW, end: int = END, keep_ids: bool = False) -> DataFrame:
    """documents(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset.

    A null or empty text is its end id alone; a token that the vocabulary adds, such as `<|endoftext|>`, has its own id in
    a text. Each id of a document lies in exactly one piece; a sequence holds at most
    `window` ids, its pieces' offsets are gapless from 0. Repeated rows are packed each on its own; a null doc_id is
    kept. Other columns are ignored; an empty table gives no rows. Only piece descriptions are shuffled (ids as well with
    keep_ids), dealt by row, so no document or id can fill a partition; a partition's descriptions are packed in memory.
    """
    need(docs, "doc_id", "text")
    schema = SCHEMA + ", serial long" + ", ids array<long>" * keep_ids
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_pieces(vocabulary, window, end, keep_ids)), schema)
    dealt = pieces.repartition(F.xxhash64("doc_id", "start", "serial"))
    return dealt.mapInArrow(lean(_pack(window)), SCHEMA + ", ids array<long>" * keep_ids + ", sequence_id long, offset long")
