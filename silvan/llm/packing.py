"""Packing of tokenised documents into sequences, by first-fit decreasing over a tournament tree."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import lean

LENGTH = 1024
#: Documents to a group. Groups are packed on their own, in one task each.
GROUP = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bins:
    """Bins of one capacity; a tournament tree over the room that each has left finds the first one that an item fits."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.room = np.full(2 * self.leaves, capacity, np.int32).tolist()
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of an item that goes to the first bin with room for it."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        offset = self.capacity - room[at]
        room[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return found, offset


def pack_group(tails: list[int], capacity: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) of each size, placed first-fit in decreasing order; equal sizes keep their order."""
    bins, out = Bins(capacity, len(tails)), [(0, 0)] * len(tails)
    for i in sorted(range(len(tails)), key=lambda i: -tails[i]):
        out[i] = bins.place(tails[i])
    return out


def pack(docs: DataFrame, path: str, ranks: str | None = None, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pieces of the documents (doc_id, text), each in a sequence of at most `length` tokens.

    path: the tokenizer's vocabulary file; ranks: the same vocabulary as a rank file, for quicker merging.
    A document's ids end with id 0, so a null or empty text has one token; an empty table has no pieces. Whole pieces of
    `length` tokens fill sequences of their own; what is left at the end of each document is packed first-fit decreasing
    with that of the other documents of its group. Groups are drawn by a hash of id, content, the task that reads the row and
    how many rows with that id and content it has had, so any source, key, order or number of copies spreads over all of
    them, and a lost executor's work gives the same groups again; their number follows from the number of documents. In
    a group, rows are in the order of id and content, so sequences don't depend on the order of the shuffle. Only
    lengths and checksums are shuffled, never ids. Rows that repeat are packed each on their own; null ids are kept.
    """
    groups = max(1, -(-docs.count() // group))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, copies = bpe.load(path, ranks), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            n, sums, keys = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokens.encode(text or "") + b"\0\0\0\0"
                n.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[at : at + 4 * length]) for at in range(0, len(ids), 4 * length)])
                row = xxhash.xxh64_intdigest(f"{doc_id} {sums[-1]}")
                keys.append(xxhash.xxh64_intdigest(f"{row} {task} {copies[row]}") % groups)
                copies[row] += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["pack_group", "doc_id", "n", "sums"])
        tokens.forget()

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        order = sorted(zip(rows["doc_id"].to_pylist(), rows["n"].to_pylist(), rows["sums"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
        ids, n, sums = zip(*order, strict=True)
        n = np.array(n, np.int64)
        whole, tail = n // length, n % length
        ends = np.flatnonzero(tail)
        spots = np.array(pack_group(tail[ends].tolist(), length), np.int64).reshape(-1, 2)
        used = int(spots[:, 0].max()) + 1 if len(spots) else 0
        doc = np.concatenate([np.repeat(np.arange(len(n)), whole), ends])
        part = np.concatenate([np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole), whole[ends]]).astype(np.int64)
        checks = [sums[d][p] for d, p in zip(doc.tolist(), part.tolist(), strict=True)]
        lengths = np.concatenate([np.full(whole.sum(), length, np.int64), tail[ends]])
        sequences = (key[0].as_py() << 32) + np.concatenate([used + np.arange(whole.sum()), spots[:, 0]])
        offsets = np.concatenate([np.zeros(whole.sum(), np.int64), spots[:, 1]])
        columns = [[ids[d] for d in doc.tolist()], part * length, lengths, checks, n[doc], sequences, offsets]
        return pa.table({name.split()[0]: pa.array(c, pa.int64()) for name, c in zip(PIECES.split(", "), columns, strict=True)})

    cuts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), "pack_group long, doc_id long, n long, sums array<long>")
    return cuts.groupBy("pack_group").applyInArrow(place, PIECES)
