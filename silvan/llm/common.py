"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut, drop, drop_since, written  # noqa: F401  for the operators

#: Rows of a lookup's hot part; a key with at least 1/HOT_KEYS of all rows is hot, so no more than this many keys can be.
HOT_KEYS = 1000
#: Bits of a Bloom filter, at most, as a power of two; and the factors that give the two places of an id in it.
BLOOM, _FACTORS = 26, np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Rows that a kernel takes, and sends, at once.
PIECE = 512

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_fold(doc_id, n: int) -> int:
    """fold() for one id in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most PIECE rows; an empty batch stays one."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), PIECE):
            yield batch.slice(at, PIECE)


def release() -> None:
    """Gives memory that is free back to the system. Workers outlive their tasks, beside executors that need the room for joins."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def lean(kernel: Kernel) -> Kernel:
    """kernel, which must not depend on how rows are cut into batches, in little memory: it sees and sends a few rows at a time, so
    what it makes of a batch (texts, sets) never exists for the whole of it, and its worker keeps nothing afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pieces(kernel(pieces(batches)))
        release()

    return run


def lookup(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """left LEFT JOIN right on key, safe when one key holds a large part of left.

    right has one row for each key, with the number of left rows of that key in column `size`. Keys with at
    least 1/HOT_KEYS of the rows (at most HOT_KEYS keys, whatever the data) go by broadcast; the rows that they
    serve get a key of their own in the shuffle join of the rest, so no task gathers them.
    right is read twice: pass a checkpointed frame.
    """
    values = [c for c in right.columns if c != key]
    total = right.agg(F.sum(size)).first()[0] or 0
    bound = max(1, -(-total // HOT_KEYS))
    hot = F.broadcast(right.where(F.col(size) >= bound).select(F.col(key).alias("hot_key"), F.struct(*values).alias("hot_value")))
    cold = right.where(F.col(size) < bound).select(F.col(key).alias("cold_key"), F.struct(*values).alias("cold_value"))
    out = left.join(hot, F.col(key) == F.col("hot_key"), "left")
    # rows that are served, or have no key, would all meet in the task of the null key: they get keys that nothing has
    probe = F.struct(F.when(F.col("hot_value").isNull(), F.col(key)).alias("key"), F.when(F.col("hot_value").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(1 + F.pmod(F.hash(*left.columns), F.lit(1 << 20))).alias("spread"))
    out = out.withColumn("probe", probe).join(cold, (F.col("probe.key") == F.col("cold_key")) & (F.col("probe.spread") == F.lit(0)), "left")
    value = F.coalesce("hot_value", "cold_value")
    return out.select(*left.columns, *[value[v].alias(v) for v in values])


def matched(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """left JOIN right on key, safe when one key holds a large part of left; right is as in lookup(), and left is read twice where keys are hot."""
    found = right.agg(F.sum(size).alias("total"), F.max(size).alias("most")).first()
    bound = max(1, -(-(found.total or 0) // HOT_KEYS))
    hot = right.where(F.col(size) >= bound)
    if (found.most or 0) < bound:
        return left.join(right, key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(size) < bound), key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.view(np.uint64)
    return np.stack([((x ^ (x >> np.uint64(32))) * m >> np.uint64(64 - bits)).astype(np.int64) for m in _FACTORS])


def bloom(ids: DataFrame) -> np.ndarray | None:
    """A Bloom filter of the ids (one column of longs), of bounded size: false hits cost work, never results. None where there
    are too many ids for it, so that at most 2 ** BLOOM / 16 of them meet in its few tasks. ids is read twice."""
    bits = max(18, int(16 * ids.count()).bit_length())
    if bits > BLOOM:
        return None
    width = 1 << 18

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            flags[_places(batch.column(0).to_numpy(), bits).ravel()] = True
        for i in range(len(flags) // width):
            part = flags[i * width : (i + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["part", "flags"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in ids.coalesce(8).mapInArrow(mark, "part long, flags binary").collect():
        out[row.part * width // 8 : (row.part + 1) * width // 8] |= np.frombuffer(row.flags, np.uint8)
    return out


def in_bloom(flags: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids, (8 * len(flags)).bit_length() - 1)
    return ((flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(0)
