"""Training data as blocks: rows of bins, packed by feature, that kernels read as numpy arrays without copying.

A block is one row of a DataFrame: a binary column of bins for each feature, and binary columns of labels, weights,
scores, row keys and queries. Columns are pruned by select() like any others, and blocks are dealt to tasks by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..operators.binning import BinModel

#: Rows to a block, at most, unless a query needs more, and bytes of their features as doubles, of which wide tables have fewer rows.
ROWS, BYTES = 1 << 15, 1 << 27


@dataclass
class Layout:
    """used: features with a column; wide: two bytes to a bin; targets and scores: numbers to a row; query: whether rows belong to
    queries; raw: whether there are columns of the features' values too (for linear leaves)."""

    used: list[int]
    wide: bool
    targets: int
    scores: int
    query: bool
    parts: int = 1
    raw: bool = False

    def bins_column(self, feature: int) -> str:
        return f"bin_{feature}"

    def columns_of(self, features: list[int]) -> list[str]:
        return [self.bins_column(f) for f in features] + [f"raw_{f}" for f in features if self.raw]

    @property
    def extra(self) -> list[str]:
        return ["y", "w", "s", "key", *(["q", "pos"] if self.query else [])]


def build(df: DataFrame, names: list[str], label: str, model: BinModel, weight: str | None, query: str | None, key: str | None, init: str | None, position: str | None, scores: int, order: list[str], raw: bool = False) -> tuple[DataFrame, Layout]:
    """Blocks of df. label may be an array (several targets); init: column of start scores, an array if there are several.

    Rows of a query stay together, in the order of key (or of the columns `order`): their frame is dealt by query. Other
    frames stay as they are dealt.
    """
    used = model.used
    targets = 1
    if df.schema[label].dataType.typeName() == "array":
        targets = scores
    layout = Layout(used, any(model.features[i].bins > 256 for i in used), targets, scores, query is not None, raw=raw)
    array = lambda c: F.col(f"`{c}`") if df.schema[c].dataType.typeName() == "array" else F.array(F.col(f"`{c}`").cast("double"))
    rows = df.select(
        *[F.col(f"`{model.names[i]}`").cast("double").alias(f"x{i}") for i in used],
        array(label).cast("array<double>").alias("y"),
        (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"),
        (array(init).cast("array<double>") if init else F.array(*[F.lit(0.0)] * scores)).alias("s"),
        (F.xxhash64(F.col(f"`{key}`")) if key else F.xxhash64(*[F.col(f"`{n}`") for n in model.names], F.col(f"`{label}`"))).alias("key"),
        *([F.col(f"`{query}`").cast("long").alias("q"), (F.col(f"`{position}`").cast("long") if position else F.lit(-1).cast("long")).alias("pos")] if query else []),
        *[F.col(f"`{o}`").alias(f"order_{i}") for i, o in enumerate(order)],
    )
    if query:
        rows = rows.repartition("q").sortWithinPartitions("q", *[f"order_{i}" for i in range(len(order))])
    rows = rows.drop(*[f"order_{i}" for i in range(len(order))])
    kind, features = np.dtype("<u2" if layout.wide else "u1"), [model.features[i] for i in used]
    columns = layout.columns_of(used) + layout.extra
    schema = StructType([StructField("rows", LongType()), *[StructField(c, BinaryType()) for c in columns]])

    most = max(1024, min(ROWS, BYTES // (8 * max(1, len(used)))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def emit(table: pa.Table) -> pa.RecordBatch:
            n = table.num_rows
            data = [f.to_bins(table[j].to_numpy(zero_copy_only=False)).astype(kind).tobytes() for j, f in enumerate(features)]
            if layout.raw:
                data += [table[j].to_numpy(zero_copy_only=False).astype("<f8").tobytes() for j in range(len(features))]
            at = len(features)
            flat = lambda c: np.ascontiguousarray(c.combine_chunks().values.to_numpy(zero_copy_only=False), "<f8").tobytes()
            data += [flat(table[at]), table[at + 1].to_numpy().astype("<f8").tobytes(), flat(table[at + 2]), table[at + 3].to_numpy().astype("<i8").tobytes()]
            if layout.query:
                data += [table[at + 4].to_numpy().astype("<i8").tobytes(), table[at + 5].to_numpy().astype("<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([d], pa.binary()) for d in data]], ["rows", *columns])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= most:
                table = pa.Table.from_batches(held)
                end = most
                if layout.query:
                    q = table["q"].to_numpy()
                    change = np.flatnonzero(q[1:] != q[:-1]) + 1
                    fit = change[change <= most]
                    if not len(fit):
                        if not len(change):
                            break
                        fit = change[:1]
                    end = int(fit[-1])
                yield emit(table.slice(0, end))
                rest = table.slice(end)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield emit(pa.Table.from_batches(held))

    return rows.mapInArrow(pack, schema), layout


class Block:
    """One block as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int, layout: Layout, features: list[int]):
        get = lambda c: batch.column(c)[row].as_buffer()
        self.n = batch.column("rows")[row].as_py()
        kind = np.dtype("<u2" if layout.wide else "u1")
        self.x = np.stack([np.frombuffer(get(layout.bins_column(f)), kind) for f in features]) if features else np.zeros((0, self.n), kind)
        self.raw = np.stack([np.frombuffer(get(f"raw_{f}"), "<f8") for f in features]) if features and layout.raw else None
        self.y = np.frombuffer(get("y"), "<f8").reshape(self.n, -1)
        self.w = np.frombuffer(get("w"), "<f8")
        self.s = np.frombuffer(get("s"), "<f8").reshape(self.n, -1)
        self.key = np.frombuffer(get("key"), "<i8")
        self.q = np.frombuffer(get("q"), "<i8") if layout.query else None
        self.pos = np.frombuffer(get("pos"), "<i8") if layout.query else None


def run(blocks: DataFrame, layout: Layout, features: list[int], kernel: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The kernel over the blocks of each task. Only the columns of `features` are read."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(Block(batch, i, layout, features) for batch in batches for i in range(batch.num_rows))

    return blocks.select("rows", *layout.columns_of(features), *layout.extra).mapInArrow(body, schema)
