"""Random-access batches as a Spark data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


class Sequence:
    """What a user implements: length, and rows of a slice as an array [rows, features]."""

    batch_size = 4096

    def __len__(self) -> int:
        raise NotImplementedError

    def __getitem__(self, rows: slice | int) -> np.ndarray:
        raise NotImplementedError


def read_sequences(spark: SparkSession, sequences: list[Any], names: list[str], label: np.ndarray | None = None) -> DataFrame:
    """Rows of the sequences, one below the other. Batches are read by tasks: only their numbers are dealt out."""
    jobs = [(i, at, min(at + s.batch_size, len(s)), sum(len(x) for x in sequences[:i])) for i, s in enumerate(sequences) for at in range(0, len(s), s.batch_size)]
    columns = [*names, *(["label"] if label is not None else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, a, b, base in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                x = np.asarray(sequences[i][a:b], np.float64).reshape(b - a, -1)
                data = [pa.array(np.ascontiguousarray(x[:, j])) for j in range(x.shape[1])]
                if label is not None:
                    data.append(pa.array(np.asarray(label[base + a : base + b], np.float64)))
                yield pa.RecordBatch.from_arrays(data, columns)

    plan = spark.createDataFrame(jobs, "part int, first long, end long, base long").repartition(max(1, min(len(jobs), 64)))
    return plan.mapInArrow(read, ", ".join(f"`{c}` double" for c in columns))


def read_rows(spark: SparkSession, count: int, row: Callable[[int], list[tuple[int, float]]], width: int) -> DataFrame:
    """Dense rows of a callback that yields the (index, value) pairs of a row, called by tasks."""
    names = [f"Column_{i}" for i in range(width)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, width))
            for at, i in enumerate(batch.column(0).to_pylist()):
                for j, v in row(i):
                    x[at, j] = v
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, j])) for j in range(width)], names)

    return spark.range(count).mapInArrow(read, ", ".join(f"{n} double" for n in names))
