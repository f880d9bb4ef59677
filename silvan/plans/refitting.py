"""Refitting: new leaf values for the trees of a model, from other data."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranking
from ..operators.splits import output
from .boosting import Gradients
from .dataset import GbtDataset, to_frame
from .model import GbtModel
from .shared import cut, drop
from .tree import Tree

#: Iterations after which scores are written.
REFRESH = 8


def refit(model: GbtModel, data: Any, decay: float) -> GbtModel:
    """One job for each iteration sums gradients and hessians by leaf; rows are read with the scores of the trees refitted so far.
    These are written to the shared folder every REFRESH iterations, so that no tree is evaluated more often (queries, which must
    stay together, are read anew instead).

    A leaf becomes decay * old + (1 - decay) * rate * new; leaves without rows keep their value.
    """
    ds = data if isinstance(data, GbtDataset) else GbtDataset(to_frame(data), features=model.features, params=model.params)
    p, k, width = model.params, model.k, len(model.features)
    out = copy.deepcopy(model)
    gradients = Gradients(p, ranking.gains_of(p))
    roles = [ds.label, *([ds.weight] if ds.weight else []), *([ds.group] if ds.group else [])]
    frame = ds.df.select(*[f"`{f}`" for f in model.features], *dict.fromkeys(roles))
    if ds.group:
        frame = ds.df.select(*[f"`{f}`" for f in model.features], *dict.fromkeys([*roles, *ds.order])).repartition(ds.group).sortWithinPartitions(ds.group, *ds.order)
    row_key = F.xxhash64(F.col(f"`{ds.row_key}`")) if ds.row_key else F.xxhash64(*[F.col(f"`{f}`") for f in model.features], F.col(f"`{ds.label}`"))
    own = ds.df.select(*[f"`{f}`" for f in model.features], *dict.fromkeys(roles), row_key.alias("refit_key"), F.array(*[F.lit(0.0)] * k).alias("refit_score")) if not ds.group else frame
    frame, label_weight, ranked, since = own.persist(), ds.weight, ds.group, 0
    for i in range(0, len(out.trees), k):
        if not ranked and i - since >= REFRESH * k:
            frame, since = _rescored(frame, out.trees[since:i], k, width), i
        before, now = out.trees[since:i], out.trees[i : i + k]
        handle = frame.sparkSession.sparkContext.broadcast((before, now))

        def sums(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            before, now = handle.value
            total = [np.zeros((t.leaves, 3)) for t in now]
            # a query may lie in several batches, so ranked data is taken a partition at a time
            for batch in (_whole(batches) if ranked else batches):
                if not batch.num_rows:
                    continue
                x = np.column_stack([np.asarray(batch.column(j).to_pandas(), np.float64) for j in range(width)])
                y = np.asarray(batch.column(width).to_pandas().tolist(), np.float64).reshape(len(x), -1)
                w = np.asarray(batch.column(label_weight).to_pandas(), np.float64) if label_weight else np.ones(len(x))
                q = np.asarray(batch.column(ranked).to_pandas(), np.int64) if ranked else None
                score = np.zeros((len(x), k)) if ranked else np.array(batch.column("refit_score").to_pandas().tolist(), np.float64)
                for j, t in enumerate(before):
                    score[:, j % k] += t.output(x)
                g, h = gradients(_Rows(y, w, q, None if ranked else batch.column("refit_key").to_numpy()), score)
                for j, t in enumerate(now):
                    leaf = t.leaf_of(x)
                    total[j] += np.stack([np.bincount(leaf, g[:, j], t.leaves), np.bincount(leaf, h[:, j], t.leaves), np.bincount(leaf, minlength=t.leaves)], 1)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(total).tobytes()], pa.binary())], ["sums"])

        found = np.sum([np.frombuffer(r.sums).reshape(-1, 3) for r in frame.mapInArrow(sums, "sums binary").collect()], axis=0)
        at = 0
        for t in now:
            part = found[at : at + t.leaves]
            at += t.leaves
            new = output(part[:, 0], part[:, 1], p, p.lambda_l2) * t.shrinkage
            old = np.array(t.leaf_value)
            t.leaf_value = np.where(part[:, 2] > 0, decay * old + (1 - decay) * np.nan_to_num(new), old).tolist()
            t.leaf_count = part[:, 2].astype(int).tolist()
    frame.unpersist()
    drop(frame)
    return out


def _rescored(frame: DataFrame, trees: list[Tree], k: int, width: int) -> DataFrame:
    """The rows with the outputs of trees added to their scores, written in place of the last ones."""
    handle = frame.sparkSession.sparkContext.broadcast(trees)
    at = frame.columns.index("refit_score")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(j).to_pandas(), np.float64) for j in range(width)])
            score = np.array(batch.column(at).to_pandas().tolist(), np.float64).reshape(len(x), k)
            for j, t in enumerate(handle.value):
                score[:, j % k] += t.output(x)
            columns = list(batch.columns)
            columns[at] = pa.array(score.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = cut(frame.mapInArrow(add, frame.schema))
    frame.unpersist()
    drop(frame)
    return out.persist()


def _whole(batches: Iterator[pa.RecordBatch]) -> list[pa.Table]:
    held = list(batches)
    return [pa.Table.from_batches(held)] if held else []


class _Rows:
    """Rows as gradients read them."""

    def __init__(self, y: np.ndarray, w: np.ndarray, q: np.ndarray | None, key: np.ndarray | None):
        self.y, self.w, self.q, self.n, self.pos = y, w, q, len(y), None
        self.key = np.arange(len(y)) if key is None else key
