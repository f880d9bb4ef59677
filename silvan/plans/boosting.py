"""Boosting: gradient boosting, random forests and dropout trees over blocks, with sampling, evaluation and early stopping."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws, ranking
from ..functions.backend import NumpyOps
from ..functions.objectives import OBJECTIVES, softmax_grad, start_value
from ..operators import metrics
from ..operators.splits import Scanner, output
from ..params import Params, metrics_of, resolve
from .blocks import Block, Layout, run
from .dataset import GbtDataset
from .grower import Constraints, Nodes, TreeJob, grow, read_forced_splits
from .model import GbtModel
from .shared import cut, drop
from .tree import Tree

RANKING = ("lambdarank", "rank_xendcg")
#: Counters that a task holds while percentiles of all leaves are looked for.
COUNTERS = 1 << 22


@dataclass
class Gradients:
    """Gradients and hessians of a block from its scores; what a kernel carries along."""

    p: Params
    gain: np.ndarray
    bias: dict[int, float] = field(default_factory=dict)
    iteration: int = 0

    def __call__(self, block: Block, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, y, w = self.p, block.y, block.w
        if callable(p.objective):
            g, h = p.objective(score, SimpleNamespace(label=y, weight=w, query=block.q))
            return np.asarray(g, float).reshape(score.shape), np.asarray(h, float).reshape(score.shape)
        if p.objective == "multiclass":
            return softmax_grad(score, y[:, 0], w)
        if p.objective == "multiclassova":
            parts = [OBJECTIVES["binary"].grad(NumpyOps, score[:, k], (y[:, 0] == k).astype(float), w, p) for k in range(score.shape[1])]
            return np.stack([g for g, _ in parts], 1), np.stack([h for _, h in parts], 1)
        if p.objective == "multi_regression":
            return (score - y) * w[:, None], np.repeat(w[:, None], score.shape[1], 1)
        if p.objective in RANKING:
            g, h = np.zeros(block.n), np.zeros(block.n)
            draw = draws.uniform(block.key, p.objective_seed, self.iteration) if p.objective == "rank_xendcg" else None
            for rows in ranking.by_length(block.q, p.lambdarank_truncation_level):
                if draw is None:
                    bias = np.vectorize(lambda k: self.bias.get(int(k), 0.0), otypes=[float])(block.pos[rows]) if self.bias else None
                    g[rows], h[rows] = ranking.lambda_gradients(score[rows, 0], y[rows, 0], p, self.gain, bias)
                else:
                    g[rows], h[rows] = ranking.xendcg_gradients(score[rows, 0], y[rows, 0], draw[rows])
            return (g * w)[:, None], (h * w)[:, None]
        target = NumpyOps.sign(y[:, 0]) * np.sqrt(np.abs(y[:, 0])) if p.reg_sqrt else y[:, 0]
        weight = 1.0 if p.objective == "cross_entropy_lambda" and (w == 1).all() else w
        g, h = OBJECTIVES[p.objective].grad(NumpyOps, score[:, 0], target, weight, p)
        return g[:, None], h[:, None]


@dataclass
class Pending:
    """Trees of which blocks don't hold the output yet: (column of the score, tree over bins, factor), and features in the tables' order."""

    features: list[int]
    trees: list[tuple[int, Nodes, float]] = field(default_factory=list)
    start: np.ndarray | None = None

    def scores(self, block: Block) -> np.ndarray:
        out = block.s + (self.start if self.start is not None else 0.0)
        for column, nodes, factor in self.trees:
            out[:, column] += factor * nodes.output(block)
        return out


@dataclass
class Sampling:
    """Which rows of a block take part in an iteration, and what their gradients are multiplied by."""

    p: Params
    iteration: int = 0
    threshold: float | None = None
    rest: float = 0.0
    factor: float = 1.0

    def __call__(self, block: Block, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        p = self.p
        if self.threshold is not None:
            size = np.abs(g * h).sum(1)
            top = size >= self.threshold
            some = ~top & (draws.uniform(block.key, p.bagging_seed, self.iteration) < self.rest)
            scale = np.where(some, self.factor, 1.0)[:, None]
            return g * scale, h * scale, np.flatnonzero(top | some)
        if p.bagging_freq <= 0 or p.data_sample_strategy == "goss":
            return g, h, None
        turn = self.iteration // p.bagging_freq
        key = block.q if p.bagging_by_query and block.q is not None else block.key
        u = draws.uniform(key, p.bagging_seed, turn)
        if p.pos_bagging_fraction < 1 or p.neg_bagging_fraction < 1:
            return g, h, np.flatnonzero(u < np.where(block.y[:, 0] > 0, p.pos_bagging_fraction, p.neg_bagging_fraction))
        return (g, h, np.flatnonzero(u < p.bagging_fraction)) if p.bagging_fraction < 1 else (g, h, None)


@dataclass
class Steps:
    """Gradients and hessians as whole numbers of steps; a step is the same for all rows of an iteration's class.

    Rounding is to the nearest, or up with the probability of what is left over, by a draw of the row's key.
    """

    g: np.ndarray
    h: np.ndarray
    salts: tuple[int, int] | None = None

    def __call__(self, block: Block, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = 0.5 if self.salts is None else draws.uniform(block.key, *self.salts)[:, None]
        near = lambda x, step: np.sign(x) * np.floor(np.abs(x) / np.where(step > 0, step, 1.0) + u) * step
        return near(g, self.g), near(h, self.h)


class Booster:
    """Trains on a dataset, one iteration with each update()."""

    def __init__(self, params: dict | Params, train: GbtDataset, init_model: GbtModel | None = None):
        self.p = resolve(params)
        self.train = train
        if train.params != self.p and train._bins is None:
            train.params = self.p
        p = self.p
        self.k = p.trees_per_iteration
        self.bins = train.bins
        self.blocks, self.layout = train.blocks(self.k, bool(p.linear_tree))
        self.used = self.layout.used
        self.valid: list[tuple[str, GbtDataset, DataFrame, Layout, Pending]] = []
        self.constraints = Constraints.read(p.interaction_constraints, train.features)
        self.forced = read_forced_splits(p.forcedsplits_filename)
        self.spent = np.zeros(len(train.features), bool)
        self.stats = self._statistics()
        if p.objective == "binary":
            pos, neg = self.stats["w_pos"], self.stats["w"] - self.stats["w_pos"]
            weights = (1.0, p.scale_pos_weight)
            if p.is_unbalance and pos > 0 and neg > 0:
                weights = (pos / neg, 1.0) if pos > neg else (1.0, neg / pos)
            self.p = p = p.with_(label_weights=weights)
        self.gradients = Gradients(p, ranking.gains_of(p))
        self.start = self._start()
        self.model = GbtModel([], p, train.features, self.k, self.bins)
        self.pending = Pending(self.used, start=np.zeros(self.k) if init_model is None else None)
        self.base = np.zeros(self.k)
        self.tables: list[list[Nodes]] = []
        self.factors: list[list[float]] = []
        self.stopped = False
        self.init_model = init_model
        self.history: dict[str, dict[str, list[float]]] = {}
        if p.boosting != "rf":
            self.pending.start = self.start.copy() if init_model is None else np.zeros(self.k)

    # -- statistics of the label -------------------------------------------------------------------------------------

    def _statistics(self) -> dict[str, Any]:
        """Weighted sums of the label, from one job: each task gives one row."""
        k, objective = self.k, self.p.objective

        def kernel(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(3 + 2 * max(k, 1))
            for b in parts:
                y = np.sign(b.y) * np.sqrt(np.abs(b.y)) if self_sqrt else b.y
                total[0] += b.n
                total[1] += b.w.sum()
                total[2] += b.w[b.y[:, 0] > 0].sum()
                if objective in ("multiclass", "multiclassova"):
                    total[3 : 3 + k] += np.bincount(b.y[:, 0].astype(int), b.w, k)[:k]
                else:
                    total[3 : 3 + y.shape[1]] += (y * b.w[:, None]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        self_sqrt = self.p.reg_sqrt
        total = np.sum([np.frombuffer(r.sums) for r in run(self.blocks, self.layout, [], kernel, "sums binary").collect()], axis=0)
        return {"n": int(total[0]), "w": float(total[1]), "w_pos": float(total[2]), "sums": total[3 : 3 + max(k, 1)]}

    def _start(self) -> np.ndarray:
        """Start value of each score; rows that bring start scores of their own begin with those."""
        p, s = self.p, self.stats
        out = np.zeros(self.k)
        if self.train.init_score:
            return out
        if callable(p.objective) or p.objective in (*RANKING, "custom") or not p.boost_from_average or not s["w"]:
            return out
        if p.objective == "multiclass":
            return np.log(np.clip(s["sums"] / s["w"], 1e-15, None))
        if p.objective == "multiclassova":
            return np.array([start_value("log_odds", x / s["w"], p.sigmoid) for x in s["sums"]])
        if p.objective == "multi_regression":
            return s["sums"] / s["w"]
        kind = OBJECTIVES[p.objective].start
        if kind in ("median", "alpha", "mape_median"):
            alpha = p.alpha if kind == "alpha" else 0.5
            weight = self._renew_weight()
            out[0] = self._percentiles(lambda b: (b.y[:, 0], weight(b)), None, 1, alpha)[0]
        elif kind == "log_odds":
            out[0] = start_value(kind, s["w_pos"] / s["w"], p.sigmoid)
        else:
            out[0] = start_value(kind, s["sums"][0] / s["w"], p.sigmoid)
        return out

    def _renew_weight(self) -> Callable[[Block], np.ndarray | None]:
        if self.p.objective == "mape":
            return lambda b: b.w / np.maximum(1.0, np.abs(b.y[:, 0]))
        return (lambda b: b.w) if self.train.weight else (lambda b: None)

    def _percentiles(self, value: Callable, group: Callable | None, groups: int, alpha: float) -> np.ndarray:
        """Exact percentile of each group, without moving rows.

        Doubles are put in the order of 64-bit integers and found some bits at a time: each pass counts, for each
        group, the rows (or their weights) that share the bits found so far. value(block) gives values and weights (or None).
        """
        totals, is_weighted = self._totals(value, group, groups)
        if not is_weighted:
            at = (totals - 1) * alpha
            low, high = np.floor(at), np.ceil(at)
            a = self._select(value, group, groups, np.maximum(low, 0))
            b = self._select(value, group, groups, np.maximum(high, 0))
            return np.where(totals > 0, a + (at - low) * (b - a), 0.0)
        target = totals * alpha
        return np.where(totals > 0, self._between(value, group, groups, target, self._select(value, group, groups, target)), 0.0)

    def _grouped(self, value: Callable, group: Callable | None) -> tuple[Callable, list[int]]:
        def rows(b: Block):
            v, w = value(b)
            return np.ascontiguousarray(v), w, (group(b) if group is not None else np.zeros(b.n, np.int64))

        return rows, self.used if group is not None else []

    def _totals(self, value: Callable, group: Callable | None, groups: int) -> tuple[np.ndarray, bool]:
        """Rows, or their weights, of each group, and whether there are weights."""
        rows, features = self._grouped(value, group)

        def total(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            out, seen = np.zeros(groups), False
            for b in parts:
                _, w, at = rows(b)
                seen = seen or w is not None
                out += np.bincount(at, w, groups)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([seen])], ["sums", "weighted"])

        found = run(self.blocks, self.layout, features, total, "sums binary, weighted boolean").collect()
        return np.sum([np.frombuffer(r.sums) for r in found], axis=0), any(r.weighted for r in found)

    def _select(self, value: Callable, group: Callable | None, groups: int, target: np.ndarray) -> np.ndarray:
        """The first value of each group at which the running rows (or weights) are above its target."""
        rows, features = self._grouped(value, group)
        # counters of a task: groups << step, whatever the groups
        step = max(4, min(16, COUNTERS.bit_length() - 1 - max(0, groups - 1).bit_length()))

        def keys(v: np.ndarray) -> np.ndarray:
            bits = (v + 0.0).view(np.uint64)
            return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))

        prefix, left, known = np.zeros(groups, np.uint64), target.copy(), 0
        while known < 64:
            width = min(step, 64 - known)
            shift = 64 - known - width

            def count(parts: Iterator[Block], shift=shift, width=width, prefix=prefix, known=known) -> Iterator[pa.RecordBatch]:
                out = np.zeros(groups << width)
                for b in parts:
                    v, w, at = rows(b)
                    key = keys(v)
                    same = (key >> np.uint64(64 - known)) == prefix[at] if known else np.ones(len(key), bool)
                    digit = ((key >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    out += np.bincount(((at.astype(np.int64) << width) + digit)[same], None if w is None else w[same], groups << width)
                place = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(out[place])], ["place", "sums"])

            # sparse counts are combined by place before they reach the driver
            found = run(self.blocks, self.layout, features, count, "place long, sums double").groupBy("place").agg(F.sum("sums").alias("sums")).toArrow()
            sums = np.zeros(groups << width)
            sums[found["place"].to_numpy()] = found["sums"].to_numpy()
            sums = sums.reshape(groups, -1)
            run_sum = np.cumsum(sums, 1)
            # never past the last digit that is there
            last = sums.shape[1] - 1 - (sums[:, ::-1] != 0).argmax(1)
            digit = np.minimum((run_sum <= left[:, None]).sum(1), np.where(sums.any(1), last, 0))
            left = left - np.where(digit > 0, run_sum[np.arange(groups), np.maximum(digit - 1, 0)], 0.0)
            prefix = (prefix << np.uint64(width)) | digit.astype(np.uint64)
            known += width
        bits = np.where(prefix >> np.uint64(63), prefix & np.uint64((1 << 63) - 1), ~prefix)
        return bits.view(np.float64)

    def _between(self, value: Callable, group: Callable | None, groups: int, target: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Weighted percentiles from the values `at` which running weights pass their targets: the point between such a value and
        the one before it, in proportion, if the row that passes has a weight of 1 or more, else the one before. The first
        and the last row of a group stand for themselves; of equal values the row with the smallest key comes first."""
        rows, features = self._grouped(value, group)

        def around(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                v, w, g = rows(b)
                lower, equal = v < at[g], v == at[g]
                before = np.full(groups, -np.inf)
                np.maximum.at(before, g[lower], v[lower])
                order = np.flatnonzero(equal)[np.lexsort((b.key[equal], g[equal]))]
                first = order[np.append(True, g[order][1:] != g[order][:-1])] if len(order) else order
                key, weight = np.full(groups, np.iinfo(np.int64).max), np.zeros(groups)
                key[g[first]], weight[g[first]] = b.key[first].astype(np.int64), w[first]
                counts = [np.bincount(g[mask], minlength=groups).astype(np.int64) for mask in (equal, v > at[g])]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups)), pa.array(before), pa.array(np.bincount(g[lower], w[lower], groups)), pa.array(key), pa.array(weight), *map(pa.array, counts)], ["place", "before", "weight_before", "key", "weight", "equal", "above"])

        schema = "place long, before double, weight_before double, key long, weight double, equal long, above long"
        found = run(self.blocks, self.layout, features, around, schema).groupBy("place").agg(F.max("before").alias("before"), F.sum("weight_before").alias("base"), F.min(F.struct("key", "weight")).alias("first"), F.sum("equal").alias("equal"), F.sum("above").alias("above"))
        out = at.copy()
        for r in found.collect():
            inner = r.before > -np.inf and not (r.equal == 1 and r.above == 0)
            if inner and target[r.place] < r.base + r.first.weight:
                share = (target[r.place] - r.base) / r.first.weight if r.first.weight >= 1.0 else 0.0
                out[r.place] = r.before + share * (at[r.place] - r.before)
        return out

    # -- one iteration -----------------------------------------------------------------------------------------------

    def _goss(self, iteration: int) -> Sampling:
        """Threshold of the rows with the greatest gradients, and the share of the others."""
        p = self.p
        out = Sampling(p, iteration)
        if p.data_sample_strategy != "goss" or iteration < 1 / p.learning_rate:
            return out
        gradients, pending = self.gradients, self.pending
        top, other = max(1, int(self.stats["n"] * p.top_rate)), max(1, int(self.stats["n"] * p.other_rate))

        def size(b: Block):
            g, h = gradients(b, pending.scores(b))
            return np.abs(g * h).sum(1), None

        whole = self._select(size, lambda b: np.zeros(b.n, np.int64), 1, np.array([float(self.stats["n"] - top)]))[0]
        out.threshold, out.rest, out.factor = float(whole), other / max(1, self.stats["n"] - top), (self.stats["n"] - top) / other
        return out

    def _columns(self, iteration: int) -> list[int]:
        """Features of an iteration's trees."""
        p, n = self.p, len(self.used)
        if p.feature_fraction >= 1 or not n:
            return self.used
        take = max(min(1, n), int(n * p.feature_fraction + 0.5))
        pick = np.random.default_rng([p.feature_fraction_seed, iteration]).permutation(n)[:take]
        return [self.used[i] for i in sorted(pick.tolist())]

    def update(self) -> bool:
        """One iteration; True if no tree could be split, which ends training."""
        p, iteration = self.p, len(self.model.trees) // self.k
        dropped = self._drop(iteration) if p.boosting == "dart" else []
        self.gradients.iteration = iteration
        sampling = self._goss(iteration)
        sampling.iteration = iteration
        columns = self._columns(iteration)
        gradients = self.gradients
        # blocks give all used features when trees wait to be added, else the sampled ones only
        pending = self.pending if p.boosting != "rf" else Pending(self.used, start=self.start)
        # stacked features are the tables' order
        places = np.array([self.used.index(c) for c in columns], np.int64)
        everything = bool(pending.trees)

        def whole(block: Block):
            return sampling(block, *gradients(block, pending.scores(block)))

        steps = self._steps(whole, iteration) if p.use_quantized_grad else None

        def prepare(block: Block):
            g, h, rows = whole(block)
            if everything:
                block.x = block.x[places]
            return (g, h, rows) if steps is None else (*steps(block, g, h), rows)

        scanner = Scanner([self.bins.features[f] for f in columns], columns, p)
        jobs = [TreeJob(k, scanner, columns, p, p.extra_seed + iteration, self.constraints.groups, self.forced, self.spent) for k in range(self.k) if self._trains(k)]
        grown = grow(self.blocks, self.layout, self.bins, jobs, columns, prepare, self.used if everything else None)
        trees: list[Tree] = []
        tables: list[Nodes] = []
        by = {j.tree: r for j, r in zip(jobs, grown, strict=True)}
        for k in range(self.k):
            tree, nodes = by.get(k, (Tree(), Nodes(np.zeros(0, np.int64), np.zeros((0, 1), bool), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1))))
            if len(nodes.feature):
                nodes.feature = places[nodes.feature]
                self.spent[[c for c in tree.feature]] = True
            trees.append(tree)
            tables.append(nodes)
        split = any(t.leaves > 1 for t in trees)
        if not split:
            for t, n in zip(trees, tables, strict=True):
                t.leaf_value, n.value = [0.0], np.zeros(1)
            if not iteration:
                for k, t in enumerate(trees):
                    t.shift(float(self.start[k]) if self.init_model is None else 0.0)
                self._append(trees, tables, [0.0] * self.k)
            self._restore(dropped)
            self.stopped = True
            return True
        for k, (tree, nodes) in enumerate(zip(trees, tables, strict=True)):
            if tree.leaves > 1:
                if not callable(p.objective) and p.objective in OBJECTIVES and OBJECTIVES[p.objective].renew:
                    self._renew(tree, nodes, k, pending)
                elif steps is not None and p.quant_train_renew_leaf:
                    self._exact_leaves(tree, nodes, k, whole)
                if p.linear_tree and iteration:
                    self._linear(tree, nodes, k, prepare, columns)
        rate = 1.0 if p.boosting == "rf" else p.learning_rate
        if p.boosting == "dart":
            rate = self._normalise(dropped, rate)
        for k, (tree, nodes) in enumerate(zip(trees, tables, strict=True)):
            if tree.leaves > 1:
                tree.scale(rate)
                nodes.value = np.array(tree.leaf_value)
                if tree.leaf_const is not None:
                    nodes.linear = np.array(tree.leaf_const), [[self.used.index(f) for f in fs] for fs in tree.leaf_features], tree.leaf_coeff
            else:
                tree.leaf_value, nodes.value = [0.0], np.zeros(1)
        for tree in trees:
            if not np.isfinite(tree.leaf_value).all():
                raise FloatingPointError(f"iteration {iteration} gave a leaf output that isn't finite; lower learning_rate, regularise more, or look for extreme labels")
        self._append(trees, tables, [1.0] * self.k)
        bias = self.start if p.boosting == "rf" or (iteration == 0 and self.init_model is None) else None
        if bias is not None:
            for k, tree in enumerate(trees):
                tree.shift(float(bias[k]))
        if p.objective == "lambdarank" and self.train.position:
            self._position_bias()
        if len(self.pending.trees) >= p.refresh * self.k and p.boosting != "dart":
            self.refresh()
        return False

    def _trains(self, k: int) -> bool:
        """A class that no row, or every row, has is not trained."""
        if self.p.objective not in ("multiclass", "multiclassova"):
            return True
        share = self.stats["sums"][k] / self.stats["w"]
        return 1e-15 < share < 1 - 1e-15

    def _append(self, trees: list[Tree], tables: list[Nodes], factors: list[float]) -> None:
        self.model.trees += trees
        self.tables.append(tables)
        self.factors.append(list(factors))
        if self.p.boosting == "rf":
            return
        for k, nodes in enumerate(tables):
            if len(nodes.feature) or nodes.value[0]:
                self.pending.trees.append((k, nodes, 1.0))
        for *_, pending in self.valid:
            pending.trees += [(k, n, 1.0) for k, n in enumerate(tables)]

    def _renew(self, tree: Tree, nodes: Nodes, k: int, pending: Pending) -> None:
        """Leaf values become percentiles of their rows' residuals."""
        p = self.p
        alpha = p.alpha if OBJECTIVES[p.objective].renew == "alpha" else 0.5
        weight = self._renew_weight()
        values = self._percentiles(lambda b: (b.y[:, 0] - pending.scores(b)[:, k], weight(b)), lambda b: nodes.leaf_of(b.x), tree.leaves, alpha)
        tree.leaf_value, nodes.value = values.tolist(), values

    def _steps(self, prepare: Callable, iteration: int) -> Steps:
        """What a step of the gradients and hessians is worth: the greatest gradient is half as many steps as there are bins, the
        greatest hessian as many. One job; each task gives its greatest ones."""
        p, k = self.p, self.k

        def kernel(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            most = np.zeros((2, k))
            for b in parts:
                g, h, rows = prepare(b)
                if rows is not None:
                    g, h = g[rows], h[rows]
                if len(g):
                    most = np.maximum(most, [np.abs(g).max(0), np.abs(h).max(0)])
            yield pa.RecordBatch.from_arrays([pa.array([most.tobytes()], pa.binary())], ["most"])

        found = [np.frombuffer(r.most).reshape(2, k) for r in run(self.blocks, self.layout, self.used, kernel, "most binary").collect()]
        most, bins = np.max(found, axis=0), p.num_grad_quant_bins or 4
        if not np.isfinite(most).all():
            raise FloatingPointError(f"iteration {iteration} has gradients that aren't finite")
        return Steps(most[0] / max(1, bins // 2), most[1] / bins, (p.data_random_seed, iteration) if p.stochastic_rounding and p.quant_mode != "fixedpoint" else None)

    def _exact_leaves(self, tree: Tree, nodes: Nodes, k: int, prepare: Callable) -> None:
        """Leaf values from the gradients before they were rounded to steps."""

        def kernel(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, tree.leaves))
            for b in parts:
                g, h, rows = prepare(b)
                rows = np.arange(b.n) if rows is None else rows
                leaf = nodes.leaf_of(b.x)[rows]
                total += [np.bincount(leaf, x[rows, k], tree.leaves) for x in (g, h)]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        g, h = np.sum([np.frombuffer(r.sums).reshape(2, -1) for r in run(self.blocks, self.layout, self.used, kernel, "sums binary").collect()], axis=0)
        values = output(g, h, self.p, self.p.lambda_l2)
        tree.leaf_value, nodes.value = values.tolist(), values

    def _linear(self, tree: Tree, nodes: Nodes, k: int, prepare: Callable, columns: list[int]) -> None:
        """Leaves get ridge regressions on the numerical features of their paths, by normal equations summed over blocks.

        Rows that lack one of these features are left out, and keep the constant, as do leaves whose equations can't be
        solved. Equations of a leaf are added up before they reach the driver.
        """
        paths: dict[int, list[int]] = {}
        waiting: list[tuple[int, list[int]]] = [(0, [])]
        while waiting:
            code, path = waiting.pop()
            if code < 0:
                paths[~code] = path
                continue
            f = tree.feature[code]
            more = path if f in path or tree.categories[code] is not None else [*path, f]
            waiting += [(tree.left[code], more), (tree.right[code], more)]
        used, gradients, pending = self.used, self.gradients, self.pending
        places = {i: [used.index(f) for f in path] for i, path in paths.items()}

        def kernel(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in parts:
                g, h = gradients(b, pending.scores(b))
                leaf = nodes.leaf_of(b.x)
                for i, own in places.items():
                    rows = np.flatnonzero(leaf == i)
                    z = np.concatenate([b.raw[np.ix_(own, rows)], np.ones((1, len(rows)))]) if own else np.ones((1, len(rows)))
                    whole = ~np.isnan(z).any(0)
                    z, rows = z[:, whole].T, rows[whole]
                    part = np.column_stack([(z * h[rows, k][:, None]).T @ z, z.T @ g[rows, k]])
                    sums[i] = sums.get(i, 0) + part
            for i, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.ascontiguousarray(s).tobytes()], pa.binary())], ["leaf", "sums"])

        def add(key: tuple, rows: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(s.as_py()) for s in rows["sums"]], axis=0)
            return pa.table({"leaf": rows["leaf"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

        found = run(self.blocks, self.layout, self.used, kernel, "leaf int, sums binary").groupBy("leaf").applyInArrow(add, "leaf int, sums binary")
        total = {r.leaf: np.frombuffer(r.sums).reshape(len(paths[r.leaf]) + 1, -1) for r in found.collect()}
        tree.leaf_const, tree.leaf_features, tree.leaf_coeff = list(tree.leaf_value), [[] for _ in range(tree.leaves)], [[] for _ in range(tree.leaves)]
        for i, s in total.items():
            size = len(s)
            ridge = np.diag([self.p.linear_lambda] * (size - 1) + [0.0])
            try:
                beta = -np.linalg.solve(s[:, :size] + ridge, s[:, size])
            except np.linalg.LinAlgError:
                continue
            if size > 1 and np.isfinite(beta).all() and tree.leaf_count[i] > size:
                tree.leaf_features[i], tree.leaf_coeff[i], tree.leaf_const[i] = paths[i], beta[:-1].tolist(), float(beta[-1])

    def _position_bias(self) -> None:
        """A Newton step on each position's bias factor."""
        gradients, pending, reg, rate = self.gradients, self.pending, self.p.lambdarank_position_bias_regularization, self.p.learning_rate

        def kernel(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                g, h = gradients(b, pending.scores(b))
                at, inverse = np.unique(b.pos, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(inverse, g[:, 0])), pa.array(np.bincount(inverse, h[:, 0])), pa.array(np.bincount(inverse).astype(np.int64))], ["pos", "g", "h", "n"])

        for r in run(self.blocks, self.layout, self.used, kernel, "pos long, g double, h double, n long").groupBy("pos").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
            old = self.gradients.bias.get(r.pos, 0.0)
            first, second = -r.g - old * reg * r.n, -r.h - reg * r.n
            self.gradients.bias[r.pos] = old + rate * first / (abs(second) + 0.001)

    # -- dropout -----------------------------------------------------------------------------------------------------

    def _drop(self, iteration: int) -> list[int]:
        """Iterations that are left out of this iteration's scores."""
        p = self.p
        draw = np.random.default_rng([p.drop_seed, iteration])
        if not iteration or draw.random() < p.skip_drop:
            return []
        weight = np.array([abs(f[0]) for f in self.factors])
        rate = np.full(iteration, p.drop_rate) if p.uniform_drop else p.drop_rate * weight * iteration / weight.sum()
        out = np.flatnonzero(draw.random(iteration) < rate).tolist()
        out = out[: p.max_drop] if p.max_drop > 0 else out
        for i in out:
            self._weigh(i, 0.0, keep=True)
        return out

    def _weigh(self, i: int, factor: float, keep: bool = False) -> None:
        """Pending trees of iteration i count with `factor` from now on."""
        for k, nodes in enumerate(self.tables[i]):
            for pending in (self.pending, *[v[-1] for v in self.valid]):
                pending.trees = [(c, t, factor if t is nodes else f) for c, t, f in pending.trees]
        if not keep:
            self.factors[i] = [factor] * self.k

    def _restore(self, dropped: list[int]) -> None:
        for i in dropped:
            self._weigh(i, self.factors[i][0])

    def _normalise(self, dropped: list[int], rate: float) -> float:
        """Scales the dropped trees back; returns the new trees' rate."""
        n, p = len(dropped), self.p
        if p.xgboost_dart_mode:
            new, old = rate / (n + rate) if n else rate, n / (n + rate) if n else 1.0
        else:
            new, old = rate / (1.0 + n), n / (n + 1.0)
        for i in dropped:
            factor = self.factors[i][0] * old
            for k in range(self.k):
                tree = self.model.trees[i * self.k + k]
                shift = self.start[k] if i == 0 and self.init_model is None else 0.0
                tree.shift(-shift)
                tree.scale(old)
                tree.shift(shift)
            self._weigh(i, factor)
        return new

    # -- scores and evaluation ---------------------------------------------------------------------------------------

    def refresh(self) -> None:
        """Writes the rows' scores anew, so that pending trees are counted once more only."""
        self.blocks = _refreshed(self.blocks, self.layout, self.pending, self.train.blocks(self.k, bool(self.p.linear_tree))[0])
        self.pending.trees, self.pending.start = [], np.zeros(self.k)
        for i, (name, data, blocks, layout, pending) in enumerate(self.valid):
            self.valid[i] = name, data, _refreshed(blocks, layout, pending, data.blocks(self.k, bool(self.p.linear_tree))[0]), layout, Pending(self.used, start=np.zeros(self.k))

    def add_valid(self, data: GbtDataset, name: str) -> None:
        blocks, layout = data.blocks(self.k, bool(self.p.linear_tree))
        pending = Pending(self.used, start=self.pending.start.copy() if self.pending.start is not None and not self.model.trees else self.start.copy())
        pending.trees = [(k, n, f) for tables, factors in zip(self.tables, self.factors, strict=True) for k, (n, f) in enumerate(zip(tables, factors, strict=True))]
        self.valid.append((name, data, blocks, layout, pending))

    def scored(self, name: str = "training", raw: bool = True) -> DataFrame:
        """Rows y (array), w, s (array of scores), and q with place in the query's order for ranked data."""
        if name == "training":
            blocks, layout, pending = self.blocks, self.layout, self.pending
        else:
            _, _, blocks, layout, pending = next(v for v in self.valid if v[0] == name)
        if self.p.boosting == "rf":
            pending = Pending(self.used, start=self.start.copy())
            m = max(1, len(self.tables))
            pending.trees = [(k, n, 1.0 / m) for tables in self.tables for k, n in enumerate(tables)]
        link = self.model.link_function()

        def kernel(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                s = pending.scores(b)
                s = s if raw else link(s)
                wide = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], np.int32)), pa.array(np.ascontiguousarray(v).ravel()))
                yield pa.RecordBatch.from_arrays([wide(b.y), pa.array(b.w), wide(s), pa.array(b.q if b.q is not None else np.zeros(b.n, np.int64)), pa.array(np.arange(b.n))], ["y", "w", "s", "q", "place"])

        return run(blocks, layout, self.used, kernel, "y array<double>, w double, s array<double>, q long, place long")

    def evaluate(self, name: str = "training", feval: Callable | None = None) -> list[tuple[str, str, float, bool]]:
        """(data, metric, value, whether more is better) of each metric."""
        rows = self.scored(name, raw=False).persist()
        try:
            out = [(name, m, value_of(rows, m, self.p), metrics.higher_is_better(m)) for m in metrics_of(self.p)]
            if feval:
                found = feval(self.scored(name, raw=True))
                out += [(name, *f) for f in (found if isinstance(found, list) else [found])]
            return out
        finally:
            rows.unpersist()

    def rollback(self) -> None:
        """Takes the last iteration back."""
        if not self.tables:
            return
        last = self.tables.pop()
        self.factors.pop()
        del self.model.trees[-self.k :]
        for pending in (self.pending, *[v[-1] for v in self.valid]):
            kept = [t for t in pending.trees if not any(t[1] is n for n in last)]
            missing = len(kept) == len(pending.trees)
            pending.trees = kept + ([(k, n, -1.0) for k, n in enumerate(last)] if missing else [])
        self.stopped = False


def _refreshed(blocks: DataFrame, layout: Layout, pending: Pending, own: DataFrame) -> DataFrame:
    """The blocks with their scores brought up to date, written to the shared folder in place of the last ones; those that the
    dataset keeps (own) stay, out of memory."""
    place = blocks.columns.index("s")
    names, used = blocks.columns, pending.features

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [np.ascontiguousarray(pending.scores(Block(batch, i, layout, used)), "<f8").tobytes() for i in range(batch.num_rows)]
            columns = list(batch.columns)
            columns[place] = pa.array(new, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = cut(blocks.mapInArrow(body, blocks.schema)).persist()
    blocks.unpersist()
    if blocks is not own:
        drop(blocks)
    return out


def value_of(rows: DataFrame, metric: str, p: Params) -> float:
    """A metric over rows of scored(raw=False)."""
    name, _, at = metric.partition("@")
    y, s, w = F.element_at("y", 1), F.element_at("s", 1), F.col("w")
    if name == "multi_logloss":
        found = metrics.multi_logloss(rows, y, F.col("s"), w)
    elif name == "multi_error":
        found = metrics.multi_error(rows, y, F.col("s"), w, p.multi_error_top_k)
    elif name == "auc_mu":
        cost = p.auc_mu_weights
        k = p.num_class
        found = metrics.auc_mu(rows, y, F.col("s"), k, [cost[i * k : (i + 1) * k] for i in range(k)] if cost else None, w)
    elif name == "multi_rmse":
        found = metrics.pointwise(rows.select(F.explode(F.arrays_zip("y", "s")).alias("x"), "w"), name, F.col("x.y"), F.col("x.s"), w)
    elif name == "auc":
        found = metrics.auc(rows, y > 0, s, w)
    elif name == "average_precision":
        found = metrics.average_precision(rows, y > 0, s, w)
    elif name == "r2":
        found = metrics.r2(rows, y, s, w)
    elif name == "ndcg":
        found = metrics.ndcg(rows, F.col("q"), y, s, int(at), [F.col("place")], p.label_gain or None, w)
    elif name == "map":
        found = metrics.mean_average_precision(rows, F.col("q"), y, s, int(at), [F.col("place")], w)
    else:
        found = metrics.pointwise(rows, name, y, s, w, p)
    value = found.first()[0]
    return float("nan") if value is None else float(value)

