"""Growing trees: one Spark job for each level of all trees of an iteration, then best-first selection on the driver.

A split's gain depends on its leaf's rows alone, so which leaves are split first only decides which splits are taken
when leaves run out. Levels are grown for every leaf that could still be taken; taking leaves by gain then gives the tree
that growing leaf by leaf would.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.binning import BinModel
from ..operators.splits import Leaf, Scanner, Split, output
from ..params import Params
from .blocks import Block, Layout, run
from .tree import Tree

#: Bytes of partial histograms that the driver adds up itself; beyond it tasks add them up first.
DRIVER_BYTES = 64 << 20


@dataclass
class Nodes:
    """A tree over bins, as kernels use it: feature is a place in the kernel's list of features; a child below 0 is leaf ~child."""

    feature: np.ndarray
    table: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    #: Linear leaves: constants, and each leaf's features (as places) and coefficients.
    linear: tuple[np.ndarray, list[list[int]], list[list[float]]] | None = None

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(x.shape[1], np.int64) if len(self.feature) else np.full(x.shape[1], -1)
        rows = np.arange(x.shape[1]) if len(self.feature) else np.zeros(0, np.int64)
        while len(rows):
            node = at[rows]
            to = np.where(self.table[node, x[self.feature[node], rows]], self.left[node], self.right[node])
            at[rows] = to
            rows = rows[to >= 0]
        return ~at

    def output(self, block: Block) -> np.ndarray:
        """Of each row; rows that lack a feature of their linear leaf have its constant value."""
        leaf = self.leaf_of(block.x)
        out = self.value[leaf]
        if self.linear is not None:
            for i, (const, places, factors) in enumerate(zip(*self.linear, strict=True)):
                rows = np.flatnonzero(leaf == i)
                z = block.raw[np.ix_(places, rows)]
                whole = ~np.isnan(z).any(0)
                out[rows[whole]] = const + np.array(factors) @ z[:, whole] if places else const
        return out


@dataclass
class Growing:
    """A node of a tree that is grown: its state, its best split, and its children once they are there."""

    leaf: Leaf
    hist: np.ndarray | None = None
    split: Split | None = None
    children: tuple[int, int] | None = None
    reach: float = math.inf  # least gain on the way here
    path: tuple[int, ...] = ()
    forced: dict | None = None


class TreeJob:
    """One tree while it grows."""

    def __init__(self, tree: int, scanner: Scanner, features: list[int], p: Params, seed: int, groups: list[set[int]], forced: dict | None, spent: np.ndarray | None):
        self.tree, self.scanner, self.features, self.p, self.seed, self.groups, self.forced, self.spent = tree, scanner, features, p, seed, groups, forced, spent
        self.nodes: list[Growing] = []
        self.done = False

    def begin(self, hist: np.ndarray, exact_rows: float) -> None:
        g, h = (float(hist[0, :, i].sum()) if len(self.features) else 0.0 for i in range(2))
        leaf = Leaf(g, h, exact_rows)
        leaf.output = float(output(g, h, self.p, self.p.lambda_l2)) if h > 0 or self.p.lambda_l2 > 0 else 0.0
        self.nodes = [Growing(leaf, hist, forced=self.forced)]
        self._search(self.nodes[0])

    def _search(self, node: Growing) -> None:
        """The node's best split, under the constraints that hold there."""
        p, k = self.p, len(self.features)
        node.split = None
        if node.hist is None or p.max_depth > 0 and node.leaf.depth >= p.max_depth:
            return
        if node.forced:
            f = int(node.forced["feature"])
            if f in self.features:
                i = self.features.index(f)
                bins = self.scanner.features[i]
                t = min(int(bins.to_bins(np.array([float(node.forced["threshold"])]))[0]), bins.bins - 2)
                node.split = self.scanner.forced(node.hist, node.leaf, i, t)
                if node.split:
                    node.split.gain = max(node.split.gain, 0.0)
                    node.reach = math.inf
                    return
            node.forced = None
        allowed = np.ones(k, bool)
        if self.groups:
            open_ = [g for g in self.groups if node.leaf.used <= g]
            allowed &= np.array([any(f in g for g in open_) for f in self.features], bool)
        draw = np.random.default_rng([self.seed, self.tree, *node.path]) if p.extra_trees or p.feature_fraction_bynode < 1 else None
        if p.feature_fraction_bynode < 1 and k:
            pick = draw.permutation(k)[: max(1, int(k * p.feature_fraction_bynode + 0.5))]
            mask = np.zeros(k, bool)
            mask[pick] = True
            allowed &= mask
        cost = None
        if p.cegb_penalty_split or p.cegb_penalty_feature_coupled or p.cegb_penalty_feature_lazy:
            cost = np.full(k, p.cegb_penalty_split * node.leaf.n)
            for i, f in enumerate(self.features):
                if f < len(p.cegb_penalty_feature_coupled) and not (self.spent is not None and self.spent[f]) and f not in node.leaf.used:
                    cost[i] += p.cegb_penalty_feature_coupled[f]
                if f < len(p.cegb_penalty_feature_lazy) and f not in node.leaf.used:
                    cost[i] += p.cegb_penalty_feature_lazy[f] * node.leaf.n
            cost *= p.cegb_tradeoff
        node.split = self.scanner.best(node.hist, node.leaf, draw if p.extra_trees else None, allowed, cost)
        if node.split:
            node.reach = min(node.reach, node.split.gain)

    def wanted(self) -> list[int]:
        """Nodes to be split at the next level: those among the num_leaves - 1 that a best-first search could take."""
        reach = sorted((n.reach for n in self.nodes if n.split), reverse=True)
        bar = reach[self.p.num_leaves - 2] if len(reach) >= self.p.num_leaves - 1 else -math.inf
        return [i for i, n in enumerate(self.nodes) if n.split and n.children is None and n.reach >= bar]

    def divide(self, i: int) -> tuple[int, int]:
        """Children of a node; (child to be counted, child that gets the rest)."""
        node = self.nodes[i]
        s, up = node.split, node.leaf
        f = self.features[s.feature]
        out = []
        for side, (sums, value) in enumerate(((s.left, s.left_output), (s.right, s.right_output))):
            low, high = up.low, up.high
            if s.monotone:
                mid = (s.left_output + s.right_output) / 2
                if (s.monotone > 0) == (side == 0):
                    high = min(high, mid)
                else:
                    low = max(low, mid)
            leaf = Leaf(sums[0], sums[1], sums[2], value, low, high, up.depth + 1, None, up.used | {f})
            forced = (node.forced or {}).get("left" if side == 0 else "right")
            out.append(Growing(leaf, reach=math.inf if node.forced else min(node.reach, s.gain), path=(*node.path, side), forced=forced))
        at = len(self.nodes)
        self.nodes += out
        node.children = at, at + 1
        return (at, at + 1) if s.left[2] <= s.right[2] else (at + 1, at)

    def settle(self, i: int, small: int, other: int, hist: np.ndarray) -> None:
        """The children's histograms, and their best splits; rows are exact from here on."""
        parent, n = self.nodes[i], self.nodes
        n[small].hist, n[other].hist = hist, parent.hist - hist
        parent.hist = None
        for c in (small, other):
            if len(self.features):
                n[c].leaf.n = float(n[c].hist[0, :, 2].sum())
            self._search(n[c])

    def table(self) -> Nodes:
        """The tree as far as it is grown; leaf numbers are node numbers."""
        inner = [i for i, n in enumerate(self.nodes) if n.children]
        place = {i: k for k, i in enumerate(inner)}
        code = lambda i: place[i] if i in place else ~i
        return Nodes(
            np.array([self.nodes[i].split.feature for i in inner], np.int64), np.array([self.scanner.goes_left(self.nodes[i].split) for i in inner], bool).reshape(len(inner), self.scanner.width),
            np.array([code(self.nodes[i].children[0]) for i in inner], np.int64), np.array([code(self.nodes[i].children[1]) for i in inner], np.int64), np.zeros(len(self.nodes)),
        )

    def finish(self, model: BinModel) -> tuple[Tree, Nodes]:
        """Best-first selection: the greatest gain first, then the lower leaf number; a left child keeps its parent's number."""
        tree = Tree(leaf_value=[self.nodes[0].leaf.output], leaf_weight=[self.nodes[0].leaf.h], leaf_count=[int(self.nodes[0].leaf.n)])
        at_leaf, link = [0], [(-1, False)]
        picked: list[int] = []
        key = lambda leaf, i: (0 if self.nodes[i].forced else 1, -self.nodes[i].split.gain, self.features[self.nodes[i].split.feature], leaf)
        queue = [(*key(0, 0), 0)] if self.nodes[0].split and self.nodes[0].children else []
        while queue and tree.leaves < self.p.num_leaves:
            *_, leaf, i = heapq.heappop(queue)
            node = self.nodes[i]
            s, number = node.split, len(tree.feature)
            f = self.features[s.feature]
            bins = model.features[f]
            picked.append(i)
            tree.feature.append(f)
            tree.missing.append(bins.missing)
            tree.default_left.append(s.default_left and s.categories is None)
            tree.gain.append(s.gain + self.p.min_gain_to_split)
            tree.node_value.append(node.leaf.output)
            tree.node_weight.append(node.leaf.h)
            tree.node_count.append(int(node.leaf.n))
            if s.categories is not None:
                tree.categories.append([bins.categories[b - 1] for b in s.categories if b > 0])
                tree.threshold.append(0.0)
            else:
                tree.categories.append(None)
                tree.threshold.append(min(bins.threshold(s.bin), 1e300) if not math.isnan(bins.threshold(s.bin)) else 1e300)
            up, side = link[leaf]
            if up >= 0:
                (tree.left if side else tree.right)[up] = number
            new = tree.leaves
            a, b = node.children
            tree.left.append(~leaf)
            tree.right.append(~new)
            for values, name in ((tree.leaf_value, "output"), (tree.leaf_weight, "h"), (tree.leaf_count, "n")):
                values[leaf] = getattr(self.nodes[a].leaf, name)
                values.append(getattr(self.nodes[b].leaf, name))
            tree.leaf_count = [int(c) for c in tree.leaf_count]
            at_leaf[leaf] = a
            at_leaf.append(b)
            link[leaf] = number, True
            link.append((number, False))
            for place, child in ((leaf, a), (new, b)):
                if self.nodes[child].split and self.nodes[child].children:
                    heapq.heappush(queue, (*key(place, child), child))
        table = Nodes(
            np.array([self.nodes[i].split.feature for i in picked], np.int64), np.array([self.scanner.goes_left(self.nodes[i].split) for i in picked], bool).reshape(len(picked), self.scanner.width),
            np.array(tree.left, np.int64), np.array(tree.right, np.int64), np.array(tree.leaf_value),
        )
        return tree, table


def histograms(blocks: DataFrame, layout: Layout, features: list[int], width: int, wanted: dict[int, tuple[Nodes | None, list[int]]], prepare: Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray | None]], read: list[int] | None = None) -> dict[tuple[int, int], np.ndarray]:
    """{(tree, node): histogram} in one job. wanted: the trees as they are, and the nodes to be counted in each.

    read: features that prepare() needs in the block, if they are others; it leaves `features` there, in their order.
    prepare(block) gives gradients and hessians [rows, trees] and the rows that take part. Each task adds up its blocks;
    few and small sums are added on the driver, in the tasks' order, others by the tasks beforehand.
    """
    handle = blocks.sparkSession.sparkContext.broadcast(wanted)
    count = len(features)

    def kernel(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for block in parts:
            g, h, picked = prepare(block)
            x = block.x if picked is None else block.x[:, picked]
            for tree, (table, nodes) in handle.value.items():
                gt, ht = (v[:, tree] if picked is None else v[picked, tree] for v in (g, h))
                if table is None:
                    slot, rows = np.zeros(x.shape[1], np.int64), None
                else:
                    place = np.full(len(table.value), -1)
                    place[nodes] = np.arange(len(nodes))
                    slot = place[table.leaf_of(x)]
                    rows = np.flatnonzero(slot >= 0)
                    slot, gt, ht = slot[rows], gt[rows], ht[rows]
                size = len(nodes) * width
                total = np.zeros((count, size, 3))
                for j in range(count):
                    at = slot * width + (x[j] if rows is None else x[j, rows])
                    total[j, :, 0] = np.bincount(at, gt, size)
                    total[j, :, 1] = np.bincount(at, ht, size)
                    total[j, :, 2] = np.bincount(at, minlength=size)
                for k, node in enumerate(nodes):
                    part = total[:, k * width : (k + 1) * width]
                    held = sums.get((tree, node))
                    sums[tree, node] = part.copy() if held is None else held + part
        keys = list(sums)
        for k in keys:
            yield pa.RecordBatch.from_arrays([pa.array([k[0]], pa.int32()), pa.array([k[1]], pa.int32()), pa.array([sums[k].tobytes()], pa.binary())], ["tree", "node", "sums"])

    made = run(blocks, layout, read or features, kernel, "tree int, node int, sums binary")
    if len([1 for _, n in wanted.values() for _ in n]) * count * width * 24 * layout.parts > DRIVER_BYTES:

        def add(key: tuple, part: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(b.as_py()) for b in part["sums"]], axis=0)
            return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        made = made.groupBy("tree", "node").applyInArrow(add, "tree int, node int, sums binary")
    out: dict[tuple[int, int], np.ndarray] = {}
    for row in made.collect():
        part = np.frombuffer(row.sums).reshape(count, width, 3)
        held = out.get((row.tree, row.node))
        out[row.tree, row.node] = part if held is None else held + part
    return out


def grow(blocks: DataFrame, layout: Layout, model: BinModel, jobs: list[TreeJob], features: list[int], prepare: Callable, read: list[int] | None = None) -> list[tuple[Tree, Nodes]]:
    """The trees of one iteration, which share their jobs: one for the roots, one for each level."""
    width = max((j.scanner.width for j in jobs), default=1)
    roots = histograms(blocks, layout, features, width, {j.tree: (None, [0]) for j in jobs}, prepare, read)
    for j in jobs:
        hist = roots.get((j.tree, 0))
        if hist is None or not features:
            j.nodes = [Growing(Leaf(0.0, 0.0, 0.0))]
            continue
        if not np.isfinite(hist).all():
            raise FloatingPointError("gradients or hessians aren't finite; look for extreme labels or weights, lower learning_rate, or regularise more")
        j.begin(hist, float(hist[0, :, 2].sum()))
    while True:
        plan: dict[int, list[tuple[int, int, int]]] = {}
        for j in jobs:
            todo = [(i, *j.divide(i)) for i in j.wanted()]
            if todo:
                plan[j.tree] = todo
        if not plan:
            return [j.finish(model) for j in jobs]
        by = {j.tree: j for j in jobs}
        found = histograms(blocks, layout, features, width, {t: (by[t].table(), [small for _, small, _ in todo]) for t, todo in plan.items()}, prepare, read)
        for t, todo in plan.items():
            for i, small, other in todo:
                by[t].settle(i, small, other, found.get((t, small), np.zeros((len(features), width, 3))))


def read_forced_splits(path: str) -> dict | None:
    if not path:
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f) or None


@dataclass
class Constraints:
    """Groups of features that may stand on one path."""

    groups: list[set[int]] = field(default_factory=list)

    @classmethod
    def read(cls, given: object, names: list[str]) -> Constraints:
        """'[0,1],[2,3]' or lists of numbers or names."""
        if not given:
            return cls()
        sets = json.loads(f"[{given}]") if isinstance(given, str) else given
        place = {n: i for i, n in enumerate(names)}
        return cls([{place[x] if isinstance(x, str) else int(x) for x in s} for s in sets])
