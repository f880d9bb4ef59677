"""Trees as arrays, and what is computed from them row by row in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

ZERO = 1e-35


@dataclass
class Tree:
    """Internal nodes 0..n-2 and leaves 0..n-1; a child c >= 0 is an internal node, else leaf ~c.

    thresholds holds the real bound of a numerical split, or the list of categories that go left.
    """

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    categories: list[list[int] | None] = field(default_factory=list)
    default_left: list[bool] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    node_value: list[float] = field(default_factory=list)
    node_weight: list[float] = field(default_factory=list)
    node_count: list[int] = field(default_factory=list)
    leaf_value: list[float] = field(default_factory=lambda: [0.0])
    leaf_weight: list[float] = field(default_factory=lambda: [0.0])
    leaf_count: list[int] = field(default_factory=lambda: [0])
    shrinkage: float = 1.0
    #: Linear leaves: intercept, features and coefficients of each leaf.
    leaf_const: list[float] | None = None
    leaf_features: list[list[int]] | None = None
    leaf_coeff: list[list[float]] | None = None

    @property
    def leaves(self) -> int:
        return len(self.leaf_value)

    def scale(self, factor: float) -> None:
        self.leaf_value = [v * factor for v in self.leaf_value]
        self.node_value = [v * factor for v in self.node_value]
        self.shrinkage *= factor
        if self.leaf_const is not None:
            self.leaf_const = [v * factor for v in self.leaf_const]
            self.leaf_coeff = [[c * factor for c in row] for row in self.leaf_coeff]

    def shift(self, by: float) -> None:
        self.leaf_value = [v + by for v in self.leaf_value]
        self.node_value = [v + by for v in self.node_value]
        if self.leaf_const is not None:
            self.leaf_const = [v + by for v in self.leaf_const]

    def decide(self, node: int, x: np.ndarray) -> np.ndarray:
        """Whether each value goes left at a node."""
        gone = np.isnan(x)
        if self.categories[node] is not None:
            whole = np.where(gone | (x < 0) | (x > 2**31), -1, x).astype(np.int64)
            return np.isin(whole, self.categories[node])
        kind = self.missing[node]
        filled = np.where(gone, 0.0, x) if kind != "nan" else x
        with np.errstate(invalid="ignore"):
            left = filled <= self.threshold[node]
        if kind == "nan":
            return np.where(gone, self.default_left[node], left)
        if kind == "zero":
            return np.where(np.abs(filled) <= ZERO, self.default_left[node], left)
        return left

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of x [rows, features]."""
        out = np.zeros(len(x), np.int64)
        if self.leaves == 1:
            return out
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            left = self.decide(node, x[rows, self.feature[node]])
            for child, part in ((self.left[node], rows[left]), (self.right[node], rows[~left])):
                if not len(part):
                    continue
                if child < 0:
                    out[part] = ~child
                else:
                    waiting.append((child, part))
        return out

    def output(self, x: np.ndarray, leaf: np.ndarray | None = None) -> np.ndarray:
        leaf = self.leaf_of(x) if leaf is None else leaf
        out = np.array(self.leaf_value)[leaf]
        if self.leaf_const is not None:
            for i in range(self.leaves):
                if self.leaf_features[i]:
                    rows = np.flatnonzero(leaf == i)
                    z = x[np.ix_(rows, self.leaf_features[i])]
                    whole = ~np.isnan(z).any(1)
                    out[rows[whole]] = self.leaf_const[i] + z[whole] @ np.array(self.leaf_coeff[i])
                else:
                    out[leaf == i] = self.leaf_const[i]
        return out

    def depth(self) -> int:
        return 0 if self.leaves == 1 else max(d for _, d in self.walk())

    def walk(self):
        """(child code, depth) of all nodes and leaves, from the root."""
        waiting = [(0 if self.leaves > 1 else -1, 0)]
        while waiting:
            code, d = waiting.pop()
            yield code, d
            if code >= 0:
                waiting += [(self.right[code], d + 1), (self.left[code], d + 1)]

    def count_of(self, code: int) -> float:
        return float(self.node_count[code] if code >= 0 else self.leaf_count[~code])

    def value_of(self, code: int) -> float:
        return self.node_value[code] if code >= 0 else self.leaf_value[~code]

    def expected(self) -> float:
        """Mean output over the training rows' leaves."""
        total = sum(self.leaf_count)
        return sum(v * c for v, c in zip(self.leaf_value, self.leaf_count, strict=True)) / total if total else float(np.mean(self.leaf_value))

    def contributions(self, x: np.ndarray, features: int) -> np.ndarray:
        """SHAP values [rows, features + 1]; the last is the expected value.

        Each leaf's Shapley sums have a closed form in the leaf's path: for every distinct feature on it, the product of
        the shares of training rows that its splits pass on, and whether the row passes them all. Polynomials over the
        path's features weigh the subsets; all rows are handled at once.
        """
        out = np.zeros((len(x), features + 1))
        out[:, features] = self.expected()
        if self.leaves == 1:
            return out
        goes = [self.decide(n, x[:, self.feature[n]]) for n in range(len(self.feature))]
        paths: list[tuple[int, list[tuple[int, bool]]]] = []
        waiting: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
        while waiting:
            code, path = waiting.pop()
            if code < 0:
                paths.append((~code, path))
            else:
                waiting += [(self.left[code], [*path, (code, True)]), (self.right[code], [*path, (code, False)])]
        for leaf, path in paths:
            share: dict[int, float] = {}
            passed: dict[int, np.ndarray] = {}
            for node, side in path:
                child = self.left[node] if side else self.right[node]
                f = self.feature[node]
                whole = self.count_of(node)
                share[f] = share.get(f, 1.0) * (self.count_of(child) / whole if whole else 0.5)
                ok = goes[node] if side else ~goes[node]
                passed[f] = passed[f] & ok if f in passed else ok
            names = list(share)
            n = len(names)
            one = {f: passed[f].astype(np.float64) for f in names}
            weights = [math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) for k in range(n)]
            value = self.leaf_value[leaf]
            for f in names:
                poly = [np.ones(len(x))]  # coefficient k: sum over subsets of k of the other features that follow the row
                for g in names:
                    if g != f:
                        poly = [(poly[k] * share[g] if k < len(poly) else 0.0) + (poly[k - 1] * one[g] if k else 0.0) for k in range(len(poly) + 1)]
                out[:, f] += value * (one[f] - share[f]) * sum(w * c for w, c in zip(weights, poly, strict=True))
        return out
