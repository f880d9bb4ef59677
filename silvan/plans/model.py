"""Trained models: prediction, storage as text, JSON and tables, importances, refitting."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.objectives import softmax
from ..operators.binning import BinModel
from ..params import Params, resolve
from .tree import Tree

MISSING = ("none", "zero", "nan")
#: Trees that a CASE expression is written for, at most: code that is generated for more outgrows the JVM's limit.
CASE_TREES = 20


def link_of(p: Params) -> Callable[[np.ndarray], np.ndarray]:
    """Output of raw scores [rows, scores]."""
    o = p.objective
    if o == "multiclass":
        return softmax
    if o == "binary" or o == "multiclassova":
        return lambda s: 1.0 / (1.0 + np.exp(-p.sigmoid * s))
    if o == "cross_entropy":
        return lambda s: 1.0 / (1.0 + np.exp(-s))
    if o == "cross_entropy_lambda":
        return lambda s: np.log1p(np.exp(s))
    if o in ("poisson", "gamma", "tweedie"):
        return np.exp
    if p.reg_sqrt:
        return lambda s: np.sign(s) * s * s
    return lambda s: s


class GbtModel:
    """Trees in the order of their iterations, `k` to each."""

    def __init__(self, trees: list[Tree], params: Params, features: list[str], k: int = 1, bins: BinModel | None = None):
        self.trees, self.params, self.features, self.k, self.bins = trees, params, features, k, bins
        self.best_iteration = -1
        self.best_score: dict[str, dict[str, float]] = {}

    # -- slices ------------------------------------------------------------------------------------------------------

    def num_trees(self) -> int:
        return len(self.trees)

    def current_iteration(self) -> int:
        return len(self.trees) // self.k

    def num_feature(self) -> int:
        return len(self.features)

    def slice(self, start: int = 0, count: int | None = None) -> list[Tree]:
        """Trees of `count` iterations from `start` on; by default up to the best iteration, or all."""
        if count is None or count <= 0:
            count = self.best_iteration if self.best_iteration > 0 and count is None else self.current_iteration()
        return self.trees[start * self.k : (start + count) * self.k]

    @property
    def averaged(self) -> bool:
        return self.params.boosting == "rf"

    def link_function(self) -> Callable[[np.ndarray], np.ndarray]:
        return link_of(self.params)

    # -- numpy prediction --------------------------------------------------------------------------------------------

    def raw(self, x: np.ndarray, trees: list[Tree]) -> np.ndarray:
        out = np.zeros((len(x), self.k))
        stop, p = None, self.params
        if p.pred_early_stop and p.objective in ("binary", "multiclass", "multiclassova") and not self.averaged:
            stop = np.ones(len(x), bool)
        for i in range(0, len(trees), self.k):
            rows = slice(None) if stop is None else np.flatnonzero(stop)
            part = x[rows]
            for k in range(self.k):
                out[rows, k] += trees[i + k].output(part)
            if stop is not None and (i // self.k + 1) % p.pred_early_stop_freq == 0:
                s = out[rows]
                margin = 2 * np.abs(s[:, 0]) if self.k == 1 else np.diff(np.sort(s, 1)[:, -2:], axis=1)[:, 0]
                stop[rows] = margin <= p.pred_early_stop_margin
        return out / max(1, len(trees) // self.k) if self.averaged else out

    def local(self, x: np.ndarray, kind: str = "normal", start: int = 0, count: int | None = None) -> np.ndarray:
        """Predictions of an array [rows, features], without Spark. kind: normal, raw, leaf or contrib."""
        x = np.atleast_2d(np.asarray(x, np.float64))
        trees = self.slice(start, count)
        if kind == "leaf":
            return np.stack([t.leaf_of(x) for t in trees], 1) if trees else np.zeros((len(x), 0), np.int64)
        if kind == "contrib":
            width = len(self.features) + 1
            out = np.zeros((len(x), self.k * width))
            for i, t in enumerate(trees):
                k = i % self.k
                out[:, k * width : (k + 1) * width] += t.contributions(x, width - 1)
            return out / max(1, len(trees) // self.k) if self.averaged else out
        s = self.raw(x, trees)
        return s if kind == "raw" else self.link_function()(s)

    # -- prediction of frames ----------------------------------------------------------------------------------------

    def predict(self, df: DataFrame, kind: str = "normal", output: str = "prediction", start: int = 0, count: int | None = None) -> DataFrame:
        """df with a column of predictions: a double, or an array (several scores, leaves, or contributions).

        The model is broadcast; rows are traversed in Arrow batches. Columns of other names stay as they are.
        """
        gone = [f for f in self.features if f not in df.columns]
        if gone:
            raise ValueError(f"columns of the model that the frame lacks: {gone}")
        wide = kind in ("leaf", "contrib") or self.k > 1
        element = "int" if kind == "leaf" else "double"
        handle = df.sparkSession.sparkContext.broadcast(self._light())

        @F.pandas_udf(f"array<{element}>" if wide else "double")
        def score(cols: pd.DataFrame) -> pd.Series:
            got = handle.value.local(cols.to_numpy(np.float64, na_value=np.nan), kind, start, count)
            return pd.Series(list(got.astype(np.int32) if kind == "leaf" else got)) if wide else pd.Series(got[:, 0])

        return df.withColumn(output, score(F.struct(*[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(self.features)])))

    def predict_sparse_contrib(self, df: DataFrame, output: str = "contrib") -> DataFrame:
        """Contributions that are not 0, as a map from place to value."""
        dense = self.predict(df, "contrib", output)
        pairs = F.filter(F.transform(F.col(output), lambda v, i: F.struct(i.alias("key"), v.alias("value"))), lambda e: e["value"] != 0)
        return dense.withColumn(output, F.map_from_entries(pairs))

    def _light(self) -> GbtModel:
        out = GbtModel(self.trees, self.params if not callable(self.params.objective) else self.params.with_(objective="custom"), self.features, self.k)
        out.best_iteration = self.best_iteration
        return out

    def case_column(self, start: int = 0, count: int | None = None, k: int = 0) -> Column:
        """Raw score as a Spark expression, for small models."""
        trees = self.slice(start, count)[k :: self.k]
        if len(trees) > CASE_TREES:
            raise ValueError(f"a CASE expression holds at most {CASE_TREES} trees")

        def node(t: Tree, code: int) -> Column:
            if code < 0:
                return F.lit(float(t.leaf_value[~code]))
            return F.when(decide(t, code), node(t, t.left[code])).otherwise(node(t, t.right[code]))

        def decide(t: Tree, i: int) -> Column:
            x = F.col(f"`{self.features[t.feature[i]]}`").cast("double")
            gone = x.isNull() | F.isnan(x)
            if t.categories[i] is not None:
                return ~gone & x.cast("long").isin(t.categories[i])
            left = F.when(gone, F.lit(0.0)).otherwise(x) <= F.lit(t.threshold[i])
            if t.missing[i] == "nan":
                return F.when(gone, F.lit(t.default_left[i])).otherwise(left)
            if t.missing[i] == "zero":
                return F.when(gone | (F.abs(x) <= 1e-35), F.lit(t.default_left[i])).otherwise(left)
            return left

        parts = [node(t, 0 if t.leaves > 1 else -1) for t in trees]
        return sum(parts[1:], parts[0]) if parts else F.lit(0.0)

    def case_sql(self, start: int = 0, count: int | None = None, k: int = 0) -> str:
        """Raw score as portable SQL; inputs that are null count as missing."""
        trees = self.slice(start, count)[k :: self.k]

        def test(t: Tree, i: int) -> str:
            x = f'"{self.features[t.feature[i]]}"'
            if t.categories[i] is not None:
                return f"coalesce({x}, -1) IN ({', '.join(map(str, t.categories[i]))})"
            if t.missing[i] == "nan":
                return f"CASE WHEN {x} IS NULL THEN {str(t.default_left[i]).upper()} ELSE {x} <= {t.threshold[i]!r} END"
            if t.missing[i] == "zero":
                return f"CASE WHEN coalesce({x}, 0) = 0 THEN {str(t.default_left[i]).upper()} ELSE {x} <= {t.threshold[i]!r} END"
            return f"coalesce({x}, 0.0) <= {t.threshold[i]!r}"

        def node(t: Tree, code: int) -> str:
            if code < 0:
                return f"{t.leaf_value[~code]!r}::DOUBLE"
            return f"CASE WHEN {test(t, code)} THEN {node(t, t.left[code])} ELSE {node(t, t.right[code])} END"

        return " + ".join(node(t, 0 if t.leaves > 1 else -1) for t in trees) or "0.0"

    # -- tables ------------------------------------------------------------------------------------------------------

    def node_rows(self) -> list[dict[str, Any]]:
        """One row for each node, in the layout of a tree table."""
        out = []
        for n, t in enumerate(self.trees):
            name = lambda code: f"{n}-S{code}" if code >= 0 else f"{n}-L{~code}"  # noqa: B023,E731
            root = 0 if t.leaves > 1 else -1
            waiting: list[tuple[int, int, int | None]] = [(root, 1, None)]
            while waiting:
                code, depth, up = waiting.pop(0)
                inner = code >= 0
                cats = t.categories[code] if inner else None
                out.append({
                    "tree_index": n, "node_depth": depth, "node_index": name(code), "left_child": name(t.left[code]) if inner else None, "right_child": name(t.right[code]) if inner else None, "parent_index": None if up is None else name(up),
                    "split_feature": self.features[t.feature[code]] if inner else None, "split_gain": float(t.gain[code]) if inner else None, "threshold": None if not inner else "||".join(map(str, cats)) if cats is not None else repr(t.threshold[code]),
                    "decision_type": None if not inner else "==" if cats is not None else "<=", "missing_direction": None if not inner else "left" if t.default_left[code] else "right", "missing_type": None if not inner else {"none": "None", "zero": "Zero", "nan": "NaN"}[t.missing[code]],
                    "value": float(t.value_of(code)), "weight": float(t.node_weight[code] if inner else t.leaf_weight[~code]), "count": int(t.count_of(code)),
                })
                if inner:
                    waiting += [(t.left[code], depth + 1, code), (t.right[code], depth + 1, code)]
        return out

    NODE_SCHEMA = "tree_index long, node_depth long, node_index string, left_child string, right_child string, parent_index string, split_feature string, split_gain double, threshold string, decision_type string, missing_direction string, missing_type string, value double, weight double, count long"

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame(self.node_rows()).astype(object).where(lambda d: d.notna(), None).to_dict("records"), self.NODE_SCHEMA)

    def feature_importance(self, kind: str = "split", count: int | None = None) -> np.ndarray:
        """Splits of each feature that gained, or their gains."""
        out = np.zeros(len(self.features))
        for t in self.slice(0, count):
            for f, g in zip(t.feature, t.gain, strict=True):
                if g > 0:
                    out[f] += 1 if kind == "split" else g
        return out

    def split_values(self, feature: str | int, bins: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Histogram of the thresholds of a numerical feature."""
        f = self.features.index(feature) if isinstance(feature, str) else feature
        values = [t.threshold[i] for t in self.trees for i, g in enumerate(t.feature) if g == f and t.categories[i] is None]
        n = len(np.unique(values))
        return np.histogram(values, bins=max(1, min(bins or n, n)))

    def bounds(self) -> tuple[float, float]:
        """Least and greatest raw score that leaves could add up to."""
        return sum(min(t.leaf_value) for t in self.trees), sum(max(t.leaf_value) for t in self.trees)

    def path_contributions(self, x: np.ndarray) -> np.ndarray:
        """[rows, features + 1]: changes of node values along each row's paths, by the feature that was split on; the last is the roots' sum."""
        x = np.atleast_2d(np.asarray(x, np.float64))
        out = np.zeros((len(x), len(self.features) + 1))
        for t in self.slice():
            leaf = t.leaf_of(x)
            if t.leaves == 1:
                out[:, -1] += t.leaf_value[0]
                continue
            up = {}
            for i in range(len(t.feature)):
                up[t.left[i]], up[t.right[i]] = i, i
            out[:, -1] += t.node_value[0]
            for i in range(t.leaves):
                rows, code = leaf == i, ~i
                while code in up:
                    out[rows, t.feature[up[code]]] += t.value_of(code) - t.value_of(up[code])
                    code = up[code]
        return out

    # -- changes -----------------------------------------------------------------------------------------------------

    def get_leaf_output(self, tree: int, leaf: int) -> float:
        return self.trees[tree].leaf_value[leaf]

    def set_leaf_output(self, tree: int, leaf: int, value: float) -> None:
        self.trees[tree].leaf_value[leaf] = float(value)

    def merge(self, other: GbtModel) -> GbtModel:
        """This model's trees, then the other's."""
        return GbtModel([*self.trees, *other.trees], self.params, self.features, self.k, self.bins)

    def shuffle(self, start: int = 0, end: int = -1, seed: int = 0) -> GbtModel:
        """The same trees with the iterations from start to end in another order."""
        n = self.current_iteration()
        end = n if end <= 0 else min(end, n)
        order = [*range(start), *(start + np.random.default_rng(seed).permutation(end - start)).tolist(), *range(end, n)]
        return GbtModel([t for i in order for t in self.trees[i * self.k : (i + 1) * self.k]], self.params, self.features, self.k, self.bins)

    # -- text and JSON -----------------------------------------------------------------------------------------------

    def to_text(self, start: int = 0, count: int | None = None) -> str:
        """Sections of key=value lines: header, trees, importances, parameters."""
        p, trees = self.params, self.slice(start, count)
        objective = {"binary": f"binary sigmoid:{p.sigmoid:g}", "multiclass": f"multiclass num_class:{self.k}", "multiclassova": f"multiclassova num_class:{self.k} sigmoid:{p.sigmoid:g}", "quantile": f"quantile alpha:{p.alpha:g}", "tweedie": f"tweedie tweedie_variance_power:{p.tweedie_variance_power:g}"}.get(p.objective, p.objective if isinstance(p.objective, str) else "custom")
        if p.reg_sqrt and objective == "regression":
            objective += " sqrt"
        head = ["tree", "version=v4", f"num_class={self.k}", f"num_tree_per_iteration={self.k}", "label_index=0", f"max_feature_idx={len(self.features) - 1}", f"objective={objective}"]
        if self.averaged:
            head.append("average_output")
        head += ["feature_names=" + " ".join(self.features), "feature_infos=" + " ".join(self._info(i) for i in range(len(self.features)))]
        parts = [f"Tree={i}\n{_tree_text(t)}\n" for i, t in enumerate(trees)]
        head += ["tree_sizes=" + " ".join(str(len(s.encode()) + 1) for s in parts), ""]
        gains = self.feature_importance("gain" if p.saved_feature_importance_type else "split")
        ranked = [f"{self.features[i]}={gains[i]:g}" for i in np.argsort(-gains, kind="stable") if gains[i] > 0]
        settings = [f"[{k}: {v}]" for k, v in vars(p).items() if not callable(v)]
        return "\n".join([*head, *parts, "end of trees", "", "feature_importances:", *ranked, "", "parameters:", *settings, "end of parameters", ""])

    def _info(self, i: int) -> str:
        if self.bins is None or self.bins.features[i].trivial:
            return "none"
        f = self.bins.features[i]
        return ":".join(map(str, f.categories)) if f.kind == "categorical" else f"[{f.low:.17g}:{f.high:.17g}]"

    @classmethod
    def from_text(cls, text: str) -> GbtModel:
        """A model from the sections of to_text(), or of a model file of the same layout."""
        head, _, rest = text.partition("\nTree=0\n")
        if not rest and "end of trees" in head:
            head, _, rest = head.partition("end of trees")
        keys = dict(line.partition("=")[::2] for line in head.splitlines() if "=" in line)
        words = keys.get("objective", "regression").split()
        given: dict[str, Any] = {"objective": words[0]}
        for w in words[1:]:
            name, _, value = w.partition(":")
            if name == "sqrt":
                given["reg_sqrt"] = True
            elif value:
                given[name] = value
        k = int(keys.get("num_tree_per_iteration", 1))
        if k > 1:
            given["num_class"] = k
        if "average_output" in head:
            given |= {"boosting": "rf", "bagging_freq": 1, "bagging_fraction": 0.5}
        body = rest.partition("end of trees")[0] if rest else ""
        trees = [_tree_from(part) for part in _split_trees(body)]
        return cls(trees, resolve(given), keys["feature_names"].split(), k)

    def save(self, path: str, **part: Any) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_text(**part))

    @classmethod
    def load(cls, path: str) -> GbtModel:
        with open(path, encoding="utf-8") as f:
            return cls.from_text(f.read())

    def save_table(self, spark: SparkSession, path: str) -> None:
        """Nodes as Parquet for queries, and the text, from which load_table reads the model."""
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.to_text(),)], "model string").write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load_table(cls, spark: SparkSession, path: str) -> GbtModel:
        return cls.from_text(spark.read.parquet(f"{path}/model").first()[0])

    def dump(self) -> dict[str, Any]:
        """The model as nested dicts."""

        def node(t: Tree, code: int) -> dict[str, Any]:
            if code < 0:
                return {"leaf_index": ~code, "leaf_value": t.leaf_value[~code], "leaf_weight": t.leaf_weight[~code], "leaf_count": t.leaf_count[~code]}
            cats = t.categories[code]
            return {
                "split_index": code, "split_feature": t.feature[code], "split_gain": t.gain[code], "threshold": "||".join(map(str, cats)) if cats is not None else t.threshold[code], "decision_type": "==" if cats is not None else "<=",
                "default_left": t.default_left[code], "missing_type": {"none": "None", "zero": "Zero", "nan": "NaN"}[t.missing[code]], "internal_value": t.node_value[code], "internal_weight": t.node_weight[code], "internal_count": t.node_count[code],
                "left_child": node(t, t.left[code]), "right_child": node(t, t.right[code]),
            }

        trees = [{"tree_index": i, "num_leaves": t.leaves, "num_cat": sum(c is not None for c in t.categories), "shrinkage": t.shrinkage, "tree_structure": node(t, 0 if t.leaves > 1 else -1)} for i, t in enumerate(self.trees)]
        return {"name": "tree", "version": "v4", "num_class": self.k, "num_tree_per_iteration": self.k, "label_index": 0, "max_feature_idx": len(self.features) - 1, "objective": self.params.objective if isinstance(self.params.objective, str) else "custom", "average_output": self.averaged, "feature_names": self.features, "tree_info": trees, "feature_importances": {f: v for f, v in zip(self.features, self.feature_importance().tolist(), strict=True) if v}}

    def dump_json(self) -> str:
        return json.dumps(self.dump())

    # -- refit -------------------------------------------------------------------------------------------------------

    def refit(self, data: Any, decay: float | None = None) -> GbtModel:
        """The same trees with leaf values drawn towards those that other data would give them.

        Rows fall into the leaves they belong to; each iteration's gradients are summed by leaf, with scores that the
        refitted trees so far give.
        """
        from .refitting import refit

        return refit(self, data, self.params.refit_decay_rate if decay is None else decay)


def _tree_text(t: Tree) -> str:
    join = lambda v, f=str: " ".join(map(f, v))
    number = lambda v: f"{v:.17g}"
    cats = [c for c in t.categories if c is not None]
    words: list[int] = []
    edges = [0]
    for c in cats:
        bits = [0] * (max(c, default=0) // 32 + 1)
        for v in c:
            bits[v // 32] |= 1 << (v % 32)
        words += bits
        edges.append(len(words))
    seen = 0
    thresholds = []
    for c, v in zip(t.categories, t.threshold, strict=True):
        if c is None:
            thresholds.append(number(v))
        else:
            thresholds.append(str(seen))
            seen += 1
    kinds = [(1 if c is not None else 0) | (2 if d else 0) | MISSING.index(m) << 2 for c, d, m in zip(t.categories, t.default_left, t.missing, strict=True)]
    lines = [f"num_leaves={t.leaves}", f"num_cat={len(cats)}"]
    if t.leaves > 1:
        lines += [
            f"split_feature={join(t.feature)}", f"split_gain={join(t.gain, lambda v: f'{v:g}')}", f"threshold={join(thresholds)}", f"decision_type={join(kinds)}", f"left_child={join(t.left)}", f"right_child={join(t.right)}",
            f"leaf_value={join(t.leaf_value, number)}", f"leaf_weight={join(t.leaf_weight, number)}", f"leaf_count={join(t.leaf_count)}", f"internal_value={join(t.node_value, number)}", f"internal_weight={join(t.node_weight, number)}", f"internal_count={join(t.node_count)}",
        ]
        if cats:
            lines += [f"cat_boundaries={join(edges)}", f"cat_threshold={join(words)}"]
    else:
        lines.append(f"leaf_value={number(t.leaf_value[0])}")
        lines.append(f"leaf_count={t.leaf_count[0]}")
    lines.append(f"is_linear={int(t.leaf_const is not None)}")
    if t.leaf_const is not None:
        lines += [f"leaf_const={join(t.leaf_const, number)}", f"num_features={join(map(len, t.leaf_coeff))}", "leaf_features=" + join(f for row in t.leaf_features for f in row), "leaf_coeff=" + " ".join(number(c) for row in t.leaf_coeff for c in row)]
    return "\n".join([*lines, f"shrinkage={t.shrinkage:g}", ""])


def _split_trees(body: str) -> Iterator[str]:
    held: list[str] = []
    for line in body.splitlines():
        if line.startswith("Tree="):
            yield "\n".join(held)
            held = []
        else:
            held.append(line)
    if any(s.strip() for s in held):
        yield "\n".join(held)


def _tree_from(text: str) -> Tree:
    keys = dict(line.partition("=")[::2] for line in text.splitlines() if "=" in line)
    get = lambda name, kind: [kind(v) for v in keys.get(name, "").split()]
    n = int(keys["num_leaves"])
    t = Tree(leaf_value=get("leaf_value", float), leaf_weight=get("leaf_weight", float) or [0.0] * n, leaf_count=get("leaf_count", int) or [0] * n, shrinkage=float(keys.get("shrinkage", 1)))
    if n > 1:
        kinds = get("decision_type", int)
        edges, words = get("cat_boundaries", int), get("cat_threshold", int)
        for kind, value in zip(kinds, keys["threshold"].split(), strict=True):
            if kind & 1:
                at = int(float(value))
                t.categories.append([32 * w + b for w, word in enumerate(words[edges[at] : edges[at + 1]]) for b in range(32) if word >> b & 1])
                t.threshold.append(0.0)
            else:
                t.categories.append(None)
                t.threshold.append(float(value))
            t.default_left.append(bool(kind & 2))
            t.missing.append(MISSING[kind >> 2 & 3])
        t.feature, t.gain, t.left, t.right = get("split_feature", int), get("split_gain", float), get("left_child", int), get("right_child", int)
        t.node_value, t.node_weight, t.node_count = get("internal_value", float), get("internal_weight", float), get("internal_count", int)
    if keys.get("is_linear") == "1" and "leaf_const" in keys:
        sizes, features, coeff = get("num_features", int), get("leaf_features", int), get("leaf_coeff", float)
        t.leaf_const, t.leaf_features, t.leaf_coeff, at = get("leaf_const", float), [], [], 0
        for size in sizes:
            t.leaf_features.append(features[at : at + size])
            t.leaf_coeff.append(coeff[at : at + size])
            at += size
    return t
