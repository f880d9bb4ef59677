"""Models of other boosting libraries, from their JSON files."""

from __future__ import annotations

import json
import math
from typing import Any

import numpy as np

from ..params import resolve
from .model import GbtModel
from .tree import Tree

#: Objectives of the two formats, by their names there.
XGBOOST = {"reg:squarederror": "regression", "reg:absoluteerror": "regression_l1", "binary:logistic": "binary", "reg:logistic": "cross_entropy", "multi:softprob": "multiclass", "multi:softmax": "multiclass", "count:poisson": "poisson", "reg:gamma": "gamma", "reg:tweedie": "tweedie", "rank:ndcg": "lambdarank", "rank:pairwise": "lambdarank"}
CATBOOST = {"RMSE": "regression", "MAE": "regression_l1", "Logloss": "binary", "CrossEntropy": "cross_entropy", "MultiClass": "multiclass", "Poisson": "poisson", "Quantile": "quantile"}


def _load(source: str | dict) -> dict[str, Any]:
    if isinstance(source, dict):
        return source
    with open(source, encoding="utf-8") as f:
        return json.load(f)


def _build(children: dict[int, tuple[int, int]], split: dict[int, tuple[int, float, bool, str]], value: dict[int, float], weight: dict[int, float], root: int) -> Tree:
    """A tree of nodes by any numbers; those without children are leaves."""
    tree = Tree(leaf_value=[], leaf_weight=[], leaf_count=[])
    code: dict[int, int] = {}
    order = [root]
    for n in order:
        if n in children:
            code[n] = len(tree.feature)
            feature, threshold, default_left, missing = split[n]
            tree.feature.append(feature)
            tree.threshold.append(threshold)
            tree.categories.append(None)
            tree.default_left.append(default_left)
            tree.missing.append(missing)
            tree.gain.append(1.0)
            tree.node_value.append(value.get(n, 0.0))
            tree.node_weight.append(weight.get(n, 0.0))
            tree.node_count.append(int(weight.get(n, 0.0)))
            order += children[n]
        else:
            code[n] = ~len(tree.leaf_value)
            tree.leaf_value.append(value[n])
            tree.leaf_weight.append(weight.get(n, 0.0))
            tree.leaf_count.append(int(weight.get(n, 0.0)))
    inner = [n for n in order if n in children]
    tree.left, tree.right = [code[children[n][0]] for n in inner], [code[children[n][1]] for n in inner]
    return tree


def from_xgboost(source: str | dict) -> GbtModel:
    """There a value goes left if it is below the threshold, compared in single precision; missing values have a side of their own.

    Boosters of trees are read, with the weights that dropout gave them; start values may be one for all classes or one each.
    """
    learner = _load(source)["learner"]
    booster = learner["gradient_booster"]
    if booster.get("name", "gbtree") not in ("gbtree", "dart"):
        raise ValueError(f"not a booster of trees: {booster['name']}")
    body = booster.get("gbtree", booster)["model"]
    weights = booster.get("weight_drop") or [1.0] * len(body["trees"])
    params = learner["learner_model_param"]
    if int(params.get("num_target", 1)) > 1 or any(int(t.get("tree_param", {}).get("size_leaf_vector", 1)) > 1 for t in body["trees"]):
        raise ValueError("models of several targets are not supported")
    name = learner["objective"]["name"]
    if name not in XGBOOST:
        raise ValueError(f"no such objective here: {name}")
    k = max(1, int(params.get("num_class", 0)))
    count = int(params["num_feature"])
    names = learner.get("feature_names") or [f"Column_{i}" for i in range(count)]
    by_class: list[list[Tree]] = [[] for _ in range(k)]
    for raw, at, weight in zip(body["trees"], body["tree_info"], weights, strict=True):
        if any(raw.get("split_type", [])):
            raise ValueError("categorical splits are not supported")
        left, right = raw["left_children"], raw["right_children"]
        inner = [i for i in range(len(left)) if left[i] >= 0]
        below = lambda t: float(np.nextafter(np.float32(t), np.float32(-math.inf)))
        split = {i: (raw["split_indices"][i], below(raw["split_conditions"][i]), bool(raw["default_left"][i]), "nan") for i in inner}
        value = {i: float(raw["base_weights"][i] if left[i] >= 0 else raw["split_conditions"][i]) for i in range(len(left))}
        by_class[at].append(_build({i: (left[i], right[i]) for i in inner}, split, value, dict(enumerate(raw.get("sum_hessian", []))), 0))
        by_class[at][-1].scale(float(weight))
    given = params.get("base_score", 0)
    bases = [float(x) for x in (given if isinstance(given, list) else str(given).strip("[]").split(","))]
    kind = XGBOOST[name]
    link = {"binary": lambda x: math.log(x / (1 - x)) if 0 < x < 1 else x, "poisson": lambda x: math.log(x) if x > 0 else x}
    link |= {"cross_entropy": link["binary"], "gamma": link["poisson"], "tweedie": link["poisson"]}
    for c, trees in enumerate(by_class):
        if trees:
            trees[0].shift(link.get(kind, float)(bases[c % len(bases)]))
    return GbtModel([t for step in zip(*by_class, strict=True) for t in step], resolve(objective=kind, num_class=k), names, k)


def from_catboost(source: str | dict) -> GbtModel:
    """Trees there ask the same question at each level; bit i of a leaf's number tells whether the i-th one's value is above its border."""
    data = _load(source)
    floats = data["features_info"].get("float_features", [])
    names = [f.get("feature_id") or f"Column_{f['flat_feature_index']}" for f in floats]
    side = {f["feature_index"]: {"AsFalse": True, "AsTrue": False}.get(f.get("nan_value_treatment", "AsIs")) for f in floats}
    loss = data.get("model_info", {}).get("params", {}).get("loss_function", {}).get("type", "RMSE")
    if loss not in CATBOOST:
        raise ValueError(f"no such loss here: {loss}")
    trees: list[Tree] = []
    k = 1
    scale, bias = data.get("scale_and_bias", [1.0, [0.0]])
    for raw in data["oblivious_trees"]:
        depth = len(raw["splits"])
        k = len(raw["leaf_values"]) >> depth
        for c in range(k):
            children, split, value = {}, {}, {}
            for level in range(depth):
                question = raw["splits"][depth - 1 - level]
                if question.get("split_type", "FloatFeature") != "FloatFeature":
                    raise ValueError("only splits of numerical features are supported")
                f = question["float_feature_index"]
                for n in range(1 << level, 2 << level):
                    children[n] = 2 * n, 2 * n + 1
                    split[n] = f, float(np.float32(question["border"])), bool(side.get(f, True)) if side.get(f) is not None else True, "nan"
            for leaf in range(1 << depth):
                value[(1 << depth) + leaf] = scale * raw["leaf_values"][leaf * k + c]
            trees.append(_build(children, split, value, {}, 1))
    for c, t in enumerate(trees[:k]):
        t.shift(bias[c] if c < len(bias) else 0.0)
    return GbtModel(trees, resolve(objective=CATBOOST[loss], num_class=k), names, k)
