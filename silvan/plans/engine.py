"""train() and cv(): the loops around a Booster."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import functions as F

from ..operators.metrics import higher_is_better
from ..params import Params, resolve
from .boosting import Booster
from .dataset import GbtDataset
from .model import GbtModel

log = logging.getLogger("silvan")


class EarlyStop(Exception):
    def __init__(self, iteration: int, score: list):
        super().__init__(iteration)
        self.iteration, self.score = iteration, score


@dataclass
class CallbackEnv:
    model: Any
    params: Params
    iteration: int
    begin_iteration: int
    end_iteration: int
    evaluation_result_list: list[tuple] | None


def log_evaluation(period: int = 1) -> Callable[[CallbackEnv], None]:
    def call(env: CallbackEnv) -> None:
        if period > 0 and env.evaluation_result_list and (env.iteration + 1) % period == 0:
            log.info("[%d] %s", env.iteration + 1, "  ".join(f"{d}'s {m}: {v:g}" for d, m, v, *_ in env.evaluation_result_list))

    call.order = 10
    return call


def record_evaluation(into: dict) -> Callable[[CallbackEnv], None]:
    def call(env: CallbackEnv) -> None:
        if env.iteration == env.begin_iteration:
            into.clear()
        for data, metric, value, *_ in env.evaluation_result_list or []:
            into.setdefault(data, {}).setdefault(metric, []).append(value)

    call.order = 20
    return call


def reset_parameter(**schedule: list | Callable[[int], Any]) -> Callable[[CallbackEnv], None]:
    """Parameters of each iteration, as lists or functions of its number."""

    def call(env: CallbackEnv) -> None:
        at = env.iteration - env.begin_iteration
        new = {k: v[at] if isinstance(v, list) else v(at) for k, v in schedule.items()}
        env.model.p = resolve(env.model.p, **new)
        env.model.gradients.p = env.model.gradients.p.with_(**new)

    call.order, call.before_iteration = 10, True
    return call


def early_stopping(rounds: int, first_metric_only: bool = False, min_delta: float = 0.0, min_iterations: int = 0) -> Callable[[CallbackEnv], None]:
    """Stops when none of a validation set's metrics has become better by min_delta for `rounds` evaluations."""
    best: dict[tuple, tuple[float, int, list]] = {}
    seen = [0]

    def call(env: CallbackEnv) -> None:
        found = [r for r in env.evaluation_result_list or [] if r[0] != "training"]
        seen[0] += 1
        first = found[0][1].partition("@")[0] if found else None
        for data, metric, value, higher, *_ in found:
            key, sign = (data, metric), 1 if higher else -1
            if key not in best or sign * value > sign * best[key][0] + min_delta:
                best[key] = value, env.iteration, list(env.evaluation_result_list)
                continue
            if first_metric_only and metric.partition("@")[0] != first or env.iteration + 1 < min_iterations:
                continue
            if env.iteration - best[key][1] >= rounds or env.iteration == env.end_iteration - 1:
                raise EarlyStop(best[key][1], best[key][2])

    call.order = 30
    return call


def train(params: dict | Params, train_set: GbtDataset, num_boost_round: int | None = None, valid_sets: list[GbtDataset] = (), valid_names: list[str] = (), feval: Callable | None = None, init_model: GbtModel | str | None = None, callbacks: list[Callable] = (), eval_freq: int = 1, keep_booster: bool = False) -> GbtModel | Booster:
    """A model of train_set. Scores of init_model, if given, are what training starts from; its trees come first in the result."""
    p = resolve(params, **({"num_iterations": num_boost_round} if num_boost_round else {}))
    if isinstance(init_model, str):
        init_model = GbtModel.load(init_model)
    if init_model is not None:
        train_set = _with_scores(train_set, init_model)
        valid_sets = [_with_scores(v, init_model) for v in valid_sets]
    booster = Booster(p, train_set, init_model)
    names = list(valid_names) or [f"valid_{i}" for i in range(len(valid_sets))]
    for name, data in zip(names, valid_sets, strict=True):
        if data is not train_set:
            booster.add_valid(data, name)
    calls = list(callbacks)
    if p.early_stopping_round > 0 and p.boosting != "dart":
        calls.append(early_stopping(p.early_stopping_round, p.first_metric_only, p.early_stopping_min_delta))
    before = sorted((c for c in calls if getattr(c, "before_iteration", False)), key=lambda c: getattr(c, "order", 0))
    after = sorted((c for c in calls if not getattr(c, "before_iteration", False)), key=lambda c: getattr(c, "order", 0))
    watched = [n for n, v in zip(names, valid_sets, strict=True) if v is not train_set]
    if any(v is train_set for v in valid_sets) or p.is_provide_training_metric:
        watched.insert(0, "training")
    best = -1
    for i in range(p.num_iterations):
        env = CallbackEnv(booster, booster.p, i, 0, p.num_iterations, None)
        for c in before:
            c(env)
        stopped = booster.update()
        if (watched or feval) and after and (i + 1) % eval_freq == 0:
            env.evaluation_result_list = [r for n in watched for r in booster.evaluate(n, feval)]
        try:
            for c in after:
                c(env)
        except EarlyStop as e:
            best = e.iteration + 1
            for data, metric, value, *_ in e.score:
                booster.model.best_score.setdefault(data, {})[metric] = value
            break
        if p.snapshot_freq > 0 and (i + 1) % p.snapshot_freq == 0 and p.output_model:
            booster.model.save(f"{p.output_model}.snapshot_iter_{i + 1}")
        if stopped:
            break
    model = booster.model
    model.params = booster.p
    if init_model is not None:
        booster.model = model = GbtModel([*init_model.trees, *model.trees], model.params, model.features, model.k, model.bins)
        best += init_model.current_iteration() if best > 0 else 0
    model.best_iteration = best
    return booster if keep_booster else model


def _with_scores(data: GbtDataset, model: GbtModel) -> GbtDataset:
    """The dataset with a model's raw scores as start scores."""
    scored = model.predict(data.df, "raw", "silvan_start")
    out = GbtDataset(scored, data.label, data.weight, data.group, "silvan_start", data.position, data.features, sorted(data.categorical), data.row_key, data.order, None, data.reference, data.params)
    out._bins = data._bins
    return out


def folds(data: GbtDataset, n: int, stratified: bool, seed: int, column: str = "silvan_fold") -> Any:
    """The frame with a fold number: by query, by place within the label in a random order, or by hash."""
    from ..operators import sampling

    if data.group:
        return data.df.withColumn(column, sampling.group_fold(F.col(data.group), n, seed))
    key = [F.col(f"`{c}`") for c in ([data.row_key] if data.row_key else [*data.features, data.label])]
    if stratified:
        return sampling.stratified_folds(data.df, F.col(data.label), key, n, seed, column)
    return data.df.withColumn(column, F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(n)).cast("int"))


def cv(params: dict | Params, train_set: GbtDataset, num_boost_round: int | None = None, nfold: int = 5, stratified: bool = True, fold: list[tuple[Any, Any]] | None = None, feval: Callable | None = None, fpreproc: Callable | None = None, seed: int = 0, callbacks: list[Callable] = (), eval_train: bool = False, return_models: bool = False) -> dict[str, Any]:
    """Mean and (population) standard deviation of each metric over folds, for every iteration."""
    p = resolve(params, **({"num_iterations": num_boost_round} if num_boost_round else {}))
    label_is_class = isinstance(p.objective, str) and p.objective in ("binary", "multiclass", "multiclassova")
    pairs = fold
    if pairs is None:
        numbered = folds(train_set, nfold, stratified and label_is_class, seed).persist()
        pairs = [(numbered.where(F.col("silvan_fold") != i).drop("silvan_fold"), numbered.where(F.col("silvan_fold") == i).drop("silvan_fold")) for i in range(nfold)]
    boosters = []
    for train_df, test_df in pairs:
        data = GbtDataset(train_df, train_set.label, train_set.weight, train_set.group, train_set.init_score, train_set.position, train_set.features, sorted(train_set.categorical), train_set.row_key, train_set.order, None, None, p)
        test = data.create_valid(test_df)
        own = p
        if fpreproc:
            data, test, own = fpreproc(data, test, p)
        b = Booster(own, data)
        b.add_valid(test, "valid")
        boosters.append(b)
    out: dict[str, list[float]] = {}
    calls = [*callbacks, *([early_stopping(p.early_stopping_round, p.first_metric_only, p.early_stopping_min_delta)] if p.early_stopping_round > 0 else [])]
    best = -1
    for i in range(p.num_iterations):
        for b in boosters:
            if not b.stopped:
                b.update()
        each = [[r for n in (["training"] if eval_train else []) + ["valid"] for r in b.evaluate(n, feval)] for b in boosters]
        merged = []
        for place, (data, metric, *_) in enumerate(each[0]):
            values = [e[place][2] for e in each]
            merged.append((data, metric, float(np.mean(values)), each[0][place][3] if len(each[0][place]) > 3 else higher_is_better(metric), float(np.std(values))))
            out.setdefault(f"{data} {metric}-mean", []).append(merged[-1][2])
            out.setdefault(f"{data} {metric}-stdv", []).append(merged[-1][4])
        try:
            for c in sorted(calls, key=lambda c: getattr(c, "order", 0)):
                c(CallbackEnv(boosters, p, i, 0, p.num_iterations, merged))
        except EarlyStop as e:
            best = e.iteration + 1
            break
    if best > 0:
        out = {k: v[:best] for k, v in out.items()}
        for b in boosters:
            b.model.best_iteration = best
    return {**out, "models": [b.model for b in boosters]} if return_models else out
