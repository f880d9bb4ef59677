"""Parameters: names, aliases, defaults and the rules between them."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field, fields, replace
from typing import Any

log = logging.getLogger("silvan")

#: Aliases of parameters (fixed values of the interface).
ALIASES: dict[str, tuple[str, ...]] = {
    "num_grad_quant_bins": ("quant_bins",),
    "task": ("task_type",),
    "objective": ("objective_type", "app", "application", "loss"),
    "boosting": ("boosting_type", "boost"),
    "data": ("train", "train_data", "train_data_file", "data_filename"),
    "valid": ("test", "valid_data", "valid_data_file", "test_data", "test_data_file", "valid_filenames"),
    "num_iterations": ("num_iteration", "n_iter", "num_tree", "num_trees", "num_round", "num_rounds", "nrounds", "num_boost_round", "n_estimators", "max_iter"),
    "learning_rate": ("shrinkage_rate", "eta"),
    "num_leaves": ("num_leaf", "max_leaves", "max_leaf", "max_leaf_nodes"),
    "seed": ("random_seed", "random_state"),
    "min_data_in_leaf": ("min_data_per_leaf", "min_data", "min_child_samples", "min_samples_leaf"),
    "min_sum_hessian_in_leaf": ("min_sum_hessian_per_leaf", "min_sum_hessian", "min_hessian", "min_child_weight"),
    "bagging_fraction": ("sub_row", "subsample", "bagging"),
    "pos_bagging_fraction": ("pos_sub_row", "pos_subsample", "pos_bagging"),
    "neg_bagging_fraction": ("neg_sub_row", "neg_subsample", "neg_bagging"),
    "bagging_freq": ("subsample_freq",),
    "bagging_seed": ("bagging_fraction_seed",),
    "feature_fraction": ("sub_feature", "colsample_bytree"),
    "feature_fraction_bynode": ("sub_feature_bynode", "colsample_bynode"),
    "extra_trees": ("extra_tree",),
    "early_stopping_round": ("early_stopping_rounds", "early_stopping", "n_iter_no_change"),
    "max_delta_step": ("max_tree_output", "max_leaf_output"),
    "lambda_l1": ("reg_alpha", "l1_regularization"),
    "lambda_l2": ("reg_lambda", "lambda", "l2_regularization"),
    "min_gain_to_split": ("min_split_gain",),
    "drop_rate": ("rate_drop",),
    "top_k": ("topk",),
    "monotone_constraints": ("mc", "monotone_constraint", "monotonic_cst"),
    "monotone_constraints_method": ("monotone_constraining_method", "mc_method"),
    "monotone_penalty": ("monotone_splits_penalty", "ms_penalty", "mc_penalty"),
    "feature_contri": ("feature_contrib", "fc", "fp", "feature_penalty"),
    "forcedsplits_filename": ("fs", "forced_splits_filename", "forced_splits_file", "forced_splits"),
    "verbosity": ("verbose",),
    "input_model": ("model_input", "model_in"),
    "output_model": ("model_output", "model_out"),
    "snapshot_freq": ("save_period",),
    "linear_tree": ("linear_trees",),
    "max_bin": ("max_bins",),
    "bin_construct_sample_cnt": ("subsample_for_bin",),
    "data_random_seed": ("data_seed",),
    "header": ("has_header",),
    "label_column": ("label",),
    "weight_column": ("weight",),
    "group_column": ("group", "group_id", "query_column", "query", "query_id"),
    "ignore_column": ("ignore_feature", "blacklist"),
    "categorical_feature": ("cat_feature", "categorical_column", "cat_column", "categorical_features"),
    "num_class": ("num_classes",),
    "is_unbalance": ("unbalance", "unbalanced_sets"),
    "metric": ("metrics", "metric_types"),
    "metric_freq": ("output_freq",),
    "eval_at": ("ndcg_eval_at", "ndcg_at", "map_eval_at", "map_at"),
    "output_result": ("predict_result", "prediction_result", "predict_name", "prediction_name", "pred_name", "name_pred"),
    "predict_raw_score": ("is_predict_raw_score", "predict_rawscore", "raw_score"),
    "predict_leaf_index": ("is_predict_leaf_index", "leaf_index"),
    "predict_contrib": ("is_predict_contrib", "contrib"),
}
#: Aliases of objectives and metrics (fixed values of the interface).
OBJECTIVE_ALIASES: dict[str, tuple[str, ...]] = {
    "regression": ("regression_l2", "l2", "mean_squared_error", "mse", "l2_root", "root_mean_squared_error", "rmse"),
    "regression_l1": ("l1", "mean_absolute_error", "mae"),
    "mape": ("mean_absolute_percentage_error",),
    "multiclass": ("softmax",),
    "multiclassova": ("multiclass_ova", "ova", "ovr"),
    "cross_entropy": ("xentropy",),
    "cross_entropy_lambda": ("xentlambda",),
    "rank_xendcg": ("xendcg", "xe_ndcg", "xe_ndcg_mart", "xendcg_mart"),
    "custom": ("none", "null", "na"),
}
METRIC_ALIASES: dict[str, tuple[str, ...]] = {
    "l1": ("mean_absolute_error", "mae", "regression_l1"),
    "l2": ("mean_squared_error", "mse", "regression_l2", "regression"),
    "rmse": ("root_mean_squared_error", "l2_root"),
    "mape": ("mean_absolute_percentage_error",),
    "ndcg": ("lambdarank", "rank_xendcg", "xendcg", "xe_ndcg", "xe_ndcg_mart", "xendcg_mart"),
    "map": ("mean_average_precision",),
    "binary_logloss": ("binary",),
    "multi_logloss": ("multiclass", "softmax", "multiclassova", "multiclass_ova", "ova", "ovr"),
    "cross_entropy": ("xentropy",),
    "cross_entropy_lambda": ("xentlambda",),
    "kullback_leibler": ("kldiv",),
    "multi_rmse": ("multi_regression",),
}
#: Parameters that name a device, threads or a network: accepted, without effect on a cluster.
IGNORED = frozenset("tree_learner tree tree_type device_type device num_threads num_thread nthread nthreads n_jobs deterministic force_col_wise force_row_wise histogram_pool_size hist_pool_size is_enable_sparse is_sparse enable_sparse sparse enable_bundle is_enable_bundle bundle pre_partition two_round precise_float_parser num_machines local_listen_port time_out machines gpu_platform_id gpu_device_id gpu_use_dp num_gpu".split())


@dataclass
class Params:
    task: str = "train"
    objective: Any = "regression"
    boosting: str = "gbdt"
    data_sample_strategy: str = "bagging"
    data: str = ""
    valid: list[str] = field(default_factory=list)
    num_iterations: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    seed: int = 0
    max_depth: int = -1
    min_data_in_leaf: int = 20
    min_sum_hessian_in_leaf: float = 1e-3
    bagging_fraction: float = 1.0
    pos_bagging_fraction: float = 1.0
    neg_bagging_fraction: float = 1.0
    bagging_freq: int = 0
    bagging_seed: int = 3
    bagging_by_query: bool = False
    feature_fraction: float = 1.0
    feature_fraction_bynode: float = 1.0
    feature_fraction_seed: int = 2
    extra_trees: bool = False
    extra_seed: int = 6
    early_stopping_round: int = 0
    early_stopping_min_delta: float = 0.0
    first_metric_only: bool = False
    max_delta_step: float = 0.0
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    linear_lambda: float = 0.0
    min_gain_to_split: float = 0.0
    drop_rate: float = 0.1
    max_drop: int = 50
    skip_drop: float = 0.5
    xgboost_dart_mode: bool = False
    uniform_drop: bool = False
    drop_seed: int = 4
    top_rate: float = 0.2
    other_rate: float = 0.1
    min_data_per_group: int = 100
    max_cat_threshold: int = 32
    cat_l2: float = 10.0
    cat_smooth: float = 10.0
    max_cat_to_onehot: int = 4
    top_k: int = 20
    monotone_constraints: list[int] = field(default_factory=list)
    monotone_constraints_method: str = "basic"
    monotone_penalty: float = 0.0
    feature_contri: list[float] = field(default_factory=list)
    forcedsplits_filename: str = ""
    use_quantized_grad: bool = False
    quant_mode: str = "auto"
    num_grad_quant_bins: int = 0
    quant_train_renew_leaf: bool = False
    stochastic_rounding: bool = True
    refit_decay_rate: float = 0.9
    cegb_tradeoff: float = 1.0
    cegb_penalty_split: float = 0.0
    cegb_penalty_feature_lazy: list[float] = field(default_factory=list)
    cegb_penalty_feature_coupled: list[float] = field(default_factory=list)
    path_smooth: float = 0.0
    interaction_constraints: Any = ""
    verbosity: int = 1
    input_model: str = ""
    output_model: str = "model.txt"
    saved_feature_importance_type: int = 0
    snapshot_freq: int = -1
    linear_tree: bool = False
    max_bin: int = 255
    max_bin_by_feature: list[int] = field(default_factory=list)
    min_data_in_bin: int = 3
    bin_construct_sample_cnt: int = 200_000
    data_random_seed: int = 1
    use_missing: bool = True
    zero_as_missing: bool = False
    feature_pre_filter: bool = True
    header: bool = False
    label_column: str = ""
    weight_column: str = ""
    group_column: str = ""
    ignore_column: str = ""
    categorical_feature: Any = ""
    forcedbins_filename: str = ""
    start_iteration_predict: int = 0
    num_iteration_predict: int = -1
    predict_raw_score: bool = False
    predict_leaf_index: bool = False
    predict_contrib: bool = False
    pred_early_stop: bool = False
    pred_early_stop_freq: int = 10
    pred_early_stop_margin: float = 10.0
    output_result: str = "predictions"
    num_class: int = 1
    is_unbalance: bool = False
    scale_pos_weight: float = 1.0
    sigmoid: float = 1.0
    boost_from_average: bool = True
    reg_sqrt: bool = False
    alpha: float = 0.9
    fair_c: float = 1.0
    poisson_max_delta_step: float = 0.7
    tweedie_variance_power: float = 1.5
    lambdarank_truncation_level: int = 30
    lambdarank_norm: bool = True
    lambdarank_position_bias_regularization: float = 0.0
    label_gain: list[float] = field(default_factory=list)
    objective_seed: int = 5
    metric: Any = ""
    metric_freq: int = 1
    is_provide_training_metric: bool = False
    eval_at: list[int] = field(default_factory=lambda: [1, 2, 3, 4, 5])
    multi_error_top_k: int = 1
    auc_mu_weights: list[float] = field(default_factory=list)
    #: Weights of label 0 and 1; follows from is_unbalance and scale_pos_weight.
    label_weights: tuple[float, float] = (1.0, 1.0)
    #: Whether bins' counts are taken from their hessians, as the reference does, or exactly.
    count_mode: str = "hessian"
    #: Trees after which the rows' scores are written anew.
    refresh: int = 8

    @property
    def trees_per_iteration(self) -> int:
        return self.num_class if self.objective in ("multiclass", "multiclassova", "multi_regression") or callable(self.objective) else 1

    def with_(self, **changes: Any) -> Params:
        return replace(self, **changes)


_NAME_OF = {alias: name for name, aliases in ALIASES.items() for alias in (name, *aliases)}
_OBJECTIVE_OF = {alias: name for name, aliases in OBJECTIVE_ALIASES.items() for alias in (name, *aliases)}
_METRIC_OF = {alias: name for name, aliases in METRIC_ALIASES.items() for alias in (name, *aliases)}


def canonical_objective(name: str) -> str:
    return _OBJECTIVE_OF.get(name, name)


def canonical_metric(name: str) -> str:
    """'ndcg@3' keeps its cut."""
    head, at, tail = name.strip().partition("@")
    return _METRIC_OF.get(head, head) + at + tail


def _value(kind: str, value: Any) -> Any:
    if not isinstance(value, str):
        return list(value) if kind.startswith("list") and not isinstance(value, list) else value
    if kind == "bool":
        return value.strip().lower() in ("true", "1", "+", "yes")
    if kind == "int":
        return int(float(value))
    if kind == "float":
        return float(value)
    if kind.startswith("list"):
        inner = {"list[int]": int, "list[float]": float}.get(kind, str)
        return [inner(x) for x in value.replace(";", ",").split(",") if x.strip()]
    return value


def resolve(given: dict[str, Any] | Params | None = None, **more: Any) -> Params:
    """Parameters from names or aliases; the first of several names for one parameter, in their own order, wins.

    Strings are read as their parameter's type. Unknown names are left out with a warning.
    """
    if isinstance(given, Params):
        return _checked(given.with_(**more))
    kinds = {f.name: str(f.type) for f in fields(Params)}
    found: dict[str, Any] = {}
    for key, value in {**(given or {}), **more}.items():
        name = _NAME_OF.get(key, key)
        if name in kinds and value is not None:
            if name not in found or key == name:
                found[name] = _value(kinds[name], value)
        elif key not in IGNORED:
            log.warning("unknown parameter %s", key)
    if "seed" in found:
        found = seeds_of(found["seed"]) | found
    return _checked(Params(**found))


#: Fixed values of the generator that a master seed starts, the seeds that it gives in their order, and their bound.
MULTIPLIER, INCREMENT, SEEDS, SEED_BOUND = 214013, 2531011, ("data_random_seed", "bagging_seed", "drop_seed", "feature_fraction_seed", "objective_seed", "extra_seed"), 32767


def seeds_of(seed: int) -> dict[str, int]:
    """The seeds that follow from a master seed. Each step's upper bits, 15 of them, give one."""
    out, state = {}, seed
    for name in SEEDS:
        state = (MULTIPLIER * state + INCREMENT) % 2**32
        out[name] = (state // 2**16) % 2**15 % SEED_BOUND
    return out


def _checked(p: Params) -> Params:
    """Rules between parameters; raises ValueError where they contradict each other."""
    out: dict[str, Any] = {}
    if isinstance(p.objective, str):
        out["objective"] = canonical_objective(p.objective)
    objective = out.get("objective", p.objective)
    if p.boosting in ("goss",):
        out |= {"boosting": "gbdt", "data_sample_strategy": "goss"}
    out["boosting"] = {"random_forest": "rf", "gbrt": "gbdt"}.get(out.get("boosting", p.boosting), out.get("boosting", p.boosting))
    if out["boosting"] not in ("gbdt", "rf", "dart"):
        raise ValueError(f"unknown boosting {p.boosting}")
    if objective in ("multiclass", "multiclassova") and p.num_class <= 1:
        raise ValueError("num_class must be above 1 for a multiclass objective")
    if objective not in ("multiclass", "multiclassova", "multi_regression", "custom") and not callable(objective) and p.num_class != 1:
        raise ValueError("num_class must be 1 for an objective of one score")
    if out["boosting"] == "rf" and not (p.bagging_freq > 0 and 0 < p.bagging_fraction < 1 or 0 < p.feature_fraction < 1):
        raise ValueError("a random forest needs bagging or feature sampling")
    if p.is_unbalance and p.scale_pos_weight != 1.0:
        raise ValueError("is_unbalance and scale_pos_weight exclude each other")
    if p.num_leaves < 2:
        raise ValueError("num_leaves must be at least 2")
    if p.max_bin < 2:
        raise ValueError("max_bin must be at least 2")
    if p.path_smooth > 0 and p.min_data_in_leaf < 2:
        out["min_data_in_leaf"] = 2
    if p.linear_tree and objective == "regression_l1":
        raise ValueError("linear trees don't go with the l1 objective")
    if 0 < p.max_depth < 31 and (1 << p.max_depth) < p.num_leaves:
        out["num_leaves"] = 1 << p.max_depth
    out["eval_at"] = sorted(p.eval_at)
    return p.with_(**out)


def alias_table() -> str:
    """All names and aliases as JSON."""
    return json.dumps({f.name: list(ALIASES.get(f.name, ())) for f in fields(Params)}, indent=1)


def default_label_gain(count: int = 31) -> list[float]:
    """2 ** grade - 1."""
    return [float((1 << i) - 1) for i in range(count)]


def metrics_of(p: Params) -> list[str]:
    """The metrics asked for, or the objective's own."""
    from .functions.objectives import OBJECTIVES

    asked = p.metric.split(",") if isinstance(p.metric, str) else list(p.metric or [])
    asked = [canonical_metric(m) for m in asked if m and str(m).strip()]
    if not asked:
        own = {"multiclass": "multi_logloss", "multiclassova": "multi_logloss", "lambdarank": "ndcg", "rank_xendcg": "ndcg", "multi_regression": "multi_rmse"}
        if not isinstance(p.objective, str) or p.objective == "custom":
            return []
        asked = [own.get(p.objective) or OBJECTIVES[p.objective].metric]
    out = []
    for m in asked:
        if m in ("ndcg", "map"):
            out += [f"{m}@{k}" for k in p.eval_at]
        elif m not in ("none", "null", "custom", "na"):
            out.append(m)
    return list(dict.fromkeys(out))
