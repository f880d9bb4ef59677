import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from silvan.plans.dataset import GbtDataset
from silvan.plans.engine import cv, early_stopping, record_evaluation, train
from silvan.plans.model import GbtModel

from . import naive


def frame(spark, x, y, parts=2, **more):
    data = pd.DataFrame(np.atleast_2d(x.T).T, columns=[f"x{i}" for i in range(1 if x.ndim == 1 else x.shape[1])]).assign(label=y, **more)
    return spark.createDataFrame(data).repartition(parts)


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(600, 4)).round(2)
    y = 2 * x[:, 0] - np.abs(x[:, 1]) + (x[:, 2] > 0) * x[:, 3] + draw.normal(scale=0.1, size=600)
    return x, y, frame(spark, x, y).persist()


SMALL = {"min_data_in_leaf": 1, "min_data_in_bin": 1, "learning_rate": 1.0, "num_iterations": 1}


def test_one_split(spark):
    x = np.arange(8.0)
    model = train({**SMALL, "num_leaves": 2}, GbtDataset(frame(spark, x, (x > 3).astype(float)), "label"))
    t = model.trees[0]
    assert t.threshold[0] == np.nextafter(3.5, np.inf) and t.leaf_value == pytest.approx([0.0, 1.0]) and t.leaf_count == [4, 4]


def test_only_missing_values_tell(spark):
    x = np.where(np.arange(100) % 2 == 0, 0.0, np.nan)
    data = frame(spark, x, np.isnan(x).astype(float))
    model = train({"num_iterations": 20, "min_data_in_leaf": 1, "min_data_in_bin": 1, "learning_rate": 0.3}, GbtDataset(data, "label"))
    assert model.predict(data).select(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0] < 0.005


def test_alternating_categories_need_one_split(spark):
    x = np.tile(np.arange(8.0), 4)
    model = train({**SMALL, "num_leaves": 2, "min_data_per_group": 1, "cat_smooth": 0, "cat_l2": 0, "max_cat_to_onehot": 1}, GbtDataset(frame(spark, x, x % 2), "label", categorical=["x0"]))
    assert np.allclose(model.local(x[:, None])[:, 0], x % 2) and model.trees[0].leaves == 2 and model.trees[0].categories[0] is not None


def test_constant_feature_predicts_the_mean(spark):
    model = train({}, GbtDataset(frame(spark, np.ones(30), np.arange(30.0)), "label"))
    assert model.local(np.ones((1, 1)))[0, 0] == pytest.approx(14.5) and len(model.trees) == 1


def test_ties_go_to_the_first_feature(spark):
    x = np.arange(20.0)
    assert train({**SMALL, "num_leaves": 2}, GbtDataset(frame(spark, np.stack([x, x], 1), (x > 9).astype(float)), "label")).trees[0].feature == [0]


@pytest.mark.parametrize(("leaves", "l2"), [(8, 0.0), (15, 1.0)])
def test_structure_of_a_plain_learner(spark, table, leaves, l2):
    x, y, df = table
    data = GbtDataset(df, "label", params={"max_bin": 16})
    model = train({"num_iterations": 1, "learning_rate": 1.0, "num_leaves": leaves, "min_data_in_leaf": 10, "max_bin": 16, "lambda_l2": l2}, data)
    bins = np.stack([f.to_bins(x[:, i]) for i, f in enumerate(data.bins.features)], 1)
    leaf, values = naive.grow(bins, [f.bins for f in data.bins.features], y.mean() - y, np.ones(len(y)), leaves, 10, l2)
    assert np.array_equal(model.trees[0].leaf_of(x), leaf)
    assert np.allclose(np.array(model.trees[0].leaf_value), values + y.mean(), atol=1e-9)


def test_partitions_and_order_don_t_matter(spark, table):
    x, y, _ = table
    p = {"num_iterations": 3, "num_leaves": 7, "bagging_fraction": 0.6, "bagging_freq": 1}
    want = train(p, GbtDataset(frame(spark, x, y, 1), "label")).local(x)
    order = np.random.default_rng(1).permutation(len(y))
    assert np.allclose(want, train(p, GbtDataset(frame(spark, x[order], y[order], 5), "label")).local(x), atol=1e-9)


def test_training_scores_are_predictions(spark, table):
    x, y, df = table
    booster = train({"num_iterations": 11, "num_leaves": 7, "refresh": 4, "metric": "l2", "feature_fraction": 0.6}, GbtDataset(df, "label"), keep_booster=True)
    value = booster.evaluate()[0][2]
    assert value == pytest.approx(((booster.model.local(x)[:, 0] - y) ** 2).mean()) and value < 0.6 * y.var()
    booster.rollback()
    assert booster.evaluate()[0][2] == pytest.approx(((booster.model.local(x)[:, 0] - y) ** 2).mean())


@pytest.mark.parametrize(("objective", "more"), [("regression_l1", {}), ("huber", {}), ("fair", {}), ("quantile", {"alpha": 0.5}), ("mape", {}), ("poisson", {}), ("gamma", {}), ("tweedie", {}), ("binary", {}), ("cross_entropy", {}), ("cross_entropy_lambda", {})])
def test_objectives_lower_their_loss(spark, table, objective, more):
    x, y, _ = table
    label = {"binary": y > 0, "cross_entropy": 1 / (1 + np.exp(-y)), "cross_entropy_lambda": 1 / (1 + np.exp(-y))}.get(objective, np.exp(y / 3) + 0.1)
    data = GbtDataset(frame(spark, x, np.asarray(label, float)), "label")
    first = train({"objective": objective, "num_iterations": 1, "num_leaves": 7, **more}, data, keep_booster=True)
    before = first.evaluate()[0][2]
    for _ in range(5):
        first.update()
    assert first.evaluate()[0][2] < before
    assert np.allclose(first.scored(raw=True).select(F.sum(F.element_at("s", 1))).first()[0], first.model.local(x, "raw").sum())


def test_leaf_percentiles_are_exact(spark, table):
    x, y, df = table
    model = train({"objective": "regression_l1", "num_iterations": 1, "learning_rate": 1.0, "num_leaves": 5}, GbtDataset(df, "label"))
    leaf = model.trees[0].leaf_of(x)
    assert np.allclose(model.trees[0].leaf_value, [np.median(y[leaf == i]) for i in range(5)])


@pytest.mark.parametrize("objective", ["multiclass", "multiclassova"])
def test_classes(spark, table, objective):
    x, y, _ = table
    c = np.digitize(y, [-1, 1]).astype(float)
    model = train({"objective": objective, "num_class": 3, "num_iterations": 8, "num_leaves": 7}, GbtDataset(frame(spark, x, c), "label"))
    assert (model.local(x).argmax(1) == c).mean() > 0.8 and len(model.trees) == 24
    if objective == "multiclass":
        assert np.allclose(model.local(x).sum(1), 1)


@pytest.mark.parametrize("more", [{"boosting": "rf", "bagging_freq": 1, "bagging_fraction": 0.7}, {"boosting": "dart", "skip_drop": 0.0, "drop_rate": 0.5}, {"boosting": "dart", "xgboost_dart_mode": True, "skip_drop": 0.0}, {"data_sample_strategy": "goss", "learning_rate": 0.5}, {"extra_trees": True, "feature_fraction_bynode": 0.7}, {"path_smooth": 5.0}, {"linear_tree": True}, {"lambda_l1": 0.5, "max_delta_step": 0.5}])
def test_variants(spark, table, more):
    x, y, df = table
    booster = train({"num_iterations": 5, "num_leaves": 7, "metric": "l2", **more}, GbtDataset(df, "label"), keep_booster=True)
    got = ((booster.model.local(x)[:, 0] - y) ** 2).mean()
    assert got < 0.9 * y.var()
    if not more.get("linear_tree"):
        assert booster.evaluate()[0][2] == pytest.approx(got)
    text = GbtModel.from_text(booster.model.to_text())
    assert np.allclose(text.local(x), booster.model.local(x))


@pytest.mark.parametrize("objective", ["lambdarank", "rank_xendcg"])
def test_ranking(spark, objective):
    draw = np.random.default_rng(3)
    q = np.repeat(np.arange(60), draw.integers(1, 12, 60))
    x = draw.normal(size=(len(q), 3))
    grade = np.clip((x[:, 0] + draw.normal(scale=0.3, size=len(q)) + 1), 0, 3).astype(int).astype(float)
    df = frame(spark, x, grade, q=q, row=np.arange(len(q)))
    booster = train({"objective": objective, "num_iterations": 1, "num_leaves": 5, "eval_at": [3], "min_data_in_leaf": 5}, GbtDataset(df, "label", group="q", order=["row"]), keep_booster=True)
    before = booster.evaluate()[0][2]
    for _ in range(8):
        booster.update()
    assert booster.evaluate()[0][2] > before and booster.evaluate()[0][2] > 0.9


def test_early_stopping_and_recording(spark, table):
    x, y, df = table
    data = GbtDataset(df, "label")
    noise = data.create_valid(frame(spark, x, np.random.default_rng(5).normal(size=len(y))))
    log = {}
    model = train({"num_iterations": 30, "metric": "l2", "num_leaves": 7}, data, valid_sets=[noise], callbacks=[early_stopping(2), record_evaluation(log)])
    losses = log["valid_0"]["l2"]
    assert model.best_iteration == int(np.argmin(losses)) + 1 and len(losses) <= model.best_iteration + 2
    assert len(model.slice()) == model.best_iteration


def test_cv_and_continued_training(spark, table):
    x, y, df = table
    found = cv({"num_iterations": 2, "metric": "l2", "num_leaves": 5}, GbtDataset(df, "label"), nfold=3)
    assert len(found["valid l2-mean"]) == 2 and found["valid l2-mean"][1] < found["valid l2-mean"][0]
    data = GbtDataset(df, "label")
    half = train({"num_iterations": 2, "num_leaves": 7}, data)
    whole = train({"num_iterations": 2, "num_leaves": 7}, data, init_model=half)
    assert whole.current_iteration() == 4
    assert np.allclose(whole.local(x), train({"num_iterations": 4, "num_leaves": 7}, data).local(x), atol=1e-6)


def test_constraints(spark, table, tmp_path):
    x, y, df = table
    grid = np.zeros((50, 4))
    grid[:, 1] = np.linspace(-2, 2, 50)
    rising = train({"num_iterations": 10, "monotone_constraints": [0, 1, 0, 0]}, GbtDataset(df, "label"))
    assert (np.diff(rising.local(grid)[:, 0]) >= -1e-9).all()
    apart = train({"num_iterations": 5, "interaction_constraints": "[0,1],[2,3]"}, GbtDataset(df, "label"))
    for t in apart.trees:
        waiting = [(0, set())]
        while waiting:
            code, path = waiting.pop()
            if code >= 0:
                path = path | {t.feature[code]}
                assert path <= {0, 1} or path <= {2, 3}
                waiting += [(t.left[code], path), (t.right[code], path)]
    forced = tmp_path / "forced.json"
    forced.write_text(json.dumps({"feature": 2, "threshold": 0.5, "left": {"feature": 3, "threshold": 0.0}}))
    t = train({"num_iterations": 1, "num_leaves": 5, "forcedsplits_filename": str(forced)}, GbtDataset(df, "label")).trees[0]
    assert t.feature[:2] == [2, 3]
    costly = train({"num_iterations": 3, "cegb_penalty_feature_coupled": [0, 1e9, 1e9, 1e9]}, GbtDataset(df, "label"))
    assert {f for t in costly.trees for f in t.feature} == {0}


def test_model_surface(spark, table, tmp_path):
    x, y, df = table
    model = train({"num_iterations": 4, "num_leaves": 7}, GbtDataset(df, "label"))
    raw = model.local(x, "raw")
    assert np.allclose(model.local(x, "contrib").sum(1), raw[:, 0]) and np.allclose(model.path_contributions(x).sum(1), raw[:, 0])
    low, high = model.bounds()
    assert low <= raw.min() and raw.max() <= high
    scored = model.predict(df).select("prediction", model.case_column().alias("case"), *model.features).toPandas()
    assert np.allclose(scored["prediction"], scored["case"]) and np.allclose(scored["prediction"], model.local(scored[model.features].to_numpy())[:, 0])
    assert np.allclose(GbtModel.from_text(model.to_text(1, 2)).local(x, "raw"), model.local(x, "raw", 1, 2))
    model.save_table(spark, str(tmp_path / "model"))
    assert np.allclose(GbtModel.load_table(spark, str(tmp_path / "model")).local(x), model.local(x))
    nodes = model.nodes(spark)
    assert nodes.where("split_feature is not null").count() == sum(t.leaves - 1 for t in model.trees)
    assert model.feature_importance().sum() == sum(t.leaves - 1 for t in model.trees) and model.split_values("x0")[0].sum() > 0
    assert np.allclose(model.merge(model).local(x, "raw"), 2 * raw) and np.allclose(model.shuffle(seed=3).local(x), model.local(x))
    assert json.loads(model.dump_json())["tree_info"][0]["num_leaves"] == 7
    model.set_leaf_output(0, 0, 5.0)
    assert model.get_leaf_output(0, 0) == 5.0
    assert model.predict_sparse_contrib(df).count() == 600


def test_refit_moves_towards_new_data(spark, table):
    x, y, df = table
    model = train({"num_iterations": 4, "num_leaves": 7}, GbtDataset(df, "label"))
    other = frame(spark, x, y + 3)
    loss = lambda m: ((m.local(x)[:, 0] - y - 3) ** 2).mean()
    assert loss(model.refit(GbtDataset(other, "label"), 0.5)) < loss(model)


def test_custom_objective_and_early_exit(spark, table):
    x, y, df = table
    own = train({"objective": lambda s, d: (s - d.label, np.ones_like(s)), "num_iterations": 3, "boost_from_average": False}, GbtDataset(df, "label"))
    same = train({"objective": "regression", "num_iterations": 3, "boost_from_average": False}, GbtDataset(df, "label"))
    assert np.allclose(own.local(x, "raw"), same.local(x, "raw"))
    sure = train({"objective": "binary", "num_iterations": 12}, GbtDataset(frame(spark, x, (y > 0).astype(float)), "label"))
    whole = sure.local(x)
    sure.params = sure.params.with_(pred_early_stop=True, pred_early_stop_freq=3, pred_early_stop_margin=1.0)
    assert ((sure.local(x) > 0.5) == (whole > 0.5)).mean() > 0.95 and not np.allclose(sure.local(x), whole)
