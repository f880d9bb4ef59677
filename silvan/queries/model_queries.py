"""Queries of models: scoring by a fixed model (with SQL twins), tables of its nodes, and models trained on the test tables."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import resolve
from ..plans.dataset import GbtDataset
from ..plans.engine import cv, train
from ..plans.model import GbtModel
from ..plans.tree import Tree
from .registry import add, query, table

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@lru_cache(maxsize=1)
def fixed_model() -> GbtModel:
    """Three hand-made trees: numerical, with missing values, and categorical."""
    first = Tree([0, 1], [25.5, 0.045], [None, None], [False, True], ["none", "none"], [10.0, 4.0], [1, ~0], [~1, ~2], [0.1, 0.3], [100.0, 60.0], [100, 60], [0.5, -0.25, 1.5], [30.0, 40.0, 30.0], [30, 40, 30])
    second = Tree([2], [0.035], [None], [True], ["zero"], [3.0], [~0], [~1], [0.05], [100.0], [100], [0.2, -0.1], [50.0, 50.0], [50, 50])
    third = Tree([3, 0], [0.0, 12.5], [[1, 4, 6], None], [False, False], ["none", "none"], [2.0, 1.0], [~0, ~1], [1, ~2], [0.0, 0.1], [100.0, 70.0], [100, 70], [0.05, -0.05, 0.15], [30.0, 30.0, 40.0], [30, 30, 40])
    return GbtModel([first, second, third], resolve(objective="regression"), FEATURES)


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
add("predict_case_tree", lambda s, d: table(s, d, "lineitem").select(*_KEYS, F.round(fixed_model().case_column(), 6).alias("score")), f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({fixed_model().case_sql()}, 6) AS score FROM lineitem")
add("predict_arrow", lambda s, d: fixed_model().predict(table(s, d, "lineitem"), "raw").select(*_KEYS, F.round("prediction", 6).alias("score")), f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({fixed_model().case_sql()}, 6) AS score FROM lineitem")
_LEAF = "CASE WHEN l_quantity <= 25.5 THEN CASE WHEN l_discount <= 0.045 THEN 0 ELSE 2 END ELSE 1 END"
add("leaf_index_case", lambda s, d: fixed_model().predict(table(s, d, "lineitem"), "leaf").groupBy(F.element_at("prediction", 1).alias("leaf"), F.element_at("prediction", 3).alias("third")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT {_LEAF} AS leaf, CASE WHEN l_linenumber IN (1, 4, 6) THEN 0 WHEN l_quantity <= 12.5 THEN 1 ELSE 2 END AS third, count(*) AS n FROM lineitem GROUP BY ALL")
add("predict_contrib_sum", lambda s, d: fixed_model().predict(table(s, d, "lineitem"), "contrib").select(*_KEYS, F.round(F.aggregate("prediction", F.lit(0.0), lambda a, b: a + b), 6).alias("score")), f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({fixed_model().case_sql()}, 6) AS score FROM lineitem")


def _values() -> str:
    """The fixed model's nodes as rows of SQL."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    rows = [f"({', '.join(text(v) for v in (r['tree_index'], r['node_index'], r['split_feature'], r['split_gain'], r['threshold'], r['decision_type'], r['value'], r['count']))})" for r in fixed_model().node_rows()]
    return f"(VALUES {', '.join(rows)}) AS t(tree_index, node_index, split_feature, split_gain, threshold, decision_type, value, n)"


NODES_SQL = _values()
add("node_importance_split", lambda s, d: fixed_model().nodes(s).where("split_gain > 0").groupBy("split_feature").agg(F.count(F.lit(1)).alias("splits")), f"SELECT split_feature, count(*) AS splits FROM {NODES_SQL} WHERE split_gain > 0 GROUP BY 1")
add("node_importance_gain", lambda s, d: fixed_model().nodes(s).where("split_gain > 0").groupBy("split_feature").agg(F.round(F.sum("split_gain"), 6).alias("gain")), f"SELECT split_feature, round(sum(split_gain)::DOUBLE, 6) AS gain FROM {NODES_SQL} WHERE split_gain > 0 GROUP BY 1")
add("split_value_hist", lambda s, d: fixed_model().nodes(s).where("decision_type = '<='").groupBy("split_feature", F.floor(F.col("threshold").cast("double") / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), f"SELECT split_feature, floor(threshold::DOUBLE / 10)::BIGINT AS bucket, count(*) AS n FROM {NODES_SQL} WHERE decision_type = '<=' GROUP BY ALL")
add("prediction_bounds", lambda s, d: fixed_model().nodes(s).where("split_feature is null").groupBy("tree_index").agg(F.min("value").alias("low"), F.max("value").alias("high")).agg(F.round(F.sum("low"), 6).alias("low"), F.round(F.sum("high"), 6).alias("high")), f"SELECT round(sum(low)::DOUBLE, 6) AS low, round(sum(high)::DOUBLE, 6) AS high FROM (SELECT tree_index, min(value) AS low, max(value) AS high FROM {NODES_SQL} WHERE split_feature IS NULL GROUP BY 1)")
add("node_table", lambda s, d: fixed_model().nodes(s).select("tree_index", "node_index", "split_feature", F.col("count").alias("n"), F.round("value", 6).alias("value")), f"SELECT tree_index::BIGINT AS tree_index, node_index, split_feature, n::BIGINT AS n, round(value::DOUBLE, 6) AS value FROM {NODES_SQL}")



@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(CASE WHEN l_quantity <= 25.5 THEN 0.3 - 0.1 ELSE -0.25 - 0.1 END + CASE WHEN l_linenumber IN (1, 4, 6) THEN 0 WHEN l_quantity <= 12.5 THEN -0.05 - 0.1 ELSE 0.15 - 0.1 END, 6)::DOUBLE AS quantity,
  round(CASE WHEN l_quantity <= 25.5 THEN CASE WHEN l_discount <= 0.045 THEN 0.5 - 0.3 ELSE 1.5 - 0.3 END ELSE 0 END, 6)::DOUBLE AS discount FROM lineitem""")
def path_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature's splits changed node values by, along the rows' paths."""
    handle = spark.sparkContext.broadcast(fixed_model())

    @F.pandas_udf("array<double>")
    def changes(cols: pd.DataFrame) -> pd.Series:
        return pd.Series(list(handle.value.path_contributions(cols.to_numpy(np.float64))))

    rows = table(spark, sf_dir, "lineitem")
    found = rows.select(*_KEYS, changes(F.struct(*[F.col(f).cast("double").alias(f) for f in FEATURES])).alias("c"))
    return found.select(*_KEYS, (F.round(F.element_at("c", 1), 6) + 0.0).alias("quantity"), (F.round(F.element_at("c", 2), 6) + 0.0).alias("discount"))


# trained models: no SQL twin
def lineitem(spark: SparkSession, sf_dir: str, label: str = "price") -> DataFrame:
    y = {"price": F.col("l_extendedprice") / 10000.0, "flag": (F.col("l_returnflag") == "R").cast("double"), "quantity": F.col("l_quantity"), "share": F.col("l_discount") * 10.0, "class": F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)}[label]
    ship = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("timestamp")).cast("double")
    used = {"price": ["l_quantity", "l_partkey"], "flag": ["l_quantity"], "quantity": [], "share": ["l_quantity"], "class": ["l_quantity"]}[label]
    return table(spark, sf_dir, "lineitem").select(y.alias("label"), *[F.col(c).cast("double").alias(c) for c in used], *([F.col("l_discount")] if label != "share" else []), "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"), ship.alias("ship"), (F.col("l_linestatus") == "F").cast("int").alias("status"))


def _summary(spark: SparkSession, model: GbtModel, df: DataFrame) -> DataFrame:
    """What the model says about its rows, leaf by leaf of each of its trees."""
    scored = model.predict(df, "leaf", "leaf").select("label", F.posexplode("leaf").alias("tree", "leaf"))
    return scored.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("label"))


OBJECTIVE_LABELS = {"regression": "price", "regression_l1": "price", "huber": "price", "fair": "price", "quantile": "price", "mape": "price", "poisson": "quantity", "gamma": "quantity", "tweedie": "quantity", "binary": "flag", "cross_entropy": "share", "cross_entropy_lambda": "share"}


def _train(objective: str, label: str, boosting: str = "gbdt", **more: object):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lineitem(spark, sf_dir, label)
        model = train({"objective": objective, "boosting": boosting, "num_iterations": 3, "num_leaves": 15, **more}, GbtDataset(df, "label"))
        return _summary(spark, model, df)

    return run


for _o, _l in OBJECTIVE_LABELS.items():
    add(f"train_gbdt_{_o}", _train(_o, _l))
add("train_rf_regression", _train("regression", "price", "rf", bagging_freq=1, bagging_fraction=0.7, feature_fraction=0.8))
add("train_dart_binary", _train("binary", "flag", "dart", drop_rate=0.5, skip_drop=0.0))
# one-side sampling begins with the third iteration at this rate
add("train_goss_regression", _train("regression", "price", data_sample_strategy="goss", learning_rate=0.5, num_iterations=4))
add("train_multiclass", _train("multiclass", "class", num_class=3))
add("train_multiclassova", _train("multiclassova", "class", num_class=3))
add("train_linear", _train("regression", "price", linear_tree=True))
add("train_monotone", _train("regression", "price", monotone_constraints=[1, 0, 0, 0, 0, 0, 0]))
add("train_extra_trees", _train("regression", "price", extra_trees=True, feature_fraction_bynode=0.6))


def _rank(objective: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") % 5).cast("double").alias("label"), "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_partkey", "l_suppkey")
        data = GbtDataset(df, "label", group="q", order=["l_partkey", "l_suppkey"], params={"objective": objective})
        return _summary(spark, train({"objective": objective, "num_iterations": 3, "num_leaves": 15}, data), df)

    return run


add("train_lambdarank", _rank("lambdarank"))
add("train_rank_xendcg", _rank("rank_xendcg"))


@query()
def train_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as categories."""
    df = table(spark, sf_dir, "part").select((F.col("p_retailprice") / 1000.0).alias("label"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("double").alias("brand"), F.col("p_size").cast("double").alias("size"))
    return _summary(spark, train({"num_iterations": 3, "num_leaves": 7, "min_data_per_group": 10}, GbtDataset(df, "label", categorical=["brand"])), df)


@query()
def train_multi_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.array("l_discount", "l_tax").alias("label"), "l_quantity", F.col("l_linenumber").cast("double").alias("l_linenumber"), (F.col("l_extendedprice") / 1000).alias("price"))
    model = train({"objective": "multi_regression", "num_class": 2, "num_iterations": 2, "num_leaves": 7}, GbtDataset(df, "label"))
    return model.predict(df).groupBy(F.floor(F.element_at("prediction", 1) * 100).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query()
def predict_contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    model = train({"num_iterations": 3, "num_leaves": 7}, GbtDataset(df, "label"))
    return model.predict(df, "contrib", "contrib").select(F.transform("contrib", lambda x: F.round(x, 6)).alias("contrib"))


@query()
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cv({"objective": "binary", "num_iterations": 2, "num_leaves": 7, "metric": "binary_logloss,auc"}, GbtDataset(lineitem(spark, sf_dir, "flag"), "label"), nfold=3)
    return spark.createDataFrame([(k, i, float(x)) for k, v in found.items() for i, x in enumerate(v)], "name string, iteration int, value double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten trees for the price of a line item, and every row's prediction."""
    df = lineitem(spark, sf_dir)
    return train({"num_iterations": 10, "num_leaves": 7, "max_bin": 63}, GbtDataset(df, "label")).predict(df)
