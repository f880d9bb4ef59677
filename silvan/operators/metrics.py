"""Evaluation metrics as aggregations and windows over scored rows.

Every function takes a frame and column expressions and returns a frame of one row, `value`. Point-wise metrics are one
hash aggregate; the ones that rank use windows whose partitions are queries, or buckets of distinct scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.backend import SparkOps
from ..params import default_label_gain
from .running import before, held

EPSILON = 1e-15


@dataclass(frozen=True)
class Options:
    alpha: float = 0.9
    fair_c: float = 1.0
    tweedie_variance_power: float = 1.5
    sigmoid: float = 1.0


def _log_loss(y: Column, p: Column) -> Column:
    """-y ln p - (1-y) ln(1-p), with probabilities no closer to 0 or 1 than EPSILON."""
    safe = lambda x: F.log(F.greatest(x, F.lit(EPSILON)))
    return -(y * safe(p) + (1.0 - y) * safe(1.0 - p))


def loss(name: str, y: Column, s: Column, o: Any = Options()) -> Column:
    """Loss of one row of a point-wise metric; s is the output, after its link."""
    d = s - y
    if name in ("l2", "rmse", "multi_rmse"):
        return d * d
    if name == "l1":
        return F.abs(d)
    if name == "quantile":
        return F.when(d < 0, -d * o.alpha).otherwise(d * (1.0 - o.alpha))
    if name == "huber":
        return F.when(F.abs(d) <= o.alpha, 0.5 * d * d).otherwise(o.alpha * (F.abs(d) - 0.5 * o.alpha))
    if name == "fair":
        return o.fair_c * F.abs(d) - o.fair_c * o.fair_c * F.log1p(F.abs(d) / o.fair_c)
    if name == "poisson":
        t = F.greatest(s, F.lit(1e-10))
        return t - y * F.log(t)
    if name == "mape":
        return F.abs(d) / F.greatest(F.lit(1.0), F.abs(y))
    if name == "gamma":
        # the shape is 1, so the normaliser is ln(1/y) + ln(y) + ln(gamma(1)), which is 0 but for rounding
        return y / s + F.log(s)
    if name == "gamma_deviance":
        r = y / (s + 1e-9)
        return r - F.log(r) - 1.0
    if name == "tweedie":
        t, rho = F.greatest(s, F.lit(1e-10)), o.tweedie_variance_power
        return -y * F.exp((1.0 - rho) * F.log(t)) / (1.0 - rho) + F.exp((2.0 - rho) * F.log(t)) / (2.0 - rho)
    if name in ("binary_logloss", "cross_entropy"):
        return _log_loss(y, s)
    if name == "binary_error":
        return F.when((s > 0.5) == (y > 0), 0.0).otherwise(1.0)
    if name == "cross_entropy_lambda":
        return _log_loss(y, 1.0 - F.exp(-s))
    if name == "kullback_leibler":
        part = lambda x: F.when(x > 0, x * SparkOps.log(x)).otherwise(0.0)
        return _log_loss(y, s) + part(y) + part(1.0 - y)
    raise ValueError(name)


POINTWISE = ("l2", "rmse", "l1", "quantile", "huber", "fair", "poisson", "mape", "gamma", "gamma_deviance", "tweedie", "binary_logloss", "binary_error", "cross_entropy", "cross_entropy_lambda", "kullback_leibler", "multi_rmse")
#: Metrics of which more is better.
HIGHER = frozenset(("auc", "average_precision", "auc_mu", "ndcg", "map", "r2"))


def higher_is_better(name: str) -> bool:
    return name.partition("@")[0] in HIGHER


def pointwise(df: DataFrame, name: str, y: Column, s: Column, w: Column | None = None, o: Any = Options()) -> DataFrame:
    """Weighted mean of the loss; its root for rmse; for gamma_deviance twice the sum."""
    w = F.lit(1.0) if w is None else w
    total, weight = F.sum(loss(name, y, s, o) * w), F.sum(w)
    value = {"rmse": F.sqrt(total / weight), "multi_rmse": F.sqrt(total / weight), "gamma_deviance": total * 2.0}.get(name, total / weight)
    return df.agg(value.alias("value"))


def r2(df: DataFrame, y: Column, s: Column, w: Column | None = None) -> DataFrame:
    """1 - residual / total sum of squares; with a constant label 1 if all scores meet it, else 0."""
    w = F.lit(1.0) if w is None else w
    base = df.select(y.alias("y"), s.alias("s"), w.alias("w"))
    mean = base.agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("mean"))
    sums = base.join(F.broadcast(mean)).agg(F.sum((F.col("y") - F.col("s")) ** 2 * F.col("w")).alias("rss"), F.sum((F.col("y") - F.col("mean")) ** 2 * F.col("w")).alias("tss"))
    return sums.select(F.when(F.col("tss") > EPSILON, 1.0 - F.col("rss") / F.col("tss")).otherwise(F.when(F.col("rss") <= EPSILON, 1.0).otherwise(0.0)).alias("value"))


def _by_score(df: DataFrame, positive: Column, s: Column, w: Column | None) -> DataFrame:
    """Positive and negative weight of each distinct score, and the same of all higher ones."""
    w = F.lit(1.0) if w is None else w
    ties = df.groupBy(s.alias("s")).agg(F.sum(F.when(positive, w).otherwise(0.0)).alias("pos"), F.sum(F.when(positive, 0.0).otherwise(w)).alias("neg"))
    found = before(held(ties), "s", ["pos", "neg"])
    return found.select("s", "pos", "neg", F.col("pos_before").alias("pos_above"), F.col("neg_before").alias("neg_above"))


def auc(df: DataFrame, positive: Column, s: Column, w: Column | None = None) -> DataFrame:
    """Area under the ROC curve; ties count half; 1 if one class only."""
    sums = _by_score(df, positive, s, w).agg(F.sum(F.col("neg") * (F.col("pos_above") + 0.5 * F.col("pos"))).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / (F.col("p") * F.col("n"))).otherwise(1.0).alias("value"))


def average_precision(df: DataFrame, positive: Column, s: Column, w: Column | None = None) -> DataFrame:
    rows = _by_score(df, positive, s, w)
    hit = F.col("pos_above") + F.col("pos")
    sums = rows.agg(F.sum(F.col("pos") * hit / (hit + F.col("neg_above") + F.col("neg"))).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / F.col("p")).otherwise(1.0).alias("value"))


def multi_logloss(df: DataFrame, y: Column, p: Column, w: Column | None = None) -> DataFrame:
    """y: class number; p: array of probabilities."""
    w = F.lit(1.0) if w is None else w
    own = F.greatest(F.element_at(p, y.cast("int") + 1), F.lit(EPSILON))
    return df.agg((F.sum(-F.log(own) * w) / F.sum(w)).alias("value"))


def multi_error(df: DataFrame, y: Column, p: Column, w: Column | None = None, top: int = 1) -> DataFrame:
    """Share of rows in which more than `top` classes are at least as probable as the right one."""
    w = F.lit(1.0) if w is None else w
    own = F.element_at(p, y.cast("int") + 1)
    miss = F.when(F.size(F.filter(p, lambda x: x >= own)) > top, 1.0).otherwise(0.0)
    return df.agg((F.sum(miss * w) / F.sum(w)).alias("value"))


def auc_mu(df: DataFrame, y: Column, p: Column, classes: int, weights: list[list[float]] | None = None, w: Column | None = None) -> DataFrame:
    """Mean over class pairs of the AUC along the normal of their separating plane; weights[i][j] is the cost of j for an i (default 1 off the diagonal)."""
    cost = weights or [[0.0 if i == j else 1.0 for j in range(classes)] for i in range(classes)]
    w = F.lit(1.0) if w is None else w
    base = df.select(y.cast("int").alias("y"), p.alias("p"), w.alias("w"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.array(*[F.lit(cost[i][k] - cost[j][k]) for k in range(classes)]).alias("v")) for i in range(classes) for j in range(i + 1, classes)])
    long = base.select("y", "p", "w", F.explode(pairs).alias("pair")).where((F.col("y") == F.col("pair.i")) | (F.col("y") == F.col("pair.j")))
    t = lambda: F.element_at(F.col("pair.v"), F.col("pair.i") + 1) - F.element_at(F.col("pair.v"), F.col("pair.j") + 1)
    dot = F.aggregate(F.zip_with(F.col("pair.v"), F.col("p"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = long.select(F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), (F.col("y") == F.col("pair.i")).alias("first"), (t() * dot).alias("d"), "w")
    ties = scored.groupBy("i", "j", "d").agg(F.sum(F.when(F.col("first"), F.col("w")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("first"), 0.0).otherwise(F.col("w"))).alias("b"))
    ranked = before(held(ties), "d", ["b"], ["i", "j"], descending=False).withColumnRenamed("b_before", "b_above")
    each = ranked.groupBy("i", "j").agg(F.sum(F.col("a") * (F.col("b_above") + 0.5 * F.col("b"))).alias("area"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return each.agg((F.sum(F.col("area") / (F.col("na") * F.col("nb"))) * 2.0 / (classes * (classes - 1))).alias("value"))


def _ranked(df: DataFrame, q: Column, y: Column, s: Column, tie: list[Column], w: Column | None = None) -> DataFrame:
    """Rows with their place in their query by falling score; equal scores keep the rows' order, which `tie` tells."""
    base = df.select(q.alias("q"), y.cast("int").alias("y"), s.alias("s"), (F.lit(1.0) if w is None else w).alias("w"), *[t.alias(f"t{i}") for i, t in enumerate(tie)])
    ties = [f"t{i}" for i in range(len(tie))]
    return base.select("q", "y", "w", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), *ties)).alias("r"), F.row_number().over(Window.partitionBy("q").orderBy(F.desc("y"), *ties)).alias("ideal"))


def _query_mean(each: DataFrame, value: Column) -> DataFrame:
    """Mean over queries, each of which counts as much as its rows' mean weight (w) says."""
    return each.agg((F.sum(value * F.col("w")) / F.sum("w")).alias("value"))


def max_dcg(df: DataFrame, q: Column, y: Column, k: int, gain: list[float] | None = None) -> DataFrame:
    """q, max_dcg: the DCG at k of each query with its labels in falling order."""
    table = F.array(*[F.lit(g) for g in gain or default_label_gain()])
    base = df.select(q.alias("q"), y.cast("int").alias("y"))
    best = base.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("y")))).where(F.col("r") <= k)
    return best.groupBy("q").agg(F.sum(F.element_at(table, F.col("y") + 1) / F.log2(F.col("r") + 1)).alias("max_dcg"))


def ndcg(df: DataFrame, q: Column, y: Column, s: Column, k: int, tie: list[Column], gain: list[float] | None = None, w: Column | None = None) -> DataFrame:
    """Mean NDCG at k over queries, weighted by the mean weight of their rows; a query without gain counts as 1."""
    table = F.array(*[F.lit(g) for g in gain or default_label_gain()])
    worth = F.element_at(table, F.col("y") + 1)
    sums = [F.sum(F.when(F.col(place) <= k, worth / F.log2(F.col(place) + 1)).otherwise(0.0)).alias(name) for place, name in (("r", "dcg"), ("ideal", "best"))]
    each = _ranked(df, q, y, s, tie, w).groupBy("q").agg(*sums, F.avg("w").alias("w"))
    return _query_mean(each, F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(1.0))


def mean_average_precision(df: DataFrame, q: Column, y: Column, s: Column, k: int, tie: list[Column], w: Column | None = None) -> DataFrame:
    """Mean over queries of average precision at k, weighted by the mean weight of their rows; a query without hit counts as 1."""
    hit = F.when(F.col("y") > 0.5, 1).otherwise(0)
    upto = Window.partitionBy("q").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    rows = _ranked(df, q, y, s, tie, w).select("q", "r", "w", hit.alias("hit")).withColumn("hits", F.sum("hit").over(upto))
    each = rows.groupBy("q").agg(F.sum(F.when((F.col("hit") == 1) & (F.col("r") <= k), F.col("hits") / F.col("r")).otherwise(0.0)).alias("sum"), F.sum("hit").alias("n"), F.count(F.lit(1)).alias("size"), F.avg("w").alias("w"))
    return _query_mean(each, F.when(F.col("n") > 0, F.col("sum") / F.least(F.col("n"), F.least(F.lit(k), F.col("size")))).otherwise(1.0))
