"""Metrics and objectives over deterministic score expressions on lineitem and embeddings."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import objectives
from ..functions.backend import SparkOps
from ..operators import metrics, percentiles
from ..operators.metrics import Options
from .registry import add, table

#: Rows that queries of this module score: regression (y, s > 0), binary (b, p), weight w, total order.
FRAME_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 10000.0 AS y, l_quantity * 0.15 + l_linenumber * 0.01 AS s,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS b, 1.0 / (1.0 + exp(-(l_discount * 20.0 - l_tax * 10.0 - 0.5))) AS p, l_discount * 10.0 AS u, l_quantity AS w,
  l_discount * 20.0 - l_tax * 10.0 - 0.5 AS raw FROM lineitem)"""


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("l_discount") * 20.0 - F.col("l_tax") * 10.0 - 0.5
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 10000.0).alias("y"), (F.col("l_quantity") * 0.15 + F.col("l_linenumber") * 0.01).alias("s"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("b"), (1.0 / (1.0 + F.exp(-raw))).alias("p"), (F.col("l_discount") * 10.0).alias("u"), F.col("l_quantity").alias("w"), raw.alias("raw"),
    )


_LOG_LOSS = "-({y} * ln(greatest({p}, 1e-15)) + (1.0 - {y}) * ln(greatest(1.0 - {p}, 1e-15)))"
_OPTIONS = Options()
#: name -> (label, score, loss in SQL).
POINT = {
    "l2": ("y", "s", "(s - y) * (s - y)"),
    "rmse": ("y", "s", "(s - y) * (s - y)"),
    "l1": ("y", "s", "abs(s - y)"),
    "quantile": ("y", "s", "CASE WHEN s < y THEN (y - s) * 0.9 ELSE (s - y) * 0.1 END"),
    "huber": ("y", "s", "CASE WHEN abs(s - y) <= 0.9 THEN 0.5 * (s - y) * (s - y) ELSE 0.9 * (abs(s - y) - 0.45) END"),
    "fair": ("y", "s", "abs(s - y) - ln(1.0 + abs(s - y))"),
    "poisson": ("y", "s", "s - y * ln(s)"),
    "mape": ("y", "s", "abs(s - y) / greatest(1.0, abs(y))"),
    "gamma": ("y", "s", "y / s + ln(s)"),
    "gamma_deviance": ("y", "s", "y / (s + 1e-9) - ln(y / (s + 1e-9)) - 1.0"),
    "tweedie": ("y", "s", "-y * exp(-0.5 * ln(s)) / -0.5 + exp(0.5 * ln(s)) / 0.5"),
    "binary_logloss": ("b", "p", _LOG_LOSS.format(y="b", p="p")),
    "binary_error": ("b", "p", "CASE WHEN (p > 0.5) = (b > 0) THEN 0.0 ELSE 1.0 END"),
    "cross_entropy": ("u", "p", _LOG_LOSS.format(y="u", p="p")),
    "cross_entropy_lambda": ("u", "s", _LOG_LOSS.format(y="u", p="(1.0 - exp(-s))")),
    "kullback_leibler": ("u", "p", _LOG_LOSS.format(y="u", p="p") + " + CASE WHEN u > 0 THEN u * ln(u) ELSE 0.0 END + CASE WHEN u < 1 THEN (1.0 - u) * ln(1.0 - u) ELSE 0.0 END"),
}


def _point(name: str, y: str, s: str, sql: str) -> None:
    total = {"rmse": "sqrt(sum(w * ({0})) / sum(w))", "gamma_deviance": "2.0 * sum(w * ({0}))"}.get(name, "sum(w * ({0})) / sum(w)").format(sql)
    digits = 2 if name == "gamma_deviance" else 6
    add(f"metric_{name}", lambda spark, d: metrics.pointwise(frame(spark, d), name, F.col(y), F.col(s), F.col("w"), _OPTIONS).select(F.round("value", digits).alias("value")), f"SELECT round({total}, {digits}) AS value FROM {FRAME_SQL}")


for _name, _spec in POINT.items():
    _point(_name, *_spec)

_rounded = lambda df: df.select(F.round("value", 6).alias("value"))
add("metric_r2", lambda spark, d: _rounded(metrics.r2(frame(spark, d), F.col("y"), F.col("s"), F.col("w"))),
    f"WITH f AS (SELECT * FROM {FRAME_SQL}), m AS (SELECT sum(y * w) / sum(w) AS mean FROM f) SELECT round(1.0 - sum(w * (y - s) * (y - s)) / sum(w * (y - mean) * (y - mean)), 6) AS value FROM f, m")
_TIES = f"WITH t AS (SELECT raw, sum(CASE WHEN b > 0 THEN w ELSE 0 END) AS pos, sum(CASE WHEN b > 0 THEN 0 ELSE w END) AS neg FROM {FRAME_SQL} GROUP BY raw), c AS (SELECT *, sum(pos) OVER (ORDER BY raw DESC) AS hit, sum(neg) OVER (ORDER BY raw DESC) AS miss FROM t)"
add("metric_auc", lambda spark, d: _rounded(metrics.auc(frame(spark, d), F.col("b") > 0, F.col("raw"), F.col("w"))), f"{_TIES} SELECT round(sum(neg * (hit - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS value FROM c")
add("metric_average_precision", lambda spark, d: _rounded(metrics.average_precision(frame(spark, d), F.col("b") > 0, F.col("raw"), F.col("w"))), f"{_TIES} SELECT round(sum(pos * hit / (hit + miss)) / sum(pos), 6) AS value FROM c")

#: Three-class rows: class number c and probabilities p0, p1, p2.
CLASSES_SQL = """(SELECT c, w, round(e0 / (e0 + e1 + e2), 9) AS p0, round(e1 / (e0 + e1 + e2), 9) AS p1, round(e2 / (e0 + e1 + e2), 9) AS p2 FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, l_quantity AS w, exp(l_discount * 10.0) AS e0, exp(l_tax * 12.0 + 0.1) AS e1, exp(l_quantity * 0.01) AS e2 FROM lineitem))"""


def class_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.exp(F.col("l_discount") * 10.0), F.exp(F.col("l_tax") * 12.0 + 0.1), F.exp(F.col("l_quantity") * 0.01)]
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("c"), F.col("l_quantity").alias("w"), *[x.alias(f"e{i}") for i, x in enumerate(e)])
    total = F.col("e0") + F.col("e1") + F.col("e2")
    return rows.select("c", "w", F.array(*[F.round(F.col(f"e{i}") / total, 9) for i in range(3)]).alias("p"))


add("metric_multi_logloss", lambda spark, d: _rounded(metrics.multi_logloss(class_frame(spark, d), F.col("c"), F.col("p"), F.col("w"))), f"SELECT round(sum(w * -ln(CASE c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) / sum(w), 6) AS value FROM {CLASSES_SQL}")
for _top in (1, 2):
    add(f"metric_multi_error_{_top}", lambda spark, d, k=_top: _rounded(metrics.multi_error(class_frame(spark, d), F.col("c"), F.col("p"), F.col("w"), k)),
        f"SELECT round(sum(CASE WHEN (p0 >= o)::INT + (p1 >= o)::INT + (p2 >= o)::INT > {_top} THEN w ELSE 0 END) / sum(w), 6) AS value FROM (SELECT *, CASE c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS o FROM {CLASSES_SQL})")
add("metric_auc_mu", lambda spark, d: _rounded(metrics.auc_mu(class_frame(spark, d), F.col("c"), F.col("p"), 3, None, F.col("w"))), f"""
  WITH f AS (SELECT * FROM {CLASSES_SQL}), x AS (
    SELECT 0 AS i, 1 AS j, c = 0 AS first, -2.0 * (p1 - p0) AS d, w FROM f WHERE c IN (0, 1) UNION ALL
    SELECT 0, 2, c = 0, -2.0 * (p2 - p0), w FROM f WHERE c IN (0, 2) UNION ALL
    SELECT 1, 2, c = 1, -2.0 * (p2 - p1), w FROM f WHERE c IN (1, 2)
  ), t AS (SELECT i, j, d, sum(CASE WHEN first THEN w ELSE 0 END) AS a, sum(CASE WHEN first THEN 0 ELSE w END) AS b FROM x GROUP BY ALL),
  r AS (SELECT *, sum(b) OVER (PARTITION BY i, j ORDER BY d DESC) - b AS above FROM t),
  e AS (SELECT i, j, sum(a * (sum_b - above - b + b / 2)) / (sum(a) * any_value(sum_b)) AS auc FROM (SELECT *, sum(b) OVER (PARTITION BY i, j) AS sum_b FROM r) GROUP BY i, j)
  SELECT round(avg(auc), 6) AS value FROM e""")
add("metric_multi_rmse", lambda spark, d: _rounded(metrics.pointwise(frame(spark, d).select(F.explode(F.array(F.struct(F.col("u").alias("y"), F.col("p").alias("s")), F.struct("y", "s"))).alias("x"), "w"), "multi_rmse", F.col("x.y"), F.col("x.s"), F.col("w"))),
    f"SELECT round(sqrt(sum(w * ((u - p) * (u - p) + (y - s) * (y - s))) / (2 * sum(w))), 6) AS value FROM {FRAME_SQL}")

#: Ranking rows: query, grade, score, total order.
RANK_SQL = "(SELECT l_orderkey AS q, l_linenumber % 5 AS grade, l_discount * 10.0 - l_tax AS score, l_linenumber AS t0, l_partkey AS t1, l_suppkey AS t2, l_quantity AS w FROM lineitem)"
TIE = ["l_linenumber", "l_partkey", "l_suppkey"]


def rank_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") % 5).alias("grade"), (F.col("l_discount") * 10.0 - F.col("l_tax")).alias("score"), F.col("l_quantity").alias("w"), *TIE)


for _k in (1, 3, 5):
    add(f"ndcg_at_{_k}", lambda spark, d, k=_k: _rounded(metrics.ndcg(rank_frame(spark, d), F.col("q"), F.col("grade"), F.col("score"), k, [F.col(t) for t in TIE])), f"""
      WITH r AS (SELECT q, pow(2, grade) - 1 AS g, row_number() OVER (PARTITION BY q ORDER BY score DESC, t0, t1, t2) AS r, row_number() OVER (PARTITION BY q ORDER BY grade DESC, t0, t1, t2) AS i FROM {RANK_SQL}),
      e AS (SELECT q, sum(CASE WHEN r <= {_k} THEN g / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= {_k} THEN g / log2(i + 1) ELSE 0 END) AS best FROM r GROUP BY q)
      SELECT round(avg(CASE WHEN best > 0 THEN dcg / best ELSE 1.0 END), 6) AS value FROM e""")
    add(f"map_at_{_k}", lambda spark, d, k=_k: _rounded(metrics.mean_average_precision(rank_frame(spark, d), F.col("q"), F.when(F.col("grade") >= 3, 1).otherwise(0), F.col("score"), k, [F.col(t) for t in TIE])), f"""
      WITH r AS (SELECT q, (grade >= 3)::INT AS hit, row_number() OVER (PARTITION BY q ORDER BY score DESC, t0, t1, t2) AS r FROM {RANK_SQL}),
      c AS (SELECT *, sum(hit) OVER (PARTITION BY q ORDER BY r) AS hits FROM r),
      e AS (SELECT q, sum(CASE WHEN hit = 1 AND r <= {_k} THEN hits / r ELSE 0 END) AS s, sum(hit) AS n, least({_k}, count(*)) AS k FROM c GROUP BY q)
      SELECT round(avg(CASE WHEN n > 0 THEN s / least(n, k) ELSE 1.0 END), 6) AS value FROM e""")
add("ndcg_weighted_at_3", lambda spark, d: _rounded(metrics.ndcg(rank_frame(spark, d), F.col("q"), F.col("grade"), F.col("score"), 3, [F.col(t) for t in TIE], w=F.col("w"))), f"""
  WITH r AS (SELECT q, w, pow(2, grade) - 1 AS g, row_number() OVER (PARTITION BY q ORDER BY score DESC, t0, t1, t2) AS r, row_number() OVER (PARTITION BY q ORDER BY grade DESC, t0, t1, t2) AS i FROM {RANK_SQL}),
  e AS (SELECT q, avg(w) AS w, sum(CASE WHEN r <= 3 THEN g / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 3 THEN g / log2(i + 1) ELSE 0 END) AS best FROM r GROUP BY q)
  SELECT round(sum(w * CASE WHEN best > 0 THEN dcg / best ELSE 1.0 END) / sum(w), 6) AS value FROM e""")
add("map_weighted_at_3", lambda spark, d: _rounded(metrics.mean_average_precision(rank_frame(spark, d), F.col("q"), F.when(F.col("grade") >= 3, 1).otherwise(0), F.col("score"), 3, [F.col(t) for t in TIE], w=F.col("w"))), f"""
  WITH r AS (SELECT q, w, (grade >= 3)::INT AS hit, row_number() OVER (PARTITION BY q ORDER BY score DESC, t0, t1, t2) AS r FROM {RANK_SQL}),
  c AS (SELECT *, sum(hit) OVER (PARTITION BY q ORDER BY r) AS hits FROM r),
  e AS (SELECT q, avg(w) AS w, sum(CASE WHEN hit = 1 AND r <= 3 THEN hits / r ELSE 0 END) AS s, sum(hit) AS n, least(3, count(*)) AS k FROM c GROUP BY q)
  SELECT round(sum(w * CASE WHEN n > 0 THEN s / least(n, k) ELSE 1.0 END) / sum(w), 6) AS value FROM e""")
add("max_dcg", lambda spark, d: metrics.max_dcg(rank_frame(spark, d), F.col("q"), F.col("grade"), 3).select("q", F.round("max_dcg", 6).alias("max_dcg")), f"SELECT q, round(sum((pow(2, grade) - 1) / log2(r + 1)), 6) AS max_dcg FROM (SELECT q, grade, row_number() OVER (PARTITION BY q ORDER BY grade DESC) AS r FROM {RANK_SQL}) WHERE r <= 3 GROUP BY q")

_P = SimpleNamespace(sigmoid=1.5, alpha=0.9, fair_c=1.0, poisson_max_delta_step=0.7, tweedie_variance_power=1.5, label_weights=(1.0, 2.0))
#: objective -> (label, raw score, g, h) in SQL.
GRADIENTS = {
    "regression": ("y", "s", "(s - y) * w", "w"),
    "regression_l1": ("y", "s", "sign(s - y) * w", "w"),
    "huber": ("y", "s", "CASE WHEN abs(s - y) <= 0.9 THEN s - y ELSE sign(s - y) * 0.9 END * w", "w"),
    "fair": ("y", "s", "(s - y) / (abs(s - y) + 1.0) * w", "1.0 / ((abs(s - y) + 1.0) * (abs(s - y) + 1.0)) * w"),
    "poisson": ("y", "raw", "(exp(raw) - y) * w", "exp(raw + 0.7) * w"),
    "quantile": ("y", "s", "CASE WHEN s >= y THEN 0.1 ELSE -0.9 END * w", "w"),
    "mape": ("y", "s", "sign(s - y) / greatest(1.0, abs(y)) * w", "w"),
    "gamma": ("y", "raw", "(1.0 - y * exp(-raw)) * w", "y * exp(-raw) * w"),
    "tweedie": ("y", "raw", "(exp(0.5 * raw) - y * exp(-0.5 * raw)) * w", "(0.5 * exp(0.5 * raw) + 0.5 * y * exp(-0.5 * raw)) * w"),
    "binary": ("b", "raw", "-(2 * b - 1) * 1.5 / (1.0 + exp((2 * b - 1) * 1.5 * raw)) * (1 + b) * w", "(1.5 / (1.0 + exp((2 * b - 1) * 1.5 * raw))) * (1.5 - 1.5 / (1.0 + exp((2 * b - 1) * 1.5 * raw))) * (1 + b) * w"),
    "cross_entropy": ("u", "raw", "(1.0 / (1.0 + exp(-raw)) - u) * w", "(1.0 / (1.0 + exp(-raw))) * (1.0 - 1.0 / (1.0 + exp(-raw))) * w"),
    "cross_entropy_lambda": ("u", "raw", "(1.0 - u / z) * v / (1.0 + exp(-raw))", "v * exp(raw) / ((1.0 + exp(raw)) * (1.0 + exp(raw))) * (1.0 + u * (1.0 / (1.0 - z)) / (((1.0 / (1.0 - z)) - 1.0) * ((1.0 / (1.0 - z)) - 1.0)) * (1.0 + v * exp(raw) - 1.0 / (1.0 - z)))"),
}


def _gradient(name: str, y: str, s: str, g: str, h: str) -> None:
    source = f"(SELECT *, w / 50.0 AS v, 1.0 - exp(-w / 50.0 * ln(1.0 + exp(raw))) AS z FROM {FRAME_SQL})"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = frame(spark, sf_dir)
        w = F.col("w") / 50.0 if name == "cross_entropy_lambda" else F.col("w")
        grad, hess = objectives.OBJECTIVES[name].grad(SparkOps, F.col(s), F.col(y), w, _P)
        return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(grad, 7) + 0.0).alias("g"), F.round(hess, 7).alias("h"))

    add(f"grad_{name}", run, f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(({g})::DOUBLE, 7) + 0.0::DOUBLE AS g, round(({h})::DOUBLE, 7) AS h FROM {source}")


for _name, _spec in GRADIENTS.items():
    _gradient(_name, *_spec)


def _multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax gradients, one row for each row and class."""
    rows = class_frame(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    p = F.element_at("p", F.col("k") + 1)
    g, h = p - F.when(F.col("c") == F.col("k"), 1.0).otherwise(0.0), 1.5 * p * (1.0 - p)
    return rows.groupBy("k").agg(F.round(F.sum(g * F.col("w")), 3).alias("g"), F.round(F.sum(h * F.col("w")), 3).alias("h"), F.count(F.lit(1)).alias("n"))


add("grad_multiclass", _multiclass, f"SELECT k, round(sum((p - (c = k)::INT) * w), 3) AS g, round(sum(1.5 * p * (1.0 - p) * w), 3) AS h, count(*) AS n FROM (SELECT c, w, unnest([0, 1, 2]) AS k, unnest([p0, p1, p2]) AS p FROM {CLASSES_SQL}) GROUP BY k")


def _ova(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = class_frame(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    g, h = objectives.OBJECTIVES["binary"].grad(SparkOps, F.element_at("p", F.col("k") + 1), F.when(F.col("c") == F.col("k"), 1.0).otherwise(0.0), F.col("w"), SimpleNamespace(sigmoid=1.0, label_weights=(1.0, 1.0)))
    return rows.groupBy("k").agg(F.round(F.sum(g), 3).alias("g"), F.round(F.sum(h), 3).alias("h"))


add("grad_multiclassova", _ova, f"SELECT k, round(sum(-t / (1 + exp(t * p)) * w), 3) AS g, round(sum(1 / (1 + exp(t * p)) * (1 - 1 / (1 + exp(t * p))) * w), 3) AS h FROM (SELECT w, k, p, CASE WHEN c = k THEN 1.0 ELSE -1.0 END AS t FROM (SELECT c, w, unnest([0, 1, 2]) AS k, unnest([p0, p1, p2]) AS p FROM {CLASSES_SQL})) GROUP BY k")
add("grad_multi_regression", lambda spark, d: frame(spark, d).select(F.posexplode(F.array(F.struct(F.col("u").alias("y"), F.col("p").alias("s")), F.struct("y", "s"))).alias("target", "x"), "w").groupBy("target").agg(F.round(F.sum((F.col("x.s") - F.col("x.y")) * F.col("w")), 3).alias("g"), F.round(F.sum("w"), 3).alias("h")),
    f"SELECT 0 AS target, round(sum((p - u) * w), 3) AS g, round(sum(w), 3) AS h FROM {FRAME_SQL} UNION ALL SELECT 1, round(sum((s - y) * w), 3), round(sum(w), 3) FROM {FRAME_SQL}")

#: start values: kind -> (label, SQL).
for _kind, _y, _sql in (
    ("mean", "y", "sum(y * w) / sum(w)"),
    ("log_mean", "y", "ln(sum(y * w) / sum(w))"),
    ("log_odds", "b", "ln((sum(b * w) / sum(w)) / (1 - sum(b * w) / sum(w)))"),
    ("logit_mean", "u", "ln((sum(u * w) / sum(w)) / (1 - sum(u * w) / sum(w)))"),
    ("log_expm1_mean", "u", "ln(exp(sum(u * w) / sum(w)) - 1)"),
):
    def _start(spark, d, kind=_kind, y=_y):
        m = F.sum(F.col(y) * F.col("w")) / F.sum("w")
        value = {"mean": m, "log_mean": F.log(m), "log_odds": F.log(m / (1 - m)), "logit_mean": F.log(m / (1 - m)), "log_expm1_mean": F.log(F.expm1(m))}[kind]
        return frame(spark, d).agg(F.round(value, 6).alias("value"))

    add(f"init_{_kind}", _start, f"SELECT round({_sql}, 6) AS value FROM {FRAME_SQL}")
add("init_median", lambda spark, d: percentiles.exact(frame(spark, d), [], F.col("y"), [0.5]).select(F.round("q0", 6).alias("value")), f"SELECT round(quantile_cont(y, 0.5), 6) AS value FROM {FRAME_SQL}")
add("init_quantile", lambda spark, d: percentiles.exact(frame(spark, d), [], F.col("y"), [0.9]).select(F.round("q0", 6).alias("value")), f"SELECT round(quantile_cont(y, 0.9), 6) AS value FROM {FRAME_SQL}")
_WEIGHTED = """WITH o AS (SELECT {k} AS k, y, sum(w) OVER (PARTITION BY {k} ORDER BY y, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS cdf, row_number() OVER (PARTITION BY {k} ORDER BY y, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r, sum(w) OVER (PARTITION BY {k}) * {a} AS t, count(*) OVER (PARTITION BY {k}) AS n FROM {f}),
  p AS (SELECT k, coalesce(min(CASE WHEN cdf > t THEN r END), any_value(n)) AS r FROM o GROUP BY k)
  SELECT o.k, round(CASE WHEN o.r = 1 OR o.r = o.n THEN o.y WHEN o.cdf - b.cdf >= 1.0 THEN b.y + (o.t - b.cdf) / (o.cdf - b.cdf) * (o.y - b.y) ELSE b.y END, 6) AS value
  FROM o JOIN p ON o.k = p.k AND o.r = p.r LEFT JOIN o b ON b.k = o.k AND b.r = o.r - 1"""
add("leaf_renew_median", lambda spark, d: percentiles.exact(frame(spark, d).withColumn("leaf", F.col("l_linenumber") % 5), ["leaf"], F.col("y") - F.col("s"), [0.5]).select("leaf", F.round("q0", 6).alias("value")), f"SELECT l_linenumber % 5 AS leaf, round(quantile_cont(y - s, 0.5), 6) AS value FROM {FRAME_SQL} GROUP BY 1")
add("leaf_renew_weighted", lambda spark, d: percentiles.weighted(frame(spark, d).withColumn("k", F.col("l_linenumber") % 5), ["k"], F.col("y"), F.col("w"), 0.3, [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).select("k", F.round("value", 6).alias("value")), _WEIGHTED.format(k="l_linenumber % 5", a=0.3, f=FRAME_SQL))
for _o, _sql in (("regression", "raw"), ("poisson", "exp(raw)"), ("binary", "1.0 / (1.0 + exp(-1.5 * raw))"), ("cross_entropy", "1.0 / (1.0 + exp(-raw))"), ("cross_entropy_lambda", "ln(1.0 + exp(raw))")):
    add(f"link_{_o}", lambda spark, d, o=_o: frame(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(objectives.OBJECTIVES[o].link(SparkOps, F.col("raw"), _P), 7) + 0.0).alias("value")), f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_sql}, 7) + 0.0::DOUBLE AS value FROM {FRAME_SQL}")
add("link_reg_sqrt", lambda spark, d: frame(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(F.signum("raw") * F.sqrt(F.abs("raw")), 7) + 0.0).alias("inward"), (F.round(F.signum("raw") * F.col("raw") * F.col("raw"), 7) + 0.0).alias("outward")), f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sign(raw) * sqrt(abs(raw)), 7) + 0.0::DOUBLE AS inward, round(sign(raw) * raw * raw, 7) + 0.0::DOUBLE AS outward FROM {FRAME_SQL}")
