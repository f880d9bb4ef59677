"""Models trained on lineitem, node by node, and the same trees grown in SQL.

Trees have two levels, so that all their splits are found level by level: histograms of the features' values, running
sums, the split of the greatest gain in each node, and the rows' scores for the next iteration.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dataset import GbtDataset
from ..plans.engine import train
from ..plans.model import GbtModel
from .registry import add, table

FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
#: Expressions that Spark and its SQL twin both read.
LABELS = {
    "price": "l_extendedprice / 10000.0",
    "flag": "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END",
    "share": "round(l_extendedprice / 200000.0, 6)",
    "class": "CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END",
}


@dataclass(frozen=True)
class Loss:
    """Gradient and hessian of (s, y) in SQL, without the weight w; start: the score that rows begin with, as an aggregate; renew: a leaf's
    value as an aggregate of its residuals y - s; scores: the names of the scores of one row, each of which has a tree."""

    g: str
    h: str
    start: str
    renew: str | None = None
    scores: int = 1


_MEAN = "sum(w * y) / sum(w)"
_ODDS = f"ln(({_MEAN}) / (1 - ({_MEAN})))"
LOSSES = {
    "regression": Loss("s - y", "1.0", _MEAN),
    "huber": Loss("CASE WHEN abs(s - y) <= 0.9 THEN s - y ELSE 0.9 * sign(s - y) END", "1.0", _MEAN),
    "fair": Loss("(s - y) / (abs(s - y) + 1.0)", "1.0 / ((abs(s - y) + 1.0) * (abs(s - y) + 1.0))", _MEAN),
    "regression_l1": Loss("sign(s - y)", "1.0", "quantile_cont(y, 0.5)", "quantile_cont(y - s, 0.5)"),
    "quantile": Loss("CASE WHEN s >= y THEN 0.1 ELSE -0.9 END", "1.0", "quantile_cont(y, 0.9)", "quantile_cont(y - s, 0.9)"),
    "poisson": Loss("exp(s) - y", "exp(s + 0.7)", f"ln({_MEAN})"),
    "gamma": Loss("1.0 - y * exp(-s)", "y * exp(-s)", f"ln({_MEAN})"),
    "tweedie": Loss("exp(0.5 * s) - y * exp(-0.5 * s)", "0.5 * exp(0.5 * s) + 0.5 * y * exp(-0.5 * s)", f"ln({_MEAN})"),
    "binary": Loss("1.0 / (1.0 + exp(-s)) - y", "(1.0 / (1.0 + exp(-s))) * (1.0 - 1.0 / (1.0 + exp(-s)))", _ODDS),
    "cross_entropy": Loss("1.0 / (1.0 + exp(-s)) - y", "(1.0 / (1.0 + exp(-s))) * (1.0 - 1.0 / (1.0 + exp(-s)))", _ODDS),
    "cross_entropy_lambda": Loss("1.0 / (1.0 + exp(-s)) - y", "(1.0 / (1.0 + exp(-s))) * (1.0 - 1.0 / (1.0 + exp(-s)))", f"ln(exp({_MEAN}) - 1)"),
}


@dataclass(frozen=True)
class Task:
    """What is trained: objective, label, number of classes (one score each), iterations, and the parameters that the SQL knows."""

    objective: str
    label: str
    classes: int = 1
    iterations: int = 3
    rate: float = 0.5
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0
    min_data: int = 20
    weight: bool = False
    rising: bool = False
    levels: int = 2
    bins: int = 0
    renew: bool = False
    more: dict = field(default_factory=dict)

    def parameters(self) -> dict:
        own = {"objective": self.objective, "num_iterations": self.iterations, "learning_rate": self.rate, "num_leaves": 2**self.levels, "max_depth": self.levels, "min_data_in_leaf": self.min_data, "min_data_in_bin": 1, "count_mode": "exact", "lambda_l1": self.l1, "lambda_l2": self.l2, "min_gain_to_split": self.min_gain}
        own |= {"num_class": self.classes} if self.classes > 1 else {}
        own |= {"use_quantized_grad": True, "num_grad_quant_bins": self.bins, "stochastic_rounding": False, "quant_train_renew_leaf": self.renew} if self.bins else {}
        return own | ({"monotone_constraints": [1, 0, 0, 0]} if self.rising else {}) | self.more


def trained(spark: SparkSession, sf_dir: str, task: Task) -> GbtModel:
    columns: list[Column] = [F.expr(LABELS[task.label]).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in FEATURES]]
    if task.weight:
        columns.append((F.col("l_suppkey") % 3 + 1).cast("double").alias("weight"))
    df = table(spark, sf_dir, "lineitem").select(*columns)
    return train(task.parameters(), GbtDataset(df, "label", weight="weight" if task.weight else None))


def nodes(spark: SparkSession, sf_dir: str, task: Task) -> DataFrame:
    """tree, feature and threshold of splits, n, and value of leaves."""
    rows = trained(spark, sf_dir, task).nodes(spark)
    leaf = F.col("split_feature").isNull()
    return rows.select(F.col("tree_index").alias("tree"), F.col("split_feature").alias("feature"), F.round(F.col("threshold").cast("double"), 6).alias("threshold"), F.col("count").alias("n"), F.when(leaf, F.round("value", 4)).alias("value"))


def _gradients(task: Task, k: int) -> tuple[str, str]:
    """g and h of score s<k>, from all scores of a row."""
    if task.objective == "multiclass":
        p = f"exp(s{k}) / ({' + '.join(f'exp(s{i})' for i in range(task.classes))})"
        return f"{p} - (y = {k})::INT", f"{task.classes / (task.classes - 1.0)!r} * ({p}) * (1.0 - {p})"
    if task.objective == "multiclassova":
        p = f"(1.0 / (1.0 + exp(-s{k})))"
        return f"{p} - (y = {k})::INT", f"{p} * (1.0 - {p})"
    loss, scored = LOSSES[task.objective], f"(SELECT s{k} AS s)"
    return f"(SELECT {loss.g} FROM {scored})", f"(SELECT {loss.h} FROM {scored})"


def _start(task: Task, k: int) -> str:
    if task.objective == "multiclass":
        return f"ln(sum(w * (y = {k})::INT) / sum(w))"
    if task.objective == "multiclassova":
        q = f"sum(w * (y = {k})::INT) / sum(w)"
        return f"ln(({q}) / (1 - {q}))"
    return LOSSES[task.objective].start


def sql(task: Task) -> str:
    """The trees of a task as one statement, tree by tree."""
    scores = range(task.classes)
    parts = [f"base AS MATERIALIZED (SELECT {', '.join(f'{c}::DOUBLE AS x{i}' for i, c in enumerate(FEATURES))}, ({LABELS[task.label]})::DOUBLE AS y, {'(l_suppkey % 3 + 1)::DOUBLE' if task.weight else '1.0'} AS w FROM lineitem)",
             f"start AS MATERIALIZED (SELECT {', '.join(f'{_start(task, k)} AS b{k}' for k in scores)} FROM base)",
             f"rows_0 AS MATERIALIZED (SELECT base.*, {', '.join(f'b{k} AS s{k}' for k in scores)} FROM base, start)"]
    found, soft = [], lambda x: f"(sign({x}) * greatest(abs({x}) - {task.l1!r}, 0.0))"
    gain = lambda g, h: f"{soft(g)} * {soft(g)} / ({h} + {task.l2!r})"
    for turn in range(task.iterations):
        rows = f"rows_{turn}"
        for k in scores:
            t = turn * task.classes + k
            g, h = _gradients(task, k)
            whole = f"SELECT *, w * ({g}) AS g0, w * ({h}) AS h0 FROM {rows}"
            near = lambda x, step: f"sign({x}) * floor(abs({x}) / {step} + 0.5) * {step}" if task.bins else x
            widths = f", max(abs(g0)) OVER () / {max(1, task.bins // 2)} AS gs, max(abs(h0)) OVER () / {max(1, task.bins)} AS hs"
            parts.append(f"node_{t}_0 AS MATERIALIZED (SELECT * EXCLUDE (gs, hs), {near('g0', 'gs')} AS g, {near('h0', 'hs')} AS h, 0 AS node FROM (SELECT *{widths} FROM ({whole})))")
            for level in range(task.levels):
                name, here = f"{t}_{level}", f"node_{t}_{level}"
                values = " UNION ALL ".join(f"SELECT node, {i} AS f, x{i} AS v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {here} GROUP BY ALL" for i in range(len(FEATURES)))
                order = "(PARTITION BY node, f ORDER BY v)"
                rising = " AND NOT (f = 0 AND -lg / lh > -(sg - lg) / (sh - lh))" if task.rising else ""
                parts.append(f"""best_{name} AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v DESC) AS place FROM (
    SELECT node, f, v, CASE WHEN v = 0 THEN 1e-35 ELSE (v + nv) / 2 END AS cut, sn, {gain('lg', 'lh')} + {gain('(sg - lg)', '(sh - lh)')} - ({gain('sg', 'sh')}) AS gain FROM (
      SELECT *, sum(g) OVER {order} AS lg, sum(h) OVER {order} AS lh, sum(n) OVER {order} AS ln, lead(v) OVER {order} AS nv, sum(g) OVER (PARTITION BY node, f) AS sg, sum(h) OVER (PARTITION BY node, f) AS sh, sum(n) OVER (PARTITION BY node, f) AS sn FROM ({values}))
    WHERE nv IS NOT NULL AND ln >= {task.min_data} AND sn - ln >= {task.min_data} AND lh >= 1e-3 AND sh - lh >= 1e-3{rising})
  WHERE gain > {task.min_gain!r}) WHERE place = 1)""")
                x = f"CASE b.f {' '.join(f'WHEN {i} THEN x{i}' for i in range(len(FEATURES)))} END"
                parts.append(f"node_{t}_{level + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN b.f IS NULL THEN -1 - abs(r.node) * 2 - 1 ELSE r.node * 2 + ({x} > b.cut)::INT END AS node FROM {here} r LEFT JOIN best_{name} b ON r.node = b.node)")
                names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATURES))
                found.append(f"SELECT {t}::BIGINT AS tree, CASE f {names} END AS feature, round(cut, 6) AS threshold, sn::BIGINT AS n, NULL::DOUBLE AS value FROM best_{name}")
            renew = LOSSES[task.objective].renew if task.objective in LOSSES else None
            value = renew.replace("s", f"s{k}").replace(f"s{k}um", "sum") if renew else f"-{soft('sum(g0)' if task.renew else 'sum(g)')} / (sum({'h0' if task.renew else 'h'}) + {task.l2!r})"
            grown = f"EXISTS (SELECT 1 FROM best_{t}_0)"
            parts.append(f"leaf_{t} AS MATERIALIZED (SELECT node, count(*) AS n, CASE WHEN {grown} THEN {task.rate!r} * ({value}) ELSE 0.0 END AS value FROM node_{t}_{task.levels} GROUP BY node)")
            shift = f" + (SELECT b{k} FROM start)" if not turn else ""
            found.append(f"SELECT {t}, NULL, NULL, n, round(value{shift}, 4) FROM leaf_{t}")
            # scores of the row's other trees change only once the iteration is over
            parts.append(f"next_{t} AS MATERIALIZED (SELECT r.* EXCLUDE (g, h, g0, h0, node), l.value AS d{k} FROM node_{t}_{task.levels} r JOIN leaf_{t} l ON r.node = l.node)")
            rows = f"next_{t}"
        changed = ", ".join(f"s{k} + d{k} AS s{k}" for k in scores)
        parts.append(f"rows_{turn + 1} AS MATERIALIZED (SELECT {', '.join(f'x{i}' for i in range(len(FEATURES)))}, y, w, {changed} FROM {rows})")
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(found)


TASKS = {
    "grow_regression": Task("regression", "price"),
    "grow_regression_weighted": Task("regression", "price", weight=True),
    "grow_regression_regularised": Task("regression", "price", l1=2.0, l2=10.0, min_gain=0.01, min_data=200),
    "grow_regression_rising": Task("regression", "price", levels=1, rising=True),
    "grow_huber": Task("huber", "price"),
    "grow_fair": Task("fair", "price"),
    "grow_l1": Task("regression_l1", "price"),
    "grow_quantile": Task("quantile", "price"),
    "grow_poisson": Task("poisson", "price"),
    "grow_gamma": Task("gamma", "price"),
    "grow_tweedie": Task("tweedie", "price"),
    "grow_binary": Task("binary", "flag"),
    "grow_binary_weighted": Task("binary", "flag", weight=True),
    "grow_cross_entropy": Task("cross_entropy", "share"),
    "grow_cross_entropy_lambda": Task("cross_entropy_lambda", "share"),
    "grow_quantised": Task("binary", "flag", bins=16),
    "grow_quantised_renewed": Task("regression", "price", bins=64, renew=True),
    "grow_multiclass": Task("multiclass", "class", classes=3, iterations=2),
    "grow_multiclassova": Task("multiclassova", "class", classes=3, iterations=2),
}

for _name, _task in TASKS.items():
    add(_name, lambda spark, sf_dir, task=_task: nodes(spark, sf_dir, task), sql(_task))
