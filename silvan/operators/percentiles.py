"""Percentiles by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import before, held


def weighted(df: DataFrame, keys: list[str], value: Column, weight: Column, alpha: float, tie: list[Column] = ()) -> DataFrame:
    """keys and value: the weighted percentile of each group.

    With values in order and their running weights, it is the first value whose running weight is above alpha times the
    total; between two values, the point between them in proportion if the step is 1 or more, else the lower one.
    """
    base = df.select(*keys, value.alias("v"), weight.cast("double").alias("w"), *[t.alias(f"tie{i}") for i, t in enumerate(tie)])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = group.orderBy("v", *[f"tie{i}" for i in range(len(tie))])
    run = base.select(*keys, "v", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cdf"), F.row_number().over(order).alias("r"), F.count(F.lit(1)).over(group).alias("n"), (F.sum("w").over(group) * alpha).alias("t"), F.lag("v").over(order).alias("v0"))
    run = run.withColumn("cdf0", F.lag("cdf").over(group.orderBy("r")))
    # the first row above the target, or the last one
    hit = run.where(((F.col("cdf") > F.col("t")) & (F.coalesce("cdf0", F.lit(float("-inf"))) <= F.col("t"))) | ((F.col("r") == F.col("n")) & (F.col("cdf") <= F.col("t"))))
    between = F.when(F.col("cdf") - F.col("cdf0") >= 1.0, F.col("v0") + (F.col("t") - F.col("cdf0")) / (F.col("cdf") - F.col("cdf0")) * (F.col("v") - F.col("v0"))).otherwise(F.col("v0"))
    return hit.select(*keys, F.when((F.col("r") == 1) | (F.col("r") == F.col("n")), F.col("v")).otherwise(between).alias("value"))


def exact(df: DataFrame, keys: list[str], value: Column, alphas: list[float]) -> DataFrame:
    """keys and q0, q1, ..: the percentiles of each group, interpolated between the two rows around them. Nulls and NaN are left out.

    Equal values become one row with a count; running counts then tell which value stands at a rank, so no task holds
    all values of a group.
    """
    rows = df.select(*keys, value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ties = held(rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("rows")))
    run = before(ties, "v", ["rows"], keys, descending=False)
    totals = ties.groupBy(*keys).agg(F.sum("rows").alias("total"))
    run = run.join(totals, keys) if keys else run.join(F.broadcast(totals))
    there = lambda rank: F.max(F.when((F.col("rows_before") <= rank) & (rank < F.col("rows_before") + F.col("rows")), F.col("v")))
    parts = []
    for i, alpha in enumerate(alphas):
        at = (F.col("total") - 1) * alpha
        parts += [there(F.floor(at)).alias(f"low{i}"), there(F.ceil(at)).alias(f"high{i}"), F.max(at - F.floor(at)).alias(f"share{i}")]
    found = run.groupBy(*keys).agg(*parts)
    return found.select(*keys, *[(F.col(f"low{i}") + F.col(f"share{i}") * (F.col(f"high{i}") - F.col(f"low{i}"))).alias(f"q{i}") for i in range(len(alphas))])
