"""Running sums over a whole table without putting it into one task.

Rows are cut into buckets by quantiles of the order column, windows run within a bucket, and the buckets' own totals
(at most BUCKETS for each key) are summed up and broadcast.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128


def held(df: DataFrame) -> DataFrame:
    """df, kept (on disk where memory is short) for the passes of before(); Spark frees it with the session, or lets go of it under pressure of others."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _bucket(x: Column, bounds: list[float], lo: int, hi: int) -> Column:
    """Number of the first bound that x does not exceed, by nested conditions."""
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x <= F.lit(bounds[mid]), _bucket(x, bounds, lo, mid)).otherwise(_bucket(x, bounds, mid + 1, hi))


def before(df: DataFrame, order: str, sums: list[str], keys: list[str] = (), descending: bool = True) -> DataFrame:
    """df with <column>_before for each of `sums`: its sum over the rows of the same keys that come earlier in the order.

    df has one row for each (keys, order), so that no order among equals is needed. It is read three times; callers that
    make it at some cost pass it held().
    """
    keys = list(keys)
    found = df.agg(F.percentile_approx(F.col(order).cast("double"), F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(1000)).alias("b")).first().b
    bounds = sorted(set(found or []))
    rows = df.withColumn("running_bucket", _bucket(F.col(order).cast("double"), bounds, 0, len(bounds)))
    if descending:
        rows = rows.withColumn("running_bucket", -F.col("running_bucket"))
    group = [*keys, "running_bucket"]
    totals = rows.groupBy(*group).agg(*[F.sum(c).alias(f"{c}_total") for c in sums])
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("running_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, *[F.coalesce(F.sum(f"{c}_total").over(earlier), F.lit(0)).alias(f"{c}_offset") for c in sums])
    within = Window.partitionBy(*group).orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(offsets), group)
    out = joined.select(*df.columns, *[(F.col(f"{c}_offset") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before") for c in sums])
    return out
