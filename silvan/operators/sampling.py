"""Row sampling and folds as columns: draws are hashes of keys, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import before, held

#: Hashes are compared with a fraction of this.
GRAIN = 1 << 20


def draw(key: list[Column], seed: int) -> Column:
    """A number in [0, 1) for each key."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(GRAIN)) / float(GRAIN)


def bagging(df: DataFrame, u: Column, fraction: float) -> DataFrame:
    return df.where(u < fraction)


def balanced_bagging(df: DataFrame, u: Column, positive: Column, pos_fraction: float, neg_fraction: float) -> DataFrame:
    return df.where(u < F.when(positive, F.lit(pos_fraction)).otherwise(F.lit(neg_fraction)))


def goss(df: DataFrame, size: Column, u: Column, top_rate: float, other_rate: float) -> DataFrame:
    """Rows with the greatest `size`, and a sample of the rest whose weight makes up for those left out: column `amplify`.

    The threshold is the value at a rank, from running counts of distinct sizes: one row, which is broadcast.
    """
    n = df.count()
    top, other = max(1, int(n * top_rate)), max(1, int(n * other_rate))
    ties = df.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    threshold = before(held(ties), "size", ["rows"]).where(F.col("rows_before") + F.col("rows") >= top).agg(F.max("size").alias("size"))
    rows = df.withColumn("size", size).join(F.broadcast(threshold.select(F.col("size").alias("bar"))))
    keep = F.col("size") >= F.col("bar")
    rest = n - top
    return rows.withColumn("amplify", F.when(keep, 1.0).when(u < other / max(1, rest), F.lit(rest / other))).where("amplify is not null").drop("bar")


def group_fold(group: Column, n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(n)).cast("int")


#: Parts of the range of hashes, in each of which the rows of a label are numbered by one task.
DEALT = 256


def stratified_folds(df: DataFrame, label: Column, key: list[Column], n: int, seed: int, column: str = "fold") -> DataFrame:
    """Folds dealt in turn within each label, in the order of a hash.

    Rows are numbered within parts of the hashes' range, and begin behind the rows of the label in earlier parts, so that
    no task has all rows of a label. df is read twice.
    """
    part = F.floor(F.xxhash64(*key, F.lit(seed)) / F.lit(float(2**64 // DEALT))).cast("int")
    rows = df.withColumn("fold_label", label).withColumn("fold_part", part)
    earlier = Window.partitionBy("fold_label").orderBy("fold_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("fold_label", "fold_part").agg(F.count(F.lit(1)).alias("rows"))
    starts = sizes.select(F.col("fold_label").alias("start_label"), F.col("fold_part").alias("start_part"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    joined = rows.join(starts, F.col("fold_label").eqNullSafe(F.col("start_label")) & (F.col("fold_part") == F.col("start_part")))
    within = Window.partitionBy("fold_label", "fold_part").orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    return joined.select(*df.columns, ((F.col("start") + F.row_number().over(within) - 1) % n).cast("int").alias(column))
