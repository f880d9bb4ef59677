"""Leaf histograms and split scans as relational operators. The trainer's kernel computes the same sums from blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bits of a packed key that hold a bin, and a feature.
BIN_BITS, FEATURE_BITS = 24, 16


def explode_histogram(df: DataFrame, leaf: Column, bins: dict[str, Column], g: Column, h: Column) -> DataFrame:
    """leaf, feature, bin, g, h, n: sums by unpivoting the features and one hash aggregate with map-side combine.

    Leaf, feature and bin travel as one number, so that rows unpivot into an array of longs and are hashed as such.
    Leaves are numbers below 2 ** 23; a null bin has a row of its own.
    """
    keys = [leaf.cast("long") * (1 << BIN_BITS + FEATURE_BITS) + (i << BIN_BITS) + F.coalesce(c.cast("long") + 1, F.lit(0)) for i, c in enumerate(bins.values())]
    rows = df.select(F.explode(F.array(*keys)).alias("key"), g.alias("g"), h.alias("h"))
    sums = rows.groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    part = lambda shift, bits: F.shiftright("key", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return sums.select(F.shiftright("key", BIN_BITS + FEATURE_BITS).cast("int").alias("leaf"), part(BIN_BITS, FEATURE_BITS).alias("feature"), F.nullif(part(0, BIN_BITS), F.lit(0)).alias("raw"), "g", "h", "n").select("leaf", "feature", (F.col("raw") - 1).alias("bin"), "g", "h", "n")


def grouping_sets_histogram(df: DataFrame, leaf: Column, bins: dict[str, Column], g: Column, h: Column) -> DataFrame:
    """The same by GROUPING SETS, one for each feature."""
    names = [f"bin_{i}" for i in range(len(bins))]
    rows = df.select(leaf.alias("leaf"), g.alias("g"), h.alias("h"), *[c.cast("int").alias(n) for n, c in zip(names, bins.values(), strict=True)])
    sets = [[F.col("leaf"), F.col(n)] for n in names]
    sums = rows.groupingSets(sets, "leaf", *names).agg(F.grouping_id().alias("gid"), F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    k = len(names)
    which = F.coalesce(*[F.when(F.col("gid") == ((1 << k) - 1 - (1 << (k - 1 - i))), F.lit(i)) for i in range(k)])
    return sums.select("leaf", which.alias("feature"), F.coalesce(*names).alias("bin"), "g", "h", "n")


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Histogram of the other child: parent less child, over (feature, bin)."""
    c = child.select("feature", "bin", F.col("g").alias("cg"), F.col("h").alias("ch"), F.col("n").alias("cn"))
    joined = parent.join(c, ["feature", "bin"], "left")
    out = joined.select("feature", "bin", *[(F.col(x) - F.coalesce(F.col(f"c{x}"), F.lit(0))).alias(x) for x in ("g", "h", "n")])
    return out.where("n > 0")


def numeric_scan(hist: DataFrame, l1: float = 0.0, l2: float = 0.0, min_data: int = 20, min_hess: float = 1e-3, min_gain: float = 0.0) -> DataFrame:
    """leaf, feature, bin, gain and left sums of every admissible threshold, missing values apart from none.

    Running sums over bins; windows are partitioned by leaf and feature, so none holds more than one feature's bins.
    """
    key = Window.partitionBy("leaf", "feature")
    upto = key.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    soft = (lambda x: F.signum(x) * F.greatest(F.abs(x) - l1, F.lit(0.0))) if l1 else (lambda x: x)
    rows = hist.select("leaf", "feature", "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(key).alias(f"t{c}") for c in "ghn"], F.max("bin").over(key).alias("last"))
    gain = lambda g, h: soft(g) * soft(g) / (h + l2)
    rg, rh, rn = (F.col(f"t{c}") - F.col(f"l{c}") for c in "ghn")
    total = gain(F.col("lg"), F.col("lh")) + gain(rg, rh) - gain(F.col("tg"), F.col("th"))
    ok = (F.col("bin") < F.col("last")) & (F.col("ln") >= min_data) & (rn >= min_data) & (F.col("lh") >= min_hess) & (rh >= min_hess)
    return rows.where(ok).select("leaf", "feature", "bin", total.alias("gain"), "lg", "lh", "ln").where(F.col("gain") > min_gain)


def missing_scan(hist: DataFrame, missing: DataFrame, l2: float = 0.0, min_data: int = 20) -> DataFrame:
    """Thresholds of features with a missing bin, with missing rows on either side: leaf, feature, bin, default_left, gain.

    hist: bins of known values; missing: leaf, feature, g, h, n of the missing ones.
    """
    key = Window.partitionBy("leaf", "feature")
    upto = key.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.select("leaf", "feature", "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(key).alias(f"t{c}") for c in "ghn"], F.max("bin").over(key).alias("last"))
    rows = rows.join(missing.select("leaf", "feature", *[F.col(c).alias(f"m{c}") for c in "ghn"]), ["leaf", "feature"])
    side = F.explode(F.array(F.lit(True), F.lit(False))).alias("default_left")
    rows = rows.select("*", side).where(~F.col("default_left") | (F.col("bin") < F.col("last")))
    left = {c: F.col(f"l{c}") + F.when(F.col("default_left"), F.col(f"m{c}")).otherwise(0) for c in "ghn"}
    all_ = {c: F.col(f"t{c}") + F.col(f"m{c}") for c in "ghn"}
    right = {c: all_[c] - left[c] for c in "ghn"}
    gain = lambda s: s["g"] * s["g"] / (s["h"] + l2)
    ok = (left["n"] >= min_data) & (right["n"] >= min_data)
    return rows.where(ok).select("leaf", "feature", "bin", "default_left", (gain(left) + gain(right) - gain(all_)).alias("gain")).where("gain > 0")


def categorical_scan(hist: DataFrame, l2: float, cat_l2: float, cat_smooth: float, most: int, min_data: int) -> DataFrame:
    """leaf, feature, direction, k, gain: the first k categories by g / (h + cat_smooth), in either direction, against the others."""
    key = Window.partitionBy("leaf", "feature")
    totals = hist.select("*", F.sum("g").over(key).alias("tg"), F.sum("h").over(key).alias("th"), F.sum("n").over(key).alias("tn"))
    used = totals.where(F.col("n") >= cat_smooth).withColumn("ratio", F.col("g") / (F.col("h") + cat_smooth)).withColumn("many", F.count(F.lit(1)).over(key))
    parts = []
    for name, order in ((1, [F.asc("ratio"), F.asc("bin")]), (-1, [F.desc("ratio"), F.desc("bin")])):
        w = key.orderBy(*order)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        parts.append(used.select("leaf", "feature", F.lit(name).alias("direction"), F.row_number().over(w).alias("k"), *[F.sum(c).over(run).alias(f"l{c}") for c in "ghn"], "tg", "th", "tn", "many"))
    rows = parts[0].unionByName(parts[1])
    rg, rh, rn = F.col("tg") - F.col("lg"), F.col("th") - F.col("lh"), F.col("tn") - F.col("ln")
    gain = F.col("lg") ** 2 / (F.col("lh") + l2 + cat_l2) + rg**2 / (rh + l2 + cat_l2) - F.col("tg") ** 2 / (F.col("th") + l2)
    ok = (F.col("k") <= F.least(F.lit(most), F.floor((F.col("many") + 1) / 2))) & (F.col("ln") >= min_data) & (rn >= min_data)
    return rows.where(ok).select("leaf", "feature", "direction", "k", gain.alias("gain")).where("gain > 0")


def onehot_scan(hist: DataFrame, l2: float, min_data: int) -> DataFrame:
    """leaf, feature, bin, gain: one category against the others."""
    key = Window.partitionBy("leaf", "feature")
    rows = hist.select("*", *[F.sum(c).over(key).alias(f"t{c}") for c in "ghn"])
    rg, rh, rn = F.col("tg") - F.col("g"), F.col("th") - F.col("h"), F.col("tn") - F.col("n")
    gain = F.col("g") ** 2 / (F.col("h") + l2) + rg**2 / (rh + l2) - F.col("tg") ** 2 / (F.col("th") + l2)
    return rows.where((F.col("n") >= min_data) & (rn >= min_data)).select("leaf", "feature", "bin", gain.alias("gain")).where("gain > 0")


def best_split(candidates: DataFrame) -> DataFrame:
    """The best candidate of each leaf: greatest gain, then smallest feature, then greatest bin."""
    order = Window.partitionBy("leaf").orderBy(F.desc("gain"), F.asc("feature"), F.desc("bin"))
    return candidates.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def leaf_outputs(sums: DataFrame, l1: float, l2: float, max_delta: float = 0.0) -> DataFrame:
    """leaf, output of (leaf, g, h)."""
    g = F.signum("g") * F.greatest(F.abs("g") - l1, F.lit(0.0))
    out = -g / (F.col("h") + l2)
    return sums.select("leaf", (F.greatest(F.least(out, F.lit(max_delta)), F.lit(-max_delta)) if max_delta else out).alias("output"))


def gram(df: DataFrame, leaf: Column, x: list[Column], g: Column, h: Column) -> DataFrame:
    """leaf, i, j, xhx and i, xg: sums of the normal equations of linear leaves, long."""
    k = len(x)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (x[i] * x[j] * h).alias("v")) for i in range(k) for j in range(i, k)], *[F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), (x[i] * g).alias("v")) for i in range(k)]))
    return df.select(leaf.alias("leaf"), pairs.alias("p")).groupBy("leaf", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("p.v").alias("v"))


def voted_features(hist: DataFrame, top: int, l2: float = 0.0, min_data: int = 20) -> DataFrame:
    """leaf, feature: the features that workers elect for the merging of histograms.

    hist: worker, leaf, feature, bin, g, h, n, of each worker's own rows. A worker votes for the `top` features of its best
    split gains in a leaf; 2 * top are elected, by the sum of the gains that their voters weigh with their share of the
    leaf's rows. Ties go to the smaller feature.
    """
    keyed = hist.select(F.struct("worker", "leaf").alias("leaf"), "feature", "bin", "g", "h", "n")
    gains = numeric_scan(keyed, l2=l2, min_data=min_data).groupBy("leaf", "feature").agg(F.max("gain").alias("gain"))
    own = Window.partitionBy("leaf").orderBy(F.desc("gain"), "feature")
    votes = gains.withColumn("place", F.row_number().over(own)).where(F.col("place") <= top).select("leaf.worker", F.col("leaf.leaf").alias("leaf"), "feature", "gain")
    rows = hist.groupBy("worker", "leaf", "feature").agg(F.sum("n").alias("rows")).groupBy("worker", "leaf").agg(F.max("rows").alias("rows"))
    weighed = votes.join(rows, ["worker", "leaf"]).groupBy("leaf", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("score"))
    order = Window.partitionBy("leaf").orderBy(F.desc("score"), "feature")
    return weighed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * top).select("leaf", "feature")


def voted_histogram(hist: DataFrame, top: int, l2: float = 0.0, min_data: int = 20) -> DataFrame:
    """leaf, feature, bin, g, h, n of the elected features over all workers; only their bins are shuffled."""
    elected = voted_features(hist, top, l2, min_data)
    return hist.join(elected, ["leaf", "feature"], "left_semi").groupBy("leaf", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])


def discretised(df: DataFrame, g: Column, h: Column, bins: int = 4) -> DataFrame:
    """df with gq, hq: gradients and hessians as whole numbers of steps, and g_step, h_step: what a step is worth.

    The greatest gradient is bins / 2 steps, the greatest hessian `bins`. Rounding is to the nearest, halves away from zero.
    """
    most = df.agg(F.max(F.abs(g)).alias("g_most"), F.max(F.abs(h)).alias("h_most"))
    steps = most.select((F.col("g_most") / (bins // 2)).alias("g_step"), (F.col("h_most") / bins).alias("h_step"))
    near = lambda x, step: F.when(F.col(step) > 0, (F.signum(x) * F.floor(F.abs(x) / F.col(step) + 0.5)).cast("int")).otherwise(0)
    return df.join(F.broadcast(steps)).withColumns({"gq": near(g, "g_step"), "hq": near(h, "h_step")})
