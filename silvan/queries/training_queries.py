"""Queries of the training steps: bins, histograms, split scans, sampling, folds, model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import histogram, percentiles, sampling
from ..operators.running import before
from .registry import add, query, table

#: Rows of the histogram queries: leaf, four binned features, gradients.
ROWS_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 3 AS leaf, floor(l_quantity / 4)::INT AS b0, (l_discount * 100)::INT AS b1, (l_tax * 100)::INT AS b2, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS b3,
  l_extendedprice / 10000.0 - 3.0 AS g, 1.0 + l_quantity / 50.0 AS h FROM lineitem)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber") % 3).alias("leaf"), F.floor(F.col("l_quantity") / 4).cast("int").alias("b0"), F.round(F.col("l_discount") * 100).cast("int").alias("b1"), F.round(F.col("l_tax") * 100).cast("int").alias("b2"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("b3"), (F.col("l_extendedprice") / 10000.0 - 3.0).alias("g"), (1.0 + F.col("l_quantity") / 50.0).alias("h"),
    )


BINS = ("b0", "b1", "b2", "b3")


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.explode_histogram(rows(spark, sf_dir), F.col("leaf"), {n: F.col(n) for n in BINS}, F.col("g"), F.col("h"))


HIST_SQL = f"(SELECT leaf, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT leaf, g, h, unnest([0, 1, 2, 3]) AS feature, unnest([b0, b1, b2, b3]) AS bin FROM {ROWS_SQL}) GROUP BY leaf, feature, bin)"
_SHOWN = "SELECT leaf, feature, bin, round(g, 4) AS g, round(h, 4) AS h, n FROM "


def shown(df: DataFrame) -> DataFrame:
    return df.select("leaf", "feature", "bin", F.round("g", 4).alias("g"), F.round("h", 4).alias("h"), "n")


add("hist_explode", lambda s, d: shown(hist(s, d)), _SHOWN + HIST_SQL)
add("hist_grouping_sets", lambda s, d: shown(histogram.grouping_sets_histogram(rows(s, d), F.col("leaf"), {n: F.col(n) for n in BINS}, F.col("g"), F.col("h"))), _SHOWN + HIST_SQL)


@query(f"SELECT feature, bin, round(sum(g), 4) AS g, round(sum(h), 4) AS h, sum(n)::BIGINT AS n FROM {HIST_SQL} WHERE leaf <> 0 GROUP BY feature, bin")
def hist_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = hist(spark, sf_dir)
    parent = all_.groupBy("feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    return histogram.subtract(parent, all_.where("leaf = 0")).select("feature", "bin", F.round("g", 4).alias("g"), F.round("h", 4).alias("h"), "n")


@query(f"SELECT round(sum(g), 4) AS g, round(sum(h), 4) AS h, count(*) AS n, round(max(abs(g)), 6) AS top FROM {ROWS_SQL}")
def root_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).agg(F.round(F.sum("g"), 4).alias("g"), F.round(F.sum("h"), 4).alias("h"), F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs("g")), 6).alias("top"))


_SCAN = f"""(SELECT leaf, feature, bin, (lg * lg / (lh + 1.0) + (tg - lg) * (tg - lg) / (th - lh + 1.0) - tg * tg / (th + 1.0)) AS gain, lg, lh, ln FROM (
  SELECT *, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln, sum(g) OVER k AS tg, sum(h) OVER k AS th, sum(n) OVER k AS tn, max(bin) OVER k AS last FROM {HIST_SQL}
  WINDOW k AS (PARTITION BY leaf, feature), w AS (PARTITION BY leaf, feature ORDER BY bin)) WHERE bin < last AND ln >= 20 AND tn - ln >= 20)"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.numeric_scan(hist(spark, sf_dir), l2=1.0)


add("split_scan_numeric", lambda s, d: scan(s, d).select("leaf", "feature", "bin", F.round("gain", 5).alias("gain"), "ln"), f"SELECT leaf, feature, bin, round(gain, 5) AS gain, ln::BIGINT AS ln FROM {_SCAN} WHERE gain > 0")
add("best_split_argmax", lambda s, d: histogram.best_split(scan(s, d)).select("leaf", "feature", "bin", F.round("gain", 5).alias("gain")), f"SELECT leaf, feature, bin, round(gain, 5) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY gain DESC, feature, bin DESC) AS r FROM {_SCAN} WHERE gain > 0) WHERE r = 1")


@query(f"""WITH k AS (SELECT *, sum(g) OVER (PARTITION BY leaf, feature ORDER BY bin) AS lg, sum(h) OVER (PARTITION BY leaf, feature ORDER BY bin) AS lh, sum(n) OVER (PARTITION BY leaf, feature ORDER BY bin) AS ln,
    sum(g) OVER (PARTITION BY leaf, feature) AS tg, sum(h) OVER (PARTITION BY leaf, feature) AS th, sum(n) OVER (PARTITION BY leaf, feature) AS tn, max(bin) OVER (PARTITION BY leaf, feature) AS last FROM {HIST_SQL} WHERE feature = 1 AND bin > 0),
  c AS (SELECT k.leaf, k.feature, k.bin, d.default_left, lg + d.default_left::INT * m.g AS ag, lh + d.default_left::INT * m.h AS ah, ln + d.default_left::INT * m.n AS an, tg + m.g AS tg, th + m.h AS th, tn + m.n AS tn
    FROM k JOIN (SELECT * FROM {HIST_SQL} WHERE feature = 1 AND bin = 0) m ON k.leaf = m.leaf, (SELECT unnest([true, false]) AS default_left) d WHERE NOT d.default_left OR k.bin < k.last)
  SELECT leaf, feature, bin, default_left, round(ag * ag / ah + (tg - ag) * (tg - ag) / (th - ah) - tg * tg / th, 5) AS gain FROM c WHERE an >= 20 AND tn - an >= 20 AND ag * ag / ah + (tg - ag) * (tg - ag) / (th - ah) - tg * tg / th > 0""")
def split_scan_missing_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discount of 0 counts as missing."""
    h = hist(spark, sf_dir).where("feature = 1")
    return histogram.missing_scan(h.where("bin > 0"), h.where("bin = 0")).select("leaf", "feature", "bin", "default_left", F.round("gain", 5).alias("gain"))


#: Category histogram: part brands over two leaves.
BRANDS_SQL = "(SELECT 0 AS feature, p_size % 2 AS leaf, replace(p_brand, 'Brand#', '')::INT AS bin, sum(p_retailprice / 1000.0 - 1.2 + (length(p_name) % 7) * 0.1) AS g, sum(1.0::DOUBLE) AS h, count(*) AS n FROM part GROUP BY ALL)"


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("p_retailprice") / 1000.0 - 1.2 + (F.length("p_name") % 7) * 0.1
    return table(spark, sf_dir, "part").groupBy(F.lit(0).alias("feature"), (F.col("p_size") % 2).alias("leaf"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("bin")).agg(F.sum(g).alias("g"), F.sum(F.lit(1.0)).alias("h"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT *, sum(g) OVER (PARTITION BY leaf) AS tg, sum(h) OVER (PARTITION BY leaf) AS th, sum(n) OVER (PARTITION BY leaf) AS tn FROM {BRANDS_SQL}), u AS (SELECT *, g / (h + 10) AS ratio, count(*) OVER (PARTITION BY leaf) AS many FROM t WHERE n >= 10),
  r AS (SELECT leaf, feature, 1 AS direction, row_number() OVER a AS k, sum(g) OVER a AS lg, sum(h) OVER a AS lh, sum(n) OVER a AS ln, tg, th, tn, many FROM u WINDOW a AS (PARTITION BY leaf ORDER BY ratio, bin)
    UNION ALL SELECT leaf, feature, -1, row_number() OVER b, sum(g) OVER b, sum(h) OVER b, sum(n) OVER b, tg, th, tn, many FROM u WINDOW b AS (PARTITION BY leaf ORDER BY ratio DESC, bin DESC))
  SELECT leaf, feature, direction, k, round(gain, 6) AS gain FROM (SELECT *, lg * lg / (lh + 10) + (tg - lg) * (tg - lg) / (th - lh + 10) - tg * tg / th AS gain FROM r WHERE k <= least(32, (many + 1) // 2) AND ln >= 5 AND tn - ln >= 5) WHERE gain > 0""")
def split_scan_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.categorical_scan(brands(spark, sf_dir), 0.0, 10.0, 10.0, 32, 5).select("leaf", "feature", "direction", "k", F.round("gain", 6).alias("gain"))


@query(f"SELECT leaf, feature, bin, round(gain, 6) AS gain FROM (SELECT *, g * g / h + (tg - g) * (tg - g) / (th - h) - tg * tg / th AS gain FROM (SELECT *, sum(g) OVER (PARTITION BY leaf) AS tg, sum(h) OVER (PARTITION BY leaf) AS th, sum(n) OVER (PARTITION BY leaf) AS tn FROM {BRANDS_SQL}) WHERE n >= 5 AND tn - n >= 5) WHERE gain > 0")
def split_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.onehot_scan(brands(spark, sf_dir), 0.0, 5).select("leaf", "feature", "bin", F.round("gain", 6).alias("gain"))


add("leaf_output_l1l2", lambda s, d: histogram.leaf_outputs(rows(s, d).groupBy("leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h")), 2.0, 3.0, 0.5).select("leaf", F.round("output", 7).alias("output")),
    f"SELECT leaf, round(greatest(least(-sign(g) * greatest(abs(g) - 2.0, 0.0) / (h + 3.0), 0.5), -0.5), 7) AS output FROM (SELECT leaf, sum(g) AS g, sum(h) AS h FROM {ROWS_SQL} GROUP BY leaf)")
add("refit_leaf_blend", lambda s, d: rows(s, d).groupBy("leaf").agg(F.round(0.9 * (F.first("leaf") * 0.01) + 0.1 * -F.sum("g") / (F.sum("h") + 1.0), 7).alias("value")), f"SELECT leaf, round(0.9 * leaf * 0.01 + 0.1 * -sum(g) / (sum(h) + 1.0), 7) AS value FROM {ROWS_SQL} GROUP BY leaf")
add("linear_leaf_gram", lambda s, d: histogram.gram(rows(s, d), F.col("leaf"), [F.col("b0").cast("double"), F.col("b1").cast("double"), F.lit(1.0)], F.col("g"), F.col("h")).select("leaf", "i", "j", F.round("v", 2).alias("v")),
    f"WITH r AS (SELECT leaf, g, h, [b0::DOUBLE, b1::DOUBLE, 1.0::DOUBLE] AS x FROM {ROWS_SQL}) SELECT leaf, i::INT AS i, j::INT AS j, round(sum(CASE WHEN j >= 0 THEN x[i + 1] * x[j + 1] * h ELSE x[i + 1] * g END), 2) AS v FROM r, (SELECT * FROM range(3) a(i), range(-1, 3) b(j) WHERE j = -1 OR j >= i) GROUP BY ALL")

# bins
add("bin_distinct_counts", lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_quantity").alias("value")).agg(F.count(F.lit(1)).alias("n")), "SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1")
_BOUNDS = (10.5, 20.5, 35.5)


def _bin_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.binning import FeatureBins

    bins = FeatureBins("l_quantity", bounds=[*_BOUNDS, float("inf"), float("nan")], missing="nan")
    value = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy(bins.bin_column(value).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


add("bin_transform", _bin_transform, "SELECT CASE WHEN l_linenumber = 7 THEN 4 WHEN l_quantity <= 10.5 THEN 0 WHEN l_quantity <= 20.5 THEN 1 WHEN l_quantity <= 35.5 THEN 2 ELSE 3 END AS bin, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
add("bin_equal_freq_bounds", lambda s, d: percentiles.exact(table(s, d, "lineitem"), [], F.col("l_extendedprice"), [q / 8 for q in range(1, 8)]).select(*[F.round(f"q{q - 1}", 4).alias(f"b{q}") for q in range(1, 8)]), "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {q / 8}), 4) AS b{q}" for q in range(1, 8)) + " FROM lineitem")


@query("WITH c AS (SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY n DESC, category) - n AS before, sum(n) OVER () AS total FROM c) SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS bin FROM r WHERE before < floor(total * 0.99 + 0.5)")
def cat_frequency_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by falling count while they hold less than 99 % of the rows. Windows run over categories only."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), "category")
    ranked = counts.select("category", "n", F.row_number().over(order).cast("long").alias("bin"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return ranked.where(F.col("before") < F.floor(F.col("total") * 0.99 + 0.5)).select("category", "n", "bin")


add("missing_type_stats", lambda s, d: table(s, d, "lineitem").agg(F.count(F.nullif("l_discount", F.lit(0.0))).alias("known"), F.sum((F.col("l_discount") == 0).cast("long")).alias("missing"), F.sum((F.col("l_tax") == 0).cast("long")).alias("zero")), "SELECT count(nullif(l_discount, 0)) AS known, sum((l_discount = 0)::INT)::BIGINT AS missing, sum((l_tax = 0)::INT)::BIGINT AS zero FROM lineitem")
add("efb_conflicts", lambda s, d: table(s, d, "lineitem").agg(*[F.sum(((F.col(a) != 0) & (F.col(b) != 0)).cast("long")).alias(f"{a}_{b}") for a, b in (("l_discount", "l_tax"), ("l_discount", "l_quantity"), ("l_tax", "l_quantity"))]), "SELECT sum((l_discount <> 0 AND l_tax <> 0)::INT)::BIGINT AS l_discount_l_tax, sum((l_discount <> 0 AND l_quantity <> 0)::INT)::BIGINT AS l_discount_l_quantity, sum((l_tax <> 0 AND l_quantity <> 0)::INT)::BIGINT AS l_tax_l_quantity FROM lineitem")
add("feature_median_iqr", lambda s, d: percentiles.exact(table(s, d, "lineitem"), [], F.col("l_quantity"), [0.25, 0.5, 0.75]).select(F.round("q1", 6).alias("median"), F.round(F.col("q2") - F.col("q0"), 6).alias("iqr")), "SELECT round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS iqr FROM lineitem")

# sampling and folds
_U = "((l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 1000) / 1000.0"


def u() -> Column:
    return F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey"), F.lit(1000)) / 1000.0


_PICK = "SELECT count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE "
picked = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))
add("bagging_hash", lambda s, d: picked(sampling.bagging(table(s, d, "lineitem"), u(), 0.3)), _PICK + f"{_U} < 0.3")
add("balanced_bagging", lambda s, d: picked(sampling.balanced_bagging(table(s, d, "lineitem"), u(), F.col("l_returnflag") == "R", 0.8, 0.1)), _PICK + f"{_U} < CASE WHEN l_returnflag = 'R' THEN 0.8 ELSE 0.1 END")
add("query_bagging", lambda s, d: picked(sampling.bagging(table(s, d, "lineitem"), F.pmod(F.col("l_orderkey") * 17, F.lit(100)) / 100.0, 0.5)), _PICK + "(l_orderkey * 17 % 100) / 100.0 < 0.5")
add("goss_topset", lambda s, d: sampling.goss(table(s, d, "lineitem"), F.abs(F.col("l_extendedprice") - 30000.0), u(), 0.2, 0.1).groupBy("amplify").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total")), f"""
  WITH f AS (SELECT *, abs(l_extendedprice - 30000.0) AS size, {_U} AS u FROM lineitem), c AS (SELECT count(*) AS n, greatest(1, floor(count(*) * 0.2)::BIGINT) AS top, greatest(1, floor(count(*) * 0.1)::BIGINT) AS other FROM f),
  b AS (SELECT size AS bar FROM (SELECT size, row_number() OVER (ORDER BY size DESC) AS r FROM f) WHERE r = (SELECT top FROM c))
  SELECT amplify, count(*) AS n, round(sum(l_quantity), 2) AS total FROM (SELECT l_quantity, CASE WHEN size >= bar THEN 1.0::DOUBLE WHEN u < other / (n - top)::DOUBLE THEN (n - top) / other::DOUBLE END AS amplify FROM f, c, b) WHERE amplify IS NOT NULL GROUP BY amplify""")


@query("SELECT fold, c AS label, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS c, (row_number() OVER (PARTITION BY l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) % 5 AS fold FROM lineitem) GROUP BY ALL")
def kfold_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = sampling.stratified_folds(table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int")), F.col("label"), [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 5, 0)
    return rows_.groupBy(F.col("fold").cast("long").alias("fold"), "label").agg(F.count(F.lit(1)).alias("n"))


add("kfold_group", lambda s, d: table(s, d, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(5)).alias("fold")).agg(F.countDistinct("l_orderkey").alias("queries"), F.count(F.lit(1)).alias("n")), "SELECT l_orderkey % 5 AS fold, count(DISTINCT l_orderkey) AS queries, count(*) AS n FROM lineitem GROUP BY 1")
add("cv_mean_std", lambda s, d: table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("fold")).agg(F.avg((F.col("l_quantity") - 25.5) ** 2).alias("v")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("stdv")), "SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stdv FROM (SELECT l_orderkey % 5 AS fold, avg((l_quantity - 25.5) * (l_quantity - 25.5)) AS v FROM lineitem GROUP BY 1)")

# joins, sets, queries of a ranking
add("add_features_join", lambda s, d: table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("p_size")), 2).alias("total")), "SELECT p_brand, count(*) AS n, round(sum(l_quantity * p_size), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
add("subset_semi", lambda s, d: picked(table(s, d, "lineitem").join(table(s, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")), _PICK + "l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
add("fold_anti", lambda s, d: picked(table(s, d, "lineitem").join(table(s, d, "orders").where("o_orderkey % 5 = 0"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")), _PICK + "l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)")
add("union_rows", lambda s, d: picked(table(s, d, "lineitem").where("l_linenumber <= 2").unionByName(table(s, d, "lineitem").where("l_linenumber >= 6"))), _PICK + "l_linenumber <= 2 OR l_linenumber >= 6")


@query("WITH r AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey AS q, n AS size, (sum(n) OVER (ORDER BY l_orderkey) - n)::BIGINT AS start FROM r")
def query_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.count(F.lit(1)).alias("size"))
    return before(sizes, "q", ["size"], descending=False).select("q", "size", F.col("size_before").alias("start"))


add("query_weights", lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.round(F.avg("l_quantity"), 6).alias("weight")), "SELECT l_orderkey AS q, round(avg(l_quantity), 6) AS weight FROM lineitem GROUP BY 1")
add("class_priors", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("weight")), "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS weight FROM lineitem GROUP BY 1")
add("position_bias_sums", lambda s, d: rows(s, d).groupBy(F.col("l_linenumber").alias("position")).agg(F.round(F.sum("g"), 4).alias("g"), F.round(F.sum("h"), 4).alias("h"), F.count(F.lit(1)).alias("n")), f"SELECT l_linenumber AS position, round(sum(g), 4) AS g, round(sum(h), 4) AS h, count(*) AS n FROM {ROWS_SQL} GROUP BY 1")

_RANKED = "(SELECT l_orderkey AS q, l_linenumber % 5 AS y, l_discount * 10.0 - l_tax AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount * 10.0 - l_tax DESC, l_linenumber, l_partkey, l_suppkey) AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 5 DESC) AS i FROM lineitem)"


@query(f"""WITH r AS (SELECT * FROM {_RANKED}), m AS (SELECT q, sum((pow(2, y) - 1) / log2(i + 1)) AS best, max(s) AS hi, min(s) AS lo FROM r WHERE i <= 30 GROUP BY q), x AS (SELECT q, max(s) AS hi, min(s) AS lo FROM r GROUP BY q),
  p AS (SELECT a.q, CASE WHEN a.y > b.y THEN a.s - b.s ELSE b.s - a.s END AS d, abs(pow(2, a.y) - pow(2, b.y)) * abs(1 / log2(a.r + 1) - 1 / log2(b.r + 1)) / m.best / CASE WHEN x.hi <> x.lo THEN 0.01 + abs(a.s - b.s) ELSE 1.0 END AS w
    FROM r a JOIN r b ON a.q = b.q AND a.r < b.r AND a.y <> b.y AND a.r <= 30 JOIN m ON m.q = a.q JOIN x ON x.q = a.q)
  SELECT q, count(*) AS pairs, round(sum(w / (1 + exp(d))), 6) AS lambda FROM p GROUP BY q""")
def lambda_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a query and the sum of their lambdas, as a join on the query with the places as its other condition."""
    key = Window.partitionBy("q")
    base = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") % 5).alias("y"), (F.col("l_discount") * 10.0 - F.col("l_tax")).alias("s"), "l_linenumber", "l_partkey", "l_suppkey")
    ranked = base.select("q", "y", "s", F.row_number().over(key.orderBy(F.desc("s"), "l_linenumber", "l_partkey", "l_suppkey")).alias("r"), F.row_number().over(key.orderBy(F.desc("y"))).alias("i"))
    worth = lambda y: F.pow(F.lit(2.0), y) - 1.0
    best = ranked.groupBy("q").agg(F.sum(F.when(F.col("i") <= 30, worth(F.col("y")) / F.log2(F.col("i") + 1))).alias("best"), (F.max("s") != F.min("s")).alias("spread"))
    a = ranked.join(best, "q").select("q", *[F.col(c).alias(f"{c}a") for c in ("y", "s", "r")], "best", "spread")
    b = ranked.select("q", *[F.col(c).alias(f"{c}b") for c in ("y", "s", "r")])
    pairs = a.join(b, "q").where((F.col("ra") < F.col("rb")) & (F.col("ya") != F.col("yb")) & (F.col("ra") <= 30))
    delta = F.when(F.col("ya") > F.col("yb"), F.col("sa") - F.col("sb")).otherwise(F.col("sb") - F.col("sa"))
    w = F.abs(worth(F.col("ya")) - worth(F.col("yb"))) * F.abs(1 / F.log2(F.col("ra") + 1) - 1 / F.log2(F.col("rb") + 1)) / F.col("best") / F.when(F.col("spread"), 0.01 + F.abs(F.col("sa") - F.col("sb"))).otherwise(1.0)
    return pairs.groupBy("q").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum(w / (1 + F.exp(delta))), 6).alias("lambda"))


@query("SELECT l_orderkey AS q, l_linenumber, l_partkey, l_suppkey, round(exp(l_discount * 10.0) / sum(exp(l_discount * 10.0)) OVER (PARTITION BY l_orderkey), 8) AS p FROM lineitem")
def xendcg_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = Window.partitionBy("l_orderkey")
    e = F.exp(F.col("l_discount") * 10.0 - F.max(F.col("l_discount") * 10.0).over(key))
    rows_ = table(spark, sf_dir, "lineitem").withColumn("e", e)
    return rows_.select(F.col("l_orderkey").alias("q"), "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("e") / F.sum("e").over(key), 8).alias("p"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5 * ((coalesce(l_quantity, 0) - m) / i) - 0.25 * ((l_discount - n) / j), 6) AS p0 FROM lineitem, (SELECT quantile_cont(l_quantity, 0.5) AS m, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS i, quantile_cont(l_discount, 0.5) AS n, quantile_cont(l_discount, 0.75) - quantile_cont(l_discount, 0.25) AS j FROM lineitem)")
def oblique_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.oblique import ObliquePool

    pool = ObliquePool(["l_quantity", "l_discount"], [[(0, 0.5), (1, -0.25)]])
    return pool.fit(table(spark, sf_dir, "lineitem")).transform(table(spark, sf_dir, "lineitem"), "p").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("p0", 6).alias("p0"))


# votes of workers, and gradients in steps
_WORKERS_SQL = f"(SELECT l_orderkey % 4 AS worker, leaf, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT l_orderkey, leaf, g, h, unnest([0, 1, 2, 3]) AS feature, unnest([b0, b1, b2, b3]) AS bin FROM {ROWS_SQL}) GROUP BY ALL)"


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of four workers."""
    packed = histogram.explode_histogram(rows(spark, sf_dir), F.col("leaf") * 4 + F.col("l_orderkey") % 4, {n: F.col(n) for n in BINS}, F.col("g"), F.col("h"))
    return packed.select((F.col("leaf") % 4).alias("worker"), F.floor(F.col("leaf") / 4).cast("int").alias("leaf"), "feature", "bin", "g", "h", "n")


@query(f"""WITH w AS (SELECT * FROM {_WORKERS_SQL}), c AS (SELECT *, sum(g) OVER o AS lg, sum(h) OVER o AS lh, sum(n) OVER o AS ln, sum(g) OVER k AS tg, sum(h) OVER k AS th, sum(n) OVER k AS tn, max(bin) OVER k AS last FROM w
    WINDOW k AS (PARTITION BY worker, leaf, feature), o AS (PARTITION BY worker, leaf, feature ORDER BY bin)),
  s AS (SELECT worker, leaf, feature, max(lg * lg / (lh + 1.0) + (tg - lg) * (tg - lg) / (th - lh + 1.0) - tg * tg / (th + 1.0)) AS gain, any_value(tn) AS rows FROM c WHERE bin < last AND ln >= 20 AND tn - ln >= 20 GROUP BY ALL),
  v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY worker, leaf ORDER BY gain DESC, feature) AS place FROM s WHERE gain > 0) WHERE place <= 1),
  e AS (SELECT leaf, feature FROM (SELECT leaf, feature, row_number() OVER (PARTITION BY leaf ORDER BY sum(gain * rows) DESC, feature) AS place FROM v GROUP BY leaf, feature) WHERE place <= 2)
  SELECT leaf, feature, bin, round(sum(g), 4) AS g, round(sum(h), 4) AS h, sum(n)::BIGINT AS n FROM w SEMI JOIN e USING (leaf, feature) GROUP BY ALL""")
def hist_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(histogram.voted_histogram(workers(spark, sf_dir), 1, l2=1.0))


@query(f"""WITH r AS (SELECT * FROM {ROWS_SQL}), m AS (SELECT max(abs(g)) / 2 AS gs, max(abs(h)) / 4 AS hs FROM r)
  SELECT leaf, sum(sign(g) * floor(abs(g) / gs + 0.5))::BIGINT AS gq, sum(sign(h) * floor(abs(h) / hs + 0.5))::BIGINT AS hq, round(any_value(gs), 7) AS g_step, round(any_value(hs), 7) AS h_step FROM r, m GROUP BY leaf""")
def quantised_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of gradients in steps, of each leaf."""
    steps = histogram.discretised(rows(spark, sf_dir), F.col("g"), F.col("h"), 4)
    return steps.groupBy("leaf").agg(F.sum("gq").alias("gq"), F.sum("hq").alias("hq"), F.round(F.first("g_step"), 7).alias("g_step"), F.round(F.first("h_step"), 7).alias("h_step"))
