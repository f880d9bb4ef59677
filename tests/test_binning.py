import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvan.operators.binning import FeatureBins, find_bins, greedy_bounds
from silvan.params import resolve

P = resolve(min_data_in_bin=1)


def test_few_values_are_cut_halfway():
    got = greedy_bounds(np.array([1.0, 2.0, 4.0]), np.array([5, 5, 5]), 10, 3)
    assert got[:2] == [math.nextafter(1.5, math.inf), math.nextafter(3.0, math.inf)] and got[2] == math.inf


def test_few_values_share_bins_until_there_is_enough_data():
    assert len(greedy_bounds(np.array([1.0, 2.0, 3.0, 4.0]), np.array([1, 1, 1, 1]), 10, 3)) == 2


def test_values_that_fill_a_bin_get_their_own():
    counts = np.array([1] * 50 + [500] + [1] * 50)
    bounds = greedy_bounds(np.arange(101.0), counts, 6, 1)
    bins = FeatureBins("x", bounds=bounds)
    alone = bins.to_bins(np.arange(101.0))
    assert len(bounds) <= 6 and (alone == alone[50]).sum() <= 51 and alone[51] != alone[50]


def test_zero_has_a_bin_of_its_own():
    bins = find_bins("x", np.array([-3.0, -2.0, 0.0, 0.0, 1.0, 2.0]), P)
    zero = bins.to_bins(np.array([0.0]))[0]
    assert (bins.to_bins(np.array([-2.0, -1e-30, 1e-30, 1.0])) != zero).all() or bins.to_bins(np.array([-2.0]))[0] != zero != bins.to_bins(np.array([1.0]))[0]
    assert bins.default_bin == zero


def test_missing_values():
    bins = find_bins("x", np.array([1.0, 2.0, np.nan, 3.0]), P)
    assert bins.missing == "nan" and math.isnan(bins.bounds[-1]) and bins.to_bins(np.array([np.nan]))[0] == bins.bins - 1
    assert find_bins("x", np.array([1.0, 2.0, 3.0]), P).missing == "none"
    assert find_bins("x", np.array([1.0, 0.0, 3.0]), P.with_(zero_as_missing=True)).missing == "zero"
    assert find_bins("x", np.array([1.0, np.nan, 3.0]), P.with_(use_missing=False)).missing == "none"
    assert find_bins("x", np.ones(10), P).bins <= 2
    assert find_bins("x", np.zeros(10), P).trivial


def test_categories_by_count():
    values = np.array([3.0] * 60 + [1.0] * 30 + [7.0] * 10 + [np.nan] * 5 + [-2.0])
    bins = find_bins("x", values, resolve(min_data_in_bin=1), categorical=True)
    assert bins.categories == [3, 1, 7] and bins.missing == "nan"
    assert bins.to_bins(np.array([3.0, 1.0, 7.0, 9.0, np.nan, -1.0])).tolist() == [1, 2, 3, 0, 0, 0]


def test_forced_bounds_stay():
    bins = find_bins("x", np.linspace(0.1, 1, 500), resolve(max_bin=8, min_data_in_bin=1), forced=[0.3, 0.35])
    assert 0.3 in bins.bounds and 0.35 in bins.bounds and bins.bins <= 8


@pytest.mark.parametrize("kind", ["plain", "nan", "categorical"])
def test_columns_agree_with_arrays(spark, kind):
    draw = np.random.default_rng(2)
    values = draw.normal(size=500).round(1) if kind != "categorical" else draw.integers(0, 9, 500).astype(float)
    if kind != "plain":
        values[::7] = np.nan
    bins = find_bins("x", values, resolve(max_bin=20), categorical=kind == "categorical")
    rows = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(values)] + [(500, float("nan"))], "i long, x double")
    got = [r.b for r in rows.select("i", bins.bin_column(F.col("x")).alias("b")).orderBy("i").collect()]
    assert got == bins.to_bins(np.append(values, np.nan)).tolist()
