"""Feature binning: from a bounded sample to bounds or category maps, and from values to bins."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params

#: Fixed values of the bins' semantics: half-width of the zero bin, mass that categories are kept for, share below which the most frequent bin gives way to the default one.
ZERO, CATEGORY_MASS, SPARSE = 1e-35, 0.99, 0.7
#: Columns whose sample is brought to the driver at once.
COLUMNS_AT_ONCE = 64


@dataclass
class FeatureBins:
    """kind: numerical or categorical; missing: none, zero or nan; bounds: upper bounds, with a last NaN for the missing bin;
    categories: value of each bin but bin 0, which holds missing and rare ones."""

    name: str
    kind: str = "numerical"
    missing: str = "none"
    bounds: list[float] = field(default_factory=lambda: [math.inf])
    categories: list[int] = field(default_factory=list)
    low: float = 0.0
    high: float = 0.0
    trivial: bool = False
    most_frequent: int = 0

    @property
    def bins(self) -> int:
        return len(self.categories) + 1 if self.kind == "categorical" else len(self.bounds)

    @property
    def default_bin(self) -> int:
        return int(self.to_bins(np.zeros(1))[0])

    def to_bins(self, values: np.ndarray) -> np.ndarray:
        """Bin of each value; NaN stands for missing."""
        values = np.asarray(values, np.float64)
        if self.kind == "categorical":
            keys = np.array(self.categories, np.int64)
            order = np.argsort(keys)
            whole = np.where(np.isnan(values) | (values < 0) | (values > 2**31), -1, values).astype(np.int64)
            if not len(keys):
                return np.zeros(len(values), np.int32)
            at = np.minimum(np.searchsorted(keys[order], whole), len(keys) - 1)
            return np.where(keys[order][at] == whole, order[at] + 1, 0).astype(np.int32)
        known = np.array(self.bounds[:-1] if self.missing == "nan" else self.bounds)
        gone = np.isnan(values)
        out = np.minimum(np.searchsorted(known, np.where(gone, 0.0, values), "left"), len(known) - 1)
        return np.where(gone, len(known), out).astype(np.int32) if self.missing == "nan" else out.astype(np.int32)

    def threshold(self, bin_: int) -> float:
        """The value up to which a split behind this bin sends rows left."""
        return self.bounds[bin_]

    def bin_column(self, value: Column) -> Column:
        """to_bins as a Spark expression: binary search by nested conditions over the bounds."""
        value = value.cast("double")
        gone = value.isNull() | F.isnan(value)
        if self.kind == "categorical":
            if not self.categories:
                return F.lit(0)
            return F.when(gone, 0).otherwise(F.array_position(F.array(*[F.lit(c) for c in self.categories]), value.cast("int")).cast("int"))
        known = self.bounds[:-1] if self.missing == "nan" else self.bounds

        def search(lo: int, hi: int) -> Column:
            if lo >= hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(x <= known[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

        x = F.when(gone, F.lit(0.0)).otherwise(value)
        found = search(0, len(known) - 1)
        return F.when(gone, len(known)).otherwise(found) if self.missing == "nan" else found


def _above(x: float) -> float:
    return math.nextafter(x, math.inf)


def _middles(values: np.ndarray) -> np.ndarray:
    """The bound behind each value but the last: just above the middle of the gap to the next one."""
    return np.nextafter((values[:-1] + values[1:]) / 2.0, np.inf)


def _apart(bounds: np.ndarray) -> list[float]:
    """Bounds in rising order without those that are the double, or its neighbour, that the last one kept is; then infinity."""
    kept: list[float] = []
    for bound in bounds.tolist():
        if not kept or bound > _above(kept[-1]):
            kept.append(bound)
    return [*kept, math.inf]


def greedy_bounds(values: np.ndarray, counts: np.ndarray, max_bin: int, min_data: int) -> list[float]:
    """Upper bounds of at most max_bin bins with about the same number of rows.

    While there are no more values than bins, every value (or run of values with min_data rows) is one. Else values that
    would fill a bin on their own get one, and the others share what is left; a run ends early, half full, before such a value.
    """
    rows = np.cumsum(counts)
    if len(values) <= max_bin:
        return _sparse_bounds(_middles(values), rows, min_data)
    most = min(max_bin, int(rows[-1]) // min_data) if min_data > 0 else max_bin
    return _apart(_middles(values)[_dense_cuts(counts, rows, max(1, most))])


def _sparse_bounds(middles: np.ndarray, rows: np.ndarray, min_data: int) -> list[float]:
    """A bound wherever min_data rows have come together since the last one, if doubles tell the two apart."""
    out: list[float] = []
    at, base = int(np.searchsorted(rows, min_data)), 0
    while at < len(middles):
        if out and middles[at] <= _above(out[-1]):
            at += 1
            continue
        out.append(float(middles[at]))
        base = int(rows[at])
        at = max(at + 1, int(np.searchsorted(rows, base + min_data)))
    return [*out, math.inf]


def _dense_cuts(counts: np.ndarray, rows: np.ndarray, most: int) -> list[int]:
    """Values behind which bins end, but the last bin. Running counts tell where each bin ends, so one step leads from cut to cut."""
    n, total = len(counts), int(rows[-1])
    alone = np.flatnonzero(counts >= total / most)
    shared = np.where(counts >= total / most, 0, counts)
    before, shared_rows = np.cumsum(shared), int(shared.sum())
    bins = most - len(alone)
    mean = shared_rows / bins if bins else math.inf
    cuts: list[int] = []
    start = 0
    while len(cuts) < most - 1:
        base = int(rows[start - 1]) if start else 0
        next_alone = np.searchsorted(alone, start)
        ends = [int(alone[next_alone]) if next_alone < len(alone) else n]
        if mean < math.inf:
            ends.append(max(start, int(np.searchsorted(rows, base + math.ceil(mean)))))
        half = max(1.0, mean * 0.5)
        if start < ends[0] < n and rows[ends[0] - 1] - base >= half:
            ends.append(ends[0] - 1)
        end = min(ends)
        if end >= n - 1:
            break
        cuts.append(end)
        start = end + 1
        if shared[end] or not counts[end]:
            bins -= 1
            mean = (shared_rows - int(before[end])) / bins if bins else math.inf
    return cuts


def _with_zero_bin(values: np.ndarray, counts: np.ndarray, max_bin: int, min_data: int) -> list[float]:
    """Bounds with zero in a bin of its own; the bins below and above zero share the rest by their rows."""
    below, above = values <= -ZERO, values > ZERO
    zeros = int(counts[~below & ~above].sum())
    bounds: list[float] = []
    if below.any() and max_bin > 1:
        share = int(counts[below].sum()) / max(1, int(counts.sum()) - zeros)
        bounds = greedy_bounds(values[below], counts[below], max(1, int(share * (max_bin - 1))), min_data)
        bounds[-1] = -ZERO
    room = max_bin - 1 - len(bounds)
    if above.any() and room > 0:
        return [*bounds, ZERO, *greedy_bounds(values[above], counts[above], room, min_data)]
    return [*bounds, math.inf]


def _with_forced(values: np.ndarray, counts: np.ndarray, max_bin: int, min_data: int, forced: list[float]) -> list[float]:
    """Forced bounds and those around zero first; each interval between them gets a share of the other bins by its rows, and
    the last one what is left."""
    sides = [(-ZERO, bool((values <= -ZERO).any())), (ZERO, bool((values > ZERO).any()))]
    around_zero = [bound for bound, there in sides if there] if max_bin > 2 else [ZERO if sides[1][1] else -ZERO]
    own = [f for f in forced if abs(f) > ZERO][: max(0, max_bin - len(around_zero) - 1)]
    bounds = np.unique([*around_zero, *own, math.inf])
    ends = np.append(np.searchsorted(values, bounds[:-1]), len(values))
    starts = np.append(0, ends[:-1])
    rows = np.diff(np.append(0, np.cumsum(counts))[np.append(0, ends)])
    free = max_bin - len(bounds)
    shares = np.floor(rows * free / max(1, int(counts.sum())) + 0.5).astype(int)
    shares[-1] = free
    extra: list[float] = []
    for start, end, share in zip(starts.tolist(), ends.tolist(), shares.tolist(), strict=True):
        bins = min(share, free - len(extra))
        if end > start and bins > 0:
            extra += greedy_bounds(values[start:end], counts[start:end], bins + 1, min_data)[:-1]
    return sorted({*bounds.tolist(), *extra})


def find_bins(name: str, values: np.ndarray, p: Params, categorical: bool = False, max_bin: int | None = None, forced: list[float] = (), min_split: int | None = None) -> FeatureBins:
    """Bins of a feature from the sampled values, NaN standing for missing."""
    max_bin = max_bin or p.max_bin
    values = np.asarray(values, np.float64)
    total = len(values)
    known = values[~np.isnan(values)]
    gone = total - len(known)
    missing = "none" if not p.use_missing else "zero" if p.zero_as_missing else "nan" if gone else "none"
    if missing == "zero":
        known = np.append(known, np.zeros(gone))
    elif not p.use_missing:
        known, gone = np.append(known, np.zeros(gone)), 0
    distinct, counts = np.unique(known, return_counts=True)
    if not len(distinct):
        distinct, counts = np.zeros(1), np.zeros(1, np.int64)
    out = FeatureBins(name, low=float(distinct[0]), high=float(distinct[-1]))
    if categorical:
        return _categories(out, distinct, counts, gone, total, max_bin, p)
    # values next to each other in doubles count as one, the greater
    near = np.append(distinct[1:] <= np.nextafter(distinct[:-1], np.inf), False)
    if near.any():
        group = np.cumsum(np.append(True, ~near[:-1])) - 1
        counts = np.bincount(group, counts).astype(np.int64)
        distinct = distinct[~near]
    cut = (lambda m: _with_forced(distinct, counts, m, p.min_data_in_bin, list(forced))) if len(forced) else (lambda m: _with_zero_bin(distinct, counts, m, p.min_data_in_bin))
    if missing == "nan":
        out.bounds, out.missing = [*cut(max_bin - 1), math.nan], "nan"
    else:
        out.bounds = cut(max_bin)
        out.missing = "none" if missing == "zero" and len(out.bounds) <= 2 else missing
    held = np.bincount(out.to_bins(values if missing != "zero" else np.nan_to_num(values)), minlength=out.bins)
    return _finish(out, held, total, p, min_split)


def _categories(out: FeatureBins, distinct: np.ndarray, counts: np.ndarray, gone: int, total: int, max_bin: int, p: Params) -> FeatureBins:
    """Categories by falling count until they hold the mass that is kept; from the third on they need min_data_in_bin rows."""
    out.kind = "categorical"
    whole = distinct.astype(np.int64)
    gone += int(counts[whole < 0].sum())
    keys, inverse = np.unique(whole[whole >= 0], return_inverse=True)
    sums = np.bincount(inverse, counts[whole >= 0], len(keys)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    order = np.lexsort((keys, -sums))
    enough, most = math.floor((total - gone) * CATEGORY_MASS + 0.5), min(len(keys) + (gone > 0), max_bin)
    used = 0
    for place, i in enumerate(order.tolist()):
        if not (used < enough or len(out.categories) + 1 < most) or sums[i] < p.min_data_in_bin and place > 1:
            break
        out.categories.append(int(keys[i]))
        used += int(sums[i])
    out.missing = "none" if len(out.categories) == len(keys) and not gone else "nan"
    held = np.array([total - used, *[int(sums[i]) for i in order[: len(out.categories)].tolist()]])
    return _finish(out, held, total, p, None)


def _finish(out: FeatureBins, held: np.ndarray, total: int, p: Params, min_split: int | None) -> FeatureBins:
    out.trivial = out.bins <= 1
    if not out.trivial and p.feature_pre_filter and min_split:
        sides = np.cumsum(held)[:-1] if out.kind == "numerical" else held
        out.trivial = not bool(((sides >= min_split) & (total - sides >= min_split)).any())
    best = int(np.argmax(held))
    out.most_frequent = best if total and held[best] / total >= SPARSE else out.default_bin if not out.trivial else 0
    return out


@dataclass
class BinModel:
    """Bins of all features, in their order. Frozen once it is fitted: other frames are read by it."""

    features: list[FeatureBins]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    @property
    def used(self) -> list[int]:
        """Features that can split."""
        return [i for i, f in enumerate(self.features) if not f.trivial]

    def to_json(self) -> str:
        return json.dumps([asdict(f) for f in self.features])

    @classmethod
    def from_json(cls, text: str) -> BinModel:
        return cls([FeatureBins(**f) for f in json.loads(text)])

    def transform(self, df: DataFrame) -> DataFrame:
        """df with every feature replaced by its bin, as Spark expressions."""
        return df.withColumns({f.name: f.bin_column(F.col(f"`{f.name}`")) for f in self.features})


def fit_bins(df: DataFrame, names: list[str], p: Params, categorical: set[str] = frozenset(), forced: dict[int, list[float]] | None = None) -> BinModel:
    """BinModel from a sample of at most about bin_construct_sample_cnt rows of df, which is the only data that reaches the driver."""
    rows = df.count()
    picked = df
    if rows > p.bin_construct_sample_cnt:
        picked = df.sample(fraction=p.bin_construct_sample_cnt / rows, seed=p.data_random_seed)
    if len(names) > COLUMNS_AT_ONCE:
        picked = picked.persist()
    sampled = min(rows, p.bin_construct_sample_cnt)
    min_split = int(p.min_data_in_leaf * sampled / rows) if rows else 0
    out = []
    for at in range(0, len(names), COLUMNS_AT_ONCE):
        part = names[at : at + COLUMNS_AT_ONCE]
        sample = picked.select(*[F.col(f"`{n}`").cast("double").alias(f"c{i}") for i, n in enumerate(part)]).toArrow()
        for i, name in enumerate(part):
            k = at + i
            own = p.max_bin_by_feature[k] if k < len(p.max_bin_by_feature) else None
            out.append(find_bins(name, sample.column(i).to_numpy().astype(np.float64), p, name in categorical, own, (forced or {}).get(k, ()), min_split))
    if len(names) > COLUMNS_AT_ONCE:
        picked.unpersist()
    return BinModel(out)


def read_forced_bins(path: str) -> dict[int, list[float]]:
    """feature -> bounds of a forced bins file."""
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        return {int(x["feature"]): sorted(map(float, x["bin_upper_bound"])) for x in json.load(f)}


def bin_table(model: BinModel, spark: Any) -> DataFrame:
    """One row for each bin: feature, bin, upper, category."""
    rows = [(f.name, i, None if f.kind == "categorical" or math.isnan(f.bounds[i]) else float(f.bounds[i]), f.categories[i - 1] if f.kind == "categorical" and i else None) for f in model.features for i in range(f.bins)]
    return spark.createDataFrame(rows, "feature string, bin int, upper double, category long")
