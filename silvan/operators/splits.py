"""Split search over the histogram of one leaf, on the driver.

A histogram is [feature, bin, (sum of gradients, sum of hessians, rows)]. Numerical features are scanned together, as
cumulative sums over bins; categorical ones are put in order of their gradient ratios first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..params import Params
from .binning import FeatureBins

EPSILON = 1e-15


@dataclass
class Split:
    """feature: index among the histogram's features; bin: last one that goes left; left, right: (gradients, hessians, rows);
    categories: bins that go left, of a categorical feature."""

    feature: int
    gain: float
    bin: int
    default_left: bool
    left: tuple[float, float, float]
    right: tuple[float, float, float]
    left_output: float
    right_output: float
    categories: list[int] | None = None
    monotone: int = 0

    def better(self, other: Split | None) -> bool:
        """Greater gain, then the smaller feature."""
        return other is None or (self.gain, -self.feature) > (other.gain, -other.feature)


@dataclass
class Leaf:
    """State of a leaf that its splits depend on."""

    g: float
    h: float
    n: float
    output: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    depth: int = 0
    features: np.ndarray | None = None
    used: frozenset[int] = field(default_factory=frozenset)


def soft(g, l1: float):
    """Gradient sum shrunk by l1."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def output(g, h, p: Params, l2: float, n=None, parent: float = 0.0):
    """Leaf output: the regularised Newton step, capped, drawn towards the parent's by path_smooth."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -soft(g, p.lambda_l1) / (h + l2)
    if p.max_delta_step > 0:
        out = np.clip(out, -p.max_delta_step, p.max_delta_step)
    if p.path_smooth > 0 and n is not None:
        share = n / p.path_smooth
        with np.errstate(invalid="ignore"):
            out = out * share / (share + 1.0) + parent / (share + 1.0)
    return out


def gain_of_output(g, h, out, p: Params, l2: float):
    # sides without rows have no finite output; callers leave them out by their hessians
    with np.errstate(invalid="ignore"):
        return -(2.0 * soft(g, p.lambda_l1) * out + (h + l2) * out * out)


def leaf_gain(g, h, p: Params, l2: float, n=None, parent: float = 0.0):
    if p.max_delta_step <= 0 and not (p.path_smooth > 0 and n is not None):
        with np.errstate(divide="ignore", invalid="ignore"):
            return soft(g, p.lambda_l1) ** 2 / (h + l2)
    return gain_of_output(g, h, output(g, h, p, l2, n, parent), p, l2)


def pair_gain(gl, hl, nl, gr, hr, nr, leaf: Leaf, p: Params, l2: float, monotone=0):
    """Gain of a left and a right part; -inf where outputs would break a monotone constraint."""
    bounded = leaf.low > -math.inf or leaf.high < math.inf or np.any(monotone)
    if not bounded:
        return leaf_gain(gl, hl, p, l2, nl, leaf.output) + leaf_gain(gr, hr, p, l2, nr, leaf.output)
    a = np.clip(output(gl, hl, p, l2, nl, leaf.output), leaf.low, leaf.high)
    b = np.clip(output(gr, hr, p, l2, nr, leaf.output), leaf.low, leaf.high)
    total = gain_of_output(gl, hl, a, p, l2) + gain_of_output(gr, hr, b, p, l2)
    return np.where(((monotone > 0) & (a > b)) | ((monotone < 0) & (a < b)), 0.0, total)


def _estimated(h: np.ndarray, n: np.ndarray, leaf: Leaf, p: Params) -> np.ndarray:
    """Rows of each bin: exact, or as its hessian's share of the leaf's rows."""
    return n if p.count_mode == "exact" or not leaf.h else np.floor(h * (leaf.n / leaf.h) + 0.5)


def shift_of(leaf: Leaf, p: Params) -> float:
    """What a split's gain must exceed."""
    if p.path_smooth > 0:
        own = float(gain_of_output(leaf.g, leaf.h, leaf.output, p, p.lambda_l2))
    else:
        own = float(leaf_gain(leaf.g, leaf.h, p, p.lambda_l2))
    return own + p.min_gain_to_split


def _grown(total: np.ndarray, may: np.ndarray, least: float) -> np.ndarray:
    """Of the places that `may` allows, those by which a rising total has grown by `least` since the last such place."""
    out, places = np.zeros(len(total), bool), np.flatnonzero(may)
    at, held = 0, total[places]
    base = 0.0
    while (at := max(at, int(np.searchsorted(held, base + least)))) < len(places):
        out[places[at]] = True
        base = held[at]
        at += 1
    return out


class Scanner:
    """Finds the best split of a leaf for a fixed set of features."""

    def __init__(self, features: list[FeatureBins], real: list[int], p: Params):
        self.features, self.real, self.p = features, real, p
        self.width = max((f.bins for f in features), default=1)
        bins = np.array([f.bins for f in features])
        self.numeric = np.array([i for i, f in enumerate(features) if f.kind == "numerical"], np.int64)
        self.categorical = [i for i, f in enumerate(features) if f.kind == "categorical"]
        at = np.arange(self.width)
        num = self.numeric
        self.is_nan = np.array([features[i].missing == "nan" and features[i].bins > 2 for i in num], bool)
        self.is_zero = np.array([features[i].missing == "zero" and features[i].bins > 2 for i in num], bool)
        two_nan = np.array([features[i].missing == "nan" and features[i].bins <= 2 for i in num], bool)
        self.two_nan = two_nan
        nb = bins[num] if len(num) else np.zeros(0, np.int64)
        default = np.array([features[i].default_bin for i in num], np.int64)
        apart = (self.is_nan[:, None] & (at == (nb - 1)[:, None])) | (self.is_zero[:, None] & (at == default[:, None]))
        self.apart = apart  # the bin of missing rows, which a scan leaves to the other side
        self.last = nb - 1 - self.is_nan  # last bin that is scanned
        self.may_reverse = (at < self.last[:, None]) & ~(self.is_zero[:, None] & (at == (default - 1)[:, None]))
        self.may_forward = np.where(self.is_nan[:, None], at <= self.last[:, None], at < self.last[:, None]) & (self.is_nan | self.is_zero)[:, None] & ~(self.is_zero[:, None] & (at == default[:, None]))
        mono = p.monotone_constraints
        self.monotone = np.array([mono[real[i]] if real[i] < len(mono) else 0 for i in range(len(features))], np.int64)
        self.contri = np.array([p.feature_contri[real[i]] if real[i] < len(p.feature_contri) else 1.0 for i in range(len(features))])

    def best(self, hist: np.ndarray, leaf: Leaf, draw: np.random.Generator | None = None, allowed: np.ndarray | None = None, cost: np.ndarray | None = None) -> Split | None:
        """Best split, or None if none has a positive gain. draw: for one random threshold a feature (extra trees);
        allowed: mask of features; cost: what each feature's gain is charged."""
        p = self.p
        if leaf.n < 2 * p.min_data_in_leaf:
            return None
        found = self._numeric(hist, leaf, draw) if len(self.numeric) else []
        found += [s for i in self.categorical if (s := self._categorical(hist, leaf, i, draw))]
        best = None
        for s in found:
            if allowed is not None and not allowed[s.feature]:
                continue
            s.gain *= self.contri[s.feature]
            if cost is not None:
                s.gain -= cost[s.feature]
            if s.monotone and p.monotone_penalty > 0:
                s.gain *= self._penalty(leaf.depth)
            if s.gain > 0 and s.better(best):
                best = s
        return best

    def _penalty(self, depth: int) -> float:
        """Factor on gains of monotone features, stricter near the root."""
        penalty = self.p.monotone_penalty
        if penalty >= depth + 1.0:
            return EPSILON
        if penalty <= 1.0:
            return 1.0 - penalty / 2.0**depth + EPSILON
        return 1.0 - 2.0 ** (penalty - 1.0 - depth) + EPSILON

    def _numeric(self, hist: np.ndarray, leaf: Leaf, draw: np.random.Generator | None) -> list[Split]:
        p, num = self.p, self.numeric
        g, h = hist[num, :, 0], hist[num, :, 1]
        n = _estimated(h, hist[num, :, 2], leaf, p)
        seen = ~self.apart
        gs, hs, ns = np.where(seen, g, 0.0), np.where(seen, h, 0.0), np.where(seen, n, 0.0)
        lg, lh, ln = np.cumsum(gs, 1), np.cumsum(hs, 1), np.cumsum(ns, 1)
        rg, rh, rn = lg[:, -1:] - lg, lh[:, -1:] - lh + EPSILON, ln[:, -1:] - ln
        mono = self.monotone[num][:, None]
        shift = shift_of(leaf, p)
        only = None
        if draw is not None:
            only = np.zeros(lg.shape, bool)
            only[np.arange(len(num)), [int(draw.integers(0, max(1, int(last)))) for last in self.last]] = True
        out: list[Split] = []
        # missing rows left: the right part is accumulated
        reverse = self._gains(leaf.g - rg, leaf.h - rh, leaf.n - rn, rg, rh, rn, self.may_reverse, leaf, mono, shift, only)
        # missing rows right: the left part is accumulated
        forward = self._gains(lg, lh + EPSILON, ln, leaf.g - lg, leaf.h - lh - EPSILON, leaf.n - ln, self.may_forward, leaf, mono, shift, only) if self.may_forward.any() else None
        back = reverse[:, ::-1].argmax(1)
        for row, i in enumerate(num.tolist()):
            t = self.width - 1 - int(back[row])
            best, side = reverse[row, t], True
            if forward is not None:
                u = int(forward[row].argmax())
                if forward[row, u] > best:
                    best, side, t = forward[row, u], False, u
            if best == -np.inf:
                continue
            if side:
                right = (rg[row, t], rh[row, t] - EPSILON, rn[row, t])
                left = (leaf.g - right[0], leaf.h - right[1], leaf.n - right[2])
            else:
                left = (lg[row, t], lh[row, t], ln[row, t])
                right = (leaf.g - left[0], leaf.h - left[1], leaf.n - left[2])
            out.append(self._split(i, float(best - shift), t, side and not self.two_nan[row], left, right, leaf, p.lambda_l2))
        return out

    def _gains(self, gl, hl, nl, gr, hr, nr, may, leaf, mono, shift, only):
        p = self.p
        ok = may & (nl >= p.min_data_in_leaf) & (nr >= p.min_data_in_leaf) & (hl >= p.min_sum_hessian_in_leaf) & (hr >= p.min_sum_hessian_in_leaf)
        if only is not None:
            ok &= only
        gain = pair_gain(gl, hl, nl, gr, hr, nr, leaf, p, p.lambda_l2, mono)
        return np.where(ok & (gain > shift), gain, -np.inf)

    def _split(self, i: int, gain: float, t: int, default_left: bool, left, right, leaf: Leaf, l2: float, categories: list[int] | None = None) -> Split:
        p = self.p
        a = float(np.clip(output(left[0], left[1], p, l2, left[2], leaf.output), leaf.low, leaf.high))
        b = float(np.clip(output(right[0], right[1], p, l2, right[2], leaf.output), leaf.low, leaf.high))
        return Split(i, gain, t, default_left, tuple(map(float, left)), tuple(map(float, right)), a, b, categories, int(self.monotone[i]) if categories is None else 0)

    def _categorical(self, hist: np.ndarray, leaf: Leaf, i: int, draw: np.random.Generator | None) -> Split | None:
        p, nb = self.p, self.features[i].bins
        g, h = hist[i, 1:nb, 0], hist[i, 1:nb, 1]
        n = _estimated(h, hist[i, 1:nb, 2], leaf, p)
        shift = shift_of(leaf, p)
        if nb <= p.max_cat_to_onehot:
            ok = (n >= p.min_data_in_leaf) & (h >= p.min_sum_hessian_in_leaf) & (leaf.n - n >= p.min_data_in_leaf) & (leaf.h - h - EPSILON >= p.min_sum_hessian_in_leaf)
            if draw is not None:
                ok &= np.arange(len(g)) == int(draw.integers(0, max(1, len(g))))
            gain = pair_gain(leaf.g - g, leaf.h - h - EPSILON, leaf.n - n, g, h + EPSILON, n, leaf, p, p.lambda_l2)
            gain = np.where(ok & (gain > shift), gain, -np.inf)
            if not len(gain) or gain.max() == -np.inf:
                return None
            t = int(gain.argmax())
            left = (g[t], h[t], n[t])
            return self._split(i, float(gain[t] - shift), t + 1, False, left, (leaf.g - g[t], leaf.h - h[t], leaf.n - n[t]), leaf, p.lambda_l2, [t + 1])
        used = np.flatnonzero(n >= p.cat_smooth)
        with np.errstate(divide="ignore", invalid="ignore"):
            order = used[np.argsort(np.nan_to_num(g[used] / (h[used] + p.cat_smooth)), kind="stable")]
        most = min(p.max_cat_threshold, (len(order) + 1) // 2)
        l2 = p.lambda_l2 + p.cat_l2
        pick = int(draw.integers(0, max(1, min(most, len(order)) - 1))) if draw is not None else None
        # the categories that go left are the first ones of the order, or the last ones: a row of each table for either side
        turns = np.stack([order[:most], order[::-1][:most]])
        if not turns.size:
            return None
        start = np.array([[0.0], [EPSILON], [0.0]])[:, None]
        gl, hl, nl = np.concatenate([np.broadcast_to(start, (3, 2, 1)), np.stack([g, h, n])[:, turns]], 2).cumsum(2)[:, :, 1:]
        filled = (nl >= p.min_data_in_leaf) & (hl >= p.min_sum_hessian_in_leaf)
        spent = (leaf.n - nl < max(p.min_data_in_leaf, p.min_data_per_group)) | (leaf.h - hl < p.min_sum_hessian_in_leaf)
        may = filled & ~np.logical_or.accumulate(filled & spent, 1)
        ok = np.stack([_grown(rows, mask, p.min_data_per_group) for rows, mask in zip(nl, may, strict=True)])
        if pick is not None:
            ok &= np.arange(turns.shape[1]) == pick
        gain = pair_gain(gl, hl, nl, leaf.g - gl, leaf.h - hl, leaf.n - nl, leaf, p, l2)
        gain = np.where(ok & (gain > shift), gain, -np.inf)
        side, k = np.unravel_index(gain.argmax(), gain.shape)
        if gain[side, k] == -np.inf:
            return None
        bins, left = (turns[side, : k + 1] + 1).tolist(), (gl[side, k], hl[side, k] - EPSILON, nl[side, k])
        return self._split(i, float(gain[side, k]) - shift, bins[0], False, left, (leaf.g - left[0], leaf.h - left[1], leaf.n - left[2]), leaf, l2, sorted(bins))

    def forced(self, hist: np.ndarray, leaf: Leaf, i: int, t: int) -> Split | None:
        """The split of feature i behind bin t, whatever its gain; None if a side would be empty."""
        seen = hist[i, : t + 1]
        left = (seen[:, 0].sum(), seen[:, 1].sum(), float(_estimated(seen[:, 1], seen[:, 2], leaf, self.p).sum()))
        right = (leaf.g - left[0], leaf.h - left[1], leaf.n - left[2])
        if left[2] <= 0 or right[2] <= 0:
            return None
        gain = float(pair_gain(*left, *right, leaf, self.p, self.p.lambda_l2)) - shift_of(leaf, self.p)
        return self._split(i, gain, t, False, left, right, leaf, self.p.lambda_l2)

    def goes_left(self, s: Split) -> np.ndarray:
        """For each bin of the split's feature, whether its rows go left."""
        f = self.features[s.feature]
        out = np.zeros(self.width, bool)
        if s.categories is not None:
            out[s.categories] = True
            return out
        out[: s.bin + 1] = True
        if f.missing == "nan" and f.bins > 2:
            out[f.bins - 1] = s.default_left
        if f.missing == "zero" and f.bins > 2:
            out[f.default_bin] = s.default_left
        return out
