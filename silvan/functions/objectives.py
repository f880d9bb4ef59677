"""Objectives: gradient and hessian of the loss by the score, start value, and output link.

Formulas take their elementwise functions from a backend, so the same definition serves Spark columns (queries, SQL
twins) and numpy arrays (the training kernel).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np

#: Guards of the reference's arithmetic (fixed values).
EPSILON, ZERO, LOWEST_PROBABILITY = 1e-15, 1e-35, 1e-15


@dataclass(frozen=True)
class Objective:
    """grad(m, s, y, w, p) -> (g, h); start: what the score begins with, a key of START; link(m, s, p): output;
    renew: percentile that replaces leaf values, or None; trees: trees of an iteration (0: one for each class);
    constant: the hessian is the weight alone."""

    name: str
    grad: Callable[..., tuple[Any, Any]]
    start: str
    link: Callable[..., Any]
    renew: str | None = None
    constant: bool = False
    metric: str = "l2"


def _identity(m, s, p):
    return s


def _exp(m, s, p):
    return m.exp(s)


def _sigmoid(m, s, p):
    return 1.0 / (1.0 + m.exp(-p.sigmoid * s))


def _logistic(m, s, p):
    return 1.0 / (1.0 + m.exp(-s))


def _l2(m, s, y, w, p):
    return (s - y) * w, m.one(s) * w


def _l1(m, s, y, w, p):
    return m.sign(s - y) * w, m.one(s) * w


def _huber(m, s, y, w, p):
    d = s - y
    return m.where(m.abs(d) <= p.alpha, d, m.sign(d) * p.alpha) * w, m.one(s) * w


def _fair(m, s, y, w, p):
    d = s - y
    q = m.abs(d) + p.fair_c
    return p.fair_c * d / q * w, p.fair_c * p.fair_c / (q * q) * w


def _poisson(m, s, y, w, p):
    return (m.exp(s) - y) * w, m.exp(s + p.poisson_max_delta_step) * w


def _quantile(m, s, y, w, p):
    return m.where(s >= y, 1.0 - p.alpha, -p.alpha) * w, m.one(s) * w


def _mape(m, s, y, w, p):
    return m.sign(s - y) / m.greatest(m.abs(y), 1.0) * w, m.one(s) * w


def _gamma(m, s, y, w, p):
    q = y * m.exp(-s)
    return (1.0 - q) * w, q * w


def _tweedie(m, s, y, w, p):
    r = p.tweedie_variance_power
    a, b = y * m.exp((1.0 - r) * s), m.exp((2.0 - r) * s)
    return (b - a) * w, ((2.0 - r) * b - (1.0 - r) * a) * w


def _binary(m, s, y, w, p):
    """y is 1 or 0; label_weights is (weight of 0, weight of 1)."""
    t = m.where(y > 0, 1.0, -1.0)
    r = -t * p.sigmoid / (1.0 + m.exp(t * p.sigmoid * s))
    lw = m.where(y > 0, p.label_weights[1], p.label_weights[0])
    return r * lw * w, m.abs(r) * (p.sigmoid - m.abs(r)) * lw * w


def _cross_entropy(m, s, y, w, p):
    z = 1.0 / (1.0 + m.exp(-s))
    return (z - y) * w, z * (1.0 - z) * w


def _cross_entropy_lambda(m, s, y, w, p):
    """The weight sits inside the link: 1 - exp(-w log1p(exp s)) is the probability."""
    if w is None or isinstance(w, float) and w == 1.0:
        z = 1.0 / (1.0 + m.exp(-s))
        return z - y, z * (1.0 - z)
    e = m.exp(s)
    z = 1.0 - m.exp(-w * m.log1p(e))
    c = 1.0 / (1.0 - z)
    b = c / ((c - 1.0) * (c - 1.0)) * (1.0 + w * e - c)
    a = w * e / ((1.0 + e) * (1.0 + e))
    return (1.0 - y / z) * w / (1.0 + m.exp(-s)), a * (1.0 + y * b)


OBJECTIVES: dict[str, Objective] = {
    o.name: o
    for o in (
        Objective("regression", _l2, "mean", _identity, constant=True, metric="l2"),
        Objective("regression_l1", _l1, "median", _identity, renew="median", constant=True, metric="l1"),
        Objective("huber", _huber, "mean", _identity, constant=True, metric="huber"),
        Objective("fair", _fair, "mean", _identity, metric="fair"),
        Objective("poisson", _poisson, "log_mean", _exp, metric="poisson"),
        Objective("quantile", _quantile, "alpha", _identity, renew="alpha", constant=True, metric="quantile"),
        Objective("mape", _mape, "mape_median", _identity, renew="mape_median", constant=True, metric="mape"),
        Objective("gamma", _gamma, "log_mean", _exp, metric="gamma"),
        Objective("tweedie", _tweedie, "log_mean", _exp, metric="tweedie"),
        Objective("binary", _binary, "log_odds", _sigmoid, metric="binary_logloss"),
        Objective("cross_entropy", _cross_entropy, "logit_mean", _logistic, metric="cross_entropy"),
        Objective("cross_entropy_lambda", _cross_entropy_lambda, "log_expm1_mean", lambda m, s, p: m.log1p(m.exp(s)), metric="cross_entropy_lambda"),
    )
}


def start_value(kind: str, mean: float, sigmoid: float = 1.0) -> float:
    """The start value that follows from the weighted mean of the label."""
    if kind == "mean":
        return mean
    if kind == "log_mean":
        return math.log(mean) if mean > 0 else -math.inf
    if kind == "log_expm1_mean":
        return math.log(math.expm1(mean)) if mean > 0 else -math.inf
    if kind in ("log_odds", "logit_mean"):
        q = min(max(mean, LOWEST_PROBABILITY), 1 - LOWEST_PROBABILITY)
        return math.log(q / (1 - q)) / (sigmoid if kind == "log_odds" else 1.0)
    raise ValueError(kind)


def softmax(scores: np.ndarray) -> np.ndarray:
    """Along the last axis, shifted by the greatest score."""
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def softmax_grad(scores: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(g, h) of shape [rows, classes] for class numbers y."""
    p, k = softmax(scores), scores.shape[1]
    g = p.copy()
    g[np.arange(len(y)), y.astype(np.int64)] -= 1.0
    return g * w[:, None], p * (1 - p) * (k / (k - 1.0)) * w[:, None]
