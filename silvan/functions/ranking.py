"""Gradients of ranking objectives in numpy; queries of one length are handled together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..params import Params, default_label_gain


def discounts(n: int) -> np.ndarray:
    return 1.0 / np.log2(np.arange(n) + 2.0)


#: Numbers in the pair arrays of queries that are handled at once.
PAIRS = 1 << 22


def max_dcg(grades: np.ndarray, gain: np.ndarray, k: int) -> np.ndarray:
    """Of each query (row)."""
    best = -np.sort(-gain[grades], axis=1)[:, :k]
    return (best * discounts(best.shape[1])).sum(1)


def lambda_gradients(score: np.ndarray, grade: np.ndarray, p: Params, gain: np.ndarray, bias: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(g, h) of the documents of queries of one length, [query, document], for LambdaRank.

    Pairs have different grades, and the better placed of the two is within the truncation level. A pair's weight is what
    swapping the two would change in NDCG, made smaller by their scores' distance if norm is on; in the end sums are
    scaled by log2(1 + total) / total. Only the first `truncation` places meet all the others, so memory is places times documents.
    """
    many, n = score.shape
    if n < 2:
        return np.zeros(score.shape), np.zeros(score.shape)
    adjusted = score if bias is None else score + bias
    order = np.argsort(-adjusted, axis=1, kind="stable")
    s, y = np.take_along_axis(adjusted, order, 1), np.take_along_axis(grade.astype(np.int64), order, 1)
    ideal = max_dcg(y, gain, p.lambdarank_truncation_level)
    top, disc, worth = min(n, p.lambdarank_truncation_level), discounts(n), gain[y]
    pair = (np.arange(n)[None, :] > np.arange(top)[:, None]) & (y[:, :top, None] != y[:, None, :]) & (ideal > 0)[:, None, None]
    sign = np.where(y[:, :top, None] > y[:, None, :], 1.0, -1.0)  # 1: the better placed one has the higher grade
    delta = sign * (s[:, :top, None] - s[:, None, :])  # score of the higher grade less that of the lower
    change = np.abs(worth[:, :top, None] - worth[:, None, :]) * np.abs(disc[:top, None] - disc[None, :]) / np.where(ideal > 0, ideal, 1.0)[:, None, None]
    if p.lambdarank_norm:
        change = np.where((s[:, 0] != s[:, -1])[:, None, None], change / (0.01 + np.abs(delta)), change)
    rho = 1.0 / (1.0 + np.exp(p.sigmoid * delta))
    lam = np.where(pair, -p.sigmoid * change * rho, 0.0)
    hess = np.where(pair, p.sigmoid * p.sigmoid * change * rho * (1.0 - rho), 0.0)
    push = sign * lam  # on the better placed one; the other gets the opposite
    sg, sh = -push.sum(1), hess.sum(1)
    sg[:, :top] += push.sum(2)
    sh[:, :top] += hess.sum(2)
    if p.lambdarank_norm:
        total = -2.0 * lam.sum((1, 2))
        factor = np.where(total > 0, np.log2(1.0 + np.maximum(total, 0)) / np.where(total > 0, total, 1.0), 1.0)[:, None]
        sg, sh = sg * factor, sh * factor
    g, h = np.zeros((many, n)), np.zeros((many, n))
    np.put_along_axis(g, order, sg, 1)
    np.put_along_axis(h, order, sh, 1)
    return g, h


def xendcg_gradients(score: np.ndarray, grade: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(g, h) of queries of one length, [query, document], for the cross-entropy bound of NDCG; gamma: a draw from [0, 1) for each document."""
    if score.shape[1] < 2:
        return np.zeros(score.shape), np.zeros(score.shape)
    e = np.exp(score - score.max(1, keepdims=True))
    rho = e / e.sum(1, keepdims=True)
    target = np.power(2.0, grade.astype(np.int64)) - gamma
    share = target / np.maximum(1e-15, target.sum(1, keepdims=True))
    first = rho - share
    a = first / (1.0 - rho)
    second = rho * (a.sum(1, keepdims=True) - a)
    b = second / (1.0 - rho)
    third = rho * (b.sum(1, keepdims=True) - b)
    return first + second + third, rho * (1.0 - rho)


def by_length(query: np.ndarray, truncation: int) -> Iterator[np.ndarray]:
    """Row numbers [query, document] of consecutive queries, those of one length together, in parts of bounded size."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1, [len(query)]])
    sizes = np.diff(edges)
    for n in np.unique(sizes).tolist():
        starts = edges[:-1][sizes == n]
        step = max(1, PAIRS // max(1, n * min(n, truncation)))
        for i in range(0, len(starts), step):
            yield starts[i : i + step, None] + np.arange(n)


def gains_of(p: Params) -> np.ndarray:
    return np.array(p.label_gain or default_label_gain())
