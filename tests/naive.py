"""A plain leaf-wise learner, for comparison: one split after the other, a loop over bins, no Spark."""

import numpy as np


def grow(bins, counts, g, h, leaves, min_data, l2=0.0):
    """bins [rows, features]; counts: bins of each feature, none of them missing. Leaf of each row, and leaf values."""
    leaf = np.zeros(len(g), int)
    best = {0: _best(bins, counts, g, h, leaf == 0, min_data, l2)}
    n = 1
    while n < leaves:
        at = max(best, key=lambda i: (best[i][0], -best[i][1], -i))
        gain, f, t = best[at]
        if gain <= 0:
            break
        rows = leaf == at
        leaf[rows & (bins[:, f] > t)] = n
        best[at], best[n] = (_best(bins, counts, g, h, leaf == i, min_data, l2) for i in (at, n))
        n += 1
    return leaf, np.array([-g[leaf == i].sum() / (h[leaf == i].sum() + l2) for i in range(n)])


def _best(bins, counts, g, h, rows, min_data, l2):
    out = (0.0, 0, 0)
    total = g[rows].sum() ** 2 / (h[rows].sum() + l2)
    for f in range(bins.shape[1]):
        for t in range(counts[f] - 2, -1, -1):
            left = rows & (bins[:, f] <= t)
            right = rows & ~left
            if min(left.sum(), right.sum()) < min_data:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - total
            if gain > out[0] + 1e-9:
                out = (gain, f, t)
    return out
