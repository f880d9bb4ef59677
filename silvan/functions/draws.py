"""Draws that depend on a row's key, not on where the row lies: the same whatever the partitioning."""

from __future__ import annotations

import numpy as np


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def uniform(key: np.ndarray, *salts: int) -> np.ndarray:
    """One number in [0, 1) for each 64-bit key."""
    x = key.view(np.uint64) if key.dtype == np.int64 else key.astype(np.uint64)
    for s in salts:
        x = _mix(x + np.uint64((s * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
