"""Sparse random projections as extra features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .percentiles import exact


class ObliquePool:
    """A fixed pool of projections: each a list of (feature, weight). Features are scaled by median and quartile range; missing ones count as the median."""

    def __init__(self, features: list[str], projections: list[list[tuple[int, float]]]):
        self.features, self.projections = features, projections
        self.center: list[float] = []
        self.scale: list[float] = []

    @classmethod
    def random(cls, features: list[str], count: int, width: int = 3, seed: int = 0) -> ObliquePool:
        draw = np.random.default_rng(seed)
        pool = []
        for _ in range(count):
            picked = sorted(draw.permutation(len(features))[: min(width, len(features))].tolist())
            weight = draw.normal(size=len(picked))
            pool.append(list(zip(picked, (weight / np.linalg.norm(weight)).tolist(), strict=True)))
        return cls(features, pool)

    def fit(self, df: DataFrame) -> ObliquePool:
        """Median and quartile range of each feature, by running counts of its distinct values; a range of 0 counts as 1."""
        long = df.select(F.posexplode(F.array(*[F.col(f"`{f}`").cast("double") for f in self.features])).alias("feature", "value"))
        found = {r.feature: r for r in exact(long, ["feature"], F.col("value"), [0.25, 0.5, 0.75]).collect()}
        rows = [found.get(i) for i in range(len(self.features))]
        self.center = [r.q1 if r else 0.0 for r in rows]
        self.scale = [(r.q2 - r.q0) or 1.0 if r else 1.0 for r in rows]
        return self

    def transform(self, df: DataFrame, prefix: str = "oblique_") -> DataFrame:
        def scaled(i: int):
            x = F.col(f"`{self.features[i]}`").cast("double")
            return (F.when(x.isNull() | F.isnan(x), F.lit(self.center[i])).otherwise(x) - self.center[i]) / self.scale[i]

        return df.withColumns({f"{prefix}{k}": sum((scaled(i) * w for i, w in p[1:]), scaled(p[0][0]) * p[0][1]) for k, p in enumerate(self.projections)})
