"""One vocabulary of elementwise functions for two engines, so that a formula is written once: Spark columns, or numpy arrays in a kernel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class SparkOps:
    exp, log1p, expm1, sqrt, abs, sign = F.exp, F.log1p, F.expm1, F.sqrt, F.abs, F.signum
    floor = staticmethod(F.floor)

    @staticmethod
    def log(x: Column) -> Column:
        """Natural logarithm; minus infinity for what is not positive, where Spark's own gives null."""
        return F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf")))

    @staticmethod
    def where(test: Column, yes, no) -> Column:
        return F.when(test, yes).otherwise(no)

    @staticmethod
    def greatest(a, b) -> Column:
        return F.greatest(_col(a), _col(b))

    @staticmethod
    def least(a, b) -> Column:
        return F.least(_col(a), _col(b))

    @staticmethod
    def one(like: Column) -> Column:
        return F.lit(1.0)


class NumpyOps:
    exp, log1p, expm1, sqrt, abs, sign, floor = np.exp, np.log1p, np.expm1, np.sqrt, np.abs, np.sign, np.floor
    where, greatest, least = staticmethod(np.where), staticmethod(np.maximum), staticmethod(np.minimum)

    @staticmethod
    def log(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), -np.inf)

    @staticmethod
    def one(like: np.ndarray) -> np.ndarray:
        return np.ones_like(like)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))
