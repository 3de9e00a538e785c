"""Tail probabilities. Used on result tables, a few rows per estimate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z975 = 1.959963984540054  # fixed value: 97.5 percent point of the normal


@F.pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return pd.Series(np.vectorize(math.erfc, otypes=[float])(x.to_numpy(float)))


def two_sided_p(statistic: Column) -> Column:
    """2 * P(Z < -|z|)."""
    return _erfc(F.abs(statistic) / F.lit(math.sqrt(2.0)))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError("the continued fraction of the tail did not converge")


def binomial_upper_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X binomial(n, p), as a regularised incomplete beta."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    a, b = float(k), float(n - k + 1)
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(p) + b * math.log1p(-p))
    if p < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _betacf(a, b, p) / a
    return 1.0 - math.exp(log_front) * _betacf(b, a, 1.0 - p) / b


@F.pandas_udf(DoubleType())
def binomial_greater_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """One-sided exact p; null when the expected rate is not inside (0, 1)."""
    def one(a, m, q):
        if q != q or q is None or q <= 0 or q >= 1:
            return np.nan
        return binomial_upper_tail(int(a), int(m), float(q))
    out = [one(*row) for row in zip(k, n, p)]
    return pd.Series(out, dtype="float64").where(lambda s: s.notna(), None)
