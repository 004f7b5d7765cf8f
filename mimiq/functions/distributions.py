"""Student's t distribution, by the continued fraction of the incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Modified Lentz evaluation."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out *= c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    inside = (x > 0) & (x < 1)
    xs = np.where(inside, x, 0.5)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(xs) + b * np.log1p(-xs))
    low = xs < (a + 1) / (a + b + 2)
    direct = front * _fraction(a, b, np.where(low, xs, 0.5)) / a
    other = 1 - front * _fraction(b, a, np.where(low, 0.5, 1 - xs)) / b
    return np.where(inside, np.where(low, direct, other), (x >= 1).astype(float))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Probability of a larger |t|; NaN stays NaN."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    x = np.where(ok, np.where(np.isinf(t), 0.0, df / (df + np.where(np.isinf(t), 0.0, t) ** 2)), 0.5)
    return np.where(ok, incomplete_beta(np.where(ok, df, 1.0) / 2, 0.5, x), np.nan)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p as a column. It runs after aggregation, over few rows."""

    @pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(t_two_sided(a.to_numpy(float), b.to_numpy(float)))
        return out.where(out.notna(), None)

    return p(t.cast("double"), df.cast("double"))
