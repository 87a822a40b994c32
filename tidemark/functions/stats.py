"""Distribution functions in the standard library and NumPy, and pandas UDFs over them.

Spark has no error function and no F or t distribution. The incomplete beta function is evaluated by
its continued fraction (modified Lentz), vectorised over columns.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType



def _each(f, x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.fromiter(map(f, x.ravel().tolist()), float, x.size).reshape(x.shape)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def z_critical(alpha: float, tests: int = 1) -> float:
    """Two-sided normal critical value with a Bonferroni correction."""
    return NormalDist().inv_cdf(1 - alpha / tests / 2)


def normal_two_sided(z):
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def betainc(a, b, x):
    """Regularised incomplete beta function, elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + _lgamma(a + b) - _lgamma(a) - _lgamma(b)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    value = np.where(x == 0, 0.0, front * out)
    return np.where(flip, 1 - value, value)


def f_cdf(x, d1, d2):
    x = np.maximum(np.asarray(x, float), 0)
    return betainc(np.asarray(d1, float) / 2, np.asarray(d2, float) / 2, d1 * x / (d1 * x + d2))


def f_two_sided(x, d1, d2):
    c = f_cdf(x, d1, d2)
    return np.minimum(1.0, 2 * np.minimum(c, 1 - c))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def siegmund_arl(h: float, k: float) -> float:
    """Average run length of a one-sided CUSUM in control (Siegmund, 1985)."""
    b = h + 1.166
    return (math.exp(2 * k * b) - 2 * k * b - 1) / (2 * k * k)


def decision_interval(arl0: float, n_vars: int, k: float) -> float:
    """The h whose run length is ``arl0`` for all two-sided charts together, by bisection."""
    target, lo, hi = arl0 * 2 * max(1, n_vars), 0.0, 1.0
    while siegmund_arl(hi, k) < target:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if siegmund_arl(mid, k) < target else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z)).where(z.notna())


@F.pandas_udf(DoubleType())
def f_test_p(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    valid = x.notna() & (d1 > 0) & (d2 > 0)
    return pd.Series(f_two_sided(x.where(valid, 1.0), d1.where(valid, 1.0), d2.where(valid, 1.0))).where(valid)
