"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BANDS


#: Fixed value: how a number is written. Spark also reads 1D and 2F as numbers, which are codes.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def number(col: Column | str) -> Column:
    """As a double; what does not convert, and NaN, is null."""
    c = F.col(col) if isinstance(col, str) else col
    value = c.try_cast("double")
    written = F.typeof(c) != "string"
    return F.when((written | c.cast("string").rlike(NUMBER)) & ~F.isnan(value), value)


def pearson(x: str, y: str) -> Column:
    """Correlation that is null, not an error, where a side has no spread."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def skewness_g1(x: str) -> Column:
    """Bias-corrected skewness; null under three values or without spread."""
    n = F.count(x).cast("double")
    return F.when((F.count(x) >= 3) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis_g2(x: str) -> Column:
    """Bias-corrected excess kurtosis; null under four values or without spread."""
    n = F.count(x).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((F.count(x) >= 4) & (F.var_pop(x) > 0), scale * ((n + 1) * F.kurtosis(x) + 6))


def severity(score: Column | str) -> Column:
    """The band of an anomaly score."""
    score = F.col(score) if isinstance(score, str) else score
    out = F.lit(BANDS[-1][1])
    for bound, name in BANDS[-2::-1]:
        out = F.when(score < bound, name).otherwise(out)
    return out


def ess(n: Column, rho: Column) -> Column:
    """Effective sample size of n values with lag-1 autocorrelation rho."""
    return F.when(n < 4, F.greatest(n.cast("double"), F.lit(1.0))).otherwise(F.least(F.greatest(n * (1 - rho) / (1 + rho), F.lit(2.0)), n.cast("double")))
