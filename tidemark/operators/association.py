"""Association of columns of any kind: phi_k of binned variables, and the method that suits each pair."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .correlate import arrays_of, spearman, variables_of

#: Fixed value: bins of a numeric variable, of equal width between its extremes.
BINS = 10
CELLS = "var_a string, var_b string, i int, j int, n long"


def equal_bins(value: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """The bin of a value; the last one holds its upper edge, and one bin holds all where there is no spread."""
    width = F.nullif((high - low) / bins, F.lit(0.0))
    return F.coalesce(F.least(F.floor((value - low) / width), F.lit(bins - 1)), F.when(value.isNotNull(), 0)).cast("int")


def _cells(names: list[str], low: np.ndarray, high: np.ndarray, bins: int):
    first, second = np.triu_indices(len(names), 1)

    def run(batches):
        total = np.zeros((len(first), bins * bins), np.int64)
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), len(names))
            width = (high - low) / bins
            with np.errstate(all="ignore"):
                at = np.where(width > 0, np.minimum(np.floor((x - low) / np.where(width > 0, width, 1.0)), bins - 1), 0)
            at = np.where(np.isfinite(x), at, -1).astype(np.int64)
            for k, (i, j) in enumerate(zip(first, second, strict=True)):
                both = (at[:, i] >= 0) & (at[:, j] >= 0)
                total[k] += np.bincount(at[both, i] * bins + at[both, j], minlength=bins * bins)
        pair, cell = np.nonzero(total)
        yield pd.DataFrame({"var_a": pd.Series([names[first[k]] for k in pair], dtype=object), "var_b": pd.Series([names[second[k]] for k in pair], dtype=object), "i": (cell // bins).astype(np.int32), "j": (cell % bins).astype(np.int32), "n": total[pair, cell]})

    return run


def contingency(obs: DataFrame, bins: int = BINS) -> DataFrame:
    """``var_a, var_b, i, j, n``: how many rows of each pair of variables lie in each cell of their bins. A
    partition counts all pairs at once, so what is shuffled does not grow with the rows. Missing and infinite
    values are left out."""
    finite = F.abs("value") < float("inf")
    edges = {r["variable"]: (r["lo"], r["hi"]) for r in obs.where(finite).groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}  # a row per variable
    names = [v for v in variables_of(obs) if v in edges]
    if len(names) < 2:
        return obs.sparkSession.createDataFrame([], CELLS)
    low, high = (np.array([edges[v][k] for v in names]) for k in (0, 1))
    rows = arrays_of(obs.where(F.col("variable").isin(names)), names)
    parts = rows.select(F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x")).mapInPandas(_cells(names, low, high, bins), CELLS)
    return parts.groupBy("var_a", "var_b", "i", "j").agg(F.sum("n").alias("n"))


def chi_square(cells: DataFrame) -> DataFrame:
    """``var_a, var_b, n, rows, columns, chi2``: Pearson's statistic of each table, over the rows and columns
    that are not empty."""
    pair = ["var_a", "var_b"]
    n = F.col("n").cast("double")
    by_row = cells.groupBy(*pair, "i").agg(F.sum(n).alias("ni"))
    by_column = cells.groupBy(*pair, "j").agg(F.sum(n).alias("nj"))
    every = cells.groupBy(*pair).agg(F.sum(n).alias("total"), F.countDistinct("i").alias("rows"), F.countDistinct("j").alias("columns"))
    sums = cells.join(by_row, [*pair, "i"]).join(by_column, [*pair, "j"]).groupBy(*pair).agg(F.sum(n * n / (F.col("ni") * F.col("nj"))).alias("s"))
    return every.join(sums, pair).select(*pair, F.col("total").cast("long").alias("n"), "rows", "columns", (F.col("total") * F.greatest(F.col("s") - 1, F.lit(0.0))).alias("chi2"))


#: Gauss-Legendre nodes for the bivariate normal distribution.
NODES, WEIGHTS = np.polynomial.legendre.leggauss(96)


def bivariate_normal(h: np.ndarray, k: np.ndarray, rho: float) -> np.ndarray:
    """P(X < h_i, Y < k_j) of standard normals with correlation ``rho`` in [0, 1], on the grid of both."""
    normal = NormalDist()
    ph, pk = (np.array([normal.cdf(v) if math.isfinite(v) else float(v > 0) for v in x]) for x in (h, k))
    if rho >= 1:
        return np.minimum(ph[:, None], pk[None, :])
    out = ph[:, None] * pk[None, :]
    inner = np.isfinite(h)[:, None] & np.isfinite(k)[None, :]
    a, b = np.where(np.isfinite(h), h, 0.0)[:, None, None], np.where(np.isfinite(k), k, 0.0)[None, :, None]
    angle = math.asin(rho) * (NODES + 1) / 2
    density = np.exp(-(a * a + b * b - 2 * a * b * np.sin(angle)) / (2 * np.cos(angle) ** 2))
    return out + inner * (density * WEIGHTS).sum(2) * math.asin(rho) / (4 * math.pi)


def normal_chi_square(rows: np.ndarray, columns: np.ndarray, rho: float) -> float:
    """Pearson's statistic, per row of data, of a bivariate normal cut so that it has these margins."""
    normal = NormalDist()
    cut = lambda p: np.array([-math.inf, *(normal.inv_cdf(min(max(q, 1e-15), 1 - 1e-15)) for q in np.cumsum(p)[:-1]), math.inf])
    grid = bivariate_normal(cut(rows), cut(columns), rho)
    cells = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    flat = rows[:, None] * columns[None, :]
    return float(((cells - flat) ** 2 / flat).sum())


def phi_k_of(table: np.ndarray) -> float | None:
    """Phi_k of a contingency table (Baak et al., 2020): the correlation of the bivariate normal, binned by
    the same margins, whose statistic equals the table's. What independent columns would show by chance is
    taken off, and the scale is such that 1 is the largest statistic that the table can have. None where a
    side has one value."""
    table = table[table.sum(1) > 0][:, table.sum(0) > 0].astype(float)
    r, k = table.shape
    if r < 2 or k < 2:
        return None
    n = table.sum()
    rows, columns = table.sum(1) / n, table.sum(0) / n
    expected = n * rows[:, None] * columns[None, :]
    chi2, chance, most = float(((table - expected) ** 2 / expected).sum()), float((r - 1) * (k - 1)), n * min(r - 1, k - 1)
    if chi2 <= chance or most <= chance:
        return 0.0
    if chi2 >= most:
        return 1.0
    top = normal_chi_square(rows, columns, 1.0)
    lo, hi = 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        reached = chance + (most - chance) / top * normal_chi_square(rows, columns, mid)
        lo, hi = (mid, hi) if reached < chi2 else (lo, mid)
    return (lo + hi) / 2


def phi_k(obs: DataFrame, bins: int = BINS) -> DataFrame:
    """``var_a, var_b, phi_k`` of each pair of variables, from their contingency tables."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((bins, bins))
        table[pdf["i"], pdf["j"]] = pdf["n"]
        return pd.DataFrame({"var_a": [pdf["var_a"].iloc[0]], "var_b": [pdf["var_b"].iloc[0]], "phi_k": [phi_k_of(table)]})

    return contingency(obs, bins).groupBy("var_a", "var_b").applyInPandas(one, "var_a string, var_b string, phi_k double")


def auto(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """``col_a, col_b, method, value``: rank correlation for two numeric columns, Cramér's V where one is
    categorical (numbers in ten equal bins). All pairs with a category are counted in one aggregation."""
    spark = df.sparkSession
    row = F.monotonically_increasing_id()
    entries = F.array(*(F.struct(F.lit(c).alias("variable"), F.lit(i).alias("var_pos"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(numeric))) if numeric else None
    out = spark.createDataFrame([], "col_a string, col_b string, method string, value double")
    if len(numeric) > 1:
        long = df.withColumn("__row", row).select(F.lit("0").alias("run_id"), F.col("__row").alias("seq"), F.explode(entries).alias("e")).select("run_id", "seq", "e.*")
        out = out.union(spearman(long).select("var_a", "var_b", F.lit("spearman"), "r"))
    if not categorical:
        return out
    edges = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max)))).first() if numeric else None
    value = {c: F.col(f"`{c}`").cast("string") for c in categorical}
    for i, c in enumerate(numeric):
        lo, hi = (F.lit(edges[f"{n}{i}"]).cast("double") for n in ("lo", "hi"))
        value[c] = equal_bins(F.col(f"`{c}`").cast("double"), lo, hi).cast("string")
    names = [*numeric, *categorical]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if not (a in numeric and b in numeric)]
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), value[a].alias("a"), value[b].alias("b")) for a, b in pairs))).alias("e")).select("e.*").where("a is not null and b is not null")
    key = ["col_a", "col_b"]
    cells = cells.groupBy(*key, "a", "b").agg(F.count("*").cast("double").alias("n"))
    sides = cells.join(cells.groupBy(*key, "a").agg(F.sum("n").alias("na")), [*key, "a"]).join(cells.groupBy(*key, "b").agg(F.sum("n").alias("nb")), [*key, "b"])
    found = sides.groupBy(*key).agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.least(F.countDistinct("a"), F.countDistinct("b")).alias("k"))
    v = F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / F.nullif(F.col("k") - 1, F.lit(0)))
    return out.union(found.select(*key, F.lit("cramers_v"), v))
