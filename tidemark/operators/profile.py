"""Column fingerprints per run and pooled, alerts, histograms and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import kurtosis_g2, skewness_g1
from ..sources.tables import written


def _stats() -> list[Column]:
    v = F.col("value")
    return [
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min(v + 0.0).alias("min"),
        F.max(v + 0.0).alias("max"),
        skewness_g1("value").alias("skewness"),
        kurtosis_g2("value").alias("kurtosis"),
        F.count_if(v.isNull()).alias("n_missing"),
        F.countDistinct("value").alias("n_distinct"),
        F.count_if(F.abs(v) == float("inf")).alias("n_infinite"),
        F.count_if(v == 0).alias("n_zeros"),
        F.count_if(v < 0).alias("n_negative"),
    ]


def _shares(df: DataFrame) -> DataFrame:
    n = F.col("n")
    valid = F.nullif(n - F.col("n_missing"), F.lit(0))
    return df.select("*", (F.col("n_distinct") / valid).alias("p_distinct"), (F.col("n_missing") / n).alias("p_missing"), (F.col("n_infinite") / n).alias("p_infinite"), (F.col("n_zeros") / n).alias("p_zeros"), (F.col("n_negative") / n).alias("p_negative"), (n * 8).alias("memory_size"))


def per_run(obs: DataFrame) -> DataFrame:
    return _shares(obs.groupBy("run_id", "variable").agg(*_stats()))


def pooled(obs: DataFrame) -> DataFrame:
    return _shares(obs.groupBy("variable").agg(*_stats()))


def both(obs: DataFrame) -> DataFrame:
    """Per run and pooled (null run) in one pass over the observations."""
    grouped = obs.groupingSets([["run_id", "variable"], ["variable"]], "run_id", "variable")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min(F.col("value") + 0.0).alias("min"), F.max(F.col("value") + 0.0).alias("max"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.grouping("run_id").cast("int").alias("is_pooled"))


def alerts(profile: DataFrame) -> DataFrame:
    """Our cut-offs: constant (one value), missing (over 5 %), zeros (over half), infinite (any), unique
    (all distinct), skewed (beyond 20). A row per alert."""
    c = F.col
    kinds = F.array_compact(
        F.array(
            F.when(c("n_distinct") == 1, "constant"),
            F.when(c("p_missing") > 0.05, "missing"),
            F.when(c("p_zeros") > 0.5, "zeros"),
            F.when(c("n_infinite") > 0, "infinite"),
            F.when(c("p_distinct") == 1, "unique"),
            F.when(F.abs("skewness") > 20, "skewed"),
        )
    )
    keys = [k for k in ("run_id", "variable") if k in profile.columns]
    return profile.select(*keys, F.explode(kinds).alias("alert"))


def alert_frequency(alert_rows: DataFrame, top: int = 15) -> DataFrame:
    return alert_rows.groupBy("alert", "variable").agg(F.countDistinct("run_id").alias("n_runs")).orderBy(F.desc("n_runs"), "alert", "variable").limit(top)


def across_runs(profile: DataFrame) -> DataFrame:
    """Means over runs of each statistic."""
    names = ["mean", "std", "min", "max", "skewness", "kurtosis", "n_missing", "n_distinct"]
    return profile.groupBy("variable").agg(*(F.avg(n).alias(f"avg_{n}") for n in names))


def compare(profile: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """Two runs' profiles: shift in deviations, ratio of variances, and whether either is large."""
    a = profile.where(F.col("run_id") == run_a).select("variable", F.col("mean").alias("ma"), F.col("std").alias("sa"))
    b = profile.where(F.col("run_id") == run_b).select("variable", F.col("mean").alias("mb"), F.col("std").alias("sb"))
    out = a.join(b, "variable").select("variable", (F.abs(F.col("mb") - F.col("ma")) / (F.col("sa") + 1e-12)).alias("shift"), (F.pow("sb", F.lit(2)) / (F.pow("sa", F.lit(2)) + 1e-12)).alias("ratio"))
    return out.withColumn("drifted", (F.col("shift") > 3) | (F.col("ratio") > 2) | (F.col("ratio") < 0.5))


def label_summary(labels: DataFrame, columns: list[str], top: int = 50) -> DataFrame:
    """``label, value, n, n_distinct`` for the commonest values; labels with more than ``top`` distinct
    values give one row without a value."""
    rows = labels.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in columns))).alias("e")).select("e.label", "e.value")
    distinct = rows.groupBy("label").agg(F.countDistinct("value").alias("n_distinct"))
    counts = rows.where("value is not null").groupBy("label", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)
    return distinct.join(ranked, (distinct.label == ranked.label) & (distinct.n_distinct <= top), "left").select(distinct.label, "value", "n", "n_distinct")


def finite(obs: DataFrame) -> DataFrame:
    """Without missing and infinite values, which have no place in a histogram or a density."""
    return obs.where(F.abs("value") < float("inf"))


def histogram(obs: DataFrame) -> DataFrame:
    """``min(50, max(10, n / 50))`` equal bins per variable; the last one holds its upper edge."""
    obs = finite(obs)
    edges = obs.groupBy("variable").agg(F.min(F.col("value") + 0.0).alias("lo"), F.max(F.col("value") + 0.0).alias("hi"), F.count("*").alias("n"))
    edges = edges.withColumn("bins", F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.col("n") / 50))).cast("int")).withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(1.0))
    edges = written(edges, "edges")  # small by its files: values are not shuffled by variable
    at = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")).cast("int"), F.col("bins") - 1)
    return obs.join(edges, "variable").withColumn("bin", at).groupBy("variable", "bin").agg(F.count("*").alias("count"), F.max("n").alias("n"), F.max("width").alias("width")).withColumn("density", F.col("count") / (F.col("n") * F.col("width"))).drop("n", "width")


def kde(obs: DataFrame, points: int = 200, cells: int = 4096) -> DataFrame:
    """Gaussian density with Scott's bandwidth on ``points`` places between the extremes. Values are
    counted into ``cells`` fine cells first, so the work per variable does not grow with its rows."""
    obs = finite(obs)
    edges = obs.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n")).where("sd > 0")
    edges = written(edges, "edges")
    cell = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))
    binned = obs.join(edges.select("variable", "lo", "hi"), "variable").groupBy("variable", cell.alias("cell")).agg(F.count("*").alias("w"), F.avg("value").alias("x"))
    grid = edges.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1))
    z = (F.col("at") - F.col("x")) / F.col("h")
    return grid.join(binned, "variable").groupBy("variable", "point").agg(F.max("at").alias("place"), (F.sum(F.col("w") * F.exp(-0.5 * z * z)) / F.max(F.col("n") * F.col("h")) / 2.5066282746310002).alias("density"))


#: Fixed value: the asymptotic 5 % critical value of the Dickey-Fuller statistic with a constant.
STATIONARY = -2.86


def dickey_fuller(obs: DataFrame) -> DataFrame:
    """``run_id, variable, n, statistic, stationary``: the Dickey-Fuller test of each series (a constant, no
    further lags) from the moments of its steps; gaps are closed. Null without spread or under four steps."""
    past = Window.partitionBy("run_id", "variable").orderBy("seq")
    rows = obs.where("value is not null").withColumn("x", F.lag("value").over(past)).where("x is not null").withColumn("step", F.col("value") - F.col("x"))
    m = rows.groupBy("run_id", "variable").agg(F.count("*").alias("n"), F.covar_pop("step", "x").alias("sxy"), F.var_pop("x").alias("sxx"), F.var_pop("step").alias("syy"))
    slope = F.col("sxy") / F.nullif("sxx", F.lit(0.0))
    error = F.sqrt(F.greatest((F.col("syy") - slope * F.col("sxy")) / F.nullif(F.col("n") - 2, F.lit(0)), F.lit(0.0)) / F.nullif("sxx", F.lit(0.0)))
    t = F.when(F.col("n") >= 4, slope / F.nullif(error, F.lit(0.0)))
    return m.select("run_id", "variable", "n", t.alias("statistic")).withColumn("stationary", F.col("statistic") < STATIONARY)
