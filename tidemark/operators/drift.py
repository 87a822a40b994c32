"""Drift of runs against a pooled baseline: mean, variance, correlation and onset.

Everything is a composition of aggregations, running windows over parts of series and joins over
``obs_long``; only p-values need Python workers. Tests correct for autocorrelation by the effective sample size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import WEIGHTS, Thresholds
from ..functions.expressions import ess, severity
from ..functions.stats import decision_interval, f_test_p, normal_p, z_critical
from ..sources.tables import written
from .quality import missing_of, trusted_runs, verdict
from .series import SERIES, laid_out, lag_moments, reflected_sums


def rho1(obs: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """``run_id, variable, var_pos, n, n_rows, mean, sd, rho1`` over non-null values, gaps closed; n_rows
    counts missing ones too. Lag-1 correlation is 0 under four values or without spread on either side,
    and clipped to 0.999. Series without a value have no row."""
    out = (lag_moments(obs) if moments is None else moments).where("n > 0")
    flat = (F.col("n") < 4) | (F.col("sx") < 1e-12) | (F.col("sy") < 1e-12)
    r = F.coalesce(F.col("c") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0)), F.lit(0.0))
    return out.select(*SERIES, "var_pos", "n", "n_rows", "mean", "sd", F.when(flat, 0.0).otherwise(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), r))).alias("rho1"))


def effective_sizes(obs: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    return rho1(obs, moments).withColumn("ess", ess(F.col("n"), F.col("rho1")))


def baseline(obs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``variable, var_pos, pooled_mean, pooled_std, pooled_n, pooled_ess, mean_rho1``, from the sizes of
    the runs alone: counts, means and deviations of runs add up to the pooled ones."""
    sizes = effective_sizes(obs) if sizes is None else sizes
    n, mean, sd = F.col("n"), F.col("mean"), F.coalesce("sd", F.lit(0.0))
    centre = sizes.groupBy("variable").agg((F.sum(n * mean) / F.sum(n)).alias("pooled_mean"))
    apart = sizes.join(centre, "variable")
    total = F.sum("n")
    squares = F.sum((n - 1) * sd * sd + n * F.pow(mean - F.col("pooled_mean"), F.lit(2)))
    return apart.groupBy("variable", "var_pos").agg(
        F.max("pooled_mean").alias("pooled_mean"),
        F.sqrt(squares / F.nullif(total - 1, F.lit(0))).alias("pooled_std"),
        total.alias("pooled_n"),
        F.sum("ess").alias("pooled_ess"),
        (F.sum(F.col("rho1") * n) / total).alias("mean_rho1"),
    )


def mean_shift(sizes: DataFrame, base: DataFrame, n_vars: int, t: Thresholds = Thresholds(), p_values: bool = True) -> DataFrame:
    """``z_score, mean_drifted`` per run and variable; 0 without spread or effective samples."""
    z = F.when((F.col("pooled_std") > 1e-12) & (F.col("ess") > 1), (F.col("mean") - F.col("pooled_mean")) / (F.col("pooled_std") / F.sqrt("ess"))).otherwise(0.0)
    out = sizes.join(base.drop("var_pos"), "variable").select(*SERIES, "var_pos", z.alias("z_score"))
    out = out.withColumn("mean_drifted", F.abs("z_score") > z_critical(t.stat_alpha, n_vars))
    return out.withColumn("p_value", normal_p("z_score")) if p_values else out


def top_mean_drifted(shifts: DataFrame, most: int = 10) -> DataFrame:
    """Each run's drifted variables, the largest deviations first."""
    ranked = shifts.where("mean_drifted").withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc(F.abs("z_score")), "var_pos")))
    return ranked.where(F.col("rank") <= most).select(*SERIES, F.round("z_score", 4).alias("z_score"), "rank")


def variance_ratio(sizes: DataFrame, base: DataFrame) -> DataFrame:
    """``ratio, df, df_pooled``; null where a side has no spread or too few effective samples."""
    usable = (F.col("pooled_std") > 1e-6) & (F.col("ess") > 2) & (F.col("pooled_ess") > 2)
    ratio = F.when(usable, F.col("sd") * F.col("sd") / F.nullif(F.col("pooled_std") * F.col("pooled_std"), F.lit(0.0)))
    return sizes.join(base.drop("var_pos"), "variable").select(*SERIES, "var_pos", ratio.alias("ratio"), (F.col("ess") - 1).alias("df"), (F.col("pooled_ess") - 1).alias("df_pooled"))


def variance_shift(sizes: DataFrame, base: DataFrame, n_vars: int, t: Thresholds = Thresholds()) -> DataFrame:
    out = variance_ratio(sizes, base).withColumn("p_value", F.coalesce(f_test_p("ratio", "df", "df_pooled"), F.lit(1.0)))
    return out.withColumn("var_drifted", F.col("p_value") < t.var_alpha / n_vars)


def cusum(obs: DataFrame, base: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``c_pos, c_neg`` at each position: reflected sums of the standardised values, less half the shift. A
    missing value counts as no deviation. Long series are split (see ``series``)."""
    k = t.shift / 2
    z = F.coalesce((F.col("value") - F.col("pooled_mean")) / F.nullif("pooled_std", F.lit(0.0)), F.lit(0.0))
    rows = obs.join(base.select("variable", "pooled_mean", "pooled_std"), "variable").withColumn("z", z)
    return reflected_sums(rows, F.col("z") - k, F.col("z") + k)


def onsets(charts: DataFrame, h: float) -> DataFrame:
    """Per run and variable: first alarm, its direction (decrease wins a tie), and the chart's peak. The direction
    is a number until the end: with text in its buffers the aggregation would sort all places."""
    alarm = (F.col("c_pos") > h) | (F.col("c_neg") < -h)
    at = F.when(alarm, F.col("seq"))
    found = charts.groupBy(*SERIES, "var_pos").agg(F.min(at).alias("onset"), F.min_by((F.col("c_neg") < -h).cast("int"), at).alias("down"), F.max(F.greatest(F.col("c_pos"), -F.col("c_neg"))).alias("peak"))
    return found.select(*SERIES, "var_pos", "onset", F.when(F.col("onset").isNotNull(), F.when(F.col("down") == 1, "decrease").otherwise("increase")).alias("direction"), "peak")


def propagation(found: DataFrame) -> DataFrame:
    """Per run: variables in the order of their alarms (column order breaks ties)."""
    hit = found.where("onset is not null").groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("onset", "var_pos", "variable"))).alias("o"))
    return hit.select("run_id", F.size("o").alias("n_detected"), F.element_at("o", 1).onset.alias("earliest_onset"), F.element_at("o", 1).variable.alias("earliest_variable"), F.transform("o", lambda x: x.variable).alias("propagation"))


def variable_count(obs: DataFrame) -> int:
    return obs.select("variable").distinct().count()


def drift_summary(obs: DataFrame, n_vars: int | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """The built-in part of a run's score: mean drift, onset and their order, per run."""
    obs = laid_out(obs)
    sizes = written(effective_sizes(obs), "sizes")
    base = written(baseline(obs, sizes), "baseline")
    n_vars = n_vars or base.count()
    means = mean_shift(sizes, base, n_vars, t, p_values=False).groupBy("run_id").agg(F.count_if("mean_drifted").alias("n_mean_drifted"), F.max(F.abs("z_score")).alias("max_abs_z"))
    found = written(onsets(cusum(obs, base, t), decision_interval(t.arl0, n_vars, t.shift / 2)), "onsets")
    peaks = found.groupBy("run_id").agg(F.max("peak").alias("peak"))
    out = means.join(peaks, "run_id").join(propagation(found), "run_id", "left")
    mean, onset = F.round(F.col("n_mean_drifted") / n_vars, 4), F.round(F.coalesce("n_detected", F.lit(0)) / n_vars, 4)
    return out.select("run_id", "n_mean_drifted", "max_abs_z", F.coalesce("n_detected", F.lit(0)).cast("long").alias("n_detected"), "earliest_onset", "earliest_variable", "peak", mean.alias("frac_mean_drifted"), onset.alias("frac_onset_detected"))


def score(mean: Column, var: Column, corr: Column, onset: Column) -> Column:
    w = WEIGHTS
    return F.round(w["mean"] * mean + w["var"] * var + w["corr"] * corr + w["onset"] * onset, 4)


@dataclass
class Known:
    """What runs are compared with: the pooled baseline and the pooled correlations."""

    base: DataFrame
    corr: DataFrame


def known_of(reference: DataFrame, arrays: tuple[DataFrame, list[str]] | None = None) -> Known:
    from .correlate import gram_pearson_parts, gram_table, pearson_of, run_gram

    sizes = effective_sizes(reference)
    grams = gram_table(*arrays, by_run=True) if arrays else run_gram(reference)
    return Known(baseline(reference, sizes), pearson_of(gram_pearson_parts(grams)))


def analyse(obs: DataFrame, known: Known | None = None, rules: DataFrame | None = None, t: Thresholds = Thresholds(), arrays: tuple[DataFrame, list[str]] | None = None, pair_p_values: bool = False) -> dict[str, DataFrame]:
    """Every perspective on the runs of ``obs``, against what is ``known`` or else against all of them:
    ``summary, quality, sizes, shifts, spreads, pairs, onsets, charts``.

    Observations are written once, by parts of series; the moments of the series and of the pairs are the
    only other passes but the CUSUM. Counts of missing values come from the moments. ``arrays`` is the wide
    form of ``obs`` (``run_id, x`` and the variables' names) where there is one, which saves a pivot."""
    from .correlate import gram_pearson_parts, gram_table, pair_drift, pearson_of, run_gram

    obs = laid_out(obs)
    moments = written(lag_moments(obs), "moments")
    grams = written(gram_table(*arrays, by_run=True) if arrays else run_gram(obs), "gram")
    sizes = effective_sizes(obs, moments)
    report = written(verdict(obs, rules, t, missing_of(moments)), "verdict")
    if known is None:
        known = Known(written(baseline(obs, sizes), "baseline"), pearson_of(gram_pearson_parts(grams)))
    base = known.base
    n_vars = base.count()
    live = lambda df: trusted_runs(df, report)
    shifts, spreads = mean_shift(sizes, base, n_vars, t, p_values=False), variance_shift(sizes, base, n_vars, t)
    pairs = pair_drift(pearson_of(grams), known.corr, sizes, base, t, p_values=pair_p_values)
    charts = cusum(obs, base, t)
    found = written(onsets(charts, decision_interval(t.arl0, n_vars, t.shift / 2)), "onsets")
    means = live(shifts).groupBy("run_id").agg(F.count_if("mean_drifted").alias("n_mean_drifted"))
    widths = live(spreads).groupBy("run_id").agg(F.count_if("var_drifted").alias("n_var_drifted"))
    corr = live(pairs).groupBy("run_id").agg(F.count("*").alias("n_pairs"), F.count_if("drifted").alias("n_corr_drifted"), F.sqrt(2 * F.sum(F.pow(F.col("r") - F.col("r0"), F.lit(2)))).alias("corr_frobenius"))
    out = report.select("run_id", "gate", "severity").join(means, "run_id", "left").join(widths, "run_id", "left").join(corr, "run_id", "left").join(propagation(live(found)), "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c, n: F.coalesce(F.round(zero(c) / n, 4), F.lit(0.0))
    parts = [share("n_mean_drifted", F.lit(n_vars)), share("n_var_drifted", F.lit(n_vars)), share("n_corr_drifted", F.nullif("n_pairs", F.lit(0))), share("n_detected", F.lit(n_vars))]
    names = ["frac_mean_drifted", "frac_var_drifted", "frac_corr_drifted", "frac_onset_detected"]
    out = out.select("run_id", "gate", F.col("severity").alias("quality"), *(p.alias(n) for p, n in zip(parts, names, strict=True)), F.coalesce("corr_frobenius", F.lit(0.0)).alias("corr_frobenius"), "earliest_onset", "earliest_variable", "propagation")
    out = out.withColumn("anomaly_score", score(*map(F.col, names)))
    summary = out.withColumn("band", severity("anomaly_score")).withColumn("needs_root_cause", F.col("band").isin("serious", "critical"))
    return {"summary": summary, "quality": report, "sizes": sizes, "shifts": shifts, "spreads": spreads, "pairs": pairs, "onsets": found, "charts": charts, "obs": obs}


def run_summary(obs: DataFrame, reference: DataFrame | None = None, rules: DataFrame | None = None, t: Thresholds = Thresholds(), arrays: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """Every run with its gate, the shares of the four perspectives, the anomaly score and its band.
    Runs that fail the gate are not analysed and score 0."""
    return analyse(obs, None if reference is None else known_of(reference), rules, t, arrays)["summary"]


def z_bars(shifts: DataFrame, most: int = 10) -> DataFrame:
    """Each run's largest deviations, with the colour of their bars."""
    ranked = shifts.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc(F.abs("z_score")), "var_pos"))).where(F.col("rank") <= most)
    return ranked.select(*SERIES, "z_score", "rank", F.when(F.abs("z_score") >= 3, "critical").otherwise("normal").alias("colour"))


def traces(obs: DataFrame, base: DataFrame, found: DataFrame, most: int = 6) -> DataFrame:
    """Values, band and onset of each run's earliest variables."""
    first = found.where("onset is not null").withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy("onset", "var_pos"))).where(F.col("k") <= most)
    rows = obs.join(first.select(*SERIES, "onset"), list(SERIES)).join(base.select("variable", "pooled_mean", "pooled_std"), "variable")
    return rows.select(*SERIES, "seq", "value", "onset", (F.col("pooled_mean") - 2 * F.col("pooled_std")).alias("low"), (F.col("pooled_mean") + 2 * F.col("pooled_std")).alias("high"))
