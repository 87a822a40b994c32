"""Missing values, operator-defined range rules, and the verdict that gates runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..sources.tables import written

RULES = "rule_id string, variable string, type string, min double, max double, description string, active boolean, created_at string"


def missing(obs: DataFrame) -> DataFrame:
    """Per run and variable: missing count and share (four digits)."""
    return _with_share(obs.groupBy("run_id", "variable").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing")))


def _with_share(counts: DataFrame) -> DataFrame:
    return counts.withColumn("frac_missing", F.round(F.col("n_missing") / F.col("n"), 4))


def missing_of(moments: DataFrame) -> DataFrame:
    """As ``missing``, from the moments of the series (``n`` values in ``n_rows``)."""
    return _with_share(moments.select("run_id", "variable", F.col("n_rows").alias("n"), (F.col("n_rows") - F.col("n")).alias("n_missing")))


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.coalesce("active", F.lit(True)))


def rule_violations(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Per run and rule: values outside the inclusive bounds. Rules without a violation, and variables
    that are absent or all missing, give no row. The rules are written, so that their size is known and the
    observations, which lie under few variables, are not shuffled by them."""
    live = active_rules(rules).where("type = 'range'").select("rule_id", "variable", F.col("min").alias("lo"), F.col("max").alias("hi"), "description")
    live = written(live, "rules")
    out = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    hits = obs.where("value is not null").join(live, "variable").groupBy("run_id", "rule_id", "variable").agg(F.count("*").alias("n_checked"), F.count_if(F.coalesce(out, F.lit(False))).alias("n_violations"))
    return hits.where("n_violations > 0").withColumn("frac_violations", F.round(F.col("n_violations") / F.col("n_checked"), 4))


def verdict(obs: DataFrame, rules: DataFrame | None = None, t: Thresholds = Thresholds(), gaps: DataFrame | None = None) -> DataFrame:
    """Per run: ``max_frac_missing, n_rules_violated, severity, trusted, gate, reasons``. Shares are
    compared as rounded; any violation is critical; a missing share is named once, by its worst band.
    ``gaps`` are the missing counts where they are known; then only rules read the observations."""
    worst = (missing(obs) if gaps is None else gaps).groupBy("run_id").agg(F.max("frac_missing").alias("max_frac_missing"))
    if rules is not None:
        broken = rule_violations(obs, rules).groupBy("run_id").agg(F.count("*").alias("n_rules_violated"))
        worst = worst.join(broken, "run_id", "left")
    else:
        worst = worst.withColumn("n_rules_violated", F.lit(None).cast("long"))
    m, v = F.col("max_frac_missing"), F.coalesce("n_rules_violated", F.lit(0))
    critical = (v > 0) | (m >= t.missing_critical)
    out = worst.select("run_id", "max_frac_missing", v.cast("long").alias("n_rules_violated"), F.when(critical, "critical").when(m >= t.missing_warning, "warning").otherwise("ok").alias("severity"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("max_frac_missing") >= t.missing_critical, "missing values: critical"),
            F.when(F.col("n_rules_violated") > 0, "rule violations"),
            F.when((F.col("max_frac_missing") >= t.missing_warning) & (F.col("max_frac_missing") < t.missing_critical), "missing values: warning"),
        )
    )
    gate = F.when(F.col("severity") == "critical", "failed").when(F.col("severity") == "warning", "warning").otherwise("passed")
    return out.withColumn("trusted", F.col("severity") != "critical").withColumn("gate", gate).withColumn("reasons", reasons)


def trusted_runs(obs: DataFrame, report: DataFrame) -> DataFrame:
    """Observations of the runs that the gate lets through."""
    return obs.join(report.where("severity = 'critical'").select("run_id"), "run_id", "left_anti")
