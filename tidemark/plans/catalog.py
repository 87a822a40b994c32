"""The registered analytics queries over the sample tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.expressions import number, severity
from ..functions.stats import decision_interval, z_critical
from ..operators import causal, cluster, correlate, drift, profile, quality, series
from ..operators.obs import run_sizes, to_long, trajectory_band, varying
from ..sources import ingest
from ..sources.tables import written
from . import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
T = Thresholds()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, as sums differ in their last bits from engine to engine; -0 is 0."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- SQL of the derived run sets and shared steps -------------------------------------------------
_ORDER = ", ".join(derive.R1_ORDER)
R1W = f"r1w as (select cast(l_suppkey % 8 as varchar) as run_id, row_number() over (partition by l_suppkey % 8 order by {_ORDER}) - 1 as seq, {', '.join(derive.R1_VARIABLES)} from lineitem)"
R1 = R1W + ", obs as (" + " union all ".join(f"select run_id, seq as sample, seq, '{v}' as variable, {i} as var_pos, {v} as value from r1w" for i, v in enumerate(derive.R1_VARIABLES)) + ")"
R2 = """ev as (select cast(date_trunc('day', ts) as date) as day, cast(extract(hour from ts) as bigint) as hour, event_type, value from events),
kinds as (select event_type, row_number() over (order by event_type) - 1 as var_pos from (select distinct event_type from ev where event_type is not null)),
obs as (select strftime(d.day, '%Y-%m-%d') as run_id, h.hour as sample, h.hour as seq, k.event_type as variable, k.var_pos, m.value from (select distinct day from ev) d
cross join (select unnest(range(0, 24)) as hour) h cross join kinds k
left join (select day, hour, event_type, avg(value) as value from ev group by all) m on m.day = d.day and m.hour = h.hour and m.event_type = k.event_type)"""
SIZES = """lagged as (select *, lag(value) over (partition by run_id, variable order by seq) as before from obs where value is not null),
rho as (select run_id, variable, var_pos, count(*) as n, avg(value) as mean, stddev_samp(value) as sd, covar_pop(before, case when before is not null then value end) as c,
  stddev_pop(before) as sx, stddev_pop(case when before is not null then value end) as sy from lagged group by all),
rhos as (select run_id, variable, var_pos, n, mean, sd, case when n < 4 or sx < 1e-12 or sy < 1e-12 then 0.0 else greatest(-0.999, least(0.999, coalesce(c / nullif(sx * sy, 0), 0))) end as rho1 from rho),
sizes as (select *, case when n < 4 then greatest(n, 1.0) else least(greatest(n * (1 - rho1) / (1 + rho1), 2.0), n) end as ess from rhos)"""
BASE = """base as (select p.variable, p.pooled_mean, p.pooled_std, p.pooled_n, s.pooled_ess, s.mean_rho1 from
  (select variable, avg(value) as pooled_mean, stddev_samp(value) as pooled_std, count(*) as pooled_n from obs where value is not null group by variable) p
  join (select variable, sum(ess) as pooled_ess, sum(rho1 * n) / sum(n) as mean_rho1 from sizes group by variable) s using (variable))"""
H4, Z4 = decision_interval(T.arl0, 4, T.shift / 2), z_critical(T.stat_alpha, 4)
SHIFT = f"""shifts as (select s.run_id, s.variable, s.var_pos, case when b.pooled_std > 1e-12 and s.ess > 1 then (s.mean - b.pooled_mean) / (b.pooled_std / sqrt(s.ess)) else 0.0 end as z_score from sizes s join base b using (variable))"""
CHARTS = """zs as (select o.*, coalesce((value - pooled_mean) / nullif(pooled_std, 0), 0) as z from obs o join base using (variable)),
sums as (select *, sum(z - 0.5) over w as up, sum(z + 0.5) over w as down from zs window w as (partition by run_id, variable order by seq rows between unbounded preceding and current row)),
charts as (select *, up - least(0.0, min(up) over w) as c_pos, down - greatest(0.0, max(down) over w) as c_neg from sums window w as (partition by run_id, variable order by seq rows between unbounded preceding and current row))"""


def onset_sql(h: float) -> str:
    return f"""found as (select run_id, variable, var_pos, min(case when c_pos > {h!r} or c_neg < {-h!r} then seq end) as onset,
  arg_min(case when c_neg < {-h!r} then 'decrease' else 'increase' end, case when c_pos > {h!r} or c_neg < {-h!r} then seq end) as side, max(greatest(c_pos, -c_neg)) as peak from charts group by all)"""


PAIRS_R1 = """pooled as (select a.variable as var_a, b.variable as var_b, corr(a.value, b.value) as r0 from obs a join obs b on a.run_id = b.run_id and a.seq = b.seq and a.var_pos < b.var_pos group by all),
own as (select a.run_id, a.variable as var_a, b.variable as var_b, corr(a.value, b.value) as r from obs a join obs b on a.run_id = b.run_id and a.seq = b.seq and a.var_pos < b.var_pos group by all)"""
FISHER = f"""pairs as (select o.run_id, o.var_a, o.var_b, o.r, p.r0, sa.n as n_run, ba.pooled_n as n0, sa.rho1 * sb.rho1 as q1, ba.mean_rho1 * bb.mean_rho1 as q0
  from own o join pooled p using (var_a, var_b) join sizes sa on sa.run_id = o.run_id and sa.variable = o.var_a join sizes sb on sb.run_id = o.run_id and sb.variable = o.var_b
  join base ba on ba.variable = o.var_a join base bb on bb.variable = o.var_b),
sized as (select *, case when n_run < 4 then greatest(n_run, 1.0) else least(greatest(n_run * (1 - q1) / (1 + q1), 2.0), n_run) end as e1,
  case when n0 < 4 then greatest(n0, 1.0) else least(greatest(n0 * (1 - q0) / (1 + q0), 2.0), n0) end as e0 from pairs),
tested as (select run_id, var_a, var_b, r, r0, case when e1 > 3 and e0 > 3 then (atanh(greatest(-0.9999, least(0.9999, r))) - atanh(greatest(-0.9999, least(0.9999, r0)))) / sqrt(1 / (e1 - 3) + 1 / (e0 - 3)) end as z_stat from sized)"""
R3W = "vecs as (select cast(label as varchar) as run_id, vec_id, embedding from embeddings), obs as (select run_id, vec_id as seq, printf('d%02d', i - 1) as variable, i - 1 as var_pos, cast(embedding[i] as double) as value from vecs, (select unnest(range(1, 65)) as i))"
PAIRS_R3 = "pooled as (select a.variable as var_a, b.variable as var_b, corr(a.value, b.value) as r, count(*) as n_pair from obs a join obs b on a.run_id = b.run_id and a.seq = b.seq and a.var_pos < b.var_pos group by all)"
WITH = "with "


def r1(spark, d):
    return derive.r1(spark, d)


def r1_parts(spark, d, kept: bool = False):
    """Observations, sizes (written, as the baseline and the tests read them) and baseline; with ``kept``
    the observations are written too, by parts of series."""
    obs = derive.r1(spark, d)
    obs = series.laid_out(obs) if kept else obs
    sizes = written(drift.effective_sizes(obs), "sizes")
    return obs, sizes, drift.baseline(obs, sizes)


# --- sources and shape ----------------------------------------------------------------------------
@query(WITH + R1 + " select run_id, variable, cast(count(*) as bigint) as n, cast(min(seq) as bigint) as first_seq, cast(max(seq) as bigint) as last_seq, round(sum(value), 2) as total from obs group by all")
def scan_runs(spark, d):
    return r1(spark, d).groupBy("run_id", "variable").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.round(F.sum("value"), 2).alias("total"))


@query(WITH + R1 + " select run_id, count(distinct seq) as n_samples from obs group by run_id")
def run_sizes_r1(spark, d):
    return run_sizes(r1(spark, d))


@query("select * from (select 'o_orderkey' as col, count(distinct o_orderkey) as n from orders union all select 'o_orderstatus', count(distinct o_orderstatus) from orders union all select 'o_orderpriority', count(distinct o_orderpriority) from orders)")
def role_detection_counts(spark, d):
    rows = derive.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    facts, n = ingest.column_facts(rows)
    ingest.settle(rows, facts, {"o_orderkey": [n], "o_orderstatus": [20], "o_orderpriority": [5]})
    facts["o_orderstatus"]["distinct"] = ingest.distinct_exactly(rows, "o_orderstatus")
    return spark.createDataFrame([(c, f["distinct"]) for c, f in facts.items()], "col string, n long")


@query("select 'o_orderstatus' as label, o_orderstatus as value, count(*) as n, (select count(distinct o_orderstatus) from orders) as n_distinct from orders group by o_orderstatus union all select 'o_orderpriority', o_orderpriority, count(*), (select count(distinct o_orderpriority) from orders) from orders group by o_orderpriority")
def value_counts_labels(spark, d):
    return profile.label_summary(derive.table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("select count(*) as n, count(try_cast(o_orderpriority[1:1] as double)) as n_numeric, count(try_cast(o_orderstatus as double)) as n_status from orders")
def coercion_counts(spark, d):
    rows = derive.table(spark, d, "orders")
    return rows.agg(F.count("*").alias("n"), F.count(number(F.substring("o_orderpriority", 1, 1))).alias("n_numeric"), F.count(number("o_orderstatus")).alias("n_status"))


@query(WITH + R1 + " select variable, cast(var_pos as integer) as var_pos from obs group by all having stddev_samp(value) > 1e-12")
def varying_variables(spark, d):
    return varying(derive.r1_values(spark, d))


@query("select o_orderpriority as run_id, cast(count(*) as bigint) as n, round(avg(o_totalprice), 3) as mean_price from orders where o_orderpriority is not null group by 1")
def multi_run_split(spark, d):
    runs = ingest.split_roles(derive.table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), run_col="o_orderpriority", label_cols=[])
    return runs.obs.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean_price"))


# --- quality ----------------------------------------------------------------------------------------
@query(WITH + R2 + " select run_id, variable, count(*) as n, cast(sum(case when value is null then 1 else 0 end) as bigint) as n_missing, round(sum(case when value is null then 1 else 0 end) / count(*), 4) as frac_missing from obs group by all")
def missing_by_column(spark, d):
    return quality.missing(derive.r2(spark, d))


_VERDICT = "worst as (select run_id, max(f) as m from (select run_id, variable, round(sum(case when value is null then 1 else 0 end) / count(*), 4) as f from obs group by all) group by run_id)"


@query(WITH + R2 + ", " + _VERDICT + " select run_id, m as max_frac_missing, cast(0 as bigint) as n_rules_violated, case when m >= 0.5 then 'critical' when m >= 0.02 then 'warning' else 'ok' end as severity, m < 0.5 as trusted, case when m >= 0.5 then 'failed' when m >= 0.02 then 'warning' else 'passed' end as gate from worst")
def quality_verdict(spark, d):
    return quality.verdict(derive.r2(spark, d)).drop("reasons")


_RULES = "rules as (select * from (values ('r1', 'l_quantity', 1.0, 49.0), ('r2', 'l_discount', 0.0, 0.1), ('r3', 'l_tax', null, 0.07)) as x(rule_id, variable, lo, hi))"


@query(WITH + R1 + ", " + _RULES + " select run_id, rule_id, variable, count(*) as n_checked, cast(sum(case when value < lo or value > hi then 1 else 0 end) as bigint) as n_violations, round(sum(case when value < lo or value > hi then 1 else 0 end) / count(*), 4) as frac_violations from obs join rules using (variable) group by all having sum(case when value < lo or value > hi then 1 else 0 end) > 0")
def rule_violations(spark, d):
    return quality.rule_violations(derive.r1_values(spark, d), derive.rule_rows(spark))


@query(WITH + R2 + ", " + _VERDICT + " select run_id, count(*) as n from obs where run_id not in (select run_id from worst where m >= 0.5) group by run_id")
def gate_antijoin(spark, d):
    obs = derive.r2(spark, d)
    return quality.trusted_runs(obs, quality.verdict(obs)).groupBy("run_id").agg(F.count("*").alias("n"))


# --- profile ----------------------------------------------------------------------------------------
_BASIC = "count(*) as n, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, round(min(value + 0.0), 4) as min, round(max(value + 0.0), 4) as max, cast(sum(case when value is null then 1 else 0 end) as bigint) as n_missing"


@query(WITH + R1 + f" select run_id, variable, {_BASIC}, count(distinct value) as n_distinct from obs group by all")
def profile_basic(spark, d):
    return rounded(profile.per_run(derive.r1_values(spark, d)).select("run_id", "variable", "n", "mean", "std", "min", "max", "n_missing", "n_distinct"), 4)


@query(WITH + R1 + " select variable, round(skewness(value), 6) + 0.0 as skewness, round(kurtosis(value), 6) + 0.0 as kurtosis, cast(sum(case when value = 0 then 1 else 0 end) as bigint) as n_zeros, cast(sum(case when value < 0 then 1 else 0 end) as bigint) as n_negative, cast(0 as bigint) as n_infinite, count(*) * 8 as memory_size from obs group by variable")
def profile_moments(spark, d):
    return rounded(profile.pooled(derive.r1_values(spark, d)).select("variable", "skewness", "kurtosis", "n_zeros", "n_negative", "n_infinite", "memory_size"))


@query(WITH + R1 + f" select run_id, variable, {_BASIC}, cast(grouping(run_id) as integer) as is_pooled from obs group by grouping sets ((run_id, variable), (variable))")
def profile_grouping_sets(spark, d):
    return rounded(profile.both(derive.r1_values(spark, d)), 4)


@query(WITH + R2 + ", p as (select run_id, variable, count(*) as n, count(value) as k, count(distinct value) as u, sum(case when value = 0 then 1 else 0 end) as z from obs group by all) select alert, variable, count(*) as n_runs from (select 'missing' as alert, variable from p where (n - k) / n > 0.05 union all select 'constant', variable from p where u = 1 union all select 'unique', variable from p where u = k and k > 0 union all select 'zeros', variable from p where z / n > 0.5) group by all order by n_runs desc, alert, variable limit 15")
def alert_frequency(spark, d):
    return profile.alert_frequency(profile.alerts(profile.per_run(derive.r2(spark, d))))


@query(WITH + R1 + ", p as (select run_id, variable, avg(value) as mean, stddev_samp(value) as std, min(value + 0.0) as lo, max(value + 0.0) as hi from obs group by all) select variable, round(avg(mean), 6) as avg_mean, round(avg(std), 6) as avg_std, round(avg(lo), 6) as avg_min, round(avg(hi), 6) as avg_max from p group by variable")
def profile_across_runs(spark, d):
    return rounded(profile.across_runs(profile.per_run(derive.r1_values(spark, d))).select("variable", "avg_mean", "avg_std", "avg_min", "avg_max"), 6)


@query(WITH + R1 + ", p as (select run_id, variable, avg(value) as mean, stddev_samp(value) as std from obs group by all) select a.variable, round(abs(b.mean - a.mean) / (a.std + 1e-12), 6) as shift, round(b.std * b.std / (a.std * a.std + 1e-12), 6) as ratio, abs(b.mean - a.mean) / (a.std + 1e-12) > 3 or b.std * b.std / (a.std * a.std + 1e-12) > 2 or b.std * b.std / (a.std * a.std + 1e-12) < 0.5 as drifted from p a join p b using (variable) where a.run_id = '0' and b.run_id = '1'")
def run_compare(spark, d):
    return rounded(profile.compare(profile.per_run(derive.r1_values(spark, d)), "0", "1"))


@query(WITH + R1 + ", e as (select variable, min(value + 0.0) as lo, max(value + 0.0) as hi, count(*) as n from obs group by variable), w as (select *, least(50, greatest(10, n // 50)) as bins, case when hi > lo then (hi - lo) / least(50, greatest(10, n // 50)) else 1.0 end as width from e) select variable, cast(least(floor((value - lo) / width), bins - 1) as integer) as bin, count(*) as count, round(count(*) / (max(n) * max(width)), 6) as density from obs join w using (variable) group by 1, 2")
def histogram_pooled(spark, d):
    return rounded(profile.histogram(derive.r1_values(spark, d)))


@query(WITH + R2 + ", e as (select variable, min(value) as lo, max(value) as hi, stddev_samp(value) as sd, count(*) as n from obs where value is not null group by variable), c as (select o.variable, least(floor((value - lo) / (hi - lo) * 4096), 4095) as cell, count(*) as w, avg(value) as x from obs o join e using (variable) where value is not null group by 1, 2), g as (select *, sd * pow(n, -0.2) as h, lo + (hi - lo) * point / 199 as place from e, (select unnest(range(0, 200)) as point)) select g.variable, cast(point as integer) as point, round(max(place), 5) as place, round(sum(w * exp(-0.5 * ((place - x) / h) * ((place - x) / h))) / max(n * h) / 2.5066282746310002, 6) as density from g join c using (variable) group by 1, 2")
def kde_grid(spark, d):
    return profile.kde(derive.r2(spark, d)).select("variable", "point", F.round("place", 5).alias("place"), F.round("density", 6).alias("density"))


@query(WITH + R1 + ", s as (select variable, min(last) as last from (select variable, run_id, max(seq) as last from obs group by all) group by variable) select variable, seq, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(median(value), 6) as median from obs join s using (variable) where seq <= last group by variable, seq")
def trajectory_bands(spark, d):
    return rounded(trajectory_band(r1(spark, d)), 6)


# --- drift ------------------------------------------------------------------------------------------
@query(WITH + R1 + ", " + SIZES + " select run_id, variable, n, round(rho1, 6) + 0.0 as rho1 from sizes")
def lag1_autocorr(spark, d):
    return rounded(drift.rho1(r1(spark, d)).select("run_id", "variable", "n", "rho1"))


@query(WITH + R2 + ", " + SIZES + " select run_id, variable, n, round(rho1, 6) + 0.0 as rho1, round(ess, 4) as ess from sizes")
def effective_sizes_gaps(spark, d):
    return drift.effective_sizes(derive.r2(spark, d)).select("run_id", "variable", "n", (F.round("rho1", 6) + 0.0).alias("rho1"), F.round("ess", 4).alias("ess"))


@query(WITH + R1 + ", " + SIZES + " select run_id, variable, round(ess, 4) as ess from sizes")
def effective_sample_size(spark, d):
    return rounded(drift.effective_sizes(r1(spark, d)).select("run_id", "variable", "ess"), 4)


@query(WITH + R1 + ", " + SIZES + ", " + BASE + " select variable, round(pooled_mean, 4) as pooled_mean, round(pooled_std, 4) as pooled_std, pooled_n, round(pooled_ess, 3) as pooled_ess, round(mean_rho1, 6) + 0.0 as mean_rho1 from base")
def baseline_pooled(spark, d):
    b = r1_parts(spark, d)[2]
    return b.select("variable", F.round("pooled_mean", 4).alias("pooled_mean"), F.round("pooled_std", 4).alias("pooled_std"), "pooled_n", F.round("pooled_ess", 3).alias("pooled_ess"), (F.round("mean_rho1", 6) + 0.0).alias("mean_rho1"))


@query(WITH + R1 + ", " + SIZES + ", " + BASE + ", " + SHIFT + f" select run_id, variable, round(z_score, 6) + 0.0 as z_score, abs(z_score) > {Z4!r} as mean_drifted from shifts")
def mean_shift_z(spark, d):
    _, sizes, base = r1_parts(spark, d)
    return rounded(drift.mean_shift(sizes, base, 4, p_values=False).drop("var_pos"))


@query(WITH + R1 + ", " + SIZES + ", " + BASE + " select run_id, variable, round(case when pooled_std > 1e-6 and ess > 2 and pooled_ess > 2 then sd * sd / (pooled_std * pooled_std) end, 6) as ratio, round(ess - 1, 3) as df from sizes join base using (variable)")
def variance_ratio(spark, d):
    _, sizes, base = r1_parts(spark, d)
    return drift.variance_ratio(sizes, base).select("run_id", "variable", F.round("ratio", 6).alias("ratio"), F.round("df", 3).alias("df"))


@query(WITH + R1 + ", " + SIZES + ", " + BASE + ", " + CHARTS + ", " + onset_sql(H4) + " select run_id, variable, onset, case when onset is not null then side end as direction from found")
def cusum_onset(spark, d):
    obs, _, base = r1_parts(spark, d, kept=True)
    return drift.onsets(drift.cusum(obs, base), H4).select("run_id", "variable", "onset", "direction")


@query(WITH + R1 + ", " + SIZES + ", " + BASE + ", " + CHARTS + ", " + onset_sql(H4) + " select run_id, variable, round(peak, 4) as peak from found")
def cusum_peak(spark, d):
    obs, _, base = r1_parts(spark, d, kept=True)
    return rounded(drift.onsets(drift.cusum(obs, base), H4).select("run_id", "variable", "peak"), 4)


@query(WITH + R1 + ", " + SIZES + ", " + BASE + ", " + CHARTS + ", " + onset_sql(2.0) + " select run_id, cast(count(*) as integer) as n_detected, cast(min(onset) as bigint) as earliest_onset, arg_min(variable, onset * 10 + var_pos) as earliest_variable, string_agg(variable, '>' order by onset, var_pos) as propagation from found where onset is not null group by run_id")
def propagation_order(spark, d):
    obs, _, base = r1_parts(spark, d, kept=True)
    return drift.propagation(drift.onsets(drift.cusum(obs, base), 2.0)).withColumn("propagation", F.array_join("propagation", ">"))


_SUMMARY = (
    WITH + R1 + ", " + SIZES + ", " + BASE + ", " + SHIFT + ", " + CHARTS + ", " + onset_sql(H4) + f""",
means as (select run_id, sum(case when abs(z_score) > {Z4!r} then 1 else 0 end) as n_mean_drifted, max(abs(z_score)) as max_abs_z from shifts group by run_id),
peaks as (select run_id, max(peak) as peak, count(onset) as n_detected, min(onset) as earliest_onset, arg_min(case when onset is not null then variable end, onset * 10 + var_pos) as earliest_variable from found group by run_id)
select run_id, cast(n_mean_drifted as bigint) as n_mean_drifted, round(max_abs_z, 6) as max_abs_z, n_detected, cast(earliest_onset as bigint) as earliest_onset, earliest_variable, round(peak, 6) as peak,
round(n_mean_drifted / 4, 4) as frac_mean_drifted, round(n_detected / 4, 4) as frac_onset_detected from means join peaks using (run_id)"""
)


@query(_SUMMARY)
def run_drift_summary(spark, d):
    return rounded(drift.drift_summary(r1(spark, d), n_vars=4))


@query("select case when p < 15 then 'good' when p < 35 then 'warning' when p < 60 then 'serious' else 'critical' end as band, count(*) as n, round(sum(p / 100), 2) as total from (select l_orderkey % 101 as p from lineitem) group by 1")
def severity_band(spark, d):
    scores = derive.table(spark, d, "lineitem").select((F.col("l_orderkey") % 101 / 100).alias("score"))
    return scores.groupBy(severity("score").alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query(WITH + R2 + ", " + SIZES + ", " + BASE + ", " + CHARTS + ", " + onset_sql(3.0) + ", first as (select *, row_number() over (partition by run_id order by onset, var_pos) as k from found where onset is not null) select o.run_id, o.variable, o.seq, round(o.value, 6) as value, f.onset, round(pooled_mean - 2 * pooled_std, 6) as low, round(pooled_mean + 2 * pooled_std, 6) as high from obs o join first f on f.run_id = o.run_id and f.variable = o.variable and k <= 6 join base b on b.variable = o.variable")
def onset_traces(spark, d):
    obs = derive.r2(spark, d)
    base = drift.baseline(obs)
    return rounded(drift.traces(obs, base, drift.onsets(drift.cusum(obs, base), 3.0)))


# --- correlation ------------------------------------------------------------------------------------
def r3_pearson(spark, d, by_run=False):
    return correlate.gram_pearson(derive.r3_arrays(spark, d), derive.r3_names(), by_run)


@query(WITH + R3W + ", " + PAIRS_R3 + " select var_a, var_b, round(r, 6) + 0.0 as r, n_pair from pooled")
def pearson_pooled(spark, d):
    return rounded(r3_pearson(spark, d))


@query(WITH + R1 + ", " + PAIRS_R1 + " select run_id, var_a, var_b, round(r, 6) + 0.0 as r from own")
def pearson_per_run(spark, d):
    return rounded(correlate.gram_pearson(derive.r1_arrays(spark, d), derive.R1_VARIABLES, by_run=True).drop("n_pair"))


_RANKS = "ranked as (select run_id, seq, variable, var_pos, rank() over (partition by variable order by value) + (count(*) over (partition by variable, value) - 1) / 2.0 as value from obs where value is not null)"


@query(WITH + R1 + ", " + _RANKS + " select a.variable as var_a, b.variable as var_b, round(corr(a.value, b.value), 6) + 0.0 as r from ranked a join ranked b on a.run_id = b.run_id and a.seq = b.seq and a.var_pos < b.var_pos group by all")
def spearman_pooled(spark, d):
    return rounded(correlate.spearman(derive.r1_values(spark, d)).select("var_a", "var_b", "r"))


@query(WITH + R2 + ", both_ as (select a.variable as va, b.variable as vb, a.value as x, b.value as y from obs a join obs b on a.run_id = b.run_id and a.seq = b.seq and a.var_pos < b.var_pos where a.value is not null and b.value is not null), rk as (select va, vb, rank() over (partition by va, vb order by x) + (count(*) over (partition by va, vb, x) - 1) / 2.0 as x, rank() over (partition by va, vb order by y) + (count(*) over (partition by va, vb, y) - 1) / 2.0 as y from both_) select va as var_a, vb as var_b, round(corr(x, y), 6) + 0.0 as r, count(*) as n_pair from rk group by all")
def spearman_gaps(spark, d):
    return rounded(correlate.spearman(derive.r2(spark, d)))


def r1_pairs(spark, d):
    _, sizes, base = r1_parts(spark, d)
    grams = written(correlate.gram_table(derive.r1_arrays(spark, d), derive.R1_VARIABLES, by_run=True), "gram")
    return correlate.pair_drift(correlate.pearson_of(grams), correlate.pearson_of(correlate.gram_pearson_parts(grams)), sizes, base)


@query(WITH + R1 + ", " + SIZES + ", " + BASE + ", " + PAIRS_R1 + ", " + FISHER + f" select run_id, var_a, var_b, round(r, 6) + 0.0 as r, round(r0, 6) + 0.0 as r0, round(z_stat, 4) + 0.0 as z_stat, coalesce(abs(z_stat) > {z_critical(T.corr_alpha)!r}, false) as drifted from tested")
def fisher_z_pairs(spark, d):
    return r1_pairs(spark, d).select("run_id", "var_a", "var_b", (F.round("r", 6) + 0.0).alias("r"), (F.round("r0", 6) + 0.0).alias("r0"), (F.round("z_stat", 4) + 0.0).alias("z_stat"), "drifted")


@query(WITH + R1 + ", " + PAIRS_R1 + " select run_id, round(sqrt(2 * sum((r - r0) * (r - r0))), 6) as frobenius, count(*) as n_pairs, round(sqrt(2 * sum((r - r0) * (r - r0))) / count(*), 6) as per_pair from own join pooled using (var_a, var_b) group by run_id")
def frobenius_drift(spark, d):
    return rounded(correlate.frobenius(r1_pairs(spark, d)))


@query(WITH + R1 + ", " + SIZES + ", " + BASE + ", " + PAIRS_R1 + ", " + FISHER + ", k as (select *, row_number() over (partition by run_id order by round(abs(z_stat), 4) desc, var_a, var_b) as rank from tested where z_stat is not null) select run_id, var_a, var_b, cast(rank as integer) as rank from k where rank <= 20")
def top_drifted_pairs_all(spark, d):
    return correlate.top_drifted(r1_pairs(spark, d)).select("run_id", "var_a", "var_b", "rank")


_TWO = "two as (select var_a, var_b, r from pooled union all select var_b, var_a, r from pooled)"


@query(WITH + R3W + ", " + PAIRS_R3 + " select var_a, var_b, round(r, 6) as r from pooled order by abs(pooled.r) desc, var_a, var_b limit 15")
def top_pairs(spark, d):
    return rounded(correlate.strongest_pairs(r3_pearson(spark, d)).select("var_a", "var_b", "r"))


@query(WITH + R3W + ", " + PAIRS_R3 + ", " + _TWO + ", k as (select *, row_number() over (partition by var_a order by abs(r) desc, var_b) as rank from two) select var_a, var_b, round(r, 6) as r, cast(rank as integer) as rank from k where rank <= 8")
def top_partners(spark, d):
    return rounded(correlate.top_partners(r3_pearson(spark, d)))


@query(WITH + R3W + ", " + PAIRS_R3 + ", " + _TWO + " select var_a as variable, round(sum(abs(r)) / 64, 6) as mean_abs_r from two group by 1 order by sum(abs(r)) / 64 desc, 1 limit 30")
def heatmap_top_n(spark, d):
    return rounded(correlate.heatmap_variables(r3_pearson(spark, d), 64))


@query(WITH + R3W + ", " + PAIRS_R3 + " select var_a, var_b, round(sqrt(greatest(0, 2 * (1 - r))), 6) as distance from pooled")
def corr_distance(spark, d):
    return rounded(correlate.distances(r3_pearson(spark, d)))


@query(None)
def clusters_upgma(spark, d):
    return cluster.clusters(r3_pearson(spark, d))


# --- causal links -----------------------------------------------------------------------------------
@query(None)
def pcmci_links(spark, d):
    return causal.links(derive.r2(spark, d), T)


@query(None)
def pcmci_52_variables(spark, d):
    """52 variables at lags up to 10 in every run."""
    return causal.links(derive.r3_series(spark, d), Thresholds(tau_max=10, pc_alpha=0.001, link_alpha=1e-4))


R4 = derive.r4_sql()
LINKS = R4 + ", " + derive.r4_links_sql()
FREQ = "freq as (select src, tgt, tau, count(*) as n_runs, avg(val) as mean_val, avg(pval) as mean_pval from links group by all)"
RUNS = "(select count(distinct run_id) from r4w)"


def frequency(spark, d, wide=None):
    found, n_runs = derive.r4_links(spark, d, wide)
    return causal.link_frequency(found), n_runs


@query(WITH + LINKS + " select run_id, src, tgt, tau, round(val, 6) as val, pval from links")
def planted_links(spark, d):
    """PCMCI over R4 finds what was planted, and nothing else."""
    return rounded(derive.r4_links(spark, d)[0])


_CENTRED = "r4c as (select run_id, seq, a, b, c, d, e, " + ", ".join(f"lag({v}, {k}) over (partition by run_id order by seq) as {v}{k}" for v, k in (("a", 1), ("a", 3), ("b", 2), ("d", 1), ("d", 2))) + " from (select run_id, seq, " + ", ".join(f"{v} - avg({v}) over (partition by run_id) as {v}" for v in derive.R4_VARIABLES) + " from r4w))"


@query(WITH + R4 + ", " + _CENTRED + ", " + derive.r4_links_sql("", "r4c") + " select src, tgt, tau, round(val, 6) as val, pval from links")
def planted_pooled_links(spark, d):
    """PCMCI over all runs as one series, masked at their starts."""
    return rounded(causal.pooled_links_of(*derive.r4_arrays(derive.r4_written(spark, d)), derive.STRICT))


@query(WITH + LINKS + ", " + FREQ + " select src, tgt, tau, n_runs, round(mean_val, 6) as mean_val, round(mean_pval, 6) as mean_pval from freq")
def link_frequency(spark, d):
    return rounded(frequency(spark, d)[0])


@query(WITH + LINKS + " select src, tgt, tau, count(*) as freq, round(avg(abs(val)), 6) as mean_abs, round(stddev_pop(abs(val)), 6) as sd_abs from links group by all")
def lag_profile(spark, d):
    return rounded(causal.lag_profile(derive.r4_links(spark, d)[0]))


@query(WITH + LINKS + ", " + FREQ + f" select src, tgt, tau, n_runs, n_runs >= {RUNS} as consensus from freq")
def consensus_links(spark, d):
    return causal.consensus(*frequency(spark, d)).select("src", "tgt", "tau", "n_runs", "consensus")


@query(WITH + LINKS + ", " + FREQ + f" select count(*) as n_links, cast(sum(case when n_runs >= {RUNS} then 1 else 0 end) as bigint) as n_consensus, cast(sum(case when n_runs < {RUNS} then 1 else 0 end) as bigint) as n_other from freq")
def causal_summary(spark, d):
    return causal.summary(causal.consensus(*frequency(spark, d)))


@query(WITH + LINKS + ", " + FREQ + ", o as (select src as variable, count(*) as n, string_agg(distinct tgt, ',' order by tgt) as p from freq group by 1), i as (select tgt as variable, count(*) as n, string_agg(distinct src, ',' order by src) as p from freq group by 1) select coalesce(o.variable, i.variable) as variable, coalesce(o.n, 0) as out_degree, coalesce(i.n, 0) as in_degree, coalesce(o.p, '') as targets, coalesce(i.p, '') as sources from o full join i on o.variable = i.variable")
def causal_degree(spark, d):
    return causal.degrees(frequency(spark, d)[0]).withColumn("targets", F.array_join("targets", ",")).withColumn("sources", F.array_join("sources", ","))


@query(WITH + LINKS + ", " + FREQ + f", k as (select * from freq where n_runs >= {RUNS} and abs(mean_val) >= 0.5) select k.src, k.tgt, k.tau, round(k.mean_val, 6) as mean_val, case when k.tau = 0 and b.src is not null then 'o-o' else '-->' end as kind from k left join (select * from k where tau = 0) b on b.src = k.tgt and b.tgt = k.src")
def consensus_graph(spark, d):
    return rounded(causal.consensus_graph(*frequency(spark, d)))


@query(WITH + LINKS + ", " + FREQ + f" select src, tgt, tau, n_runs from freq where n_runs / {RUNS} >= 0.5 and src <> tgt")
def majority_links(spark, d):
    return causal.majority(*frequency(spark, d)).select("src", "tgt", "tau", "n_runs")


@query(WITH + LINKS + ", " + FREQ + " select src as variable, tau, round(mean_val, 6) as mean_val from (select *, row_number() over (partition by src order by abs(mean_val) desc, tau) as k from freq where src = tgt) where k = 1")
def strongest_self_links(spark, d):
    return rounded(causal.strongest_self(frequency(spark, d)[0]))


@query(WITH + LINKS + ", " + FREQ + ", chosen as (select unnest(['a', 'b', 'c', 'd', 'e']) as variable, unnest([avg(a), avg(b), avg(c), avg(d), avg(e)]) as m from r4w) select src, tgt, tau, n_runs, round(mean_val, 6) as mean_val, round(mean_pval, 6) as mean_pval from freq where src in (select variable from chosen where m < 100) and tgt in (select variable from chosen where m < 100)")
def root_cause_evidence(spark, d):
    """Links between the variables whose mean is under 100."""
    wide = derive.r4_written(spark, d)
    low = to_long(wide.withColumn("sample", F.col("seq")), derive.R4_VARIABLES).groupBy("variable").agg(F.avg("value").alias("m")).where("m < 100")
    return rounded(causal.implicated(frequency(spark, d, wide)[0], written(low, "low")))


# The same operators over the links found in R2, which are not planted, so that SQL has no twin.
def r2_frequency(spark, d):
    found, n_runs = derive.r2_links(spark, d)
    return causal.link_frequency(found), n_runs


@query(None)
def link_frequency_r2(spark, d):
    return rounded(r2_frequency(spark, d)[0])


@query(None)
def lag_profile_r2(spark, d):
    return rounded(causal.lag_profile(derive.r2_links(spark, d)[0]))


@query(None)
def consensus_links_r2(spark, d):
    return causal.consensus(*r2_frequency(spark, d), T.consensus).select("src", "tgt", "tau", "n_runs", "consensus")


@query(None)
def causal_summary_r2(spark, d):
    return causal.consensus(*r2_frequency(spark, d), T.consensus).agg(F.count("*").alias("n_links"), F.count_if("consensus").alias("n_consensus"), F.count_if(~F.col("consensus")).alias("n_other"))


@query(None)
def causal_degree_r2(spark, d):
    return causal.degrees(r2_frequency(spark, d)[0]).withColumn("targets", F.array_join("targets", ",")).withColumn("sources", F.array_join("sources", ","))


@query(None)
def consensus_graph_r2(spark, d):
    return rounded(causal.consensus_graph(*r2_frequency(spark, d)))


@query(None)
def majority_links_r2(spark, d):
    return causal.majority(*r2_frequency(spark, d)).select("src", "tgt", "tau", "n_runs")


@query(None)
def strongest_self_links_r2(spark, d):
    return rounded(causal.strongest_self(r2_frequency(spark, d)[0]))


@query(None)
def root_cause_evidence_r2(spark, d):
    obs = derive.r2(spark, d)
    found = drift.onsets(drift.cusum(obs, drift.baseline(obs), T), decision_interval(T.arl0, drift.variable_count(obs), T.shift / 2))
    return rounded(causal.implicated_by_run(r2_frequency(spark, d)[0], found))


from . import scores_catalog  # noqa: E402, F401, I001 (these register their queries here)
from . import files_catalog  # noqa: E402, F401
