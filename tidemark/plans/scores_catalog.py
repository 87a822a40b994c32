"""Queries of scores, p-values and derived figures, with SQL twins that integrate the distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import decision_interval, siegmund_arl, z_critical
from ..operators import causal, correlate, drift, profile
from . import derive
from .catalog import BASE, CHARTS, FREQ, LINKS, PAIRS_R1, R1, R2, SHIFT, SIZES, T, WITH, onset_sql, query, r1, r1_parts, rounded

ROWS = "rowcounts as (select run_id, variable, count(*) as n_rows from obs group by all)"
RATIO = "vr as (select run_id, variable, var_pos, case when pooled_std > 1e-6 and ess > 2 and pooled_ess > 2 then sd * sd / (pooled_std * pooled_std) end as ratio, ess - 1 as d1, pooled_ess - 1 as d2 from sizes join base using (variable))"
#: Simpson's rule over the logarithm of F, whose density has its mode at 0, up to far beyond its spread.
_G = "d1 / 2 * ({w}) - (d1 + d2) / 2 * (ln(1 + d1 / d2 * exp({w})) - ln(1 + d1 / d2))"
_SIMPSON = "case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end"
F_TEST = f"""wide as (select *, ln(ratio) as w1, 14 * sqrt(2 / d1 + 2 / d2) + 60 / d1 + 60 / d2 as wd from vr where ratio > 0),
grid as (select unnest(range(0, 2001)) as k),
areas as (select run_id, variable, sum({_SIMPSON} * exp({_G.format(w="-wd + (w1 + wd) * k / 2000")})) * (max(w1) + max(wd)) as below, sum({_SIMPSON} * exp({_G.format(w="-wd + 2 * wd * k / 2000")})) * 2 * max(wd) as total from wide cross join grid group by all),
ptest as (select vr.run_id, vr.variable, vr.var_pos, ratio, d1, d2, case when ratio = 0 then 0.0 when ratio is null then 1.0 else least(1.0, 2 * least(below / total, 1 - below / total)) end as p_value from vr left join areas using (run_id, variable))"""
NORMAL = f"1 - sqrt(2 / pi()) * (select sum({_SIMPSON} * exp(-0.5 * (abs(z_score) * k / 2000) * (abs(z_score) * k / 2000))) * abs(z_score) / 6000 from grid)"
#: A run's rows count whether missing or not, and a gap makes its lag-1 correlation 0.
FISHER_GAPS = """pairs as (select o.run_id, o.var_a, o.var_b, o.r, p.r0, ra.n_rows as n_run, ba.pooled_n as n0,
  case when sa.n = ra.n_rows and sb.n = rb.n_rows then sa.rho1 * sb.rho1 else 0.0 end as q1, ba.mean_rho1 * bb.mean_rho1 as q0
  from own o join pooled p using (var_a, var_b) join sizes sa on sa.run_id = o.run_id and sa.variable = o.var_a join sizes sb on sb.run_id = o.run_id and sb.variable = o.var_b
  join rowcounts ra on ra.run_id = o.run_id and ra.variable = o.var_a join rowcounts rb on rb.run_id = o.run_id and rb.variable = o.var_b
  join base ba on ba.variable = o.var_a join base bb on bb.variable = o.var_b where o.r is not null and not isnan(o.r) and p.r0 is not null),
sized as (select *, case when n_run < 4 then greatest(n_run, 1.0) else least(greatest(n_run * (1 - q1) / (1 + q1), 2.0), n_run) end as e1,
  case when n0 < 4 then greatest(n0, 1.0) else least(greatest(n0 * (1 - q0) / (1 + q0), 2.0), n0) end as e0 from pairs),
tested as (select run_id, var_a, var_b, r, r0, case when e1 > 3 and e0 > 3 then (atanh(greatest(-0.9999, least(0.9999, r))) - atanh(greatest(-0.9999, least(0.9999, r0)))) / sqrt(1 / (e1 - 3) + 1 / (e0 - 3)) end as z_stat from sized)"""
PAIRS = PAIRS_R1.replace("a.var_pos < b.var_pos", "a.var_pos < b.var_pos where a.value is not null and b.value is not null")


def summary_sql(runs: str, n_vars: int) -> str:
    """CTEs up to ``summary``: every run with its gate, shares and score."""
    h, z = decision_interval(T.arl0, n_vars, T.shift / 2), z_critical(T.stat_alpha, n_vars)
    return (
        WITH + runs + ", " + SIZES + ", " + BASE + ", " + SHIFT + ", " + CHARTS + ", " + onset_sql(h) + ", " + ROWS + ", " + RATIO + ", " + F_TEST + ", " + PAIRS + ", " + FISHER_GAPS + f""",
worst as (select run_id, max(f) as m from (select run_id, variable, round(sum(case when value is null then 1 else 0 end) / count(*), 4) as f from obs group by all) group by run_id),
gates as (select run_id, case when m >= 0.5 then 'critical' when m >= 0.02 then 'warning' else 'ok' end as quality, case when m >= 0.5 then 'failed' when m >= 0.02 then 'warning' else 'passed' end as gate from worst),
sm as (select run_id, round(sum(case when abs(z_score) > {z!r} then 1 else 0 end) / {n_vars}, 4) as x from shifts group by 1),
sv as (select run_id, round(sum(case when p_value < {T.var_alpha / n_vars!r} then 1 else 0 end) / {n_vars}, 4) as x from ptest group by 1),
sc as (select run_id, round(sum(case when coalesce(abs(z_stat) > {z_critical(T.corr_alpha)!r}, false) then 1 else 0 end) / count(*), 4) as x, sqrt(2 * sum((r - r0) * (r - r0))) as fro from tested group by 1),
so as (select run_id, round(count(onset) / {n_vars}, 4) as x, min(onset) as earliest, arg_min(case when onset is not null then variable end, onset * 100 + var_pos) as first_variable, string_agg(case when onset is not null then variable end, '>' order by onset, var_pos) as route from found group by 1),
shares as (select g.*, case when gate = 'failed' then 0.0 else coalesce(sm.x, 0.0) end as frac_mean_drifted, case when gate = 'failed' then 0.0 else coalesce(sv.x, 0.0) end as frac_var_drifted, case when gate = 'failed' then 0.0 else coalesce(sc.x, 0.0) end as frac_corr_drifted,
  case when gate = 'failed' then 0.0 else coalesce(so.x, 0.0) end as frac_onset_detected, case when gate = 'failed' then 0.0 else coalesce(sc.fro, 0.0) end as fro, case when gate <> 'failed' then so.earliest end as earliest_onset, case when gate <> 'failed' then so.first_variable end as earliest_variable, case when gate <> 'failed' then so.route end as propagation
  from gates g left join sm using (run_id) left join sv using (run_id) left join sc using (run_id) left join so using (run_id)),
summary as (select *, round(0.3 * frac_mean_drifted + 0.15 * frac_var_drifted + 0.25 * frac_corr_drifted + 0.3 * frac_onset_detected, 4) as anomaly_score from shares)"""
    )


_RANKED = """ select run_id, gate, quality, frac_mean_drifted, frac_var_drifted, frac_corr_drifted, frac_onset_detected, round(fro, 6) as corr_frobenius, cast(earliest_onset as bigint) as earliest_onset, earliest_variable, propagation, anomaly_score,
case when anomaly_score < 0.15 then 'good' when anomaly_score < 0.35 then 'warning' when anomaly_score < 0.6 then 'serious' else 'critical' end as band, anomaly_score >= 0.35 as needs_root_cause from summary"""


def r1_arrays(spark, d):
    return derive.r1_arrays(spark, d), derive.R1_VARIABLES


def _shown(df):
    return rounded(df.withColumn("propagation", F.array_join("propagation", ">")))


@query(summary_sql(R1, 4) + _RANKED)
def anomaly_ranking(spark, d):
    return _shown(drift.run_summary(r1(spark, d), arrays=r1_arrays(spark, d))).orderBy(F.desc("anomaly_score"), "run_id")


@query(summary_sql(R2, 5) + _RANKED)
def gated_summary(spark, d):
    return _shown(drift.run_summary(derive.r2(spark, d)))


_PARTS = ["frac_mean_drifted", "frac_var_drifted", "frac_corr_drifted", "frac_onset_detected"]


@query(summary_sql(R1, 4) + " " + " union all ".join(f"select run_id, '{p}' as part, {p} as share from summary" for p in _PARTS))
def drift_breakdown_all(spark, d):
    """All four perspectives; ``drift_breakdown`` has the two that need no distribution."""
    return drift.run_summary(r1(spark, d), arrays=r1_arrays(spark, d)).select("run_id", F.expr(f"stack(4, {', '.join(f"'{p}', {p}" for p in _PARTS)}) as (part, share)"))


@query(WITH + R1 + ", " + SIZES + ", " + BASE + ", " + RATIO + ", " + F_TEST + f" select run_id, variable, round(p_value, 5) + 0.0 as p_value, p_value < {T.var_alpha / 4!r} as var_drifted from ptest")
def f_test_pvalues(spark, d):
    _, sizes, base = r1_parts(spark, d)
    return rounded(drift.variance_shift(sizes, base, 4).select("run_id", "variable", "p_value", "var_drifted"), 5)


@query(WITH + R1 + ", " + SIZES + ", " + BASE + ", " + SHIFT + f", grid as (select unnest(range(0, 2001)) as k) select run_id, variable, round({NORMAL}, 6) + 0.0 as p_value from shifts")
def normal_pvalues(spark, d):
    _, sizes, base = r1_parts(spark, d)
    return rounded(drift.mean_shift(sizes, base, 4).select("run_id", "variable", "p_value"))


@query(WITH + R1 + ", " + SIZES + ", " + BASE + ", " + SHIFT + ", k as (select *, row_number() over (partition by run_id order by abs(z_score) desc, var_pos) as rank from shifts) select run_id, variable, round(z_score, 6) + 0.0 as z_score, cast(rank as integer) as rank, case when abs(z_score) >= 3 then 'critical' else 'normal' end as colour from k where rank <= 10")
def z_bars(spark, d):
    _, sizes, base = r1_parts(spark, d)
    return rounded(drift.z_bars(drift.mean_shift(sizes, base, 4, p_values=False)))


@query(WITH + R2 + ", " + SIZES + ", " + BASE + ", " + ROWS + ", " + PAIRS + ", " + FISHER_GAPS + f" select run_id, var_a, var_b, round(r, 6) + 0.0 as r, round(z_stat, 4) + 0.0 as z_stat, coalesce(abs(z_stat) > {z_critical(T.corr_alpha)!r}, false) as drifted from tested")
def fisher_z_gaps(spark, d):
    """Pairs of a run set with missing values, whose effective sizes count rows and not values."""
    obs = derive.r2(spark, d)
    sizes = drift.effective_sizes(obs)
    pairs = correlate.pair_drift(correlate.pearson(obs, by_run=True), correlate.pearson(obs), sizes, drift.baseline(obs, sizes))
    return pairs.select("run_id", "var_a", "var_b", (F.round("r", 6) + 0.0).alias("r"), (F.round("z_stat", 4) + 0.0).alias("z_stat"), "drifted")


@query(WITH + R2 + """, points as (select a.variable as va, b.variable as vb, a.value as x, b.value as y, row_number() over (partition by a.variable, b.variable order by a.run_id, a.seq) as i from obs a join obs b on a.run_id = b.run_id and a.seq = b.seq and a.var_pos < b.var_pos where a.value is not null and b.value is not null),
s as (select p.va, p.vb, sum(sign(p.x - q.x) * sign(p.y - q.y)) as c, count(*) as n0, sum(case when p.x = q.x then 1 else 0 end) as tx, sum(case when p.y = q.y then 1 else 0 end) as ty from points p join points q on p.va = q.va and p.vb = q.vb and p.i < q.i group by all)
select va as var_a, vb as var_b, round(c / sqrt(cast(n0 - tx as double) * cast(n0 - ty as double)), 6) + 0.0 as tau, (select count(*) from points where points.va = s.va and points.vb = s.vb) as n_pair from s""")
def kendall_tau(spark, d):
    return rounded(correlate.kendall(derive.r2(spark, d)))


@query(WITH + R2 + ", p as (select run_id, variable, count(*) as n, count(value) as k, count(distinct value) as u, sum(case when value = 0 then 1 else 0 end) as z, sum(case when value < 0 then 1 else 0 end) as g from obs group by all) select run_id, variable, round(u / nullif(k, 0), 6) as p_distinct, round((n - k) / n, 6) + 0.0 as p_missing, 0.0::double as p_infinite, round(z / n, 6) + 0.0 as p_zeros, round(g / n, 6) + 0.0 as p_negative from p")
def profile_shares(spark, d):
    return rounded(profile.per_run(derive.r2(spark, d)).select("run_id", "variable", "p_distinct", "p_missing", "p_infinite", "p_zeros", "p_negative"))


@query(WITH + R2 + ", e as (select variable, min(value) as lo, max(value) as hi, stddev_samp(value) as sd, count(*) as n from obs where value is not null group by variable), g as (select *, sd * pow(n, -0.2) as h, lo + (hi - lo) * point / 199 as place from e, (select unnest(range(0, 200)) as point)) select g.variable, cast(point as integer) as point, round(sum(exp(-0.5 * ((place - value) / h) * ((place - value) / h))) / max(n * h) / 2.5066282746310002, 4) as density from g join obs o on o.variable = g.variable and o.value is not null group by 1, 2")
def kde_exact(spark, d):
    """The density of binned values to four places, against the sum over all values."""
    return profile.kde(derive.r2(spark, d)).select("variable", "point", F.round("density", 4).alias("density"))


@query(WITH + LINKS + ", " + FREQ + " select src, tgt, tau, n_runs, round(mean_val, 6) as mean_val from freq order by n_runs desc, src, tgt, tau limit 20")
def top_links(spark, d):
    return rounded(causal.top_links(causal.link_frequency(derive.r4_links(spark, d)[0])).drop("mean_pval"))


@query(WITH + LINKS + ", p as (select src, tgt, tau, count(*) as freq from links group by all) select src, tgt, string_agg(tau || ':' || freq, ',' order by tau) as lags, max(freq) as max_freq from p group by 1, 2 order by max_freq desc, 1, 2 limit 10")
def top_lag_profiles(spark, d):
    found = causal.top_lag_profiles(derive.r4_links(spark, d)[0])
    return found.select("src", "tgt", F.array_join(F.transform("lags", lambda x: F.concat_ws(":", x.tau.cast("string"), x.freq.cast("string"))), ",").alias("lags"), "max_freq")


@query(WITH + R2 + f" select run_id, case when count(distinct seq) < {T.tau_max + 5} then 'skipped' else 'ok' end as status, max(seq) + 1 as n_samples from obs group by 1")
def causal_status(spark, d):
    """Every run's status beside its links, for runs long enough and not."""
    obs = derive.r2(spark, d)
    return causal.run_status(obs, causal.links(obs)).drop("n_significant")


@query(WITH + R1 + f" select run_id, case when max(seq) + 1 < {T.tau_max + 5} then 'skipped' else 'ok' end as status, max(seq) + 1 as n_samples from obs where seq < 5 or run_id not in ('0', '3') group by 1")
def short_runs(spark, d):
    obs = r1(spark, d).where("seq < 5 or run_id not in ('0', '3')")
    return causal.run_status(obs, spark.createDataFrame([], causal.LINKS)).drop("n_significant")


@query(WITH + R1 + ", flat as (select variable from obs group by 1 having stddev_pop(case when variable = 'l_tax' then 1.0 else value end) = 0) select distinct variable from obs where exists (select 1 from flat)")
def undefined_variables(spark, d):
    """With one constant variable, every variable has an undefined correlation."""
    obs = r1(spark, d).withColumn("value", F.when(F.col("variable") == "l_tax", 1.0).otherwise(F.col("value")))
    return correlate.undefined_variables(correlate.pearson(obs))


@query("select name, n_vars, cast(10000 * n_vars as double) as run_length from (select 'events' as name, count(distinct event_type) as n_vars from events union all select 'parts', count(distinct p_brand) from part union all select 'vectors', max(len(embedding)) from embeddings)")
def decision_intervals(spark, d):
    """Alarm limits for as many charts as tables have kinds: in control, each side of a chart runs as long as
    all charts together run 5000 places."""
    sizes = derive.table(spark, d, "events").agg(F.countDistinct("event_type").alias("n")).select(F.lit("events").alias("name"), "n")
    sizes = sizes.union(derive.table(spark, d, "part").select(F.lit("parts"), "p_brand").groupBy("parts").agg(F.countDistinct("p_brand"))).union(derive.table(spark, d, "embeddings").select(F.lit("vectors").alias("v"), F.size("embedding").alias("s")).groupBy("v").agg(F.max("s")))
    k = T.shift / 2
    return spark.createDataFrame([(r["name"], r["n"], round(siegmund_arl(decision_interval(T.arl0, r["n"], k), k), 1)) for r in sizes.collect()], "name string, n_vars long, run_length double")


@query(WITH + R1 + ", " + PAIRS_R1 + ", m as (select var_a, var_b, r0 as r from pooled union all select var_b, var_a, r0 from pooled union all select distinct variable, variable, 1.0 from obs) select var_a, " + ", ".join(f"round(max(case when var_b = '{v}' then r end), 6) as {v}" for v in derive.R1_VARIABLES) + " from m group by 1")
def correlation_matrix(spark, d):
    from ..sources.artifacts import correlation_matrix as square

    return rounded(square(correlate.pearson(r1(spark, d)), derive.R1_VARIABLES))
