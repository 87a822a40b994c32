"""Queries over files and artifacts: tables are written, read back by the library, and compared with the
source tables by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import association, correlate, cycles, profile, quality
from ..operators.obs import with_seq_in_parts
from ..sources import artifacts, ingest
from ..sources.tables import shared_root
from . import derive, interpret, pipelines
from .catalog import BASE, ORACLES, PAIRS_R1, R1, R2, SIZES, WITH, query, rounded
from .scores_catalog import PAIRS

CUSTOMER = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]


def folder(spark) -> str:
    return f"{shared_root(spark)}/files-{uuid.uuid4().hex}"


def delimited(spark, d, layout: str, header: bool = True) -> str:
    """Customers as one text file of a layout."""
    rows = derive.table(spark, d, "customer").select(*CUSTOMER if header else CUSTOMER[:3])
    if layout == "blanks":
        path = f"{folder(spark)}/customers.dat"
        lines = rows.select(F.concat_ws("   ", *rows.columns).alias("value"))
        spark.createDataFrame([("   ".join(rows.columns),)], "value string").union(lines).coalesce(1).write.text(path)
        return path
    mark, end = {"comma": (",", "csv"), "tab": ("\t", "tsv"), "semicolon": (";", "txt")}[layout]
    path = f"{folder(spark)}/customers.{end}"
    rows.coalesce(1).write.csv(path, sep=mark, header=header)
    return path


_LOADED = " union all ".join(f"select '{{layout}}' as layout, '{c}' as variable, count({c}) as n, round(sum({c}), 2) as total from customer" for c in CUSTOMER[:3])


@query(" union all ".join(_LOADED.format(layout=x) for x in ("comma", "tab", "semicolon", "blanks")))
def load_delimited(spark, d):
    """Four layouts are told apart; numbers are converted and the text column is dropped."""
    out = None
    for layout in ("comma", "tab", "semicolon", "blanks"):
        obs = ingest.load(spark, delimited(spark, d, layout)).obs
        part = obs.groupBy("variable").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.lit(layout).alias("layout"), "variable", "n", "total")
        out = part if out is None else out.unionAll(part)
    return out


@query("select 'col_' || k as variable, n, total from (" + " union all ".join(f"select {i} as k, count({c}) as n, round(sum({c}), 2) as total from customer" for i, c in enumerate(CUSTOMER[:3])) + ")")
def load_headerless(spark, d):
    obs = ingest.load(spark, delimited(spark, d, "comma", header=False)).obs
    return obs.groupBy("variable").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select * from (values ('comma', ',', true), ('tab', chr(9), true), ('semicolon', ';', true), ('blanks', '\\s+', true)) as x(layout, delimiter, header)")
def sniffed_layouts(spark, d):
    out = []
    for layout in ("comma", "tab", "semicolon", "blanks"):
        lines = ingest.first_lines(spark, delimited(spark, d, layout))
        mark = ingest.sniff_delimiter(lines)
        out.append((layout, mark, ingest.has_header(ingest.split_line(lines[0], mark))))
    return spark.createDataFrame(out, "layout string, delimiter string, header boolean")


@query("select stem, variable, n from (select 'first' as stem, 'c_acctbal' as variable, count(c_acctbal) as n from customer union all select 'second', 's_acctbal', count(s_acctbal) from supplier)")
def load_many_files(spark, d):
    root, paths = folder(spark), []
    for stem, table, column in (("first", "customer", "c_acctbal"), ("second", "supplier", "s_acctbal")):
        derive.table(spark, d, table).select(column).coalesce(1).write.csv(f"{root}/{stem}.csv", header=True)
        paths.append(f"{root}/{stem}.csv")
    out = None
    for stem, runs in ingest.load_many(spark, paths).items():
        part = runs.obs.groupBy("variable").agg(F.count("value").alias("n")).select(F.lit(stem).alias("stem"), "variable", "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("select cast(l_suppkey % 8 as varchar) as run_id, count(*) as n, round(sum(l_quantity), 2) as quantity, count(distinct l_returnflag) as n_labels from lineitem group by 1")
def load_known_runs(spark, d):
    """A file whose name tells its roles: runs, sample and labels are set apart, the rest is measured."""
    rows = derive.table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("simulationRun"), F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("fault_status"), "l_quantity", "l_tax")
    path = f"{folder(spark)}/te_process_lines.csv"
    rows.write.csv(path, header=True)
    runs = ingest.load_runs(spark, path)
    sums = runs.obs.where("variable = 'l_quantity'").groupBy("run_id").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("quantity"))
    return sums.join(runs.labels.groupBy("run_id").agg(F.countDistinct("fault_status").alias("n_labels")), "run_id")


_ROLES = "(select count(distinct o_orderpriority) as k, count(*) as n from orders)"


@query(f"select 'run' as role, 'session_id' as col from {_ROLES} where k between 2 and n / 5 union all select 'sample', 'frame_no' union all select 'label', 'fault_status' where (select count(distinct o_orderstatus) from orders) <= 50 union all select 'variable', 'price'")
def detected_roles(spark, d):
    """Run, sample and label columns by their names, types and numbers of values."""
    rows = derive.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_no"), F.col("o_orderstatus").alias("fault_status"), F.col("o_orderpriority").alias("session_id"), F.col("o_totalprice").alias("price"))
    runs = ingest.split_roles(rows)
    found = [("run", runs.run_col), ("sample", runs.sample_col), *(("label", c) for c in runs.label_cols), *(("variable", c) for c in runs.variables)]
    return spark.createDataFrame(found, "role string, col string")


@query("select col, n from (select 'rank' as col, count(try_cast(o_orderpriority[1:1] as double)) as n, count(o_orderpriority) as k from orders union all select 'status', count(try_cast(o_orderstatus as double)), count(o_orderstatus) from orders union all select 'mixed', sum(case when o_orderkey % 3 = 0 then 0 else 1 end)::bigint, count(*) from orders union all select 'rare', sum(case when o_orderkey % 3 = 0 then 1 else 0 end)::bigint, count(*) from orders) where n >= 0.5 * k")
def coerced_columns(spark, d):
    """Text columns become numbers where half of their values convert, and go where fewer do."""
    third = F.col("o_orderkey") % 3 == 0
    rows = derive.table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("rank"), F.col("o_orderstatus").alias("status"), F.when(third, "x").otherwise(F.col("o_orderkey").cast("string")).alias("mixed"), F.when(third, F.col("o_orderkey").cast("string")).otherwise("y").alias("rare"))
    kept = ingest.coerce_numeric(rows)
    out = kept.agg(*(F.count(c).alias(c) for c in kept.columns))
    return out.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("n")) for c in kept.columns))).alias("e")).select("e.*")


@query("select row_number() over (order by ts, event_id) - 1 as seq, round(value, 4) as value from events where value is not null")
def time_ordered(spark, d):
    """A text column of times orders the rows, whatever their order in the file."""
    rows = derive.table(spark, d, "events").where("value is not null").orderBy(F.xxhash64("value")).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "value")
    path = f"{folder(spark)}/events.csv"
    rows.write.csv(path, header=True)
    return ingest.load(spark, path).obs.where("value is not null").select("seq", F.round("value", 4).alias("value"))


@query("select (select count(*) from nation) as n_rows, n_columns, (select count(*) from nation) * 8 * n_columns as memory_size, 'nation.parquet' as filename, n_numeric from (select count(*) as n_columns, cast(count_if(data_type in ('BIGINT', 'INTEGER')) as bigint) as n_numeric from duckdb_columns() where table_name = 'nation')")
def source_metadata(spark, d):
    meta = ingest.describe(derive.table(spark, d, "nation"), f"{d}/nation.parquet")
    numeric = sum(t in ("bigint", "int") for t in meta["dtypes"].values())
    return spark.createDataFrame([(meta["rows"], meta["columns"], meta["memory_size"], meta["filename"], numeric)], "n_rows long, n_columns long, memory_size long, filename string, n_numeric long")


@query("select variable, n_customers, n_suppliers from (values ('acctbal', (select count(c_acctbal) from customer), (select count(s_acctbal) from supplier)), ('name', (select count(c_name) from customer), (select count(s_name) from supplier)), ('nationkey', (select count(c_nationkey) from customer), (select count(s_nationkey) from supplier))) as x(variable, n_customers, n_suppliers)")
def common_columns(spark, d):
    """The columns that customers and suppliers have in common, and their values in both."""
    frames = [t.toDF(*(c[2:] for c in t.columns)) for t in (derive.table(spark, d, "customer").select("c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_custkey"), derive.table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", "s_name"))]
    names = ingest.common_variables(frames)
    one, two = (f.agg(*(F.count(c).alias(c) for c in names)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("n")) for c in names))).alias("e")).select("e.*") for f in frames)
    return one.withColumnRenamed("n", "n_customers").join(two.withColumnRenamed("n", "n_suppliers"), "variable")


@query("select '/x/' || p_name || ' (1).csv' as name, regexp_replace(p_name || ' (1)', '[^A-Za-z0-9._-]', '', 'g') as safe from (select distinct p_name from part)")
def safe_names(spark, d):
    names = [f"/x/{r['p_name']} (1).csv" for r in derive.table(spark, d, "part").select("p_name").distinct().collect()]  # file names are the driver's
    return spark.createDataFrame([(n, ingest.safe_name(n)) for n in names], "name string, safe string")


@query("select n_name as key, 'nations/' || n_nationkey as path, 'region ' || n_regionkey as description from nation")
def registered_datasets(spark, d):
    for r in derive.table(spark, d, "nation").collect():  # the registry is the driver's
        ingest.register_dataset(r["n_name"], f"nations/{r['n_nationkey']}", r["n_name"].title(), f"region {r['n_regionkey']}")
    return spark.createDataFrame([(k, v["path"], v["description"]) for k, v in ingest.REGISTRY.items() if v["path"].startswith("nations/")], "key string, path string, description string")


@query(WITH + R2 + ", worst as (select run_id, max(f) as m from (select run_id, variable, round(sum(case when value is null then 1 else 0 end) / count(*), 4) as f from obs group by all) group by run_id) select cast(row_number() over (order by run_id desc) as integer) as place, run_id, case when m >= 0.5 then 'critical' when m >= 0.02 then 'warning' else 'ok' end as verdict, case when m >= 0.5 then 'missing values: critical' when m >= 0.02 then 'missing values: warning' else '' end as reasons from worst")
def audit_decisions(spark, d):
    """The gate's verdict on every run as a decision of an append-only log, the latest first."""
    log = artifacts.AuditLog(f"{folder(spark)}/audit", spark)
    log.call("name", {"a": 1}, {"b": 2}, "mock")
    report = quality.verdict(derive.r2(spark, d)).orderBy("run_id").collect()  # a row per run
    for r in report:
        log.decision(r["run_id"], r["severity"], r["reasons"])
    assert ingest.read_audit(spark, log.path).count() == len(report) + 1
    rows = [(k + 1, r["run_id"], r["verdict"], ",".join(r["reasons"])) for k, r in enumerate(log.decisions())]
    return spark.createDataFrame(rows, "place int, run_id string, verdict string, reasons string")


@query(WITH + R1 + " select 'span-' || variable as rule_id, variable, min(value + 0.0) as min, max(value + 0.0) as max from obs where variable <> 'l_tax' group by variable")
def stored_rules(spark, d):
    """Rules over the span of each variable, saved, retired and deleted in a shared file; the active ones are
    read back."""
    store = interpret.RuleStore(f"{folder(spark)}/rules.json", spark)
    names = derive.R1_VARIABLES
    spans = {r["variable"]: r for r in derive.r1_values(spark, d).groupBy("variable").agg(F.min(F.col("value") + 0.0).alias("lo"), F.max(F.col("value") + 0.0).alias("hi")).collect()}
    for v in names:
        for kind in ("span", "gone"):
            store.save({**interpret.make_rule(v, "d", names, min=spans[v]["lo"], max=spans[v]["hi"]), "rule_id": f"{kind}-{v}", "active": v != "l_tax"})
        store.delete(f"gone-{v}")
    return spark.createDataFrame([(r["rule_id"], r["variable"], r["min"], r["max"]) for r in store.load(active_only=True)], "rule_id string, variable string, min double, max double")


@query("select 'flow, main' as variable, count(*) as n, round(sum(l_quantity), 2) as total from lineitem union all select 'say \"hi\"', count(*), round(sum(l_tax), 2) from lineitem")
def quoted_headers(spark, d):
    """Header fields in quotes that hold the delimiter, and quotes."""
    rows = derive.table(spark, d, "lineitem").select(F.concat_ws(",", F.col("l_quantity").cast("string"), F.col("l_tax").cast("string")).alias("value"))
    path = f"{folder(spark)}/quoted.csv"
    spark.createDataFrame([('"flow, main","say ""hi"""',)], "value string").union(rows).coalesce(1).write.text(path)
    return ingest.load(spark, path).obs.groupBy("variable").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


_IDS = "case l_linenumber % 6 when 0 then '1' when 1 then '1D' when 2 then '1f' when 3 then '7' when 4 then '007' else '1.0' end"


@query(f"select case i when '1.0' then '1' else i end as run_id, count(*) as n, round(sum(l_quantity), 2) as total from (select {_IDS} as i, l_quantity from lineitem) group by 1")
def odd_run_ids(spark, d):
    """Ids that read as the same number name different runs, unless they are whole numbers."""
    k = F.col("l_linenumber") % 6
    ids = F.when(k == 0, "1").when(k == 1, "1D").when(k == 2, "1f").when(k == 3, "7").when(k == 4, "007").otherwise("1.0")
    runs = ingest.split_roles(derive.table(spark, d, "lineitem").select(ids.alias("run"), "l_quantity"), run_col="run", label_cols=[])
    return runs.obs.groupBy("run_id").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select case when l_linenumber > 2 then 'late' else 'early' end as run_id, row_number() over (partition by l_linenumber > 2 order by case when l_linenumber > 2 then l_orderkey end nulls first, l_orderkey, l_linenumber) - 1 as seq, l_orderkey, l_linenumber from lineitem")
def null_keys(spark, d):
    """A run whose first key is null throughout keeps all its rows, in the order of the next keys."""
    late = F.col("l_linenumber") > 2
    rows = derive.table(spark, d, "lineitem").select(F.when(late, "late").otherwise("early").alias("run_id"), F.when(late, F.col("l_orderkey")).alias("key"), "l_orderkey", "l_linenumber")
    return with_seq_in_parts(rows, ["key", "l_orderkey", "l_linenumber"]).drop("key")


_N = "(select count(distinct cast(date_trunc('day', ts) as date)) as days, count(distinct event_type) as kinds from events)"


@query(f"select name, n from {_N}, lateral (select unnest(['baseline', 'clusters', 'corr', 'obs', 'pooled_profile', 'profile', 'quality', 'runs']) as name, unnest([kinds, kinds, kinds * (kinds - 1) // 2, days * kinds * 24, kinds, days * kinds, days, days]) as n)")
def baseline_artifacts(spark, d):
    """A baseline's tables, read back from where they were written."""
    base = pipelines.build_baseline(derive.r2(spark, d), folder(spark), with_causal=False)
    names = ["obs", "runs", "profile", "pooled_profile", "quality", "baseline", "corr", "clusters"]
    return spark.createDataFrame([(n, base.tables[n].count()) for n in names], "name string, n long")


@query(WITH + R2 + ", " + SIZES + ", " + BASE + f""", {PAIRS}, t as (select run_id, variable, case when pooled_std > 1e-12 and ess > 1 then (mean - pooled_mean) / (pooled_std / sqrt(ess)) else 0.0 end as z from sizes join base using (variable))
select 'statistics' as name, run_id, variable, round(z, 4) + 0.0 as value from t union all select 'missing', run_id, variable, round(sum(case when value is null then 1 else 0 end) / count(*), 4) from obs group by 2, 3""")
def check_artifacts(spark, d):
    """What a check of the same runs exports: each variable's deviation, and its missing share by the gate."""
    obs = derive.r2(spark, d)
    base = pipelines.build_baseline(obs, folder(spark), with_causal=False)
    found = pipelines.export_check(pipelines.check_run(base, obs), folder(spark))
    gaps = quality.missing(obs).join(found["quality"].select("run_id"), "run_id").select(F.lit("missing").alias("name"), "run_id", "variable", F.col("frac_missing").alias("value"))
    return rounded(found["statistics"].select(F.lit("statistics").alias("name"), "run_id", "variable", F.col("z_score").alias("value")), 4).union(gaps)


@query(WITH + R1 + ", rules as (select * from (values ('r1', 'l_quantity'), ('r2', 'l_discount'), ('r3', 'l_tax')) as x(rule_id, variable)) select obs.variable, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value + 0.0) as min, max(value + 0.0) as max, coalesce(max(rule_id), '') as rule_ids from obs left join rules on rules.variable = obs.variable group by 1")
def column_cards(spark, d):
    """Each variable's active rules beside its statistics; retired ones and those of other variables go."""
    cards = profile.pooled(derive.r1_values(spark, d)).select("variable", "n", "mean", "std", "min", "max").join(pipelines.rule_cards(derive.rule_rows(spark)), "variable", "left")
    return rounded(cards.select("variable", "n", "mean", "std", "min", "max", F.coalesce(F.array_join(F.transform("rules", lambda r: r.rule_id), ","), F.lit("")).alias("rule_ids")))


@query(WITH + R1 + ", " + PAIRS_R1 + ", m as (select var_a, var_b, r0 as r from pooled union all select var_b, var_a, r0 from pooled), k as (select *, row_number() over (partition by var_a order by abs(r) desc, var_b) as rank from m), s as (select variable, round(avg(value), 4) as mean, count(*) as n from obs group by 1) select s.variable, s.n, s.mean, string_agg(k.var_b, ',' order by k.rank) as partners from s join k on k.var_a = s.variable group by all")
def variable_evidence(spark, d):
    """The evidence of each variable, read back from its JSON."""
    obs = derive.r1(spark, d)
    rows = interpret.variable_evidence(profile.pooled(obs), correlate.pearson(obs))
    parsed = rows.withColumn("e", F.from_json("evidence", "stats struct<n: long, mean: double>, partners array<struct<rank: int, partner: string>>"))
    return parsed.select("variable", "e.stats.n", F.round("e.stats.mean", 4).alias("mean"), F.array_join(F.transform("e.partners", lambda p: p.partner), ",").alias("partners"))


@query("""with c as (select o_orderstatus as a, o_orderpriority as b, count(*) as n from orders group by all), t as (select sum(n) as total from c), ca as (select a, sum(n) as n from c group by 1), cb as (select b, sum(n) as n from c group by 1)
select 'o_orderstatus' as col_a, 'o_orderpriority' as col_b, round(sqrt((sum(c.n * c.n / (ca.n * cb.n)) - 1) / (least((select count(*) from ca), (select count(*) from cb)) - 1)), 6) as v from c join ca using (a) join cb using (b)""")
def cramers_v(spark, d):
    return rounded(correlate.cramers_v(derive.table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query(WITH + R1 + """, l as (select *, lag(value) over (partition by run_id, variable order by seq) as x from obs), m as (select run_id, variable, count(*) as n, covar_pop(value - x, x) as sxy, var_pop(x) as sxx, var_pop(value - x) as syy from l where x is not null group by all)
select run_id, variable, n, round(sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 4) as statistic, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) < -2.86 as stationary from m""")
def stationarity(spark, d):
    return rounded(profile.dickey_fuller(derive.r1(spark, d)), 4)


@query(WITH + R1 + """, l as (select *, lag(value) over s as x, value - lag(value) over s as step from obs window s as (partition by run_id, variable order by seq)), m as (select *, lag(step) over (partition by run_id, variable order by seq) as before from l),
c as (select run_id, variable, count(*) as n, corr(step, x) as sx, corr(step, before) as sb, corr(x, before) as xb from m where before is not null group by all),
p as (select *, (sx - sb * xb) / sqrt((1 - sb * sb) * (1 - xb * xb)) as r from c)
select run_id, variable, n, 1 as lags, round(r * sqrt((n - 3) / (1 - r * r)), 4) as statistic, r * sqrt((n - 3) / (1 - r * r)) < -2.86 as stationary from p""")
def stationarity_augmented(spark, d):
    """The regression with one further lag; its t value follows from a partial correlation."""
    return rounded(cycles.augmented_dickey_fuller(derive.r1(spark, d), lags=1), 4)


@query(None)
def stationarity_best_lags(spark, d):
    """As many further lags as the information criterion asks for."""
    return rounded(cycles.augmented_dickey_fuller(derive.r1(spark, d)), 4)


@query(WITH + R2 + """, g as (select *, row_number() over (partition by run_id, variable order by seq) - 1 as i, count(*) over (partition by run_id, variable) as n from obs where value is not null),
f as (select run_id, variable, n, k, (pow(sum(value * cos(2 * pi() * i * k / n)), 2) + pow(sum(value * sin(2 * pi() * i * k / n)), 2)) / n as power from g, (select unnest(range(1, 13)) as k) where k <= n // 2 group by 1, 2, 3, 4)
select run_id, variable, n, k, round(power / nullif(sum(power) over (partition by run_id, variable), 0), 6) + 0.0 as share from f""")
def periodogram(spark, d):
    """Each cycle's share of the power of its series."""
    return rounded(_shared(cycles.periodogram(derive.r2(spark, d)), F.sum("power").over(Window.partitionBy("run_id", "variable"))))


def _shared(df, total):
    return df.withColumn("share", F.col("power") / F.nullif(total, F.lit(0.0))).drop("power")


@query(ORACLES["periodogram"].replace("select run_id, variable, n, k, round(power / nullif(sum(power) over (partition by run_id, variable), 0), 6) + 0.0 as share from f", """, m as (select run_id, variable, median(power) as middle from f group by all), d as (select run_id, variable, n, max(power) as power, arg_max(k, power) as k, max(middle) as middle, sum(power) as total, median(abs(power - middle)) as mad from f join m using (run_id, variable) group by 1, 2, 3)
select run_id, variable, n, round(n / k, 6) as period, round(power / nullif(total, 0), 6) + 0.0 as share, power > middle + 6 * 1.4826 * mad as seasonal from d"""))
def seasonal_cycles(spark, d):
    obs = derive.r2(spark, d)
    total = cycles.periodogram(obs).groupBy("run_id", "variable").agg(F.sum("power").alias("total"))
    return rounded(_shared(cycles.seasonality(obs).join(total, ["run_id", "variable"]), F.col("total")).drop("total"))


_BINNED = "e as (select variable, min(value + 0.0) as lo, max(value + 0.0) as hi from obs group by variable), b as (select run_id, seq, obs.variable, var_pos, least(floor((value - lo) / ((hi - lo) / 10)), 9) as bin from obs join e on e.variable = obs.variable where value is not null), c as (select a.variable as var_a, z.variable as var_b, a.bin as i, z.bin as j, count(*) as n from b a join b z on a.run_id = z.run_id and a.seq = z.seq and a.var_pos < z.var_pos group by all)"


@query(WITH + R1 + ", " + _BINNED + """, r as (select var_a, var_b, i, sum(n) as ni from c group by all), k as (select var_a, var_b, j, sum(n) as nj from c group by all), t as (select var_a, var_b, cast(sum(n) as bigint) as n, count(distinct i) as rows, count(distinct j) as columns from c group by all)
select t.var_a, t.var_b, max(t.n) as n, max(rows) as rows, max(columns) as columns, round(max(t.n) * (sum(c.n * c.n / (ni * nj)) - 1), 4) as chi2 from c join r using (var_a, var_b, i) join k using (var_a, var_b, j) join t using (var_a, var_b) group by all""")
def contingency_chi2(spark, d):
    """The statistics from which phi_k follows."""
    return rounded(association.chi_square(association.contingency(derive.r1(spark, d))), 4)


@query(None)
def phi_k(spark, d):
    return rounded(association.phi_k(derive.r1(spark, d)), 4)


_V = "round(sqrt((sum(c.n * c.n / (ca.n * cb.n)) - 1) / (least(count(distinct c.a), count(distinct c.b)) - 1)), 6)"
_CODES = "codes as (select o_orderstatus as status, o_orderpriority as priority, cast(least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) as varchar) as price, o_totalprice as x, cast(o_custkey as double) as y, cast(least(floor((o_custkey - lo2) / ((hi2 - lo2) / 10.0)), 9) as varchar) as cust from orders, (select min(o_totalprice) as lo, max(o_totalprice) as hi, min(o_custkey) as lo2, max(o_custkey) as hi2 from orders))"
_NAMES = {"o_totalprice": "price", "o_custkey": "cust", "o_orderstatus": "status", "o_orderpriority": "priority"}
_MIXED = " union all ".join(f"select '{a}' as col_a, '{b}' as col_b, 'cramers_v' as method, (with c as (select {_NAMES[a]} as a, {_NAMES[b]} as b, count(*) as n from codes group by all), ca as (select a, sum(n) as n from c group by 1), cb as (select b, sum(n) as n from c group by 1) select {_V} from c join ca using (a) join cb using (b)) as value" for a, b in (("o_totalprice", "o_orderstatus"), ("o_totalprice", "o_orderpriority"), ("o_custkey", "o_orderstatus"), ("o_custkey", "o_orderpriority"), ("o_orderstatus", "o_orderpriority")))


@query(f"with {_CODES}, ranked as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as y from codes) select 'o_totalprice' as col_a, 'o_custkey' as col_b, 'spearman' as method, round(corr(x, y), 6) as value from ranked union all {_MIXED}")
def auto_association(spark, d):
    """Each pair by the method that suits its kinds."""
    return rounded(association.auto(derive.table(spark, d, "orders"), ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]))


_POOLED_R2 = "p as (select variable, count(*) as n, avg(value) as mean, stddev_samp(value) as std, min(value) as min, max(value) as max, cast(sum(case when value is null then 1 else 0 end) as bigint) as n_missing, count(distinct value) as u, sum(case when value = 0 then 1 else 0 end) as z from obs group by variable)"


@query(WITH + R2 + ", " + _POOLED_R2 + " select variable, round(mean, 6) as mean, round(std, 6) as std, round(min, 6) as min, round(max, 6) as max, n_missing, array_to_string(list_filter([case when u = 1 then 'constant' end, case when n_missing / n > 0.05 then 'missing' end, case when u = n - n_missing then 'unique' end, case when z / n > 0.5 then 'zeros' end], lambda x: x is not null), ',') as alerts, case variable when (select min(variable) from p) then 'r1' else '' end as rules from p")
def dashboard_cards(spark, d):
    """The cards of a baseline's dashboard: statistics, alerts and active rules of each variable."""
    base = pipelines.build_baseline(derive.r2(spark, d), folder(spark), with_causal=False)
    first = min(base.variables)
    rules = spark.createDataFrame([("r1", first, "range", 0.0, 1.0, "d", True, None), ("r2", first, "range", 0.0, 1.0, "d", False, None)], quality.RULES)
    cards = pipelines.dashboard(base, rules)
    names = F.coalesce(F.array_join(F.transform("rules", lambda r: r.rule_id), ","), F.lit(""))
    return rounded(cards.select("variable", "mean", "std", "min", "max", "n_missing", F.coalesce(F.array_join("alerts", ","), F.lit("")).alias("alerts"), names.alias("rules")))


@query(WITH + R2 + ", " + _POOLED_R2 + ", worst as (select run_id, max(f) as m from (select run_id, variable, round(sum(case when value is null then 1 else 0 end) / count(*), 4) as f from obs group by all) group by run_id), runs as (select run_id, row_number() over (order by run_id) as k, m from worst) select 'Runs' as section, run_id as name, '24' as first from runs where k <= 20 union all select 'Data quality', run_id, case when m >= 0.5 then 'critical' when m >= 0.02 then 'warning' else 'ok' end from runs where k <= 20 union all select 'Variables', variable, cast(n as varchar) from p")
def report_tables(spark, d):
    """The first tables of a baseline's report, read back from its Markdown."""
    text = pipelines.report_text(pipelines.build_baseline(derive.r2(spark, d), folder(spark), with_causal=False))
    rows, section = [], ""
    for line in text.splitlines():
        section = line[3:] if line.startswith("## ") else section
        cells = [c.strip() for c in line.strip("|").split("|")] if line.startswith("| ") else []
        if section in ("Runs", "Data quality", "Variables") and cells and cells[0] not in ("run_id", "variable"):
            rows.append((section, cells[0], cells[1]))
    return spark.createDataFrame(rows, "section string, name string, first string")
