"""Tables of a few rows are joined without shuffling the rows of large ones by their few keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_drift import frame

from tidemark.config import Thresholds
from tidemark.operators import causal, correlate, cycles, profile, quality
from tidemark.operators.obs import trajectory_band, with_seq_in_parts
from tidemark.plans import derive
from tidemark.sources import tables


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(8)
    return frame(spark, {r: {v: rng.normal(size=40) for v in ("x", "y")} for r in ("0", "1")})


def first_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_rules_do_not_shuffle_observations(spark, runs):
    rules = spark.createDataFrame([("r1", "x", "range", -9.0, 0.0, "d", True, None)], quality.RULES)
    found = quality.rule_violations(runs, rules)
    assert "SortMergeJoin" not in first_plan(found)
    values = [r["value"] for r in runs.where("variable = 'x'").collect()]
    assert sum(r["n_violations"] for r in found.collect()) == sum(v > 0 for v in values)


def test_edges_do_not_shuffle_values(spark, runs):
    found = profile.histogram(runs)
    assert "SortMergeJoin" not in first_plan(found) and "SortMergeJoin" not in first_plan(profile.kde(runs).where("point = 0"))
    assert sum(r["count"] for r in found.collect()) == 160


def test_bands_do_not_shuffle_values_by_variable(spark, runs):
    found = trajectory_band(runs)
    assert "SortMergeJoin" not in first_plan(found) and found.count() == 80


def test_lagged_sums_deal_parts_of_runs_and_no_variables(spark, runs):
    assert "SortMergeJoin" not in first_plan(causal.lagged_sums(runs, ["x", "y"], 1))
    wide = causal._arrays(runs, ["x", "y"])
    loose = Thresholds(link_alpha=1.0)
    long, short = ({tuple(r[:-2]): r["val"] for r in f.collect()} for f in (causal.links(runs, loose), causal.links_of(wide, ["x", "y"], loose)))
    assert long.keys() == short.keys() and all(short[k] == pytest.approx(v, abs=1e-9) for k, v in long.items())


def test_planted_runs_are_windowed_in_parts(spark, monkeypatch):
    d, by = "/root/testdata/sf0.001", ["run_id", "seq", "variable"]
    assert "part#" in first_plan(derive.r4(spark, d)).split("Window")[1].split("\n")[0]
    whole = derive.r4(spark, d).orderBy(*by).collect()
    monkeypatch.setattr(derive, "SPAN", 37)
    assert derive.r4(spark, d).orderBy(*by).collect() == whole and len(whole) == 30000


def test_tasks_do_not_grow_with_the_rows(spark, monkeypatch):
    """More rows are dealt to more tasks, in each shuffle of the planted runs; the results are the same."""
    d, by = "/root/testdata/sf0.001", ["run_id", "seq"]
    whole, loose = derive.r4_wide(spark, d).orderBy(*by).collect(), Thresholds(link_alpha=1.0)
    links = {tuple(r[:4]): r["val"] for r in causal.links_of(*derive.r4_arrays(derive.r4_written(spark, d)), loose).collect()}
    monkeypatch.setattr(tables, "ROWS", 500)
    for module, name in ((derive, "SPAN"), (causal, "PART")):
        monkeypatch.setattr(module, name, 100)
    numbered = with_seq_in_parts(derive.table(spark, d, "lineitem").selectExpr("l_suppkey % 8 as run_id", *derive.R1_ORDER), derive.R1_ORDER)
    assert len(numbered.inputFiles()) >= 12
    wide = derive.r4_wide(spark, d)
    assert max(r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()) <= 2000
    assert wide.orderBy(*by).collect() == whole and len(whole) == 6000
    arrays, names = derive.r4_arrays(derive.r4_written(spark, d))
    plan = causal.lagged_sums_of(arrays, len(names), 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    again = {tuple(r[:4]): r["val"] for r in causal.links_of(arrays, names, loose).collect()}
    assert again.keys() == links.keys() and all(again[k] == pytest.approx(v, abs=1e-9) for k, v in links.items())


def test_augmented_statistics_do_not_shuffle_whole_series(spark, runs):
    assert "SortMergeJoin" not in first_plan(cycles.augmented_dickey_fuller(runs, lags=1))


@pytest.mark.parametrize("common", [4, 10_000])
def test_ranks_of_common_and_rare_values(spark, monkeypatch, common):
    """Common values are joined from their own table, the rest by their values; ranks are the same."""
    monkeypatch.setattr(correlate, "COMMON", common)
    x = [1.0] * 30 + [2.5] * 5 + [7.0, -3.0, 4.0, None, 2.0]
    got = correlate.average_ranks(frame(spark, {"0": {"x": x}})).orderBy("seq").collect()
    kept = sorted(v for v in x if v is not None)
    want = [None if v is None else kept.index(v) + (kept.count(v) + 1) / 2 for v in x]
    assert [r["value"] for r in got] == want
