"""Planted anomalies, edge cases and independent NumPy recomputation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Thresholds
from tidemark.functions.stats import decision_interval
from tidemark.operators import causal, cluster, correlate, drift, profile, quality
from tidemark.operators.obs import sample_runs, to_wide
from tidemark.streaming.cusum import step

OBS = "run_id string, sample long, seq long, variable string, var_pos int, value double"


def frame(spark, runs):
    """runs: {run: {variable: values}} to obs_long."""
    rows = [(str(r), i, i, v, k, None if x is None or x != x else float(x)) for r, cols in runs.items() for k, (v, xs) in enumerate(cols.items()) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, OBS)


@pytest.fixture(scope="module")
def normal():
    rng = np.random.default_rng(7)
    return {r: {v: rng.normal(size=300) for v in "abcde"} for r in range(6)}


def test_no_alarm_and_planted_shift(spark, normal):
    ref = frame(spark, normal)
    shifted = {"x": {v: xs.copy() for v, xs in normal[0].items()}}
    shifted["x"]["b"][150:] += 2
    shifted["x"]["d"][180:] += 2
    base = drift.baseline(ref)
    h = decision_interval(5000, 5, 0.5)
    assert drift.onsets(drift.cusum(ref, base), h).where("onset is not null").count() <= 1
    found = drift.onsets(drift.cusum(frame(spark, shifted), base), h)
    order = drift.propagation(found).first()
    assert order["propagation"][:2] == ["b", "d"]
    assert 150 <= order["earliest_onset"] <= 165
    summary = drift.run_summary(frame(spark, shifted), ref).first()
    assert summary["frac_mean_drifted"] >= 0.4 and summary["frac_onset_detected"] == 0.4
    quiet = drift.run_summary(ref, ref)
    assert quiet.agg(F.max("anomaly_score")).first()[0] < 0.2


def test_cusum_is_the_recursion(spark):
    rng = np.random.default_rng(3)
    xs = rng.normal(size=200).cumsum() / 5
    xs[[3, 50, 51]] = np.nan
    obs = frame(spark, {"0": {"a": xs}})
    base = spark.createDataFrame([("a", 0.0, 1.0)], "variable string, pooled_mean double, pooled_std double")
    charts = drift.cusum(obs, base).orderBy("seq").select("c_pos", "c_neg").collect()
    up = down = 0.0
    for x, row in zip(xs, charts, strict=True):
        z = 0.0 if np.isnan(x) else x
        up, down = max(0.0, up + z - 0.5), min(0.0, down + z + 0.5)
        assert row["c_pos"] == pytest.approx(up, abs=1e-9) and row["c_neg"] == pytest.approx(down, abs=1e-9)


def test_streaming_state_equals_batch(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    xs = rng.normal(size=120)
    xs[60:] += 2
    obs = frame(spark, {"0": {"a": xs}})
    base = spark.createDataFrame([("a", 0.0, 1.0)], "variable string, pooled_mean double, pooled_std double")
    batch = drift.onsets(drift.cusum(obs, base), 5.0).first()
    state = (0.0, 0.0, -1, -1, "", 0.0, 0)
    rows = pd.DataFrame({"seq": range(120), "z": xs})
    for a, b in ((0, 40), (40, 100), (90, 120)):
        state = step(state, rows[a:b], 0.5, 5.0)
    assert (state[3], state[4], state[6]) == (batch["onset"], batch["direction"], 10)
    assert state[5] == pytest.approx(batch["peak"])


def test_streaming_query(spark, tmp_path):
    from tidemark.streaming.cusum import stream_cusum

    xs = np.concatenate([np.zeros(30), np.full(30, 3.0)])
    frame(spark, {"0": {"a": xs}}).write.parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([("a", 0.0, 1.0)], "variable string, pooled_mean double, pooled_std double")
    source = spark.readStream.schema(OBS).parquet(str(tmp_path / "in"))
    q = stream_cusum(source, base, 5.0).writeStream.format("memory").queryName("cusum_out").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cusum_out").first()["onset"] == 32


def test_autocorrelation_and_edges(spark):
    rng = np.random.default_rng(1)
    ar = np.zeros(3000)
    for i in range(1, 3000):
        ar[i] = 0.8 * ar[i - 1] + rng.normal()
    gaps = np.array([1.0, np.nan, 2.0, 4.0, np.nan, 3.0, 5.0, 1.0])
    runs = {"ar": {"a": ar}, "flat": {"a": np.ones(10)}, "short": {"a": np.array([1.0, 2, 3])}, "gaps": {"a": gaps}, "none": {"a": np.full(5, np.nan)}}
    got = {r["run_id"]: r for r in drift.effective_sizes(frame(spark, runs)).collect()}
    assert got["ar"]["rho1"] == pytest.approx(0.8, abs=0.04) and 200 < got["ar"]["ess"] < 500
    assert got["flat"]["rho1"] == 0 and got["flat"]["ess"] == 10
    assert got["short"]["rho1"] == 0 and got["short"]["ess"] == 3
    kept = gaps[~np.isnan(gaps)]
    assert got["gaps"]["rho1"] == pytest.approx(np.corrcoef(kept[:-1], kept[1:])[0, 1])
    assert "none" not in got


def test_variance_and_correlation_drift(spark, normal):
    rng = np.random.default_rng(2)

    def pair(rho, scale):
        x = rng.normal(size=300)
        return {"x": x * scale, "y": rho * x + np.sqrt(1 - rho**2) * rng.normal(size=300), "z": rng.normal(size=300)}

    ref = frame(spark, {i: pair(0.9, 1) for i in range(5)})
    new = frame(spark, {"n": pair(0.0, 3)})
    base, sizes = drift.baseline(ref), drift.effective_sizes(new)
    var = {r["variable"]: r["var_drifted"] for r in drift.variance_shift(sizes, base, 3).collect()}
    assert var == {"x": True, "y": False, "z": False}
    pairs = correlate.pair_drift(correlate.pearson(new, by_run=True), correlate.pearson(ref), sizes, base, p_values=True)
    assert {(r["var_a"], r["var_b"]) for r in pairs.where("drifted").collect()} == {("x", "y")}


@pytest.mark.parametrize(("missing", "total", "severity"), [(60, 100, "critical"), (50, 100, "critical"), (12499, 25000, "critical"), (3, 100, "warning"), (1, 100, "ok")])
def test_missing_verdicts(spark, missing, total, severity):
    obs = frame(spark, {"0": {"a": [None] * missing + [1.0] * (total - missing)}})
    row = quality.verdict(obs).first()
    assert row["severity"] == severity and row["trusted"] == (severity != "critical")
    assert len(row["reasons"]) == (severity != "ok")


def test_rules(spark):
    obs = frame(spark, {"0": {"a": [1.0, 5.0, 10.0, 11.0], "b": [None] * 4}})
    rules = spark.createDataFrame([("r", "a", "range", None, 10.0, "", None, None), ("s", "b", "range", 0.0, 1.0, "", True, None), ("t", "a", "range", 50.0, None, "", False, None)], quality.RULES)
    rows = quality.rule_violations(obs, rules).collect()
    assert [(r["rule_id"], r["n_checked"], r["n_violations"]) for r in rows] == [("r", 4, 1)]
    assert quality.verdict(obs.where("variable = 'a'"), rules).first()["severity"] == "critical"


def test_correlations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0, 1.0]]) + 1e6
    x[:5, 1] = np.nan
    obs = frame(spark, {"0": {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "k": np.ones(80)}})
    got = {(r["var_a"], r["var_b"]): r["r"] for r in correlate.pearson(obs).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef(x[5:, 0], x[5:, 1])[0, 1], abs=1e-9)
    assert got["a", "c"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 2])[0, 1], abs=1e-9)
    assert got["a", "k"] is None
    assert {r["variable"] for r in correlate.undefined_variables(correlate.pearson(obs)).collect()} >= {"k"}
    ties = frame(spark, {"0": {"a": [1, 1, 2, 3, 3, 5.0], "b": [2, 1, 2, 5, 4, 4.0]}})
    assert correlate.kendall(ties).first()["tau"] == pytest.approx(9 / 13)
    assert correlate.spearman(ties).first()["r"] == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4.5, 4.5, 6], [2.5, 1, 2.5, 6, 4.5, 4.5])[0, 1])


def test_clusters_of_blocks(spark):
    rng = np.random.default_rng(8)
    cols = {}
    for b in range(3):
        core = rng.normal(size=200)
        for i in range(3):
            cols[f"v{b}{i}"] = core + 0.2 * rng.normal(size=200)
    got = {}
    for r in cluster.clusters(correlate.pearson(frame(spark, {"0": cols}))).collect():
        got.setdefault(r["cluster_id"], set()).add(r["variable"][:2])
    assert sorted(map(sorted, got.values())) == [["v0"], ["v1"], ["v2"]]
    assert cluster.clusters(correlate.pearson(frame(spark, {"0": {"a": [1.0, 2, 4], "b": [1.0, 3, 2]}}))).count() == 0


def test_linkage_heights():
    d = np.array([[0, 1, 4, 5], [1, 0, 6, 7], [4, 6, 0, 2], [5, 7, 2, 0.0]])
    assert [(m[0], m[1], m[2]) for m in cluster.average_linkage(d)] == [(0, 1, 1.0), (2, 3, 2.0), (4, 5, 5.5)]


def test_planted_causal_links(spark):
    rng = np.random.default_rng(9)
    x, y = np.zeros(600), np.zeros(600)
    for i in range(2, 600):
        x[i] = 0.6 * x[i - 1] + rng.normal()
        y[i] = 0.7 * x[i - 2] + rng.normal()
    found = causal.links(frame(spark, {"0": {"x": x, "y": y}}), Thresholds(tau_max=3, link_alpha=0.001))
    links = {(r["src"], r["tgt"], r["tau"]) for r in found.collect()}
    assert ("x", "y", 2) in links and ("x", "x", 1) in links and not {k for k in links if k[:2] == ("y", "x") and k[2] > 0}


def test_profiles_and_moments(spark):
    obs = frame(spark, {"0": {"a": [1.0, 2, 4, 9]}, "1": {"a": [3.0, 3, 3, None]}})
    rows = {r["run_id"]: r for r in profile.per_run(obs).collect()}
    assert rows["0"]["skewness"] == pytest.approx(1.3309, abs=1e-4) and rows["0"]["kurtosis"] == pytest.approx(1.5, abs=1e-2)
    assert rows["1"]["skewness"] is None and rows["1"]["n_missing"] == 1 and rows["1"]["n_distinct"] == 1
    assert {(r["run_id"], r["alert"]) for r in profile.alerts(profile.per_run(obs)).collect()} == {("0", "unique"), ("1", "constant"), ("1", "missing")}


def test_runs_drawn_like_python(spark):
    import random

    ids = [str(i) for i in range(20)]
    assert sample_runs(ids, 5, 3) == sorted(random.Random(3).sample(ids, 5), key=int)
    wide = to_wide(frame(spark, {"0": {"a": [1.0, 2], "b": [3.0, None]}}), ["a", "b"]).orderBy("seq").collect()
    assert [(r["a"], r["b"]) for r in wide] == [(1.0, 3.0), (2.0, None)]
