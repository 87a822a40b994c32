"""The causal queries over data: what they return follows the events."""

import datetime as dt

import numpy as np
import pytest

from tidemark.plans import catalog

NAMES = ["x", "y"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Four days in which y follows x by one hour; at the end of the last day both are high."""
    rng = np.random.default_rng(5)
    rows = []
    for day in range(4):
        x = rng.normal(size=25)
        x[12:] += 30.0 * (day == 3)
        y = x[:-1] + 0.05 * rng.normal(size=24)
        for hour in range(24):
            at = dt.datetime(2024, 1, 1 + day, hour)
            rows += [(at, "x", float(x[hour + 1])), (at, "y", float(y[hour]))]
    root = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{root}/events.parquet")
    return root


def rows(spark, root, name):
    return [r.asDict() for r in catalog.QUERIES[name](spark, root).collect()]


def test_frequencies_follow_the_events(spark, planted):
    freq = {(r["src"], r["tgt"], r["tau"]): r for r in rows(spark, planted, "link_frequency_r2")}
    assert {v for k in freq for v in k[:2]} == set(NAMES)
    assert freq["x", "y", 1]["n_runs"] == 4 and freq["x", "y", 1]["mean_val"] > 0.8
    profile = {(r["src"], r["tgt"], r["tau"]): r["freq"] for r in rows(spark, planted, "lag_profile_r2")}
    assert profile == {k: r["n_runs"] for k, r in freq.items()}
    consensus = {(r["src"], r["tgt"], r["tau"]): r["consensus"] for r in rows(spark, planted, "consensus_links_r2")}
    assert consensus == {k: r["n_runs"] >= 4 for k, r in freq.items()}
    n = sum(consensus.values())
    assert rows(spark, planted, "causal_summary_r2") == [{"n_links": len(freq), "n_consensus": n, "n_other": len(freq) - n}]
    majority = {(r["src"], r["tgt"], r["tau"]) for r in rows(spark, planted, "majority_links_r2")}
    assert majority == {k for k, r in freq.items() if r["n_runs"] >= 2 and k[0] != k[1]}


def test_graph_degrees_and_evidence(spark, planted):
    freq = {(r["src"], r["tgt"], r["tau"]): r for r in rows(spark, planted, "link_frequency_r2")}
    graph = {(r["src"], r["tgt"], r["tau"]) for r in rows(spark, planted, "consensus_graph_r2")}
    assert graph == {k for k, r in freq.items() if r["n_runs"] >= 4 and abs(r["mean_val"]) >= 0.5} and ("x", "y", 1) in graph
    degree = {r["variable"]: (r["out_degree"], r["in_degree"]) for r in rows(spark, planted, "causal_degree_r2")}
    assert degree == {v: (sum(k[0] == v for k in freq), sum(k[1] == v for k in freq)) for v in NAMES}
    assert {r["variable"] for r in rows(spark, planted, "strongest_self_links_r2")} == {k[0] for k in freq if k[0] == k[1]}
    evidence = rows(spark, planted, "root_cause_evidence_r2")
    assert {r["run_id"] for r in evidence} >= {"2024-01-04"}
    assert {(r["src"], r["tgt"], r["tau"]) for r in evidence if r["run_id"] == "2024-01-04"} == {k for k in freq if k[0] != k[1]}


def test_links_at_the_default_lag(spark, tmp_path):
    """y follows x by three hours, which a range of two lags cannot hold."""
    rng = np.random.default_rng(6)
    events = []
    for day in range(3):
        x = rng.normal(size=27)
        y = x[:-3] + 0.05 * rng.normal(size=24)
        for hour in range(24):
            at = dt.datetime(2024, 1, 1 + day, hour)
            events += [(at, "x", float(x[hour + 3])), (at, "y", float(y[hour]))]
    spark.createDataFrame(events, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = rows(spark, str(tmp_path), "pcmci_links")
    assert sum((r["src"], r["tgt"], r["tau"]) == ("x", "y", 3) for r in found) == 3
