"""Tables that stay where they are, roles by sketches, mergeable medians, linkages and what clients infer."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_drift import frame

from tidemark.operators import cluster, correlate, drift, series
from tidemark.operators.obs import trajectory_band
from tidemark.plans import interpret, pipelines
from tidemark.sources import artifacts, ingest, tables


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(3)
    return frame(spark, {r: {v: rng.normal(size=40) for v in ("x", "y", "z")} for r in ("0", "1", "2")})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_check_shuffles_no_row_of_the_baseline(spark, runs, tmp_path):
    base = pipelines.build_baseline(runs, str(tmp_path / "b"), with_causal=False)
    grams = tables.written(correlate.run_gram(runs))
    sizes, known = tables.written(drift.effective_sizes(runs)), base.tables
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = correlate.pearson_of(grams).join(known["corr"].withColumnRenamed("r", "r0"), ["var_a", "var_b"])
        shifted = sizes.join(known["baseline"].drop("var_pos"), "variable")
        for df in (joined, shifted):
            plan = plan_of(df)  # the runs' side is dealt to the buckets; the baseline's is read as it lies
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
            assert "Exchange" not in plan.split("Bucketed: true")[0].rsplit("Sort [", 1)[1]
        assert joined.count() == 9 and shifted.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    again = artifacts.read_artifacts(spark, str(tmp_path / "b"))  # a later session opens the same folder
    assert again["corr"].count() == 3 and again["baseline"].count() == 3
    out = pipelines.check_run(base, runs)
    assert out["summary"].count() == 3 and out["onsets"].count() == 9
    assert spark.read.json(str(tmp_path / "b" / "profile_json")).count() == 9


def test_laid_out_series_are_not_shuffled_again(spark, runs):
    rows = series.laid_out(runs)
    plan = plan_of(series.lag_moments(rows))
    scan = plan.split("Bucketed: true")[0].splitlines()
    first = next(i for i in range(len(scan) - 1, -1, -1) if "Window" in scan[i])
    assert "Bucketed: true" in plan and not any("Exchange" in x for x in scan[first:])
    one = {(r["run_id"], r["variable"]): r["c"] for r in series.lag_moments(rows).collect()}
    two = {(r["run_id"], r["variable"]): r["c"] for r in series.lag_moments(runs).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_written_tables_end_with_their_scope(spark, runs):
    with tables.scope(spark):
        kept = tables.written(runs, "kept")
        bucketed = tables.written_by(runs, ["run_id"], "bucketed")
        paths = [f.rsplit("/", 1)[0] for df in (kept, bucketed) for f in df.inputFiles()[:1]]
        assert kept.count() == bucketed.count() == 360 and all(tables.exists(spark, p) for p in paths)
    assert not any(tables.exists(spark, p) for p in paths)


def test_roles_by_sketches(spark):
    n = 3000
    rows = [(i, f"u{i % 51}", f"c{i % 50}", f"t{i % 20}", f"s{i % 21}", i % 600, i % 601, None, float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "frame_no int, user_class string, item_class string, kind_text string, plain string, batch_a int, batch_b int, session string, flow double")
    roles = ingest.detect_roles(df)
    assert roles["run"] == "batch_a" and roles["sample"] == "frame_no"  # 600 = rows / 5, 601 is more
    assert roles["labels"] == ["user_class", "item_class", "kind_text", "session"]  # by name, or text of up to 20 values
    facts, total = ingest.column_facts(df)
    assert total == n and facts["session"] == {"present": 0, "numeric": 0, "distinct": 0} and facts["flow"]["numeric"] == n
    assert abs(facts["flow"]["distinct"] - n) < 0.1 * n
    plan = plan_of(df.agg(*(F.approx_count_distinct(c, 0.02) for c in df.columns)))
    assert "Expand" not in plan
    assert ingest.describe(df, "x")["index_type"] == "sample"


def test_medians_by_sketch(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=20_000)
    obs = spark.createDataFrame([(str(i), 0, 0, "x", 0, float(v)) for i, v in enumerate(values)], "run_id string, sample long, seq long, variable string, var_pos int, value double")
    exact, near = trajectory_band(obs).first(), trajectory_band(obs, sketch=200).first()
    assert exact["median"] == pytest.approx(np.median(values)) and near["mean"] == pytest.approx(exact["mean"])
    assert abs((values < near["median"]).mean() - 0.5) < 0.02
    gap = obs.limit(1).withColumn("value", F.lit(None).cast("double"))
    assert trajectory_band(gap, sketch=64).first()["median"] is None


def merges_by_definition(points, method):
    """The clusters that merge, by distances between whole clusters."""
    groups, out = [[i] for i in range(len(points))], []

    def apart(a, b):
        p, q = points[a], points[b]
        if method == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(p.mean(0) - q.mean(0))
        if method == "centroid":
            return np.linalg.norm(p.mean(0) - q.mean(0))
        every = np.linalg.norm(p[:, None] - q[None], axis=2)
        return {"average": every.mean(), "single": every.min(), "complete": every.max()}[method]

    while len(groups) > 1:
        d, i, j = min((apart(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        out.append((sorted(groups[i] + groups[j]), d))
        groups[i] = groups[i] + groups[j]
        del groups[j]
    return out


@pytest.mark.parametrize("method", ["average", "single", "complete", "ward", "centroid"])
def test_linkages_by_definition(method):
    points = np.random.default_rng(7).normal(size=(24, 3))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    got, members = [], {i: [i] for i in range(24)}
    for k, (a, b, height, size) in enumerate(cluster.average_linkage(d, method)):
        members[24 + k] = sorted(members[a] + members[b])
        assert len(members[24 + k]) == size
        got.append((members[24 + k], height))
    want = merges_by_definition(points, method)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_median_linkage_and_ties():
    d = np.array([[0, 2, 4], [2, 0, 3], [4, 3, 0]], float)
    assert cluster.average_linkage(d, "median")[1][2] == pytest.approx(np.sqrt(16 / 2 + 9 / 2 - 4 / 4))
    assert [m[:2] for m in cluster.average_linkage(np.ones((4, 4)))] == [(0, 1), (2, 4), (3, 5)]


def test_three_thousand_variables():
    x = np.random.default_rng(1).normal(size=(3000, 8))
    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1)))
    began = time.process_time()
    labels, scores, merges = cluster.choose(d, method="ward")
    assert time.process_time() - began < 30 and len(merges) == 2999 and len(scores) == 9


def test_inference_is_kept(spark, tmp_path):
    table = pipelines.export_inference(spark, str(tmp_path), {"x": "a flow"}, {"x": "measured"}, {1: ["feed", "cooling"]}, {"variable": "x", "confidence": 0.5})
    assert {(r["kind"], r["name"], r["value"]) for r in table.collect()} == {("identity", "x", "a flow"), ("type", "x", "measured"), ("cluster_role", "1", '["feed", "cooling"]'), ("root_cause", "variable", "x"), ("root_cause", "confidence", "0.5")}
    assert artifacts.read_document(spark, f"{tmp_path}/inference.json")["root_cause"]["confidence"] == 0.5


def test_clients_from_the_environment():
    made = []
    interpret.PROVIDERS["house"] = lambda model, url: made.append((model, url)) or interpret.MockClient()
    env = {"LLM_PROVIDER": "House", "LLM_MODEL": "m", "LLM_BASE_URL": "u"}
    interpret.client_from_environment(env=env)
    interpret.client_from_environment(True, env)
    interpret.client_from_environment(True, env | {"LLM_REASONING_MODEL": "r"})
    assert made == [("m", "u"), ("m", "u"), ("r", "u")]
    del interpret.PROVIDERS["house"]
    assert isinstance(interpret.client_from_environment(env={}), interpret.MockClient)
    with pytest.raises(ValueError, match="unknown provider"):
        interpret.client_from_environment(env=env)
