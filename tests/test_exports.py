"""Exports, cards, figures and reports of a baseline and a check; links against plain regressions."""

import numpy as np
import pytest

from tidemark.operators import causal, cluster, correlate, profile
from tidemark.plans import interpret, pipelines
from tidemark.sources import artifacts, ingest
from tidemark.streaming.cusum import step

OBS = "run_id string, sample long, seq long, variable string, var_pos int, value double"


@pytest.fixture(scope="module")
def planted(spark):
    """Three runs in which b follows a by one place; in run 2 c jumps half-way."""
    rng = np.random.default_rng(3)
    rows = []
    for run in range(3):
        x = rng.normal(size=(120, 3))
        x[1:, 1] = 0.9 * x[:-1, 0] + 0.2 * x[1:, 1]
        x[60:, 2] += 6.0 * (run == 2)
        rows += [(str(run), t, t, v, k, float(x[t, k])) for t in range(120) for k, v in enumerate("abc")]
    return spark.createDataFrame(rows, OBS)


@pytest.fixture(scope="module")
def built(spark, planted, tmp_path_factory):
    root, heard = str(tmp_path_factory.mktemp("base")), []
    labels = spark.createDataFrame([(str(r), t, "AB"[t % 2]) for r in range(3) for t in range(10)], "run_id string, sample long, kind string")
    base = pipelines.build_baseline(planted, root, labels=labels, metadata={"filename": "x.csv"}, progress=lambda *s: heard.append(s))
    return root, base, pipelines.check_run(base, planted), heard


def test_every_artifact_is_written(spark, built):
    root, base, _, heard = built
    assert {"labels", "label_summary", "runs", "alerts", "cluster_scores", "linkage", "links", "causal_status", "link_frequency", "lag_profiles"} <= set(base.tables)
    assert [n for n, k, of in heard][:2] == ["runs", "profile"] and heard[-1][1] == heard[-1][2] - 1
    meta = artifacts.read_document(spark, f"{root}/dataset_meta.json")
    assert meta["variables"] == ["a", "b", "c"] and meta["n_runs"] == 3 and artifacts.read_document(spark, f"{root}/none.json") is None
    assert set(artifacts.read_document(spark, f"{root}/complete.json")["seconds"]) >= {"links", "profile"}
    assert sorted((r["value"], r["n"]) for r in base.tables["label_summary"].collect()) == [("A", 15), ("B", 15)]
    assert base.tables["linkage"].count() == 2 and {r["status"] for r in base.tables["causal_status"].collect()} == {"ok"}


def test_check_export(spark, built, tmp_path):
    _, _, checked, _ = built
    found = pipelines.export_check(checked, str(tmp_path), pairs=2, links=4)
    scores = [r["anomaly_score"] for r in found["drift"].orderBy("place").collect()]
    assert len(scores) == 3 and scores == sorted(scores, reverse=True)
    assert found["statistics"].count() == 9 and {"z_score", "p_value", "ratio", "var_drifted"} <= set(found["statistics"].columns)
    assert found["pairs"].groupBy("run_id").count().where("count > 2").isEmpty() and found["consensus"].count() <= 4
    assert artifacts.is_complete(spark, str(tmp_path))


def test_figures_cards_and_report(spark, built):
    root, base, checked, _ = built
    figures = pipelines.figure_data(base, checked)
    assert {"trajectories", "histogram", "density", "heatmap", "dendrogram", "clusters", "link_frequency", "graph", "lag_profiles", "ranking", "breakdown", "timeline", "z_bars", "traces"} <= set(figures)
    assert all(df.limit(1).count() <= 1 for df in figures.values()) and figures["breakdown"].count() == 12
    rules = spark.createDataFrame([("r1", "a", "range", 0.0, 1.0, "d", True, None), ("r2", "a", "range", 0.0, 1.0, "d", False, None)], "rule_id string, variable string, type string, min double, max double, description string, active boolean, created_at string")
    cards = {r["variable"]: r for r in pipelines.dashboard(base, rules, {"a": "pressure"}, {"b": "measured"}).collect()}
    assert cards["a"]["identity"] == "pressure" and cards["b"]["type"] == "measured" and [x["rule_id"] for x in cards["a"]["rules"]] == ["r1"]
    text = pipelines.report_text(base, checked=checked, root_cause={"variable": "c", "confidence": 0.5})
    assert all(f"## {t}" in text for t in ("Runs by anomaly", "Onsets", "Most drifted pairs", "Frequent links", "Links that runs agree on")) and "- variable: c" in text
    assert pipelines.export_comparison(base, root, "0", "2").where("variable = 'c' and drifted").count() == 1
    client = interpret.MockClient({"z_bars": {"text": 'Here: {"note": "c is high"} as asked.'}})
    analyst = interpret.Analyst(client)
    assert analyst.explain_figure("z_bars", figures) == {"note": "c is high"}
    with pytest.raises(ValueError, match="unknown figure"):
        analyst.explain_figure("none", figures)


def test_batch_run(spark, planted, tmp_path, capsys):
    wide = planted.groupBy("run_id", "sample").pivot("variable").max("value").withColumnRenamed("run_id", "run_no")
    wide.coalesce(1).write.csv(str(tmp_path / "in.csv"), header=True)
    base = pipelines.process_file(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), n_runs=2, seed=1)
    assert base.tables["runs"].count() == 2 and (tmp_path / "out" / "report.md").read_text().startswith("# ")
    assert "total:" in capsys.readouterr().out


def test_links_equal_regressions(spark, planted):
    """Each partial correlation from lagged sums is the correlation of two regressions' residuals."""
    names, tau = ["a", "b", "c"], 2
    sums = causal.lagged_sums(planted, names, tau).where("run_id = '1'").first()
    size = 3 * (2 * tau + 1)
    panel = causal.Moments(sums["n"], np.frombuffer(sums["sums"]), np.frombuffer(sums["products"]).reshape(size, size), 3)
    rows = planted.where("run_id = '1'").orderBy("seq", "var_pos").collect()
    x = np.array([r["value"] for r in rows]).reshape(120, 3)
    rng = np.random.default_rng(0)
    for _ in range(40):
        cells = [divmod(int(k), 2 * tau + 1) for k in rng.permutation(size)[: rng.integers(2, 7)]]
        col = [x[2 * tau - lag : 120 - lag, i] for i, lag in cells]
        z = np.stack([np.ones(len(col[0])), *col[2:]], axis=1)
        a, b = (c - z @ np.linalg.lstsq(z, c, rcond=None)[0] for c in col[:2])
        at = [lag * 3 + i for i, lag in cells]
        assert panel.partial(at[0], np.array(at[1:2]), np.array(at[2:], int))[0] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-9)


def test_parts_of_a_run_add_up(spark, planted, monkeypatch):
    whole = {(r["run_id"], r["src"], r["tgt"], r["tau"]): r["val"] for r in causal.links(planted).collect()}
    monkeypatch.setattr(causal, "PART", 17)
    parted = {(r["run_id"], r["src"], r["tgt"], r["tau"]): r["val"] for r in causal.links(planted).collect()}
    assert parted.keys() == whole.keys() and all(parted[k] == pytest.approx(v, abs=1e-9) for k, v in whole.items())


def test_pooled_links_mask_starts_and_gaps(spark, planted):
    from pyspark.sql import functions as F

    gaps = planted.withColumn("value", F.when((F.col("seq") % 29 == 5) & (F.col("variable") == "a"), None).otherwise(F.col("value")))
    found = {(r["src"], r["tgt"], r["tau"]): r["val"] for r in causal.pooled_links(gaps).collect()}
    assert found["a", "b", 1] > 0.9
    sums = causal.lagged_sums(gaps, ["a", "b", "c"], 3, impute=False).collect()
    present = [all((t - lag) % 29 != 5 for lag in range(7)) for t in range(6, 120)]
    assert {r["n"] for r in sums} == {sum(present)}
    assert causal.pooled_links(planted.limit(0)).count() == 0


def test_linkages(spark):
    d = np.array([[0, 1, 4, 5], [1, 0, 2, 6], [4, 2, 0, 3], [5, 6, 3, 0]], float)
    heights = {m: [round(x[2], 4) for x in cluster.average_linkage(d, m)] for m in ("average", "single", "complete", "weighted")}
    assert heights == {"average": [1.0, 3.0, 4.6667], "single": [1.0, 2.0, 3.0], "complete": [1.0, 3.0, 6.0], "weighted": [1.0, 3.0, 4.25]}
    pairs = [("v%d" % i, "v%d" % j, float(1 - d[i, j] ** 2 / 72)) for i in range(4) for j in range(i + 1, 4)] + [("v0", "x", None)]
    found = cluster.clustering(spark.createDataFrame(pairs, "var_a string, var_b string, r double"))
    assert [r["variable"] for r in found["dropped"].collect()] == ["v0", "x"] and found["linkage"].count() == 2


def test_expected_clusters(spark):
    """Three blocks of variables that go together, by hand."""
    r = lambda i, j: 0.9 if i // 2 == j // 2 else 0.1
    pairs = [(f"v{i}", f"v{j}", r(i, j)) for i in range(6) for j in range(i + 1, 6)]
    rows = cluster.clusters(spark.createDataFrame(pairs, "var_a string, var_b string, r double")).collect()
    assert {x["variable"]: x["cluster_id"] for x in rows} == {f"v{i}": i // 2 for i in range(6)}
    near, far = np.sqrt(2 * 0.1), np.sqrt(2 * 0.9)
    assert rows[0]["silhouette"] == pytest.approx((far - near) / far, abs=1e-4) and rows[0]["n_clusters"] == 3


def test_streaming_steps_equal_a_loop():
    import pandas as pd

    rng = np.random.default_rng(2)
    state, want = (0.0, 0.0, -1, -1, "", 0.0, 0), [0.0, 0.0, -1, -1, 0.0]
    for start in range(0, 200, 25):
        z = rng.normal(0.4, 1, 25)
        z[rng.integers(25)] = np.nan
        state = step(state, pd.DataFrame({"seq": np.arange(start, start + 25), "z": z}), 0.5, 3.0)
        for i, v in enumerate(np.nan_to_num(z)):
            want[0], want[1] = max(0.0, want[0] + v - 0.5), min(0.0, want[1] + v + 0.5)
            want[4] = max(want[4], want[0], -want[1])
            if want[3] < 0 and (want[0] > 3 or want[1] < -3):
                want[3] = start + i
    assert state[0] == pytest.approx(want[0]) and state[1] == pytest.approx(want[1]) and state[3] == want[3] and state[5] == pytest.approx(want[4])
    late = step(state, pd.DataFrame({"seq": [5, 200, 200], "z": [9.0, 0.0, 9.0]}), 0.5, 3.0)
    assert late[6] == 2 and late[2] == 200


def test_numbering_in_parts(spark):
    from tidemark.operators.obs import with_seq, with_seq_in_parts

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(str(i % 3), float(rng.integers(0, 40)), i) for i in range(900)], "run_id string, at double, k long")
    order = ["at", "k"]
    assert sorted(map(tuple, with_seq(df, order).collect())) == sorted(map(tuple, with_seq_in_parts(df, order).select(*df.columns, "seq").collect()))


def test_degenerate_moments(spark):
    """Constant columns have no correlation, whatever their size; large means cost no digits."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    rows = [("0", t, t, v, k, float(value)) for t in range(400) for k, (v, value) in enumerate((("big", 1e8 + x[t]), ("flat", 12345.678), ("y", 0.5 * x[t] + 1)))]
    got = {(r["var_a"], r["var_b"]): r["r"] for r in correlate.pearson(spark.createDataFrame(rows, OBS)).collect()}
    assert got["big", "y"] == pytest.approx(1.0, abs=1e-6) and got["big", "flat"] is None and got["flat", "y"] is None


def test_unit_root(spark):
    rng = np.random.default_rng(6)
    rows = [("0", t, t, v, k, float(value)) for k, (v, series) in enumerate((("noise", rng.normal(size=300)), ("walk", np.cumsum(rng.normal(size=300))), ("flat", np.ones(300)))) for t, value in enumerate(series)]
    got = {r["variable"]: r["stationary"] for r in profile.dickey_fuller(spark.createDataFrame(rows, OBS)).collect()}
    assert got == {"noise": True, "walk": False, "flat": None}


def test_replies_with_objects():
    assert interpret.parse_json('```json\n{"a": {"b": 1}}\n```') == {"a": {"b": 1}} and interpret.parse_json("x {no} {\"k\": [1]} y") == {"k": [1]}
    assert interpret.parse_json(None) == interpret.parse_json("[1]") == {}


def test_time_columns(spark):
    df = spark.createDataFrame([("1.5", "n/a", 3.0)], "time string, update_date string, datetime double")
    assert ingest.detect_time(df) == "update_date" and ingest.detect_time(df.select("time", "datetime")) is None
