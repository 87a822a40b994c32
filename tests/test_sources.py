import json

import pytest

from tidemark.plans import interpret, pipelines
from tidemark.sources import artifacts, ingest


@pytest.mark.parametrize(("name", "text"), [("a.csv", "x,y\n1,2\n3,bad\n"), ("b.tsv", "x\ty\n1\t2\n3\tbad\n"), ("c.dat", "x;y\n1;2\n3;bad\n"), ("d.txt", "x   y\n1   2\n3   bad\n")])
def test_delimited(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    df = ingest.read_table(spark, str(tmp_path / name))
    assert df.columns == ["x", "y"] and sorted(tuple(r) for r in df.collect()) == [("1", "2"), ("3", "bad")]
    run = ingest.load(spark, str(tmp_path / name))
    assert run.variables == ["x", "y"]
    assert sorted((r["variable"], r["seq"], r["value"]) for r in run.obs.collect() if r["value"] is not None) == [("x", 0, 1.0), ("x", 1, 3.0), ("y", 0, 2.0)]


def test_headerless_and_unknown(spark, tmp_path):
    (tmp_path / "h.csv").write_text("1,2\n3,4\n")
    assert ingest.read_table(spark, str(tmp_path / "h.csv")).columns == ["col_0", "col_1"]
    with pytest.raises(ValueError):
        ingest.read_table(spark, "x.unknown")
    with pytest.raises(ValueError):
        ingest.require(spark.range(1), ["id", "b"])


def test_roles(spark, tmp_path):
    rows = [(r, s, f"f{r % 2}", r + s / 10, s * 1.5) for r in range(4) for s in range(8)]
    df = spark.createDataFrame(rows, "simulationRun int, sample int, fault_status string, p double, q double")
    path = str(tmp_path / "my_te_process.csv")
    df.coalesce(1).write.csv(path, header=True)
    runs = ingest.load_runs(spark, path)
    assert (runs.run_col, runs.sample_col, runs.label_cols, runs.variables) == ("simulationRun", "sample", ["fault_status"], ["p", "q"])
    assert runs.obs.count() == 64 and runs.labels.count() == 32
    assert runs.metadata["rows"] == 32
    guess = ingest.detect_roles(df)
    assert guess["run"] == "simulationRun" and guess["sample"] == "sample" and "fault_status" in guess["labels"]
    assert ingest.detect_roles(df, sample_col="q")["sample"] == "q"


def test_build_and_check(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [(str(r), s, s, v, k, rng.gauss(0, 1)) for r in range(3) for s in range(40) for k, v in enumerate("abc")]
    obs = spark.createDataFrame(rows, "run_id string, sample long, seq long, variable string, var_pos int, value double")
    root = str(tmp_path / "base")
    base = pipelines.build_baseline(obs, root, n_runs=3)
    assert artifacts.is_complete(spark, root) and base.variables == ["a", "b", "c"]
    out = pipelines.check_run(base, obs.where("run_id = '0'"))
    assert out["summary"].count() == 1 and out["mean_shift"].count() == 3
    assert "Data quality" in pipelines.report_text(base) and pipelines.dashboard(base).count() == 3
    with pytest.raises(ValueError, match="missing columns: c"):
        pipelines.check_run(base, obs.where("variable <> 'c'"))
    matrix = artifacts.correlation_matrix(base.tables["corr"], base.variables).collect()
    assert len(matrix) == 3 and all(r[r["var_a"]] == 1.0 for r in matrix)
    evidence = interpret.variable_evidence(base.tables["pooled_profile"], base.tables["corr"], base.tables["clusters"])
    log = artifacts.AuditLog(str(tmp_path / "audit.jsonl"))
    client = interpret.MockClient({"likely meaning": {"text": '```json\n{"a": "pressure"}\n```'}, "limit": {"text": "ok", "tool_call": {"name": "propose_range_rule", "arguments": {"column": "a", "max": 5, "description": "d"}}}})
    analyst = interpret.Analyst(client, log)
    assert analyst.identities(evidence) == {"a": "pressure"}
    assert analyst.chat("set a limit", {}, base.variables)["pending_rule"]["max"] == 5.0
    with pytest.raises(TypeError):
        analyst.explain("f", {"rows": obs})
    log.decision("0", "critical", ["x"])
    assert [r["type"] for r in log.rows()] == ["llm_call", "llm_call", "decision"] and log.decisions()[0]["run_id"] == "0"
    assert ingest.read_audit(spark, log.path).count() == 3


def test_rules_file(tmp_path):
    store = interpret.RuleStore(str(tmp_path / "rules.json"))
    rule = interpret.make_rule("a", "d", ["a"], min=1)
    store.save(rule)
    store.save({**rule, "rule_id": "off", "active": False})
    assert len(store.load()) == 2 and len(store.load(active_only=True)) == 1
    store.delete(rule["rule_id"])
    assert [r["rule_id"] for r in store.load()] == ["off"]
    for bad in ({"column": "z", "max": 1}, {"column": "a"}, {"column": "a", "min": 2, "max": 1}):
        with pytest.raises(ValueError):
            interpret.make_rule(description="", columns=["a"], **bad)
    assert interpret.parse_json("nothing") == {} and json.dumps(artifacts.plain({1: {2.5}}))
    assert ingest.safe_name("/x/My File (1).csv") == "MyFile1"
