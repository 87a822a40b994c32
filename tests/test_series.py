"""Split recursions against plain loops, and what numbering, run ids and numbers must not lose."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.expressions import number
from tidemark.operators import drift, series
from tidemark.operators.obs import run_key, with_seq, with_seq_in_parts
from tidemark.operators.positions import positions
from tidemark.sources import ingest

OBS = "run_id string, sample long, seq long, variable string, var_pos int, value double"


def gaps(seed, n=61):
    """Series with gaps at their start, their end, over whole parts, and without any value."""
    rng = random.Random(seed)
    out = {}
    for run in ("r", "s"):
        for k, v in enumerate(("a", "b", "c", "d")):
            values = [1e6 * (k == 1) + rng.gauss(0.3 * k, 1 + k) for _ in range(n)]
            if k == 2:
                values = [None if i < 9 or 20 <= i < 37 or i > 55 or i % 7 == 3 else x for i, x in enumerate(values)]
            if k == 3 and run == "s":
                values = [None] * n
            out[run, v, k] = values
    return out


@pytest.fixture(scope="module")
def data(spark):
    out = gaps(4)
    rows = [(r, i, i, v, k, x) for (r, v, k), values in out.items() for i, x in enumerate(values)]
    random.Random(1).shuffle(rows)
    return out, spark.createDataFrame(rows, OBS)


@pytest.mark.parametrize("span", [1, 2, 7, 60, 1000])
def test_lag_moments(data, span):
    want, obs = data
    got = {(r["run_id"], r["variable"]): r for r in series.lag_moments(obs, span).collect()}
    assert len(got) == len(want)
    for (run, v, _), values in want.items():
        x = [u for u in values if u is not None]
        r = got[run, v]
        assert (r["n"], r["n_rows"]) == (len(x), len(values))
        if not x:
            continue
        mean = sum(x) / len(x)
        assert r["mean"] == pytest.approx(mean) and r["sd"] == pytest.approx(math.sqrt(sum((u - mean) ** 2 for u in x) / (len(x) - 1)), rel=1e-9)
        a, b = x[:-1], x[1:]
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        assert r["n_pairs"] == len(a)
        assert r["c"] == pytest.approx(sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / len(a), rel=1e-7, abs=1e-9)
        assert r["sx"] == pytest.approx(math.sqrt(sum((p - ma) ** 2 for p in a) / len(a)), rel=1e-9)
        assert r["sy"] == pytest.approx(math.sqrt(sum((q - mb) ** 2 for q in b) / len(b)), rel=1e-9)


@pytest.mark.parametrize("span", [1, 3, 16, 1000])
def test_reflected_sums(spark, data, span, monkeypatch):
    monkeypatch.setattr(series, "SPAN", span)
    want, obs = data
    base = spark.createDataFrame([("a", 0.0, 1.0), ("b", 1e6, 2.0), ("c", 0.5, 2.5), ("d", 1.0, 0.0)], "variable string, pooled_mean double, pooled_std double")
    centre = {r["variable"]: (r["pooled_mean"], r["pooled_std"]) for r in base.collect()}
    got = {(r["run_id"], r["variable"], r["seq"]): r for r in drift.cusum(obs, base).collect()}
    assert len(got) == sum(map(len, want.values()))
    for (run, v, _), values in want.items():
        up = down = 0.0
        mean, sd = centre[v]
        for i, x in enumerate(values):
            z = (x - mean) / sd if x is not None and sd else 0.0
            up, down = max(0.0, up + z - 0.5), min(0.0, down + z + 0.5)
            assert got[run, v, i]["c_pos"] == pytest.approx(up, abs=1e-7) and got[run, v, i]["c_neg"] == pytest.approx(down, abs=1e-7)


def test_parts_are_many_tasks(data, monkeypatch):
    """Nothing is dealt by series alone but the rows of parts."""
    monkeypatch.setattr(series, "SPAN", 8)
    _, obs = data
    plan = series.lag_moments(obs)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert any("part#" in x for x in exchanges)
    below = plan.split("hashpartitioning(run_id")[-1]
    assert "part#" in below.split("\n")[0]


def test_numbering_keeps_runs_with_null_keys(spark):
    rows = [("a", None, i) for i in range(9)] + [("b", float(i % 3) if i % 4 else None, i) for i in range(9)] + [(None, 1.0, 0), (None, None, 1)]
    df = spark.createDataFrame(rows, "run_id string, key double, tie int")
    one = sorted(map(tuple, with_seq(df, ["key", "tie"]).collect()), key=str)
    two = sorted(map(tuple, with_seq_in_parts(df, ["key", "tie"]).collect()), key=str)
    assert one == two and len(one) == len(rows)


def test_positions_in_many_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([None, *range(40)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, tie int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = positions(df, ["g"], ["k", "tie"], size="n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("x", "y", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert {(r["k"], r["tie"]): (r["pos"], r["n"]) for r in got if r["g"] == g} == {(r[1], r[2]): (i, len(own)) for i, r in enumerate(own)}


def test_run_keys(spark):
    texts = ["1", "1.0", "1D", "1f", "7", "007", "-3.00", "1e3", "", "x", None, "10.5", "+1"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "i string").select(run_key("i")).collect()]
    assert got == ["1", "1", "1D", "1f", "7", "007", "-3", "1e3", "", "x", None, "10.5", "+1"]
    assert [r[0] for r in spark.createDataFrame([(1.0,), (2e9,), (2.5,), (None,)], "i double").select(run_key("i")).collect()] == ["1", "2000000000", "2.5", None]
    assert [r[0] for r in spark.createDataFrame([(12,)], "i int").select(run_key("i")).collect()] == ["12"]


def test_codes_are_not_numbers(spark):
    texts = ["1D", "2F", "3d", "0x10", "1_000", "1,5", "nan", "", " 4 ", "-.5", "6.", "7e-2", "inf", "-Infinity", "1L", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(number("t")).collect()]
    assert got == [None] * 8 + [4.0, -0.5, 6.0, 0.07, math.inf, -math.inf, None, None]
    assert ingest.coerce_numeric(spark.createDataFrame([("1D", "1"), ("2F", "2")], "code string, x string")).columns == ["x"]


def test_quoted_headers(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('"flow, main","say ""hi""", plain \n1,2,3\n"4",5.5,6\n')
    runs = ingest.load(spark, str(path))
    assert runs.variables == ["flow, main", 'say "hi"', "plain"]
    got = {(r["variable"], r["seq"]): r["value"] for r in runs.obs.where(F.col("value").isNotNull()).collect()}
    assert got == {("flow, main", 0): 1.0, ('say "hi"', 0): 2.0, ("plain", 0): 3.0, ("flow, main", 1): 4.0, ('say "hi"', 1): 5.5, ("plain", 1): 6.0}
