"""CUSUM over event time: order by the watermark, late rows apart, state that ends."""

import datetime as dt

import numpy as np

from tidemark.streaming.cusum import EMPTY, advance, stream_event_cusum

START = dt.datetime(2024, 1, 1)


def write(spark, path, rows, variable="x"):
    spark.createDataFrame([("r", variable, START + dt.timedelta(minutes=m), v) for m, v in rows], "run_id string, variable string, at timestamp, value double").coalesce(1).write.mode("append").parquet(path)


def test_event_time(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = spark.createDataFrame([("x", 0.0, 1.0), ("y", 0.0, 1.0)], "variable string, pooled_mean double, pooled_std double")
    rng = np.random.default_rng(1)
    value = {m: float(v) for m, v in enumerate(rng.normal(size=40) + (np.arange(40) > 25) * 2.0)}
    seen = []

    def run():
        stream = spark.readStream.schema("run_id string, variable string, at timestamp, value double").parquet(source)
        q = stream_event_cusum(stream, base, 4.0, delay="10 minutes", idle_minutes=30).writeStream.foreachBatch(lambda df, _: seen.extend(r.asDict() for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    order = [*range(0, 20, 2), *range(1, 20, 2)]  # out of order, but within the delay
    write(spark, source, [(m, value[m]) for m in order])
    run()
    write(spark, source, [(m, value[m]) for m in range(20, 40)])
    run()
    write(spark, source, [(3, 99.0), (25, 99.0), (41, 0.0)])  # both far behind the watermark of minute 29
    run()
    late = [r for r in seen if r["kind"] == "late"]
    assert sorted(r["at"] for r in late) == [START + dt.timedelta(minutes=m) for m in (3, 25)] and {r["z"] for r in late} == {99.0}
    write(spark, source, [(75, 0.0)])
    run()
    for minute in (200, 400, 401):  # another series moves the watermark on
        write(spark, source, [(minute, 0.0)], "y")
        run()
    charts = [r for r in seen if r["kind"] == "chart" and r["variable"] == "x"]
    final = max(charts, key=lambda r: r["at"])
    rows = [*sorted(value.items()), (41, 0.0), (75, 0.0)]
    want = EMPTY
    for r in charts:
        upto = [(m, v) for m, v in rows if START + dt.timedelta(minutes=m) <= r["at"]]
        micros = np.array([int((START + dt.timedelta(minutes=m)).replace(tzinfo=dt.UTC).timestamp() * 1e6) for m, _ in upto])
        want = advance(EMPTY, micros, np.array([v for _, v in upto]), 0.5, 4.0)
        if r["n"] == len(upto):
            assert np.isclose(r["c_pos"], want[0]) and np.isclose(r["c_neg"], want[1]) and np.isclose(r["peak"], want[5])
    alarmed = next(r for r in charts if r["onset"] is not None)
    assert alarmed["direction"] == "increase" and START + dt.timedelta(minutes=25) < alarmed["onset"] < START + dt.timedelta(minutes=40)
    closed = [r for r in seen if r["kind"] == "closed" and r["variable"] == "x"]
    assert len(closed) == 1 and closed[0]["n"] == final["n"] == len(rows) and closed[0]["n_late"] == 2
