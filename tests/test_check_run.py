"""A check reports the drifted variables by rank and the baseline's causal summary."""

import numpy as np
from test_drift import frame

from tidemark.plans import pipelines


def test_causal_perspective_and_top_list(spark, tmp_path):
    rng = np.random.default_rng(3)
    runs = {}
    for run in ("0", "1", "2"):
        x = rng.normal(size=61)
        runs[run] = {"x": x[1:], "y": x[:-1] + 0.1 * rng.normal(size=60)}
    base = pipelines.build_baseline(frame(spark, runs), str(tmp_path / "base"))
    new = {"9": {"x": runs["0"]["x"] + 2.0, "y": runs["0"]["y"] - 5.0}}
    out = pipelines.check_run(base, frame(spark, new))
    assert [(r["variable"], r["rank"], r["z_score"] < 0) for r in out["top_mean_drifted"].orderBy("rank").collect()] == [("y", 1, True), ("x", 2, False)]
    links = {(r["src"], r["tgt"], r["tau"]): r["consensus"] for r in out["causal_links"].collect()}
    assert links["x", "y", 1]
    n = sum(links.values())
    assert out["causal_summary"].first().asDict() == {"n_links": len(links), "n_consensus": n, "n_other": len(links) - n}
    assert [r["status"] for r in out["causal_status"].collect()] == ["ok"] * 3
