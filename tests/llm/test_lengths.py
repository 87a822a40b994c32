"""Embedding near-dedup over vectors of several lengths."""

import numpy as np

from tidemark.llm import embedding_dedup as module


def test_every_length_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows, groups = [], []
    for d, n in ((16, 30), (8, 20), (5, 4)):
        centres = rng.normal(size=(n, d))
        for c in centres:
            ids = [len(rows), len(rows) + 1, len(rows) + 2]
            rows += [(ids[0], c.tolist(), 1), (ids[1], (c * 2).tolist(), 1), (ids[2], c.tolist(), 2)]
            groups.append(ids)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = {d: np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in rows if len(r[1]) == d]) for d in (16, 8, 5)}
    want = {}
    for d in unit:
        own = [r for r in rows if len(r[1]) == d]
        near = (unit[d] @ unit[d].T >= 0.93) & (np.array([r[2] for r in own])[:, None] == np.array([r[2] for r in own]))
        np.fill_diagonal(near, False)
        want |= {r[0]: int(k) for r, k in zip(own, near.sum(1), strict=True)}
    for least in (module.INDEXED, 3):  # rarer lengths compared in full, then with an index of their own
        monkeypatch.setattr(module, "INDEXED", least)
        got = {r["vec_id"]: r for r in module.embedding_dedup(table, recall=1.0).collect()}
        assert {i: r["n_links"] for i, r in got.items()} == want
        for a, b, _ in groups:
            assert got[a]["n_links"] >= 1 and got[b]["component_id"] == got[a]["component_id"]
