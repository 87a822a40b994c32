"""The projection search against all distances."""

import math

import numpy as np
import pytest

from tidemark.llm import projection_search
from tidemark.llm.projection_search import chi_square_quantile, nearest

SCHEMA = "vec_id long, embedding array<double>, label int, key string, z string, score string, ids string"


def expected(rows, k=10):
    sound = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in sound:
        if q % 100 == 0:
            found = {(math.dist(x, v), i) for i, v in sound if i != q and len(v) == len(x)}
            out[q] = sorted(found)[:k]
    return out


def check(spark, rows, least=0.9, **kw):
    df = spark.createDataFrame([(i, v, 1, "k", "z", "s", "i") for i, v in rows], SCHEMA)
    want, got = expected(rows), {}
    distance = {}
    for q, x in rows:
        distance[q] = x
    for r in nearest(df, **kw).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
        assert math.isclose(r["score"], math.dist(distance[r["query_id"]], distance[r["vec_id"]]), rel_tol=1e-12, abs_tol=1e-12)
    assert all(q in got or not w for q, w in want.items())
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        hits += len({f[2] for f in found} & {i for _, i in want[q]})
        total += len(want[q])
    assert hits >= least * total
    return hits / max(total, 1)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SHARD", 40), ("QUERIES", 3), ("BUCKET", 4), ("LEAST", 2)):
        monkeypatch.setattr(projection_search, name, value)


def data(seed, n, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 :] = x[rng.integers(0, n // 8, n - n // 2)] + 0.05 * rng.normal(size=(n - n // 2, d))
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_recall(spark):
    check(spark, data(1, 1500))


def test_shards_slices_and_tiles(spark, small):
    check(spark, data(2, 1200))


def test_certainty_is_kept(spark, small):
    assert check(spark, data(3, 1500), certainty=0.999999) > 0.999


def test_copies_ties_and_odd_rows(spark, small):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)]  # all at distance 0: the smallest ids win
    rows += [(1000 + i, [float(i % 7), 0.0, 1.0]) for i in range(201)]
    rows += [(2000, None), (2100, []), (2200, [0.0, 0.0, 0.0]), (2300, [1.0, None, 2.0]), (2400, [math.nan, 1.0, 1.0]), (2500, [math.inf, 1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(2600, [1.0, 2.0]), (2601, [1.0, 2.5]), (2700, [5.0])]  # other lengths: fewer candidates, or none
    rows += [(2800, [-0.0, 1.0, 1.0]), (2801, [0.0, 1.0, 1.0]), rows[0], rows[0], rows[100]]
    assert check(spark, rows, certainty=0.9999) == 1.0


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(100, [1.0], 1, "", "", "", "")], SCHEMA)).count() == 0


def test_quantile():
    for p in (0.5, 0.95, 0.999):
        x = chi_square_quantile(p, 8)
        assert abs(np.mean(np.random.default_rng(0).chisquare(8, 200_000) <= x) - p) < 0.005
