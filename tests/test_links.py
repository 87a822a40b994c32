"""Aggregations over links, on rows written out with their exact results."""

import numpy as np
import pytest

from tidemark.operators import causal

ROWS = [
    ("0", "a", "b", 1, 0.60, 0.0010), ("1", "a", "b", 1, 0.50, 0.0020), ("2", "a", "b", 1, 0.70, 0.0005), ("3", "a", "b", 1, 0.55, 0.0030),
    ("0", "a", "b", 2, 0.20, 0.0090), ("2", "a", "b", 2, -0.30, 0.0080),
    ("0", "b", "c", 0, 0.80, 0.0001), ("1", "b", "c", 0, 0.75, 0.0001), ("2", "b", "c", 0, 0.85, 0.0001), ("3", "b", "c", 0, 0.90, 0.0001),
    ("0", "c", "b", 0, 0.80, 0.0001), ("1", "c", "b", 0, 0.75, 0.0001), ("2", "c", "b", 0, 0.85, 0.0001), ("3", "c", "b", 0, 0.90, 0.0001),
    ("0", "a", "a", 1, 0.90, 0.0001), ("1", "a", "a", 1, 0.95, 0.0001), ("2", "a", "a", 2, 0.40, 0.0040),
    ("1", "c", "a", 3, -0.35, 0.0070), ("3", "c", "d", 1, 0.25, 0.0095), ("3", "d|e", "a", 1, 0.45, 0.0060),
]


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(ROWS, causal.LINKS)


def by_link(df, *columns):
    return {(r["src"], r["tgt"], r["tau"]): tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()}


def test_frequencies(links):
    freq = causal.link_frequency(links)
    got = by_link(freq, "n_runs", "mean_val")
    assert got["a", "b", 1] == (4, 0.5875) and got["a", "b", 2] == (2, -0.05) and got["d|e", "a", 1] == (1, 0.45) and len(got) == 9
    assert by_link(causal.lag_profile(links), "freq", "mean_abs", "sd_abs")["a", "b", 2] == (2, 0.25, 0.05)
    agreed = causal.consensus(freq, 4)
    assert {k for k, v in by_link(agreed, "consensus").items() if v[0]} == {("a", "b", 1), ("b", "c", 0), ("c", "b", 0)}
    assert tuple(causal.summary(agreed).first()) == (9, 3, 6)
    assert set(by_link(causal.majority(freq, 4), "n_runs")) == {("a", "b", 1), ("a", "b", 2), ("b", "c", 0), ("c", "b", 0)}
    assert by_link(causal.consensus_graph(freq, 4), "kind") == {("a", "b", 1): ("-->",), ("b", "c", 0): ("o-o",), ("c", "b", 0): ("o-o",)}
    assert [tuple(r) for r in causal.strongest_self(freq).collect()] == [("a", 1, pytest.approx(0.925))]
    assert {(r["src"], r["tgt"], r["tau"]) for r in causal.top_links(freq, 2).collect()} == {("a", "b", 1), ("b", "c", 0)}
    degree = {r["variable"]: (r["out_degree"], r["in_degree"], r["targets"]) for r in causal.degrees(freq).collect()}
    assert degree["a"] == (4, 4, ["a", "b"]) and degree["d"] == (0, 1, []) and degree["d|e"] == (1, 0, ["a"])


def panel(seed, n_vars, tau, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, n_vars))
    for t in range(2, n):
        x[t, 1] += 0.8 * x[t - 1, 0]
        x[t, 2 % n_vars] += 0.6 * x[t - 2, 1]
    z = np.concatenate([x[2 * tau - k : n - k] for k in range(2 * tau + 1)], axis=1)
    return causal.Moments(len(z), z.sum(0), z.T @ z, n_vars)


def plain(own, a, b, given):
    keep = [a, b, *given]
    inverse = np.linalg.pinv(own.corr[np.ix_(keep, keep)])
    return -inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1])


def test_shared_factorisations_equal_single_tests():
    """The parents are those of a search that makes every test by itself."""
    for seed in range(4):
        own, tau, alpha = panel(seed, 4, 3), 3, 0.2
        for j in range(4):
            left = [k * 4 + i for i in range(4) for k in range(1, tau + 1)]
            weakest, size = dict.fromkeys(left, np.inf), 0
            while len(left) > size:
                gone = []
                for c in left:
                    given = [o for o in left if o != c][:size]
                    r = plain(own, j, c, given)
                    weakest[c] = min(weakest[c], abs(r))
                    if own.p_values(np.array([r]), size)[0] > alpha:
                        gone.append(c)
                left = sorted((c for c in left if c not in gone), key=lambda c: -weakest[c])
                size += 1
            assert causal.parents(own, j, tau, alpha).tolist() == left


def test_singular_conditions():
    own = panel(1, 3, 2)
    own.corr[:, 5] = own.corr[:, 4]
    own.corr[5, :] = own.corr[4, :]
    assert own.partial(0, np.array([7]), np.array([4, 5, 8]))[0] == pytest.approx(own.partial(0, np.array([7]), np.array([4, 8]))[0], abs=1e-9)
    assert own.partial(4, np.array([5]), np.array([8]))[0] == pytest.approx(1.0) and own.partial(0, np.array([5]), np.array([4]))[0] == 0.0
