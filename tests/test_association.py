"""Kendall's tau over parts, phi_k, mixed columns, stationarity and cycles against plain computations."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import association, correlate, cycles

OBS = "run_id string, sample long, seq long, variable string, var_pos int, value double"


def long(spark, columns):
    return spark.createDataFrame([("r", i, i, v, k, x) for k, (v, c) in enumerate(columns.items()) for i, x in enumerate(c)], OBS)


def tau_b(x, y):
    both = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None]
    c = tx = ty = 0
    for i, (a, b) in enumerate(both):
        for p, q in both[:i]:
            c += ((a > p) - (a < p)) * ((b > q) - (b < q))
            tx += a == p
            ty += b == q
    n = len(both) * (len(both) - 1) // 2
    return c / math.sqrt((n - tx) * (n - ty))


@pytest.mark.parametrize("span", [1, 3, 10, 1000])
def test_kendall_in_parts(spark, monkeypatch, span):
    monkeypatch.setattr(correlate, "SPAN", span)
    rng = random.Random(span)
    x = [rng.choice([None, -1.0, 0.0, 0.0, 2.0, rng.random()]) for _ in range(80)]
    y = [None if rng.random() < 0.1 else round((a or 0) + rng.gauss(0, 1), 1) for a in x]
    z = [float(rng.randrange(3)) for _ in x]
    got = {(r["var_a"], r["var_b"]): (r["tau"], r["n_pair"]) for r in correlate.kendall(long(spark, {"x": x, "y": y, "z": z, "one": [1.0] * 80})).collect()}
    for a, b, u, v in (("x", "y", x, y), ("x", "z", x, z), ("y", "z", y, z)):
        assert got[a, b] == (pytest.approx(tau_b(u, v), abs=1e-12), sum(p is not None and q is not None for p, q in zip(u, v, strict=True)))
    assert got["x", "one"][0] is None


def test_weighted_inversions():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 64, 100):
        rank, w = rng.permutation(n), rng.integers(1, 9, n)
        assert correlate.inversions(rank, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if rank[i] > rank[j])
    assert correlate.inversions(np.array([1, 0]), np.array([1 << 40, 1 << 40])) == 1 << 80


def test_bivariate_normal_is_the_integral():
    rng = np.random.default_rng(1)
    for rho in (0.0, 0.3, 0.8, 0.97):
        a, b = rng.normal(size=(2, 2_000_000))
        b = rho * a + math.sqrt(1 - rho**2) * b
        h, k = np.array([-1.0, 0.2, math.inf]), np.array([-0.5, 1.0])
        want = [[float(((a < p) & (b < q)).mean()) for q in k] for p in h]
        assert np.allclose(association.bivariate_normal(h, k, rho), want, atol=2e-3)


def test_phi_k(spark):
    rng = np.random.default_rng(2)
    margins = np.full(10, 0.1)
    from statistics import NormalDist

    cuts = np.array([NormalDist().inv_cdf(q) for q in np.arange(0.1, 1, 0.1)])
    for rho in (0.35, 0.7, 0.9):  # the table of a bivariate normal gives back its correlation
        a, b = rng.normal(size=(2, 400_000))
        b = rho * a + math.sqrt(1 - rho**2) * b
        table = np.zeros((10, 10))
        np.add.at(table, (np.searchsorted(cuts, a), np.searchsorted(cuts, b)), 1)
        chi = association.normal_chi_square(margins, margins, rho)
        scale = 9 / association.normal_chi_square(margins, margins, 1.0)
        found = association.phi_k_of(table)
        assert scale * association.normal_chi_square(margins, margins, found) == pytest.approx(chi, rel=0.02)
    x = rng.normal(size=3000)
    columns = {"x": x.tolist(), "same": (2 * x + 1).tolist(), "square": (x * x).tolist(), "noise": rng.normal(size=3000).tolist(), "flat": [1.0] * 3000, "gaps": [None if i % 3 else float(v) for i, v in enumerate(x)]}
    columns["x"][5] = None
    got = {(r["var_a"], r["var_b"]): r["phi_k"] for r in association.phi_k(long(spark, columns)).collect()}
    assert len(got) == 15
    assert got["x", "same"] > 0.95 and got["x", "square"] > 0.6 and got["x", "noise"] < 0.15 and got["x", "flat"] is None and got["x", "gaps"] > 0.95


def test_auto(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=600)
    rows = [(float(v), float(v**3), "p" if v > 0 else "q", rng.choice(["s", "t"]) if i % 7 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame([(a, b, c, None if d is None else str(d)) for a, b, c, d in rows], "x double, y double, sign string, noise string")
    got = {(r["col_a"], r["col_b"]): (r["method"], r["value"]) for r in association.auto(df, ["x", "y"], ["sign", "noise"]).collect()}
    assert got["x", "y"] == ("spearman", pytest.approx(1.0)) and len(got) == 6
    assert got["x", "sign"][0] == "cramers_v" and got["x", "sign"][1] > 0.8 and got["sign", "noise"][1] < 0.2
    assert association.auto(df.limit(0), ["x", "y"], ["sign"]).count() <= 1


def adf(v, p, first):
    """Ordinary least squares by NumPy."""
    step = np.diff(v, prepend=v[:1])
    t = np.arange(first, len(v))
    z = np.stack([np.ones(len(t)), v[t - 1], *(step[t - k] for k in range(1, p + 1))], axis=1)
    beta, *_ = np.linalg.lstsq(z, step[t], rcond=None)
    rest = step[t] - z @ beta
    s2 = rest @ rest / (len(t) - z.shape[1])
    return beta[1] / math.sqrt(s2 * np.linalg.inv(z.T @ z)[1, 1]), len(t) * math.log(rest @ rest / len(t)) + 2 * z.shape[1]


@pytest.mark.parametrize("span", [1000, 37])
def test_augmented_dickey_fuller(spark, monkeypatch, span):
    monkeypatch.setattr(cycles, "SPAN", span)
    rng = np.random.default_rng(4)
    e = rng.normal(size=300)
    walk, steady = np.cumsum(e) + 1e5, e.copy()
    for t in range(3, 300):
        steady[t] += 0.5 * steady[t - 1] - 0.3 * steady[t - 3]
    gaps = [None if i % 11 == 4 else float(v) for i, v in enumerate(steady)]
    data = long(spark, {"walk": walk.tolist(), "steady": steady.tolist(), "gaps": gaps, "flat": [2.0] * 300, "short": [1.0, 3.0, 2.0] + [None] * 297})
    series = {"walk": walk, "steady": steady, "gaps": np.array([v for v in gaps if v is not None])}
    got = {r["variable"]: r for r in cycles.augmented_dickey_fuller(data).collect()}
    for name, v in series.items():
        deepest = cycles.most_lags(len(v))
        best = min(range(deepest + 1), key=lambda p: adf(v, p, deepest + 1)[1])
        assert got[name]["lags"] == best and got[name]["n"] == len(v) - deepest - 1
        assert got[name]["statistic"] == pytest.approx(adf(v, best, deepest + 1)[0], rel=1e-6)
    assert got["steady"]["stationary"] and not got["walk"]["stationary"] and got["flat"]["statistic"] is None and got["short"]["statistic"] is None
    fixed = {r["variable"]: r for r in cycles.augmented_dickey_fuller(data, lags=2).collect()}
    assert fixed["walk"]["statistic"] == pytest.approx(adf(walk, 2, 3)[0], rel=1e-6) and fixed["walk"]["n"] == 297


@pytest.mark.parametrize("span", [1000, 23])
def test_cycles(spark, monkeypatch, span):
    monkeypatch.setattr(cycles, "SPAN", span)
    rng = np.random.default_rng(5)
    t = np.arange(240)
    wave, noise = np.sin(2 * np.pi * t / 12) * 3 + rng.normal(size=240), rng.normal(size=240)
    data = long(spark, {"wave": wave.tolist(), "noise": noise.tolist(), "flat": [0.0] * 240})
    power = {(r["variable"], r["k"]): r["power"] for r in cycles.periodogram(data).collect()}
    want = np.abs(np.fft.rfft(wave))[1:121] ** 2 / 240
    assert [power["wave", k] for k in range(1, 121)] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9)
    got = {r["variable"]: r for r in cycles.seasonality(data).collect()}
    assert got["wave"]["period"] == 12 and got["wave"]["seasonal"] and not got["flat"]["seasonal"]
    assert cycles.periodogram(data.limit(0)).count() == 0
    assert cycles.periodogram(data.where("seq = 0")).count() == 0  # one value has no cycle


def test_infinite_values_count_as_missing(spark):
    from tidemark.operators import profile

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(2, 200))
    odd, plain = x.tolist(), x.tolist()
    odd[3], odd[7] = math.inf, -math.inf
    plain[3] = plain[7] = None
    for f in (profile.histogram, profile.kde, correlate.pearson):
        a, b = (sorted(map(str, f(long(spark, {"x": v, "y": y.tolist()})).collect())) for v in (odd, plain))
        assert a == b and a
