import math

import numpy as np
import pytest

from tidemark.functions import stats


def test_incomplete_beta_identities():
    a, b, x = np.array([0.5, 2.0, 7.3, 150.0]), np.array([0.5, 3.0, 1.2, 80.5]), np.array([0.3, 0.5, 0.9, 0.65])
    assert np.allclose(stats.betainc(a, b, x), 1 - stats.betainc(b, a, 1 - x), atol=1e-12)
    assert stats.betainc(1, 1, 0.37) == pytest.approx(0.37)
    assert stats.betainc(2, 2, 0.5) == pytest.approx(0.5)
    assert stats.betainc(0.5, 0.5, 0.25) == pytest.approx(2 / math.pi * math.asin(0.5))


def test_tabulated_quantiles():
    assert 1 - stats.f_cdf(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert 1 - stats.f_cdf(2.8655, 4, 20) == pytest.approx(0.05, abs=1e-4)
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert stats.z_critical(0.05) == pytest.approx(1.959963985)


@pytest.mark.parametrize(("n", "h"), [(1, 7.3531), (4, 8.738), (5, 8.9611), (52, 11.3025), (64, 11.5101)])
def test_decision_interval(n, h):
    assert stats.decision_interval(5000, n, 0.5) == pytest.approx(h, abs=1e-3)
