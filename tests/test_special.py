"""Tail probabilities against closed forms (no Spark)."""
import math

import pytest

from tablelens.functions.special import betainc, chi2_sf, f_sf, gammaincc, t_two_sided_from_r


@pytest.mark.parametrize("x", [0.1, 1.0, 3.2, 10.0, 40.0])
def test_chi2_even_dof_closed_form(x):
    assert chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
    assert chi2_sf(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)


@pytest.mark.parametrize("x", [0.01, 0.5, 2.0, 7.5, 20.0])
def test_chi2_one_dof_is_erfc(x):
    assert chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10, abs=1e-300)


@pytest.mark.parametrize("f,d2", [(0.3, 10), (2.5, 100), (7.0, 5), (1.0, 1000)])
def test_f_with_two_numerator_dof(f, d2):
    assert f_sf(f, 2, d2) == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), rel=1e-10)


def _t_series(r, n):
    """Abramowitz–Stegun finite series for the two-sided t tail."""
    nu = n - 2
    s, c = abs(r), math.sqrt(1 - r * r)
    if nu % 2 == 0:
        term, acc = 1.0, 1.0
        for j in range(1, nu // 2):
            term *= (2 * j - 1) / (2 * j) * c * c
            acc += term
        return 1 - s * acc
    theta = math.asin(s)
    if nu == 1:
        return 1 - 2 * theta / math.pi
    term, acc = c, c
    for j in range(1, (nu - 1) // 2):
        term *= (2 * j) / (2 * j + 1) * c * c
        acc += term
    return 1 - 2 / math.pi * (theta + s * acc)


@pytest.mark.parametrize("r,n", [(0.1, 10), (0.5, 11), (-0.3, 30), (0.05, 501), (0.9, 6), (0.2, 3)])
def test_correlation_p_matches_series(r, n):
    assert t_two_sided_from_r(r, n) == pytest.approx(_t_series(r, n), rel=1e-9, abs=1e-14)


def test_edges():
    assert t_two_sided_from_r(1.0, 10) == 0.0
    assert math.isnan(t_two_sided_from_r(0.5, 2))
    assert chi2_sf(0.0, 3) == 1.0
    assert chi2_sf(5.0, 0) == 1.0
    assert betainc(2, 3, 0.0) == 0.0 and betainc(2, 3, 1.0) == 1.0
    assert gammaincc(1.0, 2.0) == pytest.approx(math.exp(-2.0), rel=1e-12)


@pytest.mark.parametrize("x,dof", [(55.5, 57), (3.0, 3), (40.0, 21), (0.7, 5)])
def test_chi2_odd_dof_against_lower_series(x, dof):
    a, z = dof / 2, x / 2
    lower = sum(math.exp((a + k) * math.log(z) - z - math.lgamma(a + k + 1)) for k in range(2000))
    assert chi2_sf(x, dof) == pytest.approx(1 - lower, abs=1e-12)


@pytest.mark.parametrize("n", [1e6, 1e9, 1e12])
def test_large_samples_reach_the_normal_limit(n):
    r = 1 / math.sqrt(n)
    assert t_two_sided_from_r(r, n) == pytest.approx(math.erfc(math.sqrt(0.5)), rel=2e-6)
    assert chi2_sf(n, n) == pytest.approx(0.5 - 1 / (3 * math.sqrt(math.pi * n)), abs=1e-9)
    assert chi2_sf(n + math.sqrt(2 * n), n) == pytest.approx(0.5 * math.erfc(math.sqrt(0.5)), abs=2e-4)
    assert f_sf(1.0, 2, n) == pytest.approx(math.exp(-1), rel=2e-6)


def test_asymptotic_forms_meet_the_fractions(monkeypatch):
    from tablelens.functions import special
    points = [(4e5 + 900, 4e5), (4e5 - 900, 4e5), (4.2e5, 4e5)]
    exact = [chi2_sf(*p) for p in points] + [t_two_sided_from_r(2e-3, 1e6)]
    monkeypatch.setattr(special, "_LARGE", 1e3)
    assert [chi2_sf(*p) for p in points] + [t_two_sided_from_r(2e-3, 1e6)] == pytest.approx(exact, rel=1e-8, abs=1e-12)
