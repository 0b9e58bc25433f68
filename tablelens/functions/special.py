"""Tail probabilities for the tests (t, F, chi-square).

Regularised incomplete beta and gamma functions by their continued fractions
(Lentz's method, as in any numerical-methods text), and normal approximations
with correction terms where the degrees of freedom are huge. They run on
*result* rows only (one per column pair or test). A fraction or series that
does not converge raises; an unconverged value is never returned.
"""

from __future__ import annotations

import math

_EPS = 3e-16
_TINY = 1e-300
_MAXIT = 1_000_000
_LARGE = 1e6   # degrees of freedom from which the asymptotic forms are used (their error is below 1e-9 there)


def _stirling_rest(x: float) -> float:
    """lgamma(x) less the leading terms of Stirling's series, x >= 10."""
    y = 1.0 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def log_beta(a: float, b: float) -> float:
    """log B(a, b) without subtracting large logarithms of gamma."""
    p, q = min(a, b), max(a, b)
    if p >= 10:
        rest = _stirling_rest(p) + _stirling_rest(q) - _stirling_rest(p + q)
        return (-0.5 * math.log(q) + 0.5 * math.log(2 * math.pi) + rest
                + (p - 0.5) * math.log(p / (p + q)) + q * math.log1p(-p / (p + q)))
    if q >= 10:
        rest = _stirling_rest(q) - _stirling_rest(p + q)
        return math.lgamma(p) + rest + p - p * math.log(p + q) + (q - 0.5) * math.log1p(-p / (p + q))
    return math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q)


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, _MAXIT):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return h
    raise ArithmeticError(f"incomplete beta did not converge at a={a}, b={b}, x={x}")


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x where it is known better."""
    if x is None or a is None or b is None or math.isnan(x) or a <= 0 or b <= 0:
        return float("nan")
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    y = 1.0 - x if y is None else y
    if y <= 0.0:
        return 1.0
    lbt = a * (math.log1p(-y) if y < 0.5 else math.log(x)) + b * math.log(y) - log_beta(a, b)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, y) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x is None or a is None or math.isnan(x) or a <= 0:
        return float("nan")
    if x <= 0.0:
        return 1.0
    if a > _LARGE:
        return _gammaincc_large(a, x)
    lg = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1.0:  # series for P, then Q = 1 - P
        ap, s = a, 1.0 / a
        term = s
        for _ in range(_MAXIT):
            ap += 1.0
            term *= x / ap
            s += term
            if abs(term) < abs(s) * _EPS:
                return max(0.0, 1.0 - s * math.exp(lg))
        raise ArithmeticError(f"incomplete gamma series did not converge at a={a}, x={x}")
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAXIT):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return math.exp(lg) * h
    raise ArithmeticError(f"incomplete gamma fraction did not converge at a={a}, x={x}")


def _gammaincc_large(a: float, x: float) -> float:
    """Q(a, x) for large a: the uniform normal approximation with its first two corrections."""
    mu = (x - a) / a
    if abs(mu) < 1e-4:   # the closed forms below cancel here
        half = mu * mu * (0.5 - mu * (1 / 3 - mu * (0.25 - mu * 0.2)))
    else:
        half = mu - math.log1p(mu)
    eta = math.copysign(math.sqrt(2 * half), mu)
    if abs(mu) < 1e-2:
        c0 = -1 / 3 + eta * (1 / 12 - eta * (2 / 135 - eta / 864))
        c1 = -1 / 540 - eta / 288
    else:
        c0 = 1 / mu - 1 / eta
        c1 = 1 / eta ** 3 - 1 / mu ** 3 - 1 / mu ** 2 - 1 / (12 * mu)
    tail = math.exp(-a * half) / math.sqrt(2 * math.pi * a) * (c0 + c1 / a)
    return min(1.0, max(0.0, 0.5 * math.erfc(eta * math.sqrt(a / 2)) + tail))


def t_two_sided_from_r(r: float, n: float) -> float:
    """Two-sided p of a correlation r on n pairs (t test with n-2 dof)."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    dof = n - 2.0
    if dof > _LARGE:   # the t statistic as a normal deviate; the error falls with dof squared
        z = (8 * dof + 1) / (8 * dof + 3) * math.sqrt(dof * -math.log1p(-r * r))
        return math.erfc(z / math.sqrt(2))
    return betainc(dof / 2.0, 0.5, 1.0 - r * r, r * r)


def chi2_sf(x: float, dof: float) -> float:
    if x is None or dof is None or math.isnan(x):
        return float("nan")
    if dof <= 0:
        return 1.0
    return gammaincc(dof / 2.0, x / 2.0)


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or d1 is None or d2 is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    if d2 > 1e4 * d1 * max(1.0, d1) and d2 > 1e8:   # the denominator is as good as constant
        return chi2_sf(d1 * f, d1)
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))
