"""Distribution functions from series and continued fractions, without SciPy."""

from __future__ import annotations

from math import exp, lgamma, log, nan, pi, sqrt
from statistics import NormalDist

_NORMAL = NormalDist()
_TINY = 1e-300


def normal_pdf(x: float) -> float:
    return exp(-x * x / 2) / sqrt(2 * pi)


def normal_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function, by Lentz's evaluation of its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), _TINY)
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def gamma_tail(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    b, c = x + 1 - a, 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2) if df > 0 and x == x else nan


def f_tail(x: float, df1: float, df2: float) -> float:
    if not (df1 > 0 and df2 > 0 and x == x):
        return nan
    return 1.0 if x <= 0 else beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * x))


def t_tail(x: float, df: float) -> float:
    """Two-sided tail of Student's t; df None or infinite: normal."""
    if df is None or df == float("inf"):
        return 2 * normal_cdf(-abs(x))
    return beta_tail(df / 2, 0.5, df / (df + x * x)) if df > 0 and x == x else nan
