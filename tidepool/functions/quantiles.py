"""Quantiles and tail probabilities, by series, continued fractions and bisection."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

normal_quantile = NormalDist().inv_cdf


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def gamma_cdf(x: float, a: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    total = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * total


def _inverse(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def beta_quantile(p: float, a: float, b: float) -> float:
    return _inverse(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def t_cdf(t: float, dof: float) -> float:
    tail = beta_cdf(dof / (dof + t * t), dof / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, dof: float) -> float:
    return _inverse(lambda x: t_cdf(x, dof), p, -1e7, 1e7)


def chi2_sf(x: float, dof: float) -> float:
    return 1 - gamma_cdf(x / 2, dof / 2)


def chi2_quantile(p: float, dof: float) -> float:
    return _inverse(lambda x: gamma_cdf(x / 2, dof / 2), p, 0.0, 100.0 + 20 * dof)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Limits of a share k / n."""
    low = 0.0 if k == 0 else beta_quantile(alpha / 2, k, n - k + 1)
    high = 1.0 if k == n else beta_quantile(1 - alpha / 2, k + 1, n - k)
    return low, high
