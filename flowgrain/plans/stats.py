"""Tails of the t and F distributions and p-by-p algebra, on the driver.

Inputs are a handful of numbers that aggregations return.
"""

from __future__ import annotations

import math

import numpy as np


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_tail(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def _solve(fn, target: float, low: float = 0.0) -> float:
    high = 1.0
    while fn(high) > target and high < 1e12:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if fn(mid) > target else (low, mid)
    return 0.5 * (low + high)


def t_critical(alpha: float, df: float) -> float:
    """Value exceeded in absolute terms with probability ``alpha``."""
    return _solve(lambda t: t_two_sided(t, df), alpha)


def f_critical(alpha: float, d1: float, d2: float) -> float:
    return _solve(lambda f: f_upper(f, d1, d2), alpha)


def pseudo_inverse(h: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(h)
