"""Tails and quantiles of the t, F and chi-square distributions on `math` alone."""

from __future__ import annotations

import math


def beta_regularized(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction (modified Lentz evaluation)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularized(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    value = d
    for m in range(1, 1000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * value


def gamma_upper(s: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - s, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b)
        c = b + a / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * front


def t_two_sided(t: float, dof: float) -> float:
    return beta_regularized(dof / 2, 0.5, dof / (dof + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_regularized(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)


def _root(upper_tail, tail: float, high: float) -> float:
    low = 0.0
    while upper_tail(high) > tail:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper_tail(mid) > tail else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, dof: float) -> float:
    """The point below which t lies with probability p of at least a half."""
    return _root(lambda t: t_two_sided(t, dof), 2 * (1 - p), 10.0)


def chi2_quantile(p: float, dof: float) -> float:
    return _root(lambda x: chi2_upper(x, dof), 1 - p, 10.0)
