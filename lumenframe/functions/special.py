"""Distributions, without scipy: binomial tails and Student's t."""

from __future__ import annotations

from math import exp, lgamma, log, log1p, pi, sqrt


def choose(n: int, k: int) -> float:
    """Binomial coefficient, by logarithms."""
    return exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) if 0 <= k <= n else 0.0


def log_binomial_tail(n: int, k: int, p: float) -> float:
    """Natural logarithm of the chance of k or more hits in n tries."""
    if k <= 0 or p >= 1:
        return 0.0
    if p <= 0 or k > n:
        return float("-inf")
    terms = [lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log1p(-p) for j in range(k, n + 1)]
    top = max(terms)
    return min(0.0, top + log(sum(exp(t - top) for t in terms)))


def binomial_tail(n: int, k: int, p: float) -> float:
    """Chance of k or more hits in n tries."""
    return exp(log_binomial_tail(n, k, p))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized, by Lentz's evaluation of its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return f * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a


def t_two_sided(t: float, df: float) -> float:
    """Chance of a value at least as far from 0, on either side."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def t_density(t: float, df: float) -> float:
    return exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi) * (1 + t * t / df) ** (-(df + 1) / 2) if df > 0 else float("nan")


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3 or r != r:
        return float("nan")
    return 0.0 if abs(r) >= 1 else t_two_sided(r * sqrt((n - 2) / (1 - r * r)), n - 2)


def correlation_density(r: float, n: int) -> float:
    """Density of Student's t at a correlation of n pairs."""
    if n < 3 or r != r:
        return float("nan")
    return 0.0 if abs(r) >= 1 else t_density(r * sqrt((n - 2) / (1 - r * r)), n - 2)
