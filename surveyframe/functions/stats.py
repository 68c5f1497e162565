"""Closed-form and short-series statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyframe.functions.basics import clip, col

Z95 = 1.96  # fixed value: two-sided 95 % point


def wilson(k: str | Column, n: str | Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """(rate, low, high) of a proportion; NULL for n = 0."""
    k, n = col(k).cast("double"), F.when(col(n) > 0, col(n)).cast("double")
    p, den = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return p, F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def ln_factorial(n: Column) -> Column:
    """ln n! from a short table below 12 and Stirling's series from there on."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(12)])
    x = n.cast("double")
    series = (x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)))
    return F.when(n < 12, F.get(small, n.cast("int"))).otherwise(series)


def _span(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo.cast("bigint"), hi.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def binomial_two_sided(k: str | Column, n: str | Column) -> Column:
    """Exact two-sided sign test; terms more than 40 standard deviations away add nothing to a double."""
    k, n = col(k).cast("bigint"), col(n).cast("bigint")
    m = F.least(k, n - k)
    low = F.greatest(F.lit(0), (m - 20 * F.sqrt(n.cast("double")) - 1).cast("bigint"))
    ln_n = ln_factorial(n)
    tail = _total(F.transform(_span(low, m), lambda i: F.exp(ln_n - ln_factorial(i) - ln_factorial(n - i) - n * math.log(2.0))))
    return F.when(n == 0, 1.0).when(2 * m == n, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def fisher_two_sided(a: str | Column, b: str | Column, c: str | Column, d: str | Column) -> Column:
    """Exact test of [[a, b], [c, d]]: the sum of all tables no more likely than the observed one."""
    a, b, c, d = (col(x).cast("bigint") for x in (a, b, c, d))
    r1, c1, n = a + b, a + c, a + b + c + d
    fixed = ln_factorial(r1) + ln_factorial(n - r1) + ln_factorial(c1) + ln_factorial(n - c1) - ln_factorial(n)
    ln_p = lambda i: fixed - ln_factorial(i) - ln_factorial(r1 - i) - ln_factorial(c1 - i) - ln_factorial(n - r1 - c1 + i)
    mean = r1.cast("double") * c1 / n
    sd = F.sqrt(mean * (1 - r1 / n) * (1 - c1 / n) * n / F.greatest(n - 1, F.lit(1))) + 1
    # Outward from the mean and from the observed table, wherever that lies.
    lo = F.greatest(F.lit(0), r1 + c1 - n, F.floor(F.least(mean, a.cast("double")) - 40 * sd))
    hi = F.least(r1, c1, F.ceil(F.greatest(mean, a.cast("double")) + 40 * sd))
    seen = ln_p(a)
    total = _total(F.transform(_span(lo, hi), lambda i: F.when(ln_p(i) <= seen + 1e-7, F.exp(ln_p(i))).otherwise(0.0)))
    return F.least(F.lit(1.0), total)


# Coefficients of a rational Chebyshev fit to erfc, relative error 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def normal_tail(z: str | Column) -> Column:
    """P(Z > z)."""
    x = col(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.5 * F.abs(x))
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    half = t * F.exp(-x * x + poly) / 2
    return F.when(x >= 0, half).otherwise(1 - half)


def bisect(f, lo: Column, hi: Column, steps: int = 60) -> Column:
    """Root of f between lo and hi, where f changes sign."""
    start = F.struct(lo.cast("double").alias("a"), hi.cast("double").alias("b"))

    def halve(s, _):
        m = (s["a"] + s["b"]) / 2
        same = F.signum(f(m)) == F.signum(f(s["a"]))
        return F.struct(F.when(same, m).otherwise(s["a"]).alias("a"), F.when(same, s["b"]).otherwise(m).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["a"] + s["b"]) / 2)


def auc_interval(auc: str | Column, m: str | Column, n: str | Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a rank-based AUC that stays usable at a perfect ranking."""
    a, m, n = col(auc), col(m).cast("double"), col(n).cast("double")
    s = (m + n) / 2 - 1

    def gap(t):
        var = t * (1 - t) / (m * n) * (1 + s * (1 - t) / (2 - t) + s * t / (1 + t))
        return (a - t) * (a - t) - z * z * var

    lo = F.when(a > 1e-6, bisect(gap, F.lit(1e-6), a - 1e-9)).otherwise(0.0)
    hi = F.when(a < 1 - 1e-6, bisect(gap, a + 1e-9, F.lit(1 - 1e-9))).otherwise(1.0)
    return lo, hi


def kappa(both: Column, a_pos: Column, b_pos: Column, n: Column) -> Column:
    """Cohen's kappa of two yes/no labelings from counts: both yes, yes in a, yes in b, all."""
    both, a_pos, b_pos, n = (c.cast("double") for c in (both, a_pos, b_pos, n))
    po = (both + (n - a_pos - b_pos + both)) / n
    pe = (a_pos * b_pos + (n - a_pos) * (n - b_pos)) / (n * n)
    return (po - pe) / F.nullif(1 - pe, F.lit(0.0))


def logit(p: str | Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def platt(p: str | Column, a: float, b: float, eps: float = 1e-6) -> Column:
    return sigmoid(a * logit(p, eps) + b)


def prior_shift(p: str | Column, source: str | Column, target: str | Column) -> Column:
    """Posterior under another base rate; both rates are kept in [0.01, 0.99]."""
    p, s, t = col(p), clip(col(source), 0.01, 0.99), clip(col(target), 0.01, 0.99)
    r1, r0 = t / s * p, (1 - t) / (1 - s) * (1 - p)
    return r1 / (r1 + r0)
