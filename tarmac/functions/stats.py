"""Tails of distributions, in plain Python and as vectorised columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0 or a <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if abs(an * d + b) > 1e-300 else 1e-300)
        c = b + an / c if abs(b + an / c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        before = h
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(h - before) < 1e-15 * abs(h):
            break
    return front * h


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def chi2_quantile(p: float, df: float) -> float:
    """By bisection."""
    lo, hi = 0.0, max(10.0, df * 10)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - chi2_sf(mid, df) < p else (lo, mid)
    return lo


def normal_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _column(f, *cols: Column) -> Column:
    @F.pandas_udf("double")
    def run(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else f(*row) for row in zip(*args, strict=True)], dtype="float64")

    return run(*[c.cast("double") for c in cols])


def chi2_p(x: Column, df: Column) -> Column:
    return _column(chi2_sf, x, df)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, f, d1, d2)


def t_p(t: Column, df: Column) -> Column:
    return _column(t_sf2, t, df)


def normal_p(z: Column) -> Column:
    return _column(normal_sf2, z)


def hypergeometric_v(k: float, draws: float, good: float, total: float) -> float:
    """v-test of k good ones among `draws` of `total`, by mid-probability tails as a normal quantile."""
    log_c = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    pmf = lambda i: math.exp(log_c(good, i) + log_c(total - good, draws - i) - log_c(total, draws))
    lo, hi = max(0, int(draws + good - total)), int(min(draws, good))
    over = k * total > draws * good
    tail, i, step = pmf(k) / 2, int(k), 1 if over else -1
    own = tail
    while lo <= i + step <= hi:  # terms fall off geometrically away from the mean
        i += step
        term = pmf(i)
        tail += term
        if term < 1e-17 * max(tail, own):
            break
    p = min(max(tail, 1e-300), 0.5)
    v = -NormalDist().inv_cdf(p) if p > 1e-300 else 37.0
    return v if over else -v


def hypergeometric_vtest(k: Column, draws: Column, good: Column, total: Column) -> Column:
    return _column(hypergeometric_v, k, draws, good, total)
