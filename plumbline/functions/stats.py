"""Distribution functions and intervals for the handful of numbers that end on the driver, and their Column forms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + num * d or tiny)
        c = 1.0 + num / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    """The quantile of Student's t by bisection, to 1e-12."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p:
        lo *= 2
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
        if hi - lo < 1e-12 * max(1.0, abs(mid)):
            break
    return (lo + hi) / 2


def f_upper(f: float, d1: float, d2: float) -> float:
    """The upper tail of the F distribution."""
    return 1.0 if f <= 0 else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def hypergeom_below(n_all: int, n_good: int, k: int, m: int) -> float:
    """The chance that fewer than ``m`` of ``k`` drawn without replacement are among the ``n_good`` of ``n_all``."""
    total = math.comb(n_all, k)
    if total == 0:
        return math.nan
    return sum(math.comb(n_good, j) * math.comb(n_all - n_good, k - j) for j in range(0, min(m, k + 1))) / total


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k out of n; null for n = 0."""
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def log_contrast(selected: Column, mean_log_null: Column) -> Column:
    """ln of the selected value minus the mean log of the null's; null where the value is not positive."""
    return F.when(selected > 0, F.ln(selected) - mean_log_null)


def null_bias_bounds(log_selected: Column, log_survivors: Column, fraction: Column, m: int) -> tuple[Column, Column]:
    """Bracket of the contrast when the ``fraction`` of null draws that could not be evaluated had the greatest
    diversity ln m, or the least, 0."""
    upper = log_selected - (1 - fraction) * log_survivors
    return upper - fraction * math.log(m), upper


def z_score(x: Column, window) -> Column:
    """Population z-score with a guarded spread."""
    return (x - F.avg(x).over(window)) / (F.stddev_pop(x).over(window) + 1e-12)
