"""Distribution functions for drift p-values.

The Kolmogorov limit distribution is a built-in Column expression (a
fixed-length alternating series); the exact distribution for small samples
counts lattice paths.  That, the chi-square and normal upper tails
(regularized incomplete gamma / erfc, which Spark SQL lacks)
run as Arrow-batched pandas UDFs over one row per tested column.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kolmogorov_sf(z: Column, terms: int = 100) -> Column:
    """P(K > z) = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 z^2), clipped to [0, 1]."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.lit(2.0) * F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * z * z))
    return F.when(z < 0.18, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_exact_np(d: float, m: int, n: int) -> float:
    """Exact two-sided P(D >= d) of the two-sample KS statistic, m and n rows without ties.

    Under equal distributions every order of the pooled rows, a lattice path
    from (0, 0) to (m, n), is equally likely; D >= d if the path leaves the
    band |x/m - y/n| < d.  The paths inside are counted row by row (a running
    sum of the row below, cut to the band), in floats scaled after each row;
    the absolute error is about 1e-12.
    """
    m, n = max(m, n), min(m, n)
    if n == 0:
        return 1.0
    g = math.gcd(m, n)
    up, right = m // g, n // g                             # x/m - y/n = (x * right - y * up) / lcm
    lcm = m * right
    h = int(round(d * lcm))                                # the statistic is a multiple of 1 / lcm
    if h <= 0:
        return 1.0
    if h > lcm:
        return 0.0
    row, first, scale = np.ones(1), 0, 0.0                 # below the first row: one path
    for y in range(n + 1):
        low = max(0, (y * up - h) // right + 1)            # smallest x with x * right - y * up > -h
        high = min(m, -((-(y * up + h)) // right) - 1)     # largest x with x * right - y * up < h
        if low > high:
            return 1.0
        below = np.zeros(high - low + 1)
        a, b = max(low, first), min(high, first + len(row) - 1)
        if a <= b:
            below[a - low:b - low + 1] = row[a - first:b - first + 1]
        row, first = np.cumsum(below), low
        top = row[-1]
        if top == 0:
            return 1.0
        row /= top
        scale += math.log(top)
    if first + len(row) - 1 < m:                           # (m, n) itself lies outside only for h <= 0
        return 1.0
    total = math.lgamma(m + n + 1) - math.lgamma(m + 1) - math.lgamma(n + 1)
    return float(min(1.0, max(0.0, 1.0 - math.exp(min(0.0, scale - total)))))


@F.pandas_udf(T.DoubleType())
def ks_exact(d: pd.Series, n_ref: pd.Series, n_cur: pd.Series) -> pd.Series:
    """``ks_exact_np`` per row; null where ``d`` is null."""
    return pd.Series([None if pd.isna(x) else ks_exact_np(float(x), int(m), int(n)) for x, m, n in zip(d, n_ref, n_cur)],
                     dtype="float64")


def ks_pvalue(d: Column, n_ref: Column, n_cur: Column, exact: Column | None = None) -> Column:
    """Two-sided p-value of the two-sample KS statistic: exact where ``exact`` holds, else asymptotic."""
    en = n_ref.cast("double") * n_cur.cast("double") / (n_ref + n_cur).cast("double")
    limit = kolmogorov_sf(F.sqrt(en) * d)
    return limit if exact is None else F.when(exact, ks_exact(F.when(exact, d), n_ref, n_cur)).otherwise(limit)


def _gammaincc(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x) (series / continued fraction).

    Both converge in a multiple of sqrt(a) steps near x = a, so the number of
    steps follows ``a``; running out of them is an error, never a value."""
    if x <= 0 or a <= 0:
        return 1.0
    gln = math.lgamma(a)
    steps = 1000 + 60 * math.isqrt(int(a) + 1)
    if x < a + 1:
        ap, s, delta = a, 1.0 / a, 1.0 / a
        for _ in range(steps):
            ap += 1
            delta *= x / ap
            s += delta
            if abs(delta) < abs(s) * 1e-15:
                break
        else:
            raise ArithmeticError(f"incomplete gamma did not converge: a={a}, x={x}")
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b, c, d = x + 1 - a, 1.0 / 1e-300, 1.0 / (x + 1 - a)
    h = d
    for i in range(1, steps):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 4e-15:
            break
    else:
        raise ArithmeticError(f"incomplete gamma did not converge: a={a}, x={x}")
    return min(1.0, math.exp(-x + a * math.log(x) - gln) * h)


def chi2_sf_np(stat: np.ndarray, dof: np.ndarray) -> np.ndarray:
    out = np.empty(len(stat))
    for i, (s, k) in enumerate(zip(stat, dof)):
        if s is None or k is None or np.isnan(s) or np.isnan(k) or k <= 0:
            out[i] = np.nan
        elif np.isinf(s):
            out[i] = 0.0
        else:
            out[i] = _gammaincc(k / 2.0, s / 2.0)
    return out


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution."""
    return pd.Series(chi2_sf_np(stat.to_numpy(dtype=float), dof.to_numpy(dtype=float)))


@F.pandas_udf(T.DoubleType())
def norm_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal tail 2 * (1 - Phi(|z|)) = erfc(|z| / sqrt 2)."""
    return z.abs().map(lambda v: math.erfc(v / math.sqrt(2.0)) if pd.notna(v) else np.nan)
