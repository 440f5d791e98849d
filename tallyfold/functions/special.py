"""Tail probabilities of the chi-square, t and F distributions for result rows.

They are applied to one row per tested column pair, never to data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _upper_gamma_ratio(a: float, x: float) -> float:
    """Q(a, x): series below a + 1, Lentz continued fraction above."""
    if x <= 0:
        return 1.0
    log_head = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_head))
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / ((step * d + b) or tiny)
        c = (b + step / c) or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return math.exp(log_head) * h


def _beta_ratio(a: float, b: float, x: float) -> float:
    """I_x(a, b) by the continued fraction, using the symmetry for fast convergence."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_ratio(b, a, 1.0 - x)
    log_head = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
    h = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + step * d) or tiny)
            c = (1.0 + step / c) or tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return math.exp(log_head) * h / a


def chi2_tail(x: float, df: float) -> float:
    return _upper_gamma_ratio(df / 2.0, x / 2.0)


def t_tail_two_sided(t: float, df: float) -> float:
    return _beta_ratio(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else _beta_ratio(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def _usable(*values: float) -> bool:
    return all(v is not None and math.isfinite(v) for v in values)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) if _usable(a, b) and b > 0 else None for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [t_tail_two_sided(a, b) if _usable(a, b) and b > 0 else None for a, b in zip(t, df)], dtype="float64"
    )


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(
        [f_tail(a, b, c) if _usable(a, b, c) and b > 0 and c > 0 else None for a, b, c in zip(f, d1, d2)],
        dtype="float64",
    )
