"""Student-t tail and quantile for one-row test results.

Both numbers need an inverse special function that Spark has no expression
for.  They are evaluated on the finished result row only (a handful of rows),
never on data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta, evaluated from the tail."""
    value = 0.0
    for m in range(400, 0, -1):
        half, odd = divmod(m, 2)
        if odd:
            term = -(a + half) * (a + b + half) * x
            term /= (a + 2 * half) * (a + 2 * half + 1)
        else:
            term = half * (b - half) * x / ((a + 2 * half - 1) * (a + 2 * half))
        value = term / (1.0 + value)
    return 1.0 / (1.0 + value)


def _beta_ratio(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, df: float) -> float:
    return _beta_ratio(df / 2, 0.5, df / (df + t * t))


def quantile(p: float, df: float) -> float:
    """Upper quantile for p > 0.5, by bisection on the two-sided tail."""
    tail = 2 * (1 - p)
    lo, hi = 0.0, 1.0
    while two_sided_p(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if two_sided_p(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [two_sided_p(a, b) if pd.notna(a) and pd.notna(b) else None
         for a, b in zip(t, df)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [quantile(a, b) if pd.notna(b) else None for a, b in zip(p, df)],
        dtype="float64",
    )
