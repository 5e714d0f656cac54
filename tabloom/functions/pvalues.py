"""Upper tail probabilities, evaluated for one row per feature.

Series and continued fractions as in Abramowitz & Stegun 6.5 and 26.5; plain
Python so that they also work where no JVM gateway is reachable.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_TINY = 1e-300


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        for _ in range(10000):
            k += 1
            term *= x / k
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - total * math.exp(log_front))
    b = x + 1 - a
    cc = 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or _TINY)
        cc = (b + an / cc) or _TINY
        step = d * cc
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return min(1.0, math.exp(log_front) * h)


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(b, a, 1 - x)
    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    )
    cc, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or _TINY)
    h = d
    for m in range(1, 10000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + num * d) or _TINY)
            cc = (1 + num / cc) or _TINY
            step = d * cc
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h / a


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def f_tail(x: float, d1: float, d2: float) -> float:
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    return beta_lower(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * x))


def _over(fn, *series: pd.Series) -> pd.Series:
    rows = zip(*series)
    return pd.Series([None if any(pd.isna(v) for v in r) else fn(*map(float, r)) for r in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _over(chi2_tail, x, df)


@F.pandas_udf(T.DoubleType())
def _f(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _over(f_tail, x, d1, d2)


def chi2_p(x: Column, df: Column) -> Column:
    return _chi2(x.cast("double"), df.cast("double"))


def f_p(x: Column, d1: Column, d2: Column) -> Column:
    return _f(x.cast("double"), d1.cast("double"), d2.cast("double"))
