"""Distribution tails for test statistics.

Only aggregate rows (a handful per test) ever reach these functions, so a
vectorised Python helper behind a pandas UDF is enough.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _stirling_rest(z: float) -> float:
    """lgamma(z) less (z - 1/2) ln z - z + ln(2 pi) / 2, for z of 10 or more."""
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z


def _log_gamma_ratio(a: float, b: float) -> float:
    """lgamma(a + b) - lgamma(a) without the cancellation of two large values."""
    if a < 10.0:
        return math.lgamma(a + b) - math.lgamma(a)
    grown = (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b
    return grown + _stirling_rest(a + b) - _stirling_rest(a)


def _beta_tail(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction; y is 1 - x, given
    apart because it may be too small to tell from x. NaN if the fraction does not settle."""
    if not (a > 0 and b > 0) or math.isnan(x) or math.isnan(y):
        return math.nan
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    # near x = 1 the fraction's own terms cancel, so the other end serves there, too; further out
    # its terms grow beyond what they sum to
    if x > (a + 1.0) / (a + b + 2.0) or x > 0.9 and y * (a + b + 2.0) < 8.0 and b < a:
        return 1.0 - _beta_fraction(b, a, y, x)
    return _beta_fraction(a, b, x, y)


def _beta_fraction(a: float, b: float, x: float, y: float) -> float:
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    large, small = max(a, b), min(a, b)
    front = math.exp(_log_gamma_ratio(large, small) - math.lgamma(small) + a * log_x + b * log_y) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 20_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return front * h
    return math.nan


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if not a > 0 or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 20_000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return scale * h
    return math.nan


def f_tail(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or f < 0:
        return math.nan
    return _beta_tail(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def t_tail(t: float, dof: float) -> float:
    """Two-sided Student t tail."""
    return _beta_tail(dof / 2.0, 0.5, dof / (dof + t * t), t * t / (dof + t * t))


def chi2_tail(x: float, dof: float) -> float:
    return _gamma_upper(dof / 2.0, x / 2.0)


def normal_tail(z: float) -> float:
    """Two-sided standard normal tail."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _apply(fn, *cols: pd.Series) -> pd.Series:
    out = [
        fn(*map(float, vals)) if all(v is not None and not pd.isna(v) for v in vals) else np.nan
        for vals in zip(*cols)
    ]
    return pd.Series(out, dtype="float64")


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _apply(f_tail, a, b, c)

    return F.nanvl(tail(f, d1.cast("double"), d2.cast("double")), F.lit(None).cast("double"))


def t_p_value(t: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return _apply(t_tail, a, b)

    return F.nanvl(tail(t, dof.cast("double")), F.lit(None).cast("double"))


def chi2_p_value(x: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return _apply(chi2_tail, a, b)

    return F.nanvl(tail(x, dof.cast("double")), F.lit(None).cast("double"))


def normal_p_value(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series) -> pd.Series:
        return _apply(normal_tail, a)

    return F.nanvl(tail(z.cast("double")), F.lit(None).cast("double"))
