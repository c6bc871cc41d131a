"""Distribution functions: numpy on the driver, pandas UDFs for columns; no SciPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS, _TINY, _STEPS = 1e-15, 1e-300, 500


def gamma(x: float) -> float:
    return math.gamma(x)


def beta(a: float, b: float) -> float:
    return math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    out = d
    for m in range(1, _STEPS):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + top / c
            c = c if abs(c) > _TINY else _TINY
            out *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return out


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1 - x, b, a) / b


def incomplete_gamma(s: float, x: float) -> float:
    """Regularised lower P(s, x)."""
    if x <= 0:
        return 0.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        n = s
        for _ in range(10 * _STEPS):
            n += 1
            term *= x / n
            total += term
            if term < total * _EPS:
                break
        return front * total
    b = x + 1 - s
    c, d = 1 / _TINY, 1 / b
    out = d
    for i in range(1, 10 * _STEPS):
        a = -i * (i - s)
        b += 2
        d = 1.0 / (b + a * d)
        c = b + a / c
        out *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return 1.0 - front * out


def normal_pdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    z = (x - mean) / sd
    return math.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * math.erfc(-(x - mean) / (sd * math.sqrt(2)))


standard_normal_cdf = normal_cdf


def normal_ppf(p: float) -> float:
    """Inverse of the standard normal CDF, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def chi_squared_pdf(x: float, df: float) -> float:
    return 0.0 if x <= 0 else math.exp((df / 2 - 1) * math.log(x) - x / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))


def chi_squared_cdf(x: float, df: float) -> float:
    return incomplete_gamma(df / 2, x / 2)


def chi_squared_p_value(x: float, df: float) -> float:
    return 1.0 - chi_squared_cdf(x, df)


def t_pdf(x: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / (df + x * x), df / 2, 0.5)
    return 1 - tail if x > 0 else tail


def t_test_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def f_pdf(x: float, d1: float, d2: float) -> float:
    if x <= 0:
        return 0.0
    log = d1 / 2 * math.log(d1 / d2) + (d1 / 2 - 1) * math.log(x) - (d1 + d2) / 2 * math.log1p(d1 * x / d2)
    return math.exp(log) / beta(d1 / 2, d2 / 2)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 0.0 if x <= 0 else incomplete_beta(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2)


def f_test_p_value(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else incomplete_beta(d2 / (d1 * x + d2), d2 / 2, d1 / 2)


def column(f, *args: Column | str | float) -> Column:
    """f over columns or constants, batch by batch; NULL or NaN in gives NULL out."""

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        rows = np.column_stack([np.asarray(c, float) for c in cols])
        return pd.Series([None if np.isnan(r).any() else f(*r) for r in rows], dtype="float64")

    return run(*[F.col(a) if isinstance(a, str) else a if isinstance(a, Column) else F.lit(float(a)) for a in args])


def normal_cdf_expr(x: Column) -> Column:
    """Standard normal CDF without Python: the rational approximation of erf of absolute error 1.5e-7."""
    # Coefficients of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + p * z)
    poly = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)
