"""Closed forms of correlation inference, as column expressions where SQL has the functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959963984540054


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    half = F.try_divide(F.lit(Z95), F.sqrt(F.greatest(n - 3, F.lit(0))))
    z = F.atanh(r)
    return F.tanh(z - half), F.tanh(z + half)


def t_value(r: Column, n: Column) -> Column:
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt(F.try_divide(n - 2, 1 - r * r)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t. One row per test; SQL has no incomplete beta function."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(n) else incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df)], dtype="float64")

    return p(t, df)


def normal_p_value(z: Column) -> Column:
    """Two-sided p of a normal deviate."""

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)) for x in z], dtype="float64")

    return p(z)


def steiger_z(jk: Column, jh: Column, kh: Column, n: Column) -> Column:
    """Test of two correlations that share a variable."""
    r = (jk + jh) / 2
    rr = r * r
    s = F.try_divide(kh * (1 - 2 * rr) - rr / 2 * (1 - 2 * rr - kh * kh), F.pow(1 - rr, F.lit(2)))
    return F.try_divide((F.atanh(jk) - F.atanh(jh)) * F.sqrt(n - 3), F.sqrt(2 - 2 * s))
