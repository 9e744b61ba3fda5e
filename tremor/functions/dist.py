"""Distribution tails and quantiles as vectorised column functions (no SciPy)."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def ppf(p: float) -> float:
    """The normal quantile."""
    return _NORMAL.inv_cdf(p)


def normal_p(z: float) -> float:
    """Two-sided normal p-value."""
    return erfc(abs(z) / sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_p(t: float, dof: float) -> float:
    """Two-sided Student p-value."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 else float("nan")


def f_p(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def norm_ppf(p: Column) -> Column:
    @F.pandas_udf("double")
    def udf(x: pd.Series) -> pd.Series:
        return x.map(lambda v: ppf(v) if v is not None and 0 < v < 1 else None)

    return udf(p)


def norm_two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def udf(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else normal_p(v))

    return udf(z)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def udf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan([u, v, w]).any() else f_p(u, v, w) for u, v, w in zip(x.astype(float), a.astype(float), b.astype(float), strict=True)], dtype=float)

    return udf(f, d1, d2)
