"""Distribution functions in numpy, and as Arrow-batched column functions for small aggregates."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def beta_inc(a, b, x):  # noqa: ANN001, ANN201
    """Regularised incomplete beta function, by its continued fraction (modified Lentz) on the side where it converges fast."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if not inside.any():
        return out
    p, q, y = a[inside], b[inside], x[inside]
    swap = y > (p + 1) / (p + q + 2)
    p, q, y = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - y, y)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 500):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    value = front * h
    out[inside] = np.where(swap, 1 - value, value)
    return out


def gamma_inc(a, x):  # noqa: ANN001, ANN201
    """Regularised lower incomplete gamma function, by series below a + 1 and by continued fraction above."""
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    out = np.where(x <= 0, 0.0, np.nan)
    low, high = (x > 0) & (x < a + 1), x >= a + 1
    if low.any():
        p, y = a[low], x[low]
        term = total = 1 / p
        for k in range(1, 1000):
            term = term * y / (p + k)
            total = total + term
            if np.all(term < total * 1e-16):
                break
        out[low] = total * np.exp(-y + p * np.log(y) - _lgamma(p))
    if high.any():
        p, y = a[high], x[high]
        b = y + 1 - p
        c, d = np.full_like(y, 1 / _TINY), 1 / b
        h = d.copy()
        for k in range(1, 1000):
            step = -k * (k - p)
            b = b + 2
            d = step * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + step / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * c * d
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        out[high] = 1 - np.exp(-y + p * np.log(y) - _lgamma(p)) * h
    return out


def t_two_sided(t, df):  # noqa: ANN001, ANN201
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return np.where(np.isinf(t), 0.0, beta_inc(df / 2, 0.5, df / (df + np.where(np.isinf(t), 0, t) ** 2)))


def t_cdf(t, df):  # noqa: ANN001, ANN201
    half = t_two_sided(t, df) / 2
    return np.where(np.asarray(t) > 0, 1 - half, half)


def f_upper(f, d1, d2):  # noqa: ANN001, ANN201
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return np.where(f <= 0, 1.0, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))))


def chi2_upper(x, df):  # noqa: ANN001, ANN201
    return 1 - gamma_inc(np.asarray(df, dtype=float) / 2, np.asarray(x, dtype=float) / 2)


def normal_cdf(z):  # noqa: ANN001, ANN201
    return _erfc(-np.asarray(z, dtype=float) / math.sqrt(2)) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _invert(cdf, p, lo, hi):  # noqa: ANN001, ANN202
    lo, hi = np.broadcast_to(np.asarray(lo, float), np.shape(p)).copy(), np.broadcast_to(np.asarray(hi, float), np.shape(p)).copy()
    for _ in range(200):
        mid = (lo + hi) / 2
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def t_quantile(p, df):  # noqa: ANN001, ANN201
    p, df = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(p, df))
    return _invert(lambda t: t_cdf(t, df), p, -1e4, 1e4)


def beta_quantile(p, a, b):  # noqa: ANN001, ANN201
    p, a, b = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(p, a, b))
    return _invert(lambda x: beta_inc(a, b, x), p, 0.0, 1.0)


def _valid(fn, *series: pd.Series) -> pd.Series:  # noqa: ANN001
    """Apply to the rows in which everything is there; the others are null."""
    ok = np.logical_and.reduce([s.notna().to_numpy() for s in series])
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = fn(*(s.to_numpy(dtype=float, na_value=np.nan)[ok] for s in series))
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p value of Student's t."""
    return _valid(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper p value of F."""
    return _valid(f_upper, f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper p value of chi squared."""
    return _valid(chi2_upper, x, df)


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    """Two-sided p value of a standard normal."""
    return _valid(lambda v: 2 * (1 - normal_cdf(np.abs(v))), z)


@F.pandas_udf(DoubleType())
def t_critical(level: pd.Series, df: pd.Series) -> pd.Series:
    """The two-sided critical value of Student's t at a confidence level."""
    return _valid(lambda c, n: t_quantile((1 + c) / 2, n), level, df)


@F.pandas_udf(DoubleType())
def beta_ppf(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _valid(beta_quantile, p, a, b)
