"""Tails and quantiles of distributions for small result tables (a row a test), by series and continued fractions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            top = 1.0
        elif k % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / (c or 1e-300)
        out *= c * d
        if k > 0 and abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 10000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for n in range(1, 10000):
        b += 2
        d = 1 / (b - n * (n - a) * d or 1e-300)
        c = b - n * (n - a) / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """P(T > t) with df degrees of freedom."""
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_quantile(p: float, df: float) -> float:
    """The t above which a share 1 - p of the distribution lies, by bisection."""
    lo, hi = 0.0, 1.0
    while t_tail(hi, df) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def beta_inc_all(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """:func:`beta_inc` of arrays, whose fractions go on together until all have settled."""
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(y) + b * np.log1p(-y)) / a
    c, d, out = np.ones_like(y), np.zeros_like(y), np.ones_like(y)
    for k in range(400):
        m = k // 2
        if k == 0:
            top = np.ones_like(y)
        elif k % 2 == 0:
            top = m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + top * d
        d = 1 / np.where(d == 0, 1e-300, d)
        c = 1 + top / np.where(c == 0, 1e-300, c)
        out = out * c * d
        if k > 0 and (np.abs(1 - c * d) < 1e-14).all():
            break
    value = np.where(inside, front * (out - 1), (x >= 1).astype(float))
    return np.where(swap, 1 - value, value)


def t_tail_all(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """:func:`t_tail` of arrays."""
    tail = 0.5 * beta_inc_all(df / 2, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(t >= 0, tail, 1 - tail)


def _over(f, *columns: Column) -> Column:
    """f of whole arrays of one, two or three columns; null where any is null."""

    def run(*parts):
        x = [p.to_numpy(dtype="float64", na_value=np.nan) for p in parts]
        fine = ~np.isnan(np.stack(x)).any(axis=0)
        out = np.full(len(fine), np.nan)
        out[fine] = f(*[c[fine] for c in x])
        return pd.Series(out).astype(object).where(fine, None)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf((one, two, three)[len(columns) - 1], "double")(*columns)


def _column(f, *columns: Column) -> Column:
    """f over the columns of a small table, number by number."""
    return _over(lambda *x: np.array([f(*map(float, row)) for row in zip(*x)], float), *columns)


def normal_p(z: Column, alternative: str = "two-sided") -> Column:
    tails = {"two-sided": lambda x: 2 * normal_tail(abs(x)), "greater": normal_tail, "less": lambda x: normal_tail(-x)}
    return _column(tails[alternative], z)


def t_p(t: Column, df: Column) -> Column:
    """Two-sided."""
    return _over(lambda x, n: 2 * t_tail_all(np.abs(x), n), t, df)


def t_p_greater(t: Column, df: Column) -> Column:
    return _over(t_tail_all, t, df)


def t_critical(df: Column, level: float = 0.95) -> Column:
    """Half-width of a two-sided interval in standard errors."""
    return _column(lambda n: t_quantile(0.5 + level / 2, n), df)


def chi2_p(x: Column, df: Column) -> Column:
    return _column(lambda a, n: gamma_tail(n / 2, a / 2) if n > 0 else 1.0, x, df)


def f_p(x: Column, d1: Column, d2: Column) -> Column:
    return _column(lambda f, a, b: beta_inc(b / 2, a / 2, b / (b + a * f)), x, d1, d2)
