"""Tail probabilities as Columns and Arrow UDFs, without SciPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_sf2(z: Column) -> Column:
    """Two-sided normal p-value; error below 1.2e-7 (rational Chebyshev fit of erfc)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the published fit, lowest power first.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for a in reversed(c[:-1]):
        poly = poly * t + a
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    lg = np.vectorize(math.lgamma)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    out = np.where(low, front * _beta_fraction(a, b, inside) / a, 1 - front * _beta_fraction(b, a, 1 - inside) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(DoubleType())
def student_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t; null where t or df is."""
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        v = df[ok].to_numpy(float)
        out[ok] = beta_inc(v / 2, np.full(len(v), 0.5), v / (v + t[ok].to_numpy(float) ** 2))
    return out


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    ok = f.notna() & (d1 > 0) & (d2 > 0)
    out = pd.Series(np.nan, index=f.index)
    if ok.any():
        a, b, x = (s[ok].to_numpy(float) for s in (d1, d2, f))
        out[ok] = beta_inc(b / 2, a / 2, b / (b + a * x))
    return out


def _kolmogorov(x: np.ndarray) -> np.ndarray:
    v, k = np.maximum(x, 1e-3)[:, None], np.arange(1, 101)
    p = np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * (k * v) ** 2)).sum(1), 0, 1)
    return np.where(x < 0.2, 1.0, p)


@F.pandas_udf(DoubleType())
def kolmogorov_sf(x: pd.Series) -> pd.Series:
    """Upper tail of the Kolmogorov distribution: asymptotic p-value of sqrt(n1 n2 / (n1 + n2)) * D."""
    return pd.Series(_kolmogorov(x.to_numpy(float)), index=x.index)


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _tail(first: int, step: int, end: int, b: int, c: int, d: int) -> float:
    """Sum of the hypergeometric terms from ``first`` on towards ``end``, in units of the first, until they vanish; blocks of ratios."""
    total, last, i = 1.0, 1.0, first
    while i != end:
        n = min(4096, abs(end - i))
        j = i + step * np.arange(n, dtype=float)
        up = (b - j) * (c - j) / ((j + 1) * (d - b - c + j + 1)) if step > 0 else j * (d - b - c + j) / ((b - j + 1) * (c - j + 1))
        terms = last * np.cumprod(up)
        total += float(terms.sum())
        last, i = float(terms[-1]), i + step * n
        if last < 1e-18 * total and (up[-1] < 1):
            break
    return total


def _log_term(i: int, b: int, c: int, d: int) -> float:
    return _log_choose(b, i) + _log_choose(d - b, c - i) - _log_choose(d, c)


def hypergeom_tail(a: int, b: int, c: int, d: int) -> float:
    """P(at least ``a`` of ``c`` draws marked), ``b`` of ``d`` marked: summed outward from the likeliest term of the tail."""
    low, high = max(0, b + c - d), min(b, c)
    a = max(a, low)
    if a > high:
        return 0.0
    if a == low:
        return 1.0
    mode = min(high, max(a, (b + 1) * (c + 1) // (d + 2)))
    inner = _tail(mode, -1, a, b, c, d) - 1.0 if mode > a else 0.0
    return min(1.0, math.exp(_log_term(mode, b, c, d)) * (_tail(mode, 1, high, b, c, d) + inner))


@F.pandas_udf(DoubleType())
def hypergeom_sf(k: pd.Series, k_all: pd.Series, n: pd.Series, n_all: pd.Series) -> pd.Series:
    """P(at least k of n draws marked) with k_all of n_all marked: Fisher's one-sided p, and that of over-representation."""
    return pd.Series([hypergeom_tail(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, k_all, n, n_all, strict=True)], dtype=float)


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact two-sided p: all tables no likelier than this one, on its side and from where the other side is no likelier."""
    a, b, c, d = (max(0, x) for x in (a, b, c, d))
    r, s, n = a + b, a + c, a + b + c + d
    low, high = max(0, r + s - n), min(r, s)
    here = _log_term(a, r, s, n)
    mode = min(high, max(low, (r + 1) * (s + 1) // (n + 2)))
    if a == mode or low == high:
        return 1.0
    step, end, far = (1, high, low) if a > mode else (-1, low, high)
    total = math.exp(here) * _tail(a, step, end, r, s, n)
    # on the other side terms fall away from the mode: the first that is no likelier, by bisection
    x, y = mode, far
    if _log_term(far, r, s, n) <= here + 1e-7:
        while x != y:
            m = (x + y) // 2 if far > mode else -((-x - y) // 2)
            x, y = (x, m) if _log_term(m, r, s, n) <= here + 1e-7 else (m + (1 if far > mode else -1), y)
        total += math.exp(_log_term(x, r, s, n)) * _tail(x, -step, far, r, s, n)
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Fisher's exact two-sided p of a 2x2 table: all tables no likelier than this one. Negative cells count as 0."""
    return pd.Series([fisher_p(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)


#: Most cells of the table of paths for which the Kolmogorov-Smirnov p-value is exact.
EXACT_CELLS = 250_000


def ks_exact(ks: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Exact p-values of two-sample distances: shares of the paths from (0, 0) to (n1, n0) that stray that far from the diagonal, for all distances at once."""
    far = (0.5 + np.floor(np.asarray(ks, float) * n1 * n0 - 1e-7)) / (n1 * n0)
    j = np.arange(n0 + 1) / n0
    u = (j[:, None] <= far).astype(float)
    for i in range(1, n1 + 1):
        w, near = i / (i + n0), np.abs(i / n1 - j)[:, None] <= far
        u[0] = np.where(near[0], u[0] * w, 0.0)
        for k in range(1, n0 + 1):
            u[k] = np.where(near[k], w * u[k] + u[k - 1], 0.0)
    return np.clip(1 - u[-1], 0, 1)


@F.pandas_udf(DoubleType())
def ks_two_sample_sf(ks: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
    """p-value of a two-sample distance: exact while n1 times n0 is at most EXACT_CELLS, asymptotic beyond; rows of equal sizes share their table."""
    out = pd.Series(np.nan, index=ks.index)
    for (a, b), own in ks.groupby([n1, n0]):
        a, b = int(a), int(b)
        if a * b <= EXACT_CELLS:
            distinct, at = np.unique(own.to_numpy(), return_inverse=True)
            out[own.index] = ks_exact(distinct, a, b)[at]
        else:
            out[own.index] = _kolmogorov(np.sqrt(a * b / (a + b)) * own.to_numpy())
    return out
