"""The gamma distribution in numpy, and Arrow-batched functions over columns.

Regularised incomplete gamma functions: a power series below the mean, a continued
fraction (Lentz) above it; quantiles by bracketing and bisection.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _lower_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    term = 1.0 / a
    total = term.copy()
    n = a.copy()
    for _ in range(5000):
        n += 1
        term = term * x / n
        total += term
        if np.all(term <= total * 1e-17):
            break
    return total * np.exp(-x + a * np.log(x) - _lgamma(a))


def _upper_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    b = x + 1 - a
    c = np.full_like(x, 1 / tiny)
    d = 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for i in range(1, 5000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-16):
            break
    return h * np.exp(-x + a * np.log(x) - _lgamma(a))


def survival(shape, rate, at) -> np.ndarray:
    """P(X > at) of Gamma(shape, rate); NaN where a parameter is null or not positive."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (shape, rate, at)))
    out = np.full(a.shape, np.nan)
    good = (a > 0) & (b > 0) & ~np.isnan(x)
    z = np.where(good, b * x, 1.0)
    out[good & (z <= 0)] = 1.0
    for pick, f, flip in ((good & (z > 0) & (z < a + 1), _lower_series, True), (good & (z > 0) & (z >= a + 1), _upper_fraction, False)):
        if pick.any():
            v = f(a[pick].copy(), z[pick].copy())
            out[pick] = 1 - v if flip else v
    return np.clip(out, 0, 1)


def quantile(shape, rate, p) -> np.ndarray:
    """The value below which a share ``p`` of Gamma(shape, rate) lies, by bisection to a relative 1e-14."""
    a, b, q = np.broadcast_arrays(*(np.asarray(v, float) for v in (shape, rate, p)))
    good = (a > 0) & (b > 0) & (q > 0) & (q < 1)
    a1, q1 = np.where(good, a, 1.0), np.where(good, q, 0.5)
    lo, hi = np.zeros(a.shape), a1 + 10 * np.sqrt(a1) + 10
    for _ in range(60):
        short = survival(a1, 1.0, hi) > 1 - q1
        if not short.any():
            break
        hi = np.where(short, 2 * hi, hi)
    for _ in range(120):
        mid = (lo + hi) / 2
        up = survival(a1, 1.0, mid) > 1 - q1
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        if np.all(hi - lo <= 1e-14 * hi):
            break
    return np.where(good, (lo + hi) / 2 / np.where(good, b, 1.0), np.nan)


def gamma_survival(shape: Column, rate: Column, at: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(survival(a, b, x))

    return run(shape.cast("double"), rate.cast("double"), at.cast("double"))


def gamma_quantile(shape: Column, rate: Column, p: float) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(quantile(a, b, p))

    return run(shape.cast("double"), rate.cast("double"))


def posterior_survival(observed: Column, expected: Column, alpha: float = 1, beta: float = 1) -> Column:
    """Survival of Gamma(observed + alpha, expected + beta) at the observed count."""
    return gamma_survival(observed + F.lit(alpha), expected + F.lit(beta), observed)


def ratio_survival(observed: Column, expected: Column, alpha: Column, beta: Column) -> Column:
    """Survival of Gamma(alpha, beta) at the ratio that those parameters adjust."""
    return gamma_survival(alpha, beta, (observed + alpha) / (expected + beta))
