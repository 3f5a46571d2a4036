"""Upper tail of the chi-square distribution, vectorised."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Steps beyond the usual ``8 * sqrt(a)`` until the last bit stands still.
_MORE_STEPS = 500
_TINY = 1e-300


def _log_gamma(values: np.ndarray) -> np.ndarray:
    # Degrees of freedom are few distinct numbers, so each is reckoned once.
    distinct, where = np.unique(values, return_inverse=True)
    return np.array([math.lgamma(v) for v in distinct])[where].reshape(values.shape)


def _steps(a: np.ndarray) -> int:
    return _MORE_STEPS + int(20 * math.sqrt(a.max()))


def chi2_tail(statistic, dof) -> np.ndarray:
    """P(X >= statistic) for ``dof`` degrees of freedom; 1 where there are none.

    Regularised incomplete gamma function: the power series below ``a + 1``, the continued
    fraction (Lentz) above.
    """
    x = np.atleast_1d(np.asarray(statistic, dtype=float)) / 2.0
    a = np.atleast_1d(np.asarray(dof, dtype=float)) / 2.0
    x, a = np.broadcast_arrays(x, a)
    out = np.ones(x.shape)
    usable = (a > 0) & (x > 0)
    if not usable.any():
        return out
    xs, as_ = x[usable], a[usable]
    scale = np.exp(-xs + as_ * np.log(xs) - _log_gamma(as_))
    result = np.empty(xs.shape)

    series = xs < as_ + 1.0
    if series.any():
        xi, ai = xs[series], as_[series]
        term = 1.0 / ai
        total, going = term.copy(), np.ones(xi.shape, bool)
        for n in range(1, _steps(ai)):
            term = term * xi / (ai + n)
            # A value which has settled stays, so that it does not hang on those beside it.
            np.add(total, term, out=total, where=going)
            going &= term > total * 1e-16
            if not going.any():
                break
        else:
            raise ArithmeticError("the series of the incomplete gamma function did not settle")
        result[series] = 1.0 - total * scale[series]
    rest = ~series
    if rest.any():
        xi, ai = xs[rest], as_[rest]
        b = xi + 1.0 - ai
        c = np.full(xi.shape, 1.0 / _TINY)
        d = 1.0 / np.where(b == 0, _TINY, b)
        h, going = d.copy(), np.ones(xi.shape, bool)
        for n in range(1, _steps(ai)):
            factor = -n * (n - ai)
            b = b + 2.0
            d = factor * d + b
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + factor / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            np.multiply(h, step, out=h, where=going)
            going &= ~(np.abs(step - 1.0) < 4e-16)
            if not going.any():
                break
        else:
            raise ArithmeticError("the continued fraction of the incomplete gamma function did not settle")
        result[rest] = scale[rest] * h
    out[usable] = np.clip(result, 0.0, 1.0)
    return out


@lru_cache(maxsize=64)
def _critical(level: float, most: int) -> np.ndarray:
    """The statistic whose tail is ``level``, for 0 (there is none) to ``most`` degrees of freedom."""
    dof = np.arange(1, most + 1)
    low, high = np.zeros(most), dof + 1.0
    while (above := chi2_tail(high, dof) > level).any():
        high = np.where(above, 2 * high, high)
    while (high - low > 1e-9 * high).any():
        middle = (low + high) / 2
        above = chi2_tail(middle, dof) > level
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return np.concatenate([[np.nan], high])


def tail_against(statistic: np.ndarray, dof: np.ndarray, level: float) -> np.ndarray:
    """The sign of ``chi2_tail(statistic, dof) - level``; the tail itself is reckoned next to the level only."""
    if not 0 < level < 1 or not len(dof):
        return np.sign(chi2_tail(statistic, dof) - level)
    bound = _critical(level, 1 << int(dof.max()).bit_length())[dof]
    sign = np.sign(bound - statistic)
    near = ~(np.abs(bound - statistic) > 1e-6 * bound)
    if near.any():
        sign[near] = np.sign(chi2_tail(statistic[near], dof[near]) - level)
    return sign


@F.pandas_udf(DoubleType())
def chi2_tail_column(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(chi2_tail(statistic.to_numpy(float), dof.to_numpy(float)))
