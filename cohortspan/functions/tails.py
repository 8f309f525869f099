"""Upper tail probabilities for one-row-per-model results.

Small vectorised helpers for p-values; they see finished statistics only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _rounds(size: float) -> int:
    """Rounds that a continued fraction may take; it settles in about the root of its size."""
    return int(1000 + 20 * math.sqrt(size))


def gamma_tail(shape: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(shape, x)."""
    if not (shape > 0 and x >= 0):
        return math.nan
    if x == 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        # power series for the lower part
        term = total = 1.0 / shape
        n = shape
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - scale * total
    # continued fraction for the upper part, evaluated forwards
    b = x + 1 - shape
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, _rounds(shape)):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or _TINY)
        c = b + a / c or _TINY
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            return scale * h
    raise ArithmeticError(f"no convergence of Q({shape}, {x})")


def _log_gamma_ratio(a: float, b: float) -> float:
    """log of gamma(a + b) / gamma(a), without the cancellation of large terms."""
    if a < 1e5 or b > 10:
        return math.lgamma(a + b) - math.lgamma(a)
    return b * math.log(a) + b * (b - 1) / (2 * a) - b * (b - 1) * (2 * b - 1) / (12 * a * a)


def beta_lower(a: float, b: float, x: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b); ``rest`` is 1 - x where that loses digits."""
    if not 0 <= x <= 1:
        return math.nan
    rest = 1 - x if rest is None else rest
    if x == 0 or rest == 0:
        return float(x > 0)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, rest, x)
    big, small = max(a, b), min(a, b)
    log_beta = math.lgamma(small) - _log_gamma_ratio(big, small)
    log_x = math.log(x) if x < 0.5 else math.log1p(-rest)
    log_rest = math.log(rest) if rest < 0.5 else math.log1p(-x)
    front = math.exp(a * log_x + b * log_rest - log_beta) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, _rounds(a + b)):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + numerator * d or _TINY)
            c = 1 + numerator / c or _TINY
            step = c * d
            h *= step
        if abs(step - 1) < 1e-15:
            return front * h
    raise ArithmeticError(f"no convergence of I_{x}({a}, {b})")


def chi2_tail(statistic: float, dof: float) -> float:
    return gamma_tail(dof / 2, statistic / 2)


def t_two_sided(t: float, dof: float) -> float:
    if math.isnan(t) or not dof > 0:
        return math.nan
    if not math.isfinite(t):
        return 0.0
    if dof > 1e6:
        # the normal approximation is right to 1 / dof^2, where the fraction loses digits
        return normal_two_sided(t * (1 - 1 / (4 * dof)) / math.sqrt(1 + t * t / (2 * dof)))
    return beta_lower(dof / 2, 0.5, dof / (dof + t * t), t * t / (dof + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _series(function, *args: pd.Series) -> pd.Series:
    values = [
        function(*map(float, row)) if all(pd.notna(v) for v in row) else None
        for row in zip(*args)
    ]
    return pd.Series(np.array(values, dtype="float64"))


@F.pandas_udf(T.DoubleType())
def _chi2(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return _series(chi2_tail, statistic, dof)


@F.pandas_udf(T.DoubleType())
def _t(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return _series(t_two_sided, statistic, dof)


def _nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def chi2_p(statistic: str, dof: str) -> Column:
    """p-value of a chi-square statistic; null when undefined."""
    return _nan_to_null(_chi2(F.col(statistic).cast("double"), F.col(dof).cast("double")))


def t_p(statistic: str, dof: str) -> Column:
    """Two-sided p-value of a t statistic; null when undefined."""
    return _nan_to_null(_t(F.col(statistic).cast("double"), F.col(dof).cast("double")))
