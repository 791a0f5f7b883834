"""Upper-tail probabilities of the F and chi-square distributions.

Spark has no F or chi-square tail function, so these are small numeric helpers
(log-gamma, continued fractions for the incomplete beta and gamma functions)
applied with a pandas UDF to the few rows of a test result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300
#: beyond these degrees of freedom the limit distribution is used (relative error about 1 / value)
_LARGE_F = 1e8
_LARGE_A = 1e6


def _steps(*parameters: float) -> int:
    """Terms after which a fraction or series must have converged: their number grows
    with the root of the parameters."""
    return 10_000 + int(50 * math.sqrt(max(parameters)))


def _not_converged() -> ArithmeticError:
    return ArithmeticError("tail probability did not converge")


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, _steps(a, b)):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return h
    raise _not_converged()


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(ln_front) * _betacf(a, b, x) / a
    return 1.0 - math.exp(ln_front) * _betacf(b, a, 1.0 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float | None:
    """P(F(d1, d2) > f)."""
    if f is None or d1 is None or d2 is None or not (d1 > 0 and d2 > 0) or math.isnan(f):
        return None
    if f <= 0:
        return 1.0
    if d2 > _LARGE_F:  # d1 F tends to chi-square(d1)
        return chi2_sf(d1 * f, d1)
    if d1 > _LARGE_F:  # d2 / F tends to chi-square(d2)
        return 1.0 - chi2_sf(d2 / f, d2)
    x = d2 / (d2 + d1 * f)
    return betainc_reg(d2 / 2.0, d1 / 2.0, x)


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if a > _LARGE_A:  # uniform expansion: normal tail of eta and its first correction
        mu = (x - a) / a
        eta = math.copysign(math.sqrt(max(0.0, 2.0 * (mu - math.log1p(mu)))), mu)
        first = 1.0 / mu - 1.0 / eta if abs(mu) > 1e-4 else -1.0 / 3.0 + mu / 12.0
        q = 0.5 * math.erfc(eta * math.sqrt(a / 2.0)) + first * math.exp(-0.5 * a * eta * eta) / math.sqrt(2.0 * math.pi * a)
        return min(1.0, max(0.0, q))
    ln_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        ap, s, term = a, 1.0 / a, 1.0 / a
        for _ in range(_steps(a)):
            ap += 1.0
            term *= x / ap
            s += term
            if abs(term) < abs(s) * _EPS:
                return 1.0 - s * math.exp(ln_front)
        raise _not_converged()
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, _steps(a)):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return math.exp(ln_front) * h
    raise _not_converged()


def chi2_sf(x: float, k: float) -> float | None:
    """P(chi2(k) > x)."""
    if x is None or k is None or not k > 0 or math.isnan(x):
        return None
    return _gamma_q(k / 2.0, x / 2.0)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_sf(a, b, c) if pd.notna(a) and pd.notna(b) and pd.notna(c) else None
                      for a, b, c in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, k)], dtype="float64")
