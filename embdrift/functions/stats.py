"""Small numeric helpers applied to aggregated rows (one per window), never per document."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_FPMIN = 1e-300
#: Far beyond what either expansion needs (about 10 * sqrt(a) terms); reaching it is an error.
_MAX_ITER = 50_000_000


def _log_prefactor(a: float, x: float) -> float:
    """-x + a log x - lgamma(a), without the cancellation of its large terms."""
    if a < 100:
        return -x + a * math.log(x) - math.lgamma(a)
    mu = (x - a) / a
    stirling = 0.5 * math.log(a / (2 * math.pi)) - 1 / (12 * a) + 1 / (360 * a ** 3)
    return -a * (mu - math.log1p(mu)) + stirling


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) (series / continued fraction)."""
    if x is None or a is None or math.isnan(x) or math.isnan(a):
        return float("nan")
    if x <= 0:
        return 1.0
    log_pref = _log_prefactor(a, x)
    if x < a + 1.0:
        ap, term, total = a, 1.0 / a, 1.0 / a
        for _ in range(_MAX_ITER):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * _EPS:
                return max(0.0, 1.0 - total * math.exp(log_pref))
        raise ArithmeticError(f"incomplete gamma series did not converge at a={a}, x={x}")
    b = x + 1.0 - a
    c = 1.0 / _FPMIN
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_ITER):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _FPMIN if abs(d) < _FPMIN else d
        c = b + an / c
        c = _FPMIN if abs(c) < _FPMIN else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return min(1.0, math.exp(log_pref) * h)
    raise ArithmeticError(f"incomplete gamma fraction did not converge at a={a}, x={x}")


def chi2_sf_scalar(statistic: float, dof: float) -> float:
    return gamma_q(dof / 2.0, statistic / 2.0)


@F.pandas_udf(T.DoubleType())
def _chi2_sf(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf_scalar(float(s), float(d)) if pd.notna(s) and pd.notna(d) else float("nan")
                      for s, d in zip(statistic, dof)], dtype="float64")


def chi2_sf(statistic, dof) -> Column:
    """Upper tail of the chi-square distribution (SciPy's ``chi2.sf``)."""
    s = F.col(statistic) if isinstance(statistic, str) else statistic
    d = F.col(dof) if isinstance(dof, str) else dof
    return _chi2_sf(s.cast("double"), d.cast("double"))
