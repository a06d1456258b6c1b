"""Distribution functions (no SciPy here): the normal quantile as a column expression, and normal
CDF and Student-t tail as NumPy helpers and Arrow-batched pandas UDFs.

The latter are applied to small per-series result tables (one row per series or per
lag), never to raw observations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def norm_cdf(x):
    x = np.asarray(x, dtype=float)
    return 0.5 * np.vectorize(math.erfc)(-x / math.sqrt(2.0))


# Wichura's rational approximations (AS 241) of the normal quantile, numerators and
# denominators by rising power, near the middle (|p - 1/2| <= 0.425) and in the tails (r <= 5).
PPF_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
PPF_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))


def _ratio(coefficients, x):
    """Quotient of two polynomials by Horner's rule, for columns as for SQL text."""
    top, bottom = coefficients
    if isinstance(x, str):
        def horner(c):
            out = repr(c[-1])
            for v in c[-2::-1]:
                out = f"({out} * {x} + {v!r})"
            return out
        return f"{horner(top)} / {horner(bottom)}"

    def horner(c):
        out = F.lit(c[-1])
        for v in c[-2::-1]:
            out = out * x + F.lit(v)
        return out
    return horner(top) / horner(bottom)


def norm_ppf_col(p: Column) -> Column:
    """Normal quantile of ``p`` as a column expression, for 1e-11 < p < 1 - 1e-11."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = _ratio(PPF_TAIL, r - 1.6)
    return F.when(F.abs(q) <= 0.425, q * _ratio(PPF_MIDDLE, 0.180625 - q * q)).otherwise(F.when(q < 0, -tail).otherwise(tail))


def norm_ppf_sql(p: str) -> str:
    """The same as SQL text."""
    tail = _ratio(PPF_TAIL, f"(sqrt(-ln(least({p}, 1 - ({p})))) - 1.6)")
    middle = _ratio(PPF_MIDDLE, f"(0.180625 - (({p}) - 0.5) * (({p}) - 0.5))")
    return f"CASE WHEN abs(({p}) - 0.5) <= 0.425 THEN (({p}) - 0.5) * {middle} WHEN ({p}) < 0.5 THEN -({tail}) ELSE {tail} END"


def _betacf(a: float, b: float, x: float, iters: int = 300, eps: float = 3e-16) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_sf_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student t with ``df`` degrees of freedom."""
    if t is None or df is None or not math.isfinite(df) or df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def _t_two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    out = [t_sf_two_sided(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
           for a, b in zip(t, df)]
    return pd.Series(out, dtype="float64")


def t_two_sided_p(t: Column, df: Column) -> Column:
    return _t_two_sided_udf(t.cast("double"), df.cast("double"))


@F.pandas_udf(T.DoubleType())
def _norm_cdf_udf(x: pd.Series) -> pd.Series:
    return pd.Series(norm_cdf(x.to_numpy(dtype=float, na_value=np.nan)))


def norm_cdf_col(x: Column) -> Column:
    return _norm_cdf_udf(x.cast("double"))
