"""Special functions without scipy: normal and Student-t quantiles, regularised incomplete beta and gamma."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_unit = NormalDist()


def normal_quantile(p: float, scale: float = 1.0) -> float:
    return scale * _unit.inv_cdf(p)


def normal_cdf(x: float) -> float:
    return _unit.cdf(x)


def beta_regularized(a: float, b: float, x: float) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularized(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total / a


def beta_quantile(p: float, a: float, b: float) -> float:
    """Bisection on the regularised incomplete beta."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_regularized(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def student_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_regularized(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def student_quantile(p: float, df: float) -> float:
    """Bisection on the distribution function."""
    if p == 0.5:
        return 0.0
    lo, hi = -1.0, 1.0
    while student_cdf(lo, df) > p:
        lo *= 2
    while student_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_regularized(a: float, x: float) -> float:
    """Lower P(a, x): the series, or the continued fraction beyond a + 1."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for n in range(1, 1000):
        an = -n * (n - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def symmetric_root(m: np.ndarray) -> np.ndarray:
    """Square root of a symmetric positive semidefinite matrix."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


# Coefficients of the rational approximations of the normal quantile (Wichura's AS 241), constant term
# first: around the middle, in the tails, and far out; numerator, then denominator.
NORMAL_QUANTILE = {
    "middle": (
        [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
        [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
    ),
    "tail": (
        [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
        [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
    ),
    "far": (
        [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
        [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
    ),
}


def _polynomial(terms: list[float], x: Column) -> Column:
    out = F.lit(terms[-1])
    for c in terms[-2::-1]:
        out = out * x + F.lit(c)
    return out


def normal_quantile_column(p: Column) -> Column:
    """The standard normal quantile of a column, within 1e-15 of it relatively, in built-in functions."""
    ratio = lambda kind, x: _polynomial(NORMAL_QUANTILE[kind][0], x) / _polynomial(NORMAL_QUANTILE[kind][1], x)
    q = p - F.lit(0.5)
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    far = F.when(r <= 5.0, ratio("tail", r - F.lit(1.6))).otherwise(ratio("far", r - F.lit(5.0)))
    return F.when(F.abs(q) <= 0.425, q * ratio("middle", F.lit(0.180625) - q * q)).otherwise(F.signum(q) * far)


def normal_quantile_sql(p: str) -> str:
    """The same as SQL text."""

    def polynomial(terms: list[float], x: str) -> str:
        out = f"CAST({terms[-1]!r} AS DOUBLE)"
        for c in terms[-2::-1]:
            out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
        return out

    ratio = lambda kind, x: f"{polynomial(NORMAL_QUANTILE[kind][0], x)} / {polynomial(NORMAL_QUANTILE[kind][1], x)}"
    q, r = f"({p} - CAST(0.5 AS DOUBLE))", f"sqrt(-ln(least({p}, CAST(1 AS DOUBLE) - {p})))"
    return f"""CASE WHEN abs({q}) <= CAST(0.425 AS DOUBLE) THEN {q} * {ratio("middle", f"(CAST(0.180625 AS DOUBLE) - {q} * {q})")}
WHEN {r} <= 5 THEN sign({q}) * {ratio("tail", f"({r} - CAST(1.6 AS DOUBLE))")} ELSE sign({q}) * {ratio("far", f"({r} - CAST(5 AS DOUBLE))")} END"""
