"""Intervals under zero-concentrated privacy: clipped Gaussian means (CoinPress) of little-bootstrap estimates.

The inputs of a step are one value a chunk; sizing bounds their number (under a hundred), so a step is one small
aggregate and its state, two numbers, stays with the caller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstat.functions.keyed import normal_py
from veilstat.functions.special import normal_quantile


LEAST = 1e-9


def _functions(*values) -> tuple:
    """Logarithm and square root for numbers, or for columns if one of the values is."""
    return (F.log, F.sqrt) if any(isinstance(v, Column) for v in values) else (math.log, math.sqrt)


def eps_to_rho(eps, delta):
    """The rho that gives eps at delta; numbers or columns."""
    log, sqrt = _functions(eps, delta)
    a = log(1.0 / delta)
    return (sqrt(eps + a) - sqrt(a)) ** 2


def gaussian_tailbound(d: int, b):
    """Norm that a d-dimensional standard normal exceeds with probability at most b, a number or a column."""
    log, sqrt = _functions(b)
    a = log(1.0 / b)
    return sqrt(d + 2.0 * sqrt(d * a) + 2.0 * a)


def inverse_variance(df: DataFrame, by: list[str], m: str = "m", v: str = "v") -> DataFrame:
    """(est, var) per group: sum(m / v) / sum(1 / v) and 1 / sum(1 / v)."""
    return df.groupBy(*by).agg((F.sum(F.col(m) / F.col(v)) / F.sum(F.lit(1.0) / F.col(v))).alias("est"), (F.lit(1.0) / F.sum(F.lit(1.0) / F.col(v))).alias("var"))


def mean_step(values: DataFrame, x: str, c: float, r: float, beta: float, rho: float, s: int, *key) -> dict[str, float]:
    """One step: clip to c +- (r + tail), release the mean with Gaussian noise, shrink the radius."""
    beta = beta / 2
    clip = r + gaussian_tailbound(1, beta / s)
    sd = 2 * clip / s / math.sqrt(2 * rho)
    v = F.col(x)
    row = values.agg(F.sum(F.greatest(F.lit(c - clip), F.least(F.lit(c + clip), v))).alias("t"), F.count_if(F.abs(v - F.lit(c)) > F.lit(clip)).alias("k")).first()
    return {
        "c": (row["t"] or 0.0) / s + sd * normal_py("coinpress", *key),
        "r": gaussian_tailbound(1, beta) * math.sqrt(1 / s + 2 * clip**2 / (s**2 * rho)),
        "noise_var": sd**2,
        "clipped": row["k"],
    }


def mean_iterative(values: DataFrame, x: str, c: float, r: float, cov: float, betas: list[float], rhos: list[float], s: int, *key, center: float | None = None) -> list[dict[str, float]]:
    """The steps' releases in the values' scale: (est, noise_var) each. Values are centred by `center`, or by their own mean.

    Centring by the values' own mean and adding it back is what the compared method does; it is not private. Give
    `center` for a release that is.
    """
    root = math.sqrt(cov)
    mid = values.agg(F.avg(x)).first()[0] if center is None else center
    scaled = values.select(((F.col(x) - F.lit(mid)) / F.lit(root)).alias("z"))
    c, r = c / root, r / root
    out = []
    for i, (beta, rho) in enumerate(zip(betas, rhos, strict=True)):
        step = mean_step(scaled, "z", c, r, beta, rho, s, *key, i)
        c, r = step["c"], step["r"]
        out.append({"est": c * root + mid, "noise_var": step["noise_var"] * cov, "clipped": step["clipped"]})
    return out


def budgets(total: float, steps: int) -> list[float]:
    """A quarter over the first steps, three quarters for the last."""
    return [total / (4 * (steps - 1))] * (steps - 1) + [0.75 * total]


def weighted(releases: list[dict[str, float]], extra: float = 0.0) -> tuple[float, float]:
    w = [1 / (x["noise_var"] + extra) for x in releases]
    return sum(a * x["est"] for a, x in zip(w, releases, strict=True)) / sum(w), 1 / sum(w)


def private_interval(chunks: DataFrame, s: int, cov_c: float, cov_r: float, cov_cov: float, mean_c: float, mean_r: float, steps: int, rho: float, beta: float, alpha: float, rho_mean: float = 0.5, beta_mean: float = 0.5, seed: int = 0, center: float | None = None, cov_center: float | None = None) -> dict[str, float]:
    """Interval of the mean from (m, v), a mean and a variance of bootstrap estimates a chunk.

    `center` and `cov_center` centre the means and the variances by given values instead of their own mean, which is not
    private. A released variance of 0 counts as the square of LEAST times the radius of the means.
    """
    if not 0 < rho_mean < 1 or not 0 < beta_mean < 1:
        raise ValueError("the shares of the budgets must lie between 0 and 1")
    beta_cov = beta * (1 - beta_mean) / 2
    cov = mean_iterative(chunks, "v", cov_c, cov_r, cov_cov, budgets(beta_cov / 2, steps), budgets(rho * (1 - rho_mean), steps), s, seed, "cov", center=cov_center)
    est, var = weighted(cov)
    est = max((LEAST * mean_r) ** 2, max(0.0, est) + normal_quantile(1 - beta_cov, math.sqrt(var)))
    mean = mean_iterative(chunks, "m", mean_c, mean_r, s * est, budgets(beta * beta_mean, steps), budgets(rho * rho_mean, steps), s, seed, "mean", center=center)
    value, noise = weighted(mean, est)
    half = normal_quantile(1 - alpha / 2, math.sqrt(est + noise))
    return {"est": value, "noise_var": noise, "cov": est, "l": value - half, "u": value + half}
