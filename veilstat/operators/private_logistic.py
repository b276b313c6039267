"""Private logistic regression by inverse sensitivity: the noise of the smooth form, and a Metropolis-Hastings sampler."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from veilstat.functions.keyed import normal_py, uniform_py
from veilstat.operators.logistic import derivatives, fit, gradients, with_intercept


def sphere(d: int, *key) -> np.ndarray:
    z = np.array([normal_py("sphere", *key, i) for i in range(d)])
    return z / np.linalg.norm(z)


def gamma_draw(shape: int, *key) -> float:
    return -sum(math.log(uniform_py("gamma", *key, i)) for i in range(shape))


def noise(hessian: np.ndarray, n: int, eps: float, norm_bound: float, *key, ridge: float = 1e-7) -> np.ndarray:
    """(2 norm_bound / (n eps)) r H^-1 v with r ~ Gamma(d, 1) and v uniform on the sphere."""
    d = len(hessian)
    return 2 * norm_bound / (n * eps) * gamma_draw(d, *key) * np.linalg.solve(hessian + ridge * np.eye(d), sphere(d, *key))


def private_fit(df: DataFrame, d: int, eps: float, norm_bound: float, seed: int = 0, intercept: bool = False, estimate: list[float] | None = None, tolerance: float = 1e-6) -> list[float]:
    """Estimate + noise; a given non-private estimate is used instead of a new fit. eps = infinity gives the estimate."""
    rows = with_intercept(df) if intercept else df
    d = d + intercept
    beta = estimate if estimate is not None else fit(rows, d, tolerance=tolerance)
    if math.isinf(eps):
        return list(beta)
    _, h = derivatives(rows, beta)
    return (np.array(beta) + noise(h, rows.count(), eps, norm_bound, seed)).tolist()


def metropolis(df: DataFrame, d: int, eps: float, norm_bound: float, steps: int = 200, seed: int = 0, intercept: bool = False, center: list[float] | None = None, radius: float = 10.0, mix: float = 0.1, limit: int = 1000) -> DataFrame:
    """(dim, value) of a draw near the estimate with density exp(-eps / 2 ceil(n |grad| / norm_bound)).

    Proposals: with probability `mix` a point of the whole domain ball, else one in the region of radius 4 n^(-5/6)
    around the estimate, by a Gamma radius through the inverse Hessian. The region test maps the offset by the Hessian as
    a matrix. Proposals do not depend on the current point, so all of them are drawn first and their gradients come from
    one pass over the rows; the chain itself runs over `steps` numbers. `limit` rejections in a row are an error.
    """
    rows = with_intercept(df) if intercept else df
    dim = d + intercept
    beta = np.array(fit(rows, dim, tolerance=1e-6))
    _, h = derivatives(rows, beta.tolist())
    middle = np.zeros(dim) if center is None else np.array(center, float)
    if len(middle) != dim:
        raise ValueError("the centre of the domain has one coordinate a dimension, the intercept's last")
    n = rows.count()
    region, scale = 4 * n ** (-5 / 6), 2 * norm_bound / (n * eps)
    inverse = np.linalg.inv(h + 1e-7 * np.eye(dim))
    rng = np.random.default_rng([seed, dim])

    def log_proposal(b: np.ndarray) -> float:
        v = h @ (b - beta)
        inside = np.linalg.norm(v) / scale if np.linalg.norm(b - beta) <= region else math.inf
        wide = math.log(mix) - dim * math.log(radius)
        return wide if math.isinf(inside) else np.logaddexp(wide, math.log(1 - mix) - inside - dim * math.log(scale))

    proposals, coins = [beta], []
    for _ in range(steps):
        v = rng.normal(size=dim)
        v /= np.linalg.norm(v)
        proposals.append(middle + radius * rng.random() ** (1 / dim) * v if rng.random() < mix else beta + scale * rng.gamma(dim) * (inverse @ v))
        coins.append(rng.random())
    grads = np.zeros((steps + 1, dim))
    for r in gradients(rows, np.array(proposals)).collect():  # (steps + 1) x dim numbers
        grads[r["step"], r["dim"]] = r["value"]
    cost = eps / 2 * np.ceil(np.linalg.norm(grads, axis=1) * n / norm_bound)
    at, rejected = 0, 0
    for k, coin in enumerate(coins, 1):
        ratio = cost[at] - cost[k] + log_proposal(proposals[at]) - log_proposal(proposals[k])
        if np.linalg.norm(proposals[k] - middle) <= radius and math.log(coin) < ratio:
            at, rejected = k, 0
        else:
            rejected += 1
            if rejected > limit:
                raise ValueError(f"more than {limit} proposals in a row were rejected")
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(proposals[at])], "dim int, value double")
