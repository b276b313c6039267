"""Logistic regression with labels -1 and 1: objective, gradient, Hessian and Newton fits as aggregates.

Rows are (x array, y). Each Newton iteration is one aggregate of d + d(d + 1)/2 sums; the state is d numbers. An
intercept is a last constant coordinate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstat.functions.special import symmetric_root


NEWTON_RIDGE = 1e-6


def with_intercept(df: DataFrame, x: str = "x") -> DataFrame:
    return df.withColumn(x, F.array_append(F.col(x), F.lit(1.0)))


def margin(beta: list[float], x: str = "x", y: str = "y") -> Column:
    """y times the linear predictor."""
    z = F.lit(0.0)
    for i, b in enumerate(beta):
        z = z + F.lit(float(b)) * F.col(x)[i]
    return F.col(y) * z


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def objective(df: DataFrame, beta: list[float]) -> DataFrame:
    """Mean log loss, stable for large margins of either sign."""
    m = margin(beta)
    return df.agg(F.avg(F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))).alias("objective"))


def _gradient(beta: list[float]) -> list[Column]:
    s = sigmoid(-margin(beta))
    return [(-F.avg(s * F.col("y") * F.col("x")[i])).alias(f"g{i}") for i in range(len(beta))]


def _hessian(beta: list[float]) -> list[Column]:
    s = sigmoid(margin(beta))
    w = s * (F.lit(1.0) - s)
    return [F.avg(w * F.col("x")[i] * F.col("x")[j]).alias(f"h{i}_{j}") for i in range(len(beta)) for j in range(i, len(beta))]


def gradient(df: DataFrame, beta: list[float]) -> DataFrame:
    return df.agg(*_gradient(beta))


def hessian(df: DataFrame, beta: list[float]) -> DataFrame:
    """Upper triangle of the mean Hessian."""
    return df.agg(*_hessian(beta))


def outer(df: DataFrame, beta: list[float]) -> DataFrame:
    """Upper triangle of the mean of gradient times gradient transposed, row by row."""
    s = sigmoid(-margin(beta))
    return df.agg(*[F.avg(s * s * F.col("x")[i] * F.col("x")[j]).alias(f"o{i}_{j}") for i in range(len(beta)) for j in range(i, len(beta))])


def _matrix(row, letter: str, d: int) -> np.ndarray:
    m = np.array([[row[f"{letter}{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
    return m


def derivatives(df: DataFrame, beta: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian in one aggregate."""
    d = len(beta)
    row = df.agg(*_gradient(beta), *_hessian(beta)).first()
    return np.array([row[f"g{i}"] for i in range(d)], float), _matrix(row, "h", d)


def newton_step(df: DataFrame, beta: list[float], ridge: float = NEWTON_RIDGE) -> list[float]:
    g, h = derivatives(df, beta)
    return (np.array(beta) - np.linalg.solve(h + ridge * np.eye(len(beta)), g)).tolist()


def fit(df: DataFrame, d: int, start: list[float] | None = None, tolerance: float = 1e-3, steps: int = 100, ridge: float = NEWTON_RIDGE, solver: str = "newton") -> list[float]:
    """The estimate; `newton` by default, `lbfgs` by Spark's own optimiser."""
    if solver == "lbfgs":
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        rows = df.select(array_to_vector("x").alias("features"), ((F.col("y") + 1) / 2).alias("label"))
        model = LogisticRegression(regParam=0.0, standardization=False, fitIntercept=False, tol=1e-9, maxIter=steps).fit(rows)
        return model.coefficients.toArray().tolist()
    if solver != "newton":
        raise ValueError(f"no solver {solver!r}")
    beta = list(start or [0.0] * d)
    for _ in range(steps):
        new = newton_step(df, beta, ridge)
        if float(np.linalg.norm(np.subtract(new, beta))) <= tolerance:
            return new
        beta = new
    return beta


def sandwich(df: DataFrame, beta: list[float], ridge: float = 1e-10) -> np.ndarray:
    """H^-1 G H^-1 at beta."""
    _, h = derivatives(df, beta)
    inverse = np.linalg.inv(h + ridge * np.eye(len(beta)))
    return inverse @ _matrix(outer(df, beta).first(), "o", len(beta)) @ inverse


def deviation(df: DataFrame, beta: list[float]) -> np.ndarray:
    """Root of the sandwich."""
    return symmetric_root(sandwich(df, beta))


def inverse_hessian_square(df: DataFrame, beta: list[float], ridge: float = 1e-10) -> np.ndarray:
    _, h = derivatives(df, beta)
    inverse = np.linalg.inv(h + ridge * np.eye(len(beta)))
    return inverse @ inverse.T


def _pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of the columns of x, pair by pair, and the pairs."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j], i, j


def _matrices(sums: np.ndarray, i: np.ndarray, j: np.ndarray, d: int) -> np.ndarray:
    """Symmetric matrices from rows of their upper triangles."""
    out = np.empty((len(sums), d, d))
    out[:, i, j] = sums
    out[:, j, i] = sums
    return out


def weighted_newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray, tolerance: float = 1e-6, steps: int = 100, ridge: float = NEWTON_RIDGE) -> np.ndarray:
    """One estimate a row of weights, all rows of weights at once: (runs, d)."""
    d = x.shape[1]
    share = w / w.sum(1)[:, None]
    beta = np.tile(start.astype(float), (len(w), 1))
    active = np.arange(len(w))
    signed, (products, i, j) = y[:, None] * x, _pairs(x)
    for _ in range(steps):
        b, own = beta[active], share if len(active) == len(share) else share[active]
        s = 1 / (1 + np.exp(np.clip(b @ signed.T, -700, 700)))
        pull = own * s
        g = -(pull @ signed)
        h = _matrices((pull * (1 - s)) @ products, i, j, d) + ridge * np.eye(d)
        step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        beta[active] = b - step
        active = active[np.linalg.norm(step, axis=1) > tolerance]
        if not len(active):
            break
    return beta


def private_weighted(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray, eps: float, norm_bound: float, rng: np.random.Generator) -> np.ndarray:
    """Released estimates of each row of weights: (2 norm_bound / (n eps)) r H^-1 v is added, r ~ Gamma(d, 1), v uniform on the sphere."""
    beta = weighted_newton(x, y, w, start)
    runs, d = beta.shape
    n = w.sum(1)
    s = 1 / (1 + np.exp(np.clip(-(beta @ x.T), -700, 700)))
    products, i, j = _pairs(x)
    h = _matrices((w * s * (1 - s)) @ products / n[:, None], i, j, d) + 1e-7 * np.eye(d)
    v = rng.normal(size=(runs, d))
    v *= (2 * norm_bound / (n * eps) * rng.gamma(d, size=runs) / np.linalg.norm(v, axis=1))[:, None]
    return beta + np.linalg.solve(h, v[:, :, None])[:, :, 0]


def private_estimator(start: list[float], eps: float, norm_bound: float):
    """The released form of `weighted_estimator`."""

    def run(rows: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return private_weighted(rows[:, :-1], rows[:, -1], w, np.array(start), eps, norm_bound, rng)

    return run


def weighted_deviation(start: list[float]):
    """Roots of the sandwich at each row of weights' estimate, whose last column of rows is y: (runs, d, d)."""

    def run(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        x, y = rows[:, :-1], rows[:, -1]
        beta, n = weighted_newton(x, y, w, np.array(start)), w.sum(1)[:, None, None]
        s = 1 / (1 + np.exp(np.clip(-y * (beta @ x.T), -700, 700)))
        inverse = np.linalg.inv(np.einsum("rb,bi,bj->rij", w * s * (1 - s), x, x, optimize=True) / n + 1e-10 * np.eye(x.shape[1]))
        middle = np.einsum("rb,bi,bj->rij", w * (1 - s) ** 2, x, x, optimize=True) / n
        return np.stack([symmetric_root(m) for m in inverse @ middle @ inverse])

    return run


def weighted_estimator(start: list[float]):
    """An estimator for `resampling.weighted_stats` whose last column is y."""

    def run(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        return weighted_newton(rows[:, :-1], rows[:, -1], w, np.array(start))

    return run


def halvings(n: int) -> Iterator[int]:
    """The rows after which a pass over n rows halves its step: n - ceil(n / 2^k) for k = 1, 2, ..., each once."""
    k, last = 1, -1
    while (at := n - -(-n // 2**k)) > last:
        yield at
        k, last = k + 1, at


def projected_sgd(df: DataFrame, d: int, radius: float, order: str = "row_id", step: float | None = None, start: list[float] | None = None, center: list[float] | None = None) -> DataFrame:
    """(dim, value): the mean iterate of one sequential pass, each iterate projected to the ball of the radius around the centre.

    The step (1 / sqrt(n) if none is given) is halved after the rows of `halvings`. A pass in order is sequential by
    definition: all rows of the one group are read by one task.
    """
    import pandas as pd

    begin, middle = np.array(start or [0.0] * d, float), np.array(center or [0.0] * d, float)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy()
        n = len(y)
        halve = set(halvings(n))
        beta, total, rate = begin, np.zeros(d), 1 / np.sqrt(n) if step is None else step
        for i in range(n):
            beta = beta + rate * y[i] * x[i] / (1 + np.exp(y[i] * (beta @ x[i])))
            far = np.linalg.norm(beta - middle)
            if far > radius:
                beta = middle + (beta - middle) / far * radius
            total += beta
            if i in halve:
                rate /= 2
        return pd.DataFrame({"dim": np.arange(d), "value": total / n})

    return df.select(order, "x", "y").groupBy().applyInPandas(run, "dim int, value double")


def gradients(df: DataFrame, betas: np.ndarray) -> DataFrame:
    """(step, dim, value): the mean gradient at each of many points, by one pass of partial sums."""
    import pyarrow as pa

    points = np.asarray(betas, float)
    steps, d = points.shape

    def run(batches):
        total, n = np.zeros((steps, d)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = np.array(batch.column(0).to_pylist(), float), batch.column(1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(y), 4096):
                own, label = x[lo : lo + 4096], y[lo : lo + 4096]
                m = (own @ points.T) * label[:, None]
                total -= (label[:, None] / (1 + np.exp(np.clip(m, -700, 700)))).T @ own
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(steps), d), pa.int32()), pa.array(np.tile(np.arange(d), steps), pa.int32()), pa.array(total.ravel()), pa.array(np.full(steps * d, n), pa.int64())], names=["step", "dim", "g", "n"])

    sums = df.select("x", "y").mapInArrow(run, "step int, dim int, g double, n long")
    return sums.groupBy("step", "dim").agg((F.sum("g") / F.sum("n")).alias("value"))
