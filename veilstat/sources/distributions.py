"""Row generators: each distribution samples by a Spark expression over keyed uniforms, and knows its moments.

`sample(spark, n, seed)` gives (row_id, x). Rows are made by `spark.range` where they are needed; nothing is shipped.
"""

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.functions.keyed import normal, normal_py, uniform, uniform_py
from veilstat.functions.special import normal_quantile_column

_unit = NormalDist()
INF = float("inf")


class Distribution:
    """One-dimensional distribution: `expression(seed, key)` is a draw for the row with that key."""

    def expression(self, seed: int, key: Column) -> Column:
        raise NotImplementedError

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        return spark.range(n).select(F.col("id").alias("row_id"), self.expression(seed, F.col("id")).alias("x"))

    mean = median = std = float("nan")
    bounds = (-INF, INF)

    def quantile(self, u: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    purpose = ""  # of the uniform that `expression` turns into a draw

    def at(self, seed: int, keys: np.ndarray) -> np.ndarray:
        """The draws of `expression` for whole keys, in Python."""
        return self.quantile(np.array([uniform_py(self.purpose, seed, int(k)) for k in keys], float))

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """n draws in numpy, for trials inside one task."""
        return self.quantile(rng.random(n))

    @property
    def median_std(self) -> float:
        """Asymptotic standard deviation of the sample median, times the root of n: 1 / (2 f(median))."""
        return 1 / (2 * self.density(self.median))

    def density(self, x: float) -> float:
        raise NotImplementedError


@dataclass
class Gauss(Distribution):
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self):
        self.mean = self.median = self.mu
        self.std = self.sigma

    def expression(self, seed, key):
        return F.lit(self.mu) + F.lit(self.sigma) * normal("gauss", seed, key)

    def at(self, seed, keys):
        return self.mu + self.sigma * np.array([normal_py("gauss", seed, int(k)) for k in keys], float)

    def density(self, x):
        return NormalDist(self.mu, self.sigma).pdf(x)

    def draw(self, rng, n):
        return rng.normal(self.mu, self.sigma, n)


@dataclass
class TruncatedGauss(Distribution):
    """Normal(mu, sigma) within [mu + a sigma, mu + b sigma]."""

    a: float
    b: float
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self):
        self._lo, self._hi = _unit.cdf(self.a), _unit.cdf(self.b)
        z, fa, fb = self._hi - self._lo, _unit.pdf(self.a), _unit.pdf(self.b)
        self.mean = self.mu + self.sigma * (fa - fb) / z
        self.std = self.sigma * math.sqrt(1 + (self.a * fa - self.b * fb) / z - ((fa - fb) / z) ** 2)
        self.median = self.mu + self.sigma * _unit.inv_cdf((self._lo + self._hi) / 2)
        self.bounds = (self.mu + self.a * self.sigma, self.mu + self.b * self.sigma)

    def expression(self, seed, key):
        return F.lit(self.mu) + F.lit(self.sigma) * normal_quantile_column(F.lit(self._lo) + uniform("trunc", seed, key) * F.lit(self._hi - self._lo))

    purpose = "trunc"

    def quantile(self, u):
        return self.mu + self.sigma * np.array([_unit.inv_cdf(v) for v in self._lo + u * (self._hi - self._lo)])

    def density(self, x):
        return _unit.pdf((x - self.mu) / self.sigma) / self.sigma / (self._hi - self._lo)


@dataclass
class Triangular(Distribution):
    """Mode at left + c (right - left)."""

    c: float
    left: float
    right: float

    def __post_init__(self):
        w, c = self.right - self.left, self.c
        self.mean = self.left + w * (1 + c) / 3
        self.std = w * math.sqrt((1 - c + c * c) / 18)
        self.median = self.left + w * math.sqrt(c / 2) if c >= 0.5 else self.right - w * math.sqrt((1 - c) / 2)
        self.bounds = (self.left, self.right)

    def expression(self, seed, key):
        u, w = uniform("triang", seed, key), F.lit(self.right - self.left)
        return F.when(u < F.lit(self.c), F.lit(self.left) + w * F.sqrt(u * F.lit(self.c))).otherwise(F.lit(self.right) - w * F.sqrt((F.lit(1.0) - u) * F.lit(1 - self.c)))

    purpose = "triang"

    def quantile(self, u):
        w = self.right - self.left
        return np.where(u < self.c, self.left + w * np.sqrt(u * self.c), self.right - w * np.sqrt((1 - u) * (1 - self.c)))

    def density(self, x):
        t, w = (x - self.left) / (self.right - self.left), self.right - self.left
        return (2 * t / self.c if t < self.c else 2 * (1 - t) / (1 - self.c)) / w if 0 <= t <= 1 else 0.0


@dataclass
class GaussMixture(Distribution):
    """Normal(mu, sigma) with probability p, else standard normal."""

    mu: float
    sigma: float
    p: float

    def __post_init__(self):
        self.mean = self.p * self.mu
        self.std = math.sqrt(self.p * (self.sigma**2 + self.mu**2) + (1 - self.p) - self.mean**2)

    def expression(self, seed, key):
        z = normal("mixture", seed, key)
        return F.when(uniform("mixture-side", seed, key) <= F.lit(self.p), F.lit(self.mu) + F.lit(self.sigma) * z).otherwise(z)


@dataclass
class Weibull(Distribution):
    c: float

    def __post_init__(self):
        self.mean = math.gamma(1 + 1 / self.c)
        self.std = math.sqrt(math.gamma(1 + 2 / self.c) - self.mean**2)
        self.median = math.log(2) ** (1 / self.c)
        self.bounds = (0.0, INF)

    def expression(self, seed, key):
        return F.pow(-F.log(F.lit(1.0) - uniform("weibull", seed, key)), F.lit(1 / self.c))


@dataclass
class Pareto(Distribution):
    b: float

    def __post_init__(self):
        self.mean = self.b / (self.b - 1) if self.b > 1 else INF
        self.std = math.sqrt(self.b / (self.b - 2)) / (self.b - 1) if self.b > 2 else INF
        self.median = 2 ** (1 / self.b)
        self.bounds = (1.0, INF)

    def expression(self, seed, key):
        return F.pow(F.lit(1.0) - uniform("pareto", seed, key), F.lit(-1 / self.b))


@dataclass
class ChiSquare(Distribution):
    df: int

    def __post_init__(self):
        from veilstat.functions.special import gamma_regularized

        self.mean, self.std = float(self.df), math.sqrt(2 * self.df)
        lo, hi = 0.0, 2.0 * self.df + 10  # the median proper, not the mean
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if gamma_regularized(self.df / 2, mid / 2) < 0.5 else (lo, mid)
        self.median, self.bounds = (lo + hi) / 2, (0.0, INF)

    def expression(self, seed, key):
        total = F.lit(0.0)
        for i in range(self.df):
            total = total + F.pow(normal("chi2", seed, i, key), F.lit(2.0))
        return total


@dataclass
class SkewNormal(Distribution):
    a: float

    def __post_init__(self):
        d = self.a / math.sqrt(1 + self.a**2)
        self._delta = d
        self.mean = d * math.sqrt(2 / math.pi)
        self.std = math.sqrt(1 - 2 * d * d / math.pi)
        self.median = self._median()

    def _median(self) -> float:
        """Interpolation in the distribution function, by trapezoid sums of the density."""
        grid = np.linspace(-9, 9, 3601)
        f = np.array([2 * _unit.pdf(v) * _unit.cdf(self.a * v) for v in grid])
        area = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(grid))])
        return float(np.interp(0.5, area / area[-1], grid))

    def expression(self, seed, key):
        return F.lit(self._delta) * F.abs(normal("skew-0", seed, key)) + F.lit(math.sqrt(1 - self._delta**2)) * normal("skew-1", seed, key)


def gauss_vector(mu: list[float], sigma: list[list[float]], seed: int, key: Column) -> Column:
    """A multivariate normal for the row with that key: Cholesky factor times independent normals."""
    factor = np.linalg.cholesky(np.array(sigma, float))
    z = [normal("gauss-d", seed, i, key) for i in range(len(mu))]
    row = lambda i: sum((F.lit(float(factor[i, j])) * z[j] for j in range(i + 1)), F.lit(float(mu[i])))
    return F.array(*[row(i) for i in range(len(mu))])


def mixture_vector(d: int, mu: float, sigma: float, p: float, seed: int, key: Column) -> Column:
    """d coordinates that are mixtures and share the side."""
    z = [normal("mixture-d", seed, i, key) for i in range(d)]
    side = uniform("mixture-d-side", seed, key) <= F.lit(p)
    return F.array(*[F.when(side, F.lit(mu) + F.lit(sigma) * v).otherwise(v) for v in z])


def logistic_row(beta: list[float], intercept: float, kind: str, seed: int, key: Column) -> tuple[Column, Column]:
    """(x, y): x uniform on (-1, 1) or standard normal, y = 1 with probability sigmoid(x beta + intercept), else -1."""
    draw = {"uniform": lambda i: F.lit(2.0) * uniform("logreg-x", seed, i, key) - F.lit(1.0), "normal": lambda i: normal("logreg-x", seed, i, key)}
    if kind not in draw:
        raise ValueError(f"no kind of rows {kind!r}")
    x = [draw[kind](i) for i in range(len(beta))]
    z = sum((F.lit(float(b)) * v for b, v in zip(beta, x, strict=True)), F.lit(float(intercept)))
    return F.array(*x), F.when(uniform("logreg-y", seed, key) < F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), F.lit(1.0)).otherwise(F.lit(-1.0))


def logistic_rows(spark: SparkSession, n: int, beta: list[float], intercept: float = 0.0, kind: str = "uniform", seed: int = 0) -> DataFrame:
    """(row_id, x array, y) of n made rows."""
    x, y = logistic_row(beta, intercept, kind, seed, F.col("id"))
    return spark.range(n).select(F.col("id").alias("row_id"), x.alias("x"), y.alias("y"))


# The distributions of the one-dimensional study.
STUDY = {
    "truncnorm_sym": TruncatedGauss(-1, 1, 0, 5),
    "truncnorm_assym": TruncatedGauss(-3, 2, 0, 2),
    "truncnorm_assym2": TruncatedGauss(-4, 1, 0, 2),
    "truncnorm_assym3": TruncatedGauss(0, 5, 0, 2),
    "triang_sym": Triangular(0.5, -5, 5),
    "triang_assym": Triangular(0.2, -5, 5),
    "normal": Gauss(0, 1),
}


def study_distribution(name: str) -> Distribution:
    """A distribution of the study by name; unknown names are an error."""
    if name not in STUDY:
        raise ValueError(f"no distribution {name!r}; known: {', '.join(sorted(STUDY))}")
    return STUDY[name]
