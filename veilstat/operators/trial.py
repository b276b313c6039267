"""Monte-Carlo trials of the one-dimensional study: one grouped map over (n, eps, trial), each trial in numpy.

A trial samples n rows, forms the interval of every method, and evaluates all of them on fresh samples. Groups are
tiny and independent, so they fill any number of cores; the generator of a group depends on its key alone.

The zCDP interval (gvdp) has a study of its own (`zcdp=True`), with its own chunks and one interval a trial, which all
resamples of the trial repeat. The studies of logistic coefficients are in `logistic_trial`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.functions.special import normal_quantile, student_quantile
from veilstat.operators.chunking import chunk_count, granularity, sizing, variance_bound, zcdp_sizing
from veilstat.operators.histograms import Bins
from veilstat.operators.resampling import RUNS, resample_counts, weighted_mean, weighted_median
from veilstat.operators.zcdp import budgets, eps_to_rho, gaussian_tailbound, weighted
from veilstat.sources.distributions import Distribution, study_distribution

SET_TYPES = ("symm", "eqtail", "short", "low", "up")
METHODS = ("proper_unstud", "normal_proper_blb", "normal_proper_adhoc", "boot_unstud_priv")
ZCDP_STEPS, OVERESTIMATE, FAILURE, SEARCH = 5, 10, 0.01, 5


@dataclass(frozen=True)
class Study:
    """What a trial estimates and how; names that do not exist are an error."""

    task: str = "mean"
    dist: str = "truncnorm_assym"
    alpha: float = 0.05
    share: float = 0.5
    set_type: str = "symm"
    resamples: int = 100
    max_boot: int = 10_000
    zcdp: bool = False

    def __post_init__(self):
        if self.task not in ("mean", "median"):
            raise ValueError(f"no one-dimensional task {self.task!r}")
        if self.set_type not in SET_TYPES:
            raise ValueError(f"no set type {self.set_type!r}")
        if not all(map(math.isfinite, study_distribution(self.dist).bounds)):
            raise ValueError(f"the study needs a bounded distribution, {self.dist!r} is not")

    @property
    def methods(self) -> tuple[str, ...]:
        if self.zcdp:
            return ("gvdp",)
        return METHODS if self.task == "mean" else tuple(m for m in METHODS if m != "normal_proper_adhoc")

    def truth(self, dist: Distribution) -> tuple[float, float]:
        """(parameter, deviation of the values, which the search range and the variance bound follow)."""
        return (dist.mean if self.task == "mean" else dist.median), dist.std


def rank_distance(i: np.ndarray, n: int) -> np.ndarray:
    """Distance in ranks of gap i, 0..n, from the median."""
    if n % 2 == 0:
        return np.abs(n / 2 - i)
    inner = np.where(i < (n + 1) / 2, (n + 1) / 2 - i, i - (n - 1) / 2)
    return np.where((i == 0) | (i == n), (n + 1) / 2, inner)


def spread_apart(x: np.ndarray, rho: float, low: float, high: float) -> np.ndarray:
    """Sorted values with the lower half moved down and the upper half moved up by rho, within bounds."""
    x, half = np.sort(x), len(x) // 2
    return np.clip(np.concatenate([x[:half] - rho, x[half : len(x) - half], x[len(x) - half :] + rho]), low, high)


def private_medians(x: np.ndarray, w: np.ndarray, eps: float, low: float, high: float, rng: np.random.Generator) -> np.ndarray:
    """Exponential-mechanism median of each row of counts w over the values x."""
    order = np.argsort(x, kind="stable")
    edges = np.concatenate([[low], x[order], [high]])
    n = int(w[0].sum())
    rank = np.concatenate([np.zeros((len(w), 1)), w[:, order].cumsum(1)], 1)
    width = np.diff(edges)[None, :].repeat(len(w), 0)
    with np.errstate(divide="ignore"):
        score = np.log(width) - eps / 2 * rank_distance(rank, n) + rng.gumbel(size=width.shape)
    # A gap around a value that a resample lacks is part of the larger gap of the same rank; splitting it by width
    # leaves the law of the released point unchanged.
    best = score.argmax(1)
    return edges[best] + rng.random(len(w)) * (edges[best + 1] - edges[best])


def estimates(x: np.ndarray, w: np.ndarray, study: Study, eps: float, dist: Distribution, rng: np.random.Generator) -> np.ndarray:
    """Private estimates of each row of counts; eps infinite gives the plain ones."""
    low, high = dist.bounds
    if study.task == "mean":
        est = weighted_mean(x[:, None], w)[:, 0]
        return est if math.isinf(eps) else est + rng.laplace(0, (high - low) / (w[0].sum() * eps), len(w))
    return weighted_median(x[:, None], w)[:, 0] if math.isinf(eps) else private_medians(x, w, eps, low, high, rng)


def noisy_middles(values: np.ndarray, g: float, l_: float, rng: np.random.Generator) -> np.ndarray:
    """Order statistics at noisy middle ranks of each column: below 1 gives 0, above all gives 1."""
    n, k = values.shape
    i = np.trunc(n / 2 + rng.laplace(0, 1 / g, k) + rng.laplace(0, 1 / l_, k)).astype(int)
    picked = np.sort(values, axis=0)[np.clip(i - 1, 0, n - 1), np.arange(k)]
    return np.where(i < 1, 0.0, np.where(i > n, 1.0, picked))


def orders(kind: str, m: int, least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first, last) bins of the candidates in their order, in blocks: short ones by width, others all at once."""
    if kind == "symm":
        q, odd = divmod(m, 2)
        i = np.arange(least // 2, q if odd else q - 1)
        yield (q if odd else q - 1) - i, q + i
    elif kind == "low":
        first = np.arange(m // 2, -1, -1)
        yield first, np.full(len(first), m - 1)
    elif kind == "up":
        last = np.arange(m // 2, m)
        yield np.zeros(len(last), int), last
    elif kind == "short":
        for w in range(least, m):
            k = m - w
            t = np.arange(k)
            place = np.where(t % 2 == 0, k // 2 - t // 2, k // 2 + t // 2) if k % 2 == 0 else np.where(t % 2 == 1, k // 2 - (t + 1) // 2, k // 2 + t // 2)
            yield place, place + w
    else:
        raise ValueError(f"no set type {kind!r}")


def searched(stats: list[np.ndarray], low: float, high: float, m: int, alpha: float, eps: float, kind: str, rng: np.random.Generator, least: int = 0) -> tuple[float, float]:
    """AboveThreshold over the chunks' histograms: the first accepted candidate, else the whole range."""
    if kind == "eqtail":
        return searched(stats, low, high, m, alpha / 2, eps / 2, "low", rng)[0], searched(stats, low, high, m, alpha / 2, eps / 2, "up", rng)[1]
    edges = np.linspace(low, high, m + 1)
    cum = np.array([np.concatenate([[0], np.histogram(s[(s >= low) & (s < high)], edges)[0].cumsum()]) / len(s) for s in stats])
    for first, last in orders(kind, m, least):
        hit = np.flatnonzero(noisy_middles(cum[:, last + 1] - cum[:, first], eps / 2, eps / 4, rng) > 1 - alpha)
        if len(hit):
            return float(edges[first[hit[0]]]), float(edges[last[hit[0]] + 1])
    return low, high


def quantiles(stats: np.ndarray, alpha: float, kind: str) -> tuple[float, float]:
    """The bootstrap's interval of a set type; the shortest is not defined for it and counts as symmetric."""
    q = lambda x, p: float(np.quantile(x, p, method="inverted_cdf"))
    if kind == "eqtail":
        return q(stats, alpha / 2), q(stats, 1 - alpha / 2)
    if kind == "low":
        return q(stats, alpha), math.inf
    if kind == "up":
        return -math.inf, q(stats, 1 - alpha)
    half = q(np.abs(stats), 1 - alpha)
    return -half, half


def clipped_means(values: np.ndarray, c: float, r: float, cov: float, betas: list[float], rhos: list[float], rng: np.random.Generator) -> list[dict[str, float]]:
    """zcdp.mean_iterative over an array, with a generator's noise."""
    root, mid, s = math.sqrt(cov), float(values.mean()), len(values)
    z, c, r, out = (values - mid) / root, c / root, r / root, []
    for beta, rho in zip(betas, rhos, strict=True):
        clip = r + gaussian_tailbound(1, beta / 2 / s)
        sd = 2 * clip / s / math.sqrt(2 * rho)
        c, r = float(np.clip(z, c - clip, c + clip).mean()) + sd * rng.normal(), gaussian_tailbound(1, beta / 2) * math.sqrt(1 / s + 2 * clip**2 / (s**2 * rho))
        out.append({"est": c * root + mid, "noise_var": sd**2 * cov})
    return out


def zcdp_set(x: np.ndarray, eps: float, alpha: float, estimate: Callable[[np.ndarray, np.ndarray], np.ndarray], rng: np.random.Generator, steps: int = ZCDP_STEPS) -> tuple[float, float]:
    """The zCDP interval of the parameter that `estimate` gives for rows and each row of their counts: clipped Gaussian
    means of the chunks' bootstrap means and variances.

    The bounds of the clipping come from a little bootstrap of its own on the same rows, as the study has it.
    """
    n = len(x)
    size = zcdp_sizing(n, eps)
    b, chunks = size["b"], chunk_count(n, size["b"], "drop")

    def little() -> tuple[np.ndarray, np.ndarray]:
        parts = rng.permutation(x)[: chunks * b].reshape(chunks, b, *x.shape[1:])
        est = [estimate(c, resample_counts(n, b, size["runs"], rng)) for c in parts]
        return np.array([e.mean() for e in est]), np.array([e.var(ddof=1) for e in est])

    (guess_m, guess_v), (m, v) = little(), little()
    rho, beta = eps_to_rho(eps, n**-1.1) / 2, FAILURE / 2
    center = float(guess_v.mean())
    releases = clipped_means(v, center, OVERESTIMATE * center, OVERESTIMATE * float(guess_v.var(ddof=1)), budgets(beta / 4, steps), budgets(rho, steps), rng)
    est, var = weighted(releases)
    est = max(0.0, max(0.0, est) + normal_quantile(1 - beta / 2, math.sqrt(var)))
    releases = clipped_means(m, float(guess_m.mean()), OVERESTIMATE * float(np.abs(guess_m).max()), chunks * est, budgets(beta, steps), budgets(rho, steps), rng)
    value, noise = weighted(releases, est)
    half = normal_quantile(1 - alpha / 2, math.sqrt(est + noise))
    return value - half, value + half


COLUMNS = ["n", "eps", "trial", "method", "resample", "covered", "width"]


def one_trial(n: int, eps: float, trial: int, study: Study) -> pd.DataFrame:
    """Rows (n, eps, trial, method, resample, covered, width)."""
    dist = study_distribution(study.dist)
    rng = np.random.default_rng([n, round(eps * 1000), trial])
    draw = lambda: dist.draw(rng, n)
    truth, sd = study.truth(dist)
    low, high = dist.bounds
    if study.zcdp:
        lo, hi = zcdp_set(draw(), eps, study.alpha, lambda c, w: estimates(c, w, study, math.inf, dist, rng), rng)
        return pd.DataFrame([(n, eps, trial, "gvdp", k, int(lo <= truth <= hi), hi - lo) for k in range(study.resamples)], columns=COLUMNS)
    own, rest = study.share * eps, (1 - study.share) * eps
    size = sizing(n, rest, study.set_type)
    x, root = draw(), math.sqrt(n)
    s = chunk_count(n, size["b"])
    perm = rng.permutation(x)
    chunks = [perm[i * size["b"] : (i + 1) * size["b"] if i < s - 1 else n] for i in range(s)]
    runs = min(size["runs"], study.max_boot)
    stats = []
    for c in chunks:
        w = resample_counts(n, len(c), runs, rng)
        theta = estimates(c, np.ones((1, len(c))), study, math.inf, dist, rng)
        stats.append(root * (theta - estimates(c, w, study, own, dist, rng)))
    found: dict[str, tuple[float, float]] = {}
    bins = Bins.of_precision(-SEARCH * sd, SEARCH * sd, size["precision"], True)
    found["proper_unstud"] = searched(stats, bins.low, bins.high, bins.count, study.alpha, rest, study.set_type, rng)
    # Variances and their bound are those of the estimate times n, and so is the granularity n^-1.5 of the median.
    variances = np.clip(np.nan_to_num([v.var(ddof=1) for v in stats], nan=1e9), 0, top := variance_bound(n, sd=sd) * n)
    middle = private_medians(spread_apart(variances, granularity(n) * n, 0.0, top), np.ones((1, s)), rest, 0.0, top, rng)[0]
    half = student_quantile(1 - study.alpha / 2, n - 1) * math.sqrt(middle)
    found["normal_proper_blb"] = (-half, half)
    if "normal_proper_adhoc" in study.methods:
        m = max(abs(low), abs(high))
        std = x.std(ddof=1) + rng.laplace(0, (m * m / n + 2 * m * (high - low) / (n * (n - 1))) / rest)
        half = student_quantile(1 - study.alpha / 2, n - 1) * math.hypot(std, math.sqrt(2) * (high - low) / (n * own) * root)
        found["normal_proper_adhoc"] = (-half, half)
    most = min(size["boot_runs"], study.max_boot)
    released = [estimates(x, resample_counts(n, n, min(RUNS, most - at), rng), study, own, dist, rng) for at in range(0, most, RUNS)]
    boot = root * (estimates(x, np.ones((1, n)), study, math.inf, dist, rng) - np.concatenate(released))
    found["boot_unstud_priv"] = quantiles(boot, study.alpha, study.set_type)
    rows = []
    for k in range(study.resamples):
        est = float(estimates(draw(), np.ones((1, n)), study, own, dist, rng)[0])
        rows += [(n, eps, trial, method, k, int(est + lo / root <= truth <= est + hi / root), (hi - lo) / root) for method, (lo, hi) in found.items()]
    return pd.DataFrame(rows, columns=COLUMNS)


SCHEMA = "n int, eps double, trial int, method string, resample int, covered int, width double"


MOST_TASKS = 2048


def dealt(rows: DataFrame, groups: int, *keys: str) -> DataFrame:
    """rows by their keys in a task a group, up to MOST_TASKS: the size of the rows says nothing of the work on a group,
    so adaptive execution must not join partitions here."""
    return rows.repartition(max(1, min(groups, MOST_TASKS)), *keys)


def run_trials(spark: SparkSession, study: Study, ns: list[int], budgets: list[float], trials: int) -> DataFrame:
    """All trials of a study as one frame."""
    cases = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(e)).alias("eps")) for n in ns for e in budgets])
    return trials_of(spark.range(trials).select(F.col("id").cast("int").alias("trial"), F.explode(cases).alias("c")).select("c.n", "c.eps", "trial"), study)


def trials_of(cells: DataFrame, study: Study) -> DataFrame:
    """The rows of the trials (n, eps, trial)."""

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        return one_trial(int(key[0]), float(key[1]), int(key[2]), study)

    return dealt(cells, cells.count(), "n", "eps", "trial").groupBy("n", "eps", "trial").applyInPandas(run, SCHEMA)


def study_summary(results: DataFrame) -> DataFrame:
    """Coverage and width of every method by n and eps."""
    return results.groupBy("n", "eps", "method").agg(F.avg("covered").alias("coverage"), F.avg("width").alias("width"), (F.stddev_samp("width") / F.sqrt(F.count("*"))).alias("width_se"), F.count("*").alias("rows"))
