"""Monte-Carlo trials of logistic coefficients, each trial on rows drawn without replacement from a population.

The population is a table of any size: rows get their place in a keyed permutation once, a trial draws places, and an
equi-join brings the rows. First come the sets: one grouped map over (n, trial) forms the intervals of every method
and coefficient. Then each resample's released estimate, one grouped map over (n, trial, resample), meets the sets of
its trial by an equi-join. The generator of a group depends on its key alone.

The zCDP interval (gvdp) of one coefficient is a study of its own, on the same draws or on rows made in the trial.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.functions.session import checkpointed
from veilstat.functions.special import student_quantile
from veilstat.operators.chunking import SURVEY_RANGES, chunk_count, granularity, permutation_rank, survey_sizing, variance_bound
from veilstat.operators.histograms import Bins
from veilstat.operators.logistic import fit, private_weighted, weighted_newton, with_intercept
from veilstat.operators.mechanisms import in_interval
from veilstat.operators.resampling import resample_counts
from veilstat.operators.trial import dealt, private_medians, quantiles, searched, spread_apart, zcdp_set

METHODS = ("proper_unstud", "normal_proper_blb", "boot_unstud_priv")
BLOCK = 256
FEW_DRAWS = 1 << 20  # draws that are broadcast to the population, about 40 MB; more of them meet it by a merge join


@dataclass(frozen=True)
class LogisticStudy:
    """Sizes and budgets of the study of all coefficients, the intercept last; `ranges` are half widths of the search."""

    ranges: tuple[float, ...] = SURVEY_RANGES
    eps: float = 8.0
    share: float = 0.5
    alpha: float = 0.05
    set_type: str = "symm"
    resamples: int = 320
    norm_bound: float = 1.0
    round_up: bool = False

    def __post_init__(self):
        if self.set_type not in ("symm", "short"):
            raise ValueError(f"set type {self.set_type!r} is not for all dimensions")


def arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """x with a last column of ones, and y, in one order whatever the order of the rows."""
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float)
    order = np.lexsort((y, *x.T))
    return np.hstack([x, np.ones((len(x), 1))])[order], y[order]


def resampled(x: np.ndarray, y: np.ndarray, n: int, runs: int, start: np.ndarray, eps: float, norm_bound: float, rng: np.random.Generator) -> np.ndarray:
    """Released estimates of `runs` resamples of n rows; infinite eps gives the plain ones."""
    out = []
    for lo in range(0, runs, BLOCK):
        w = resample_counts(n, len(x), min(BLOCK, runs - lo), rng)
        out.append(weighted_newton(x, y, w, start) if math.isinf(eps) else private_weighted(x, y, w, start, eps, norm_bound, rng))
    return np.concatenate(out)


def sets_of(x: np.ndarray, y: np.ndarray, study: LogisticStudy, start: np.ndarray, rng: np.random.Generator) -> list[tuple[str, int, float, float]]:
    """(method, dim, l, u) of every method and coefficient, in the scale of the root of n."""
    n, root = len(y), math.sqrt(len(y))
    own, rest = study.share * study.eps, (1 - study.share) * study.eps
    size = survey_sizing(n, rest)
    s = chunk_count(n, size["b"], "all_dim")
    perm = rng.permutation(n)
    stats = []
    for i in range(s):
        at = perm[i * size["b"] : (i + 1) * size["b"] if i < s - 1 else n]
        theta = weighted_newton(x[at], y[at], np.ones((1, len(at))), start)
        stats.append(root * (theta - resampled(x[at], y[at], n, size["runs"], start, own, study.norm_bound, rng)))
    whole = weighted_newton(x, y, np.ones((1, n)), start)
    boot = root * (whole - resampled(x, y, n, size["boot_runs"], start, own, study.norm_bound, rng))
    out = []
    for d, reach in enumerate(study.ranges):
        bins = Bins.of_precision(-reach, reach, size["precision"], study.round_up)
        out.append(("proper_unstud", d, *searched([c[:, d] for c in stats], bins.low, bins.high, bins.count, study.alpha, rest, study.set_type, rng)))
        top = variance_bound(n, width=reach) * n
        variances = np.clip(np.nan_to_num([c[:, d].var(ddof=1) for c in stats], nan=top), 0, top)
        middle = private_medians(spread_apart(variances, granularity(n) * n, 0.0, top), np.ones((1, s)), rest, 0.0, top, rng)[0]
        half = student_quantile(1 - study.alpha / 2, n - 1) * math.sqrt(middle)
        out.append(("normal_proper_blb", d, -half, half))
        out.append(("boot_unstud_priv", d, *quantiles(boot[:, d], study.alpha, "eqtail")))
    return out


def run_logistic_trials(population: DataFrame, key: str, study: LogisticStudy, ns: list[int], trials: int) -> DataFrame:
    """All trials of a study as one frame."""
    grid = population.sparkSession.range(trials).select(F.explode(F.array(*[F.lit(n) for n in ns])).alias("n"), F.col("id").cast("int").alias("trial"))
    return logistic_trials_of(Population(population, key), study, grid)


class Population:
    """Rows (key, x, y) to draw from, with their places in a keyed permutation and the coefficients of all of them: found once, used by every part of a study."""

    def __init__(self, rows: DataFrame, key: str, few: int = FEW_DRAWS):
        self.rows, self.total, self.few = rows, rows.count(), few
        self.placed = checkpointed(permutation_rank(rows.select(key, "x", "y"), key, purpose="population", n=self.total).select("pos", "x", "y"))
        self.d = rows.select(F.size("x")).first()[0] + 1
        self.truth = np.array(fit(with_intercept(self.placed), self.d, tolerance=1e-6))  # a step reads x and y, and makes no row anew

    def drawn(self, cases: DataFrame) -> DataFrame:
        """(n, trial, resample, x, y) of the cases (n, trial, resample): n rows for each, without replacement."""
        total = self.total

        def places(frames):
            for frame in frames:
                for n, t, k in frame.itertuples(index=False):
                    if n > total:
                        raise ValueError(f"the population has {total} rows, a trial asks for {n}")
                    at = np.random.default_rng([n, t, k + 1]).choice(total, n, replace=False)
                    yield pd.DataFrame({"n": n, "trial": t, "resample": k, "pos": at})

        draws = cases.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
        rows = cases.repartition("n", "trial", "resample").mapInPandas(places, "n int, trial int, resample int, pos long")
        if draws <= self.few:  # the population stays where it is: no round sorts it or sends it
            return self.placed.join(F.broadcast(rows), "pos").select("n", "trial", "resample", "x", "y")
        # The plan takes the draws for as small as their cases, and the places for as small as the files: neither may be broadcast.
        return rows.hint("merge").join(self.placed.hint("merge"), "pos").select("n", "trial", "resample", "x", "y")


def logistic_trials_of(population: Population, study: LogisticStudy, grid: DataFrame) -> DataFrame:
    """(n, eps, trial, method, dim, resample, covered, width) of the trials (n, trial); each dimension spends the whole budget."""
    d, truth, cells = len(study.ranges), population.truth, grid.count()

    def form(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, t = int(key[0]), int(key[1])
        x, y = arrays(rows)
        return pd.DataFrame([(n, t, *r) for r in sets_of(x, y, study, truth, np.random.default_rng([n, t, 7]))], columns=["n", "trial", "method", "dim", "l", "u"])

    def release(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, t, k = (int(v) for v in key)
        x, y = arrays(rows)
        est = private_weighted(x, y, np.ones((1, n)), truth, study.share * study.eps, study.norm_bound, np.random.default_rng([n, t, k, 11]))[0]
        return pd.DataFrame({"n": n, "trial": t, "resample": k, "dim": np.arange(d), "est": est, "truth": truth})

    first = population.drawn(grid.withColumn("resample", F.lit(-1)))
    sets = checkpointed(dealt(first, cells, "n", "trial").groupBy("n", "trial").applyInPandas(form, "n int, trial int, method string, dim int, l double, u double"))
    again = population.drawn(grid.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(study.resamples - 1)))))
    released = dealt(again, cells * study.resamples, "n", "trial", "resample").groupBy("n", "trial", "resample").applyInPandas(release, "n int, trial int, resample int, dim int, est double, truth double")
    root = F.sqrt(F.col("n"))
    return released.join(sets, ["n", "trial", "dim"]).select(
        "n", F.lit(study.eps).alias("eps"), "trial", "method", "dim", "resample",
        in_interval(F.col("truth"), F.col("est") + F.col("l") / root, F.col("est") + F.col("u") / root).alias("covered"), ((F.col("u") - F.col("l")) / root).alias("width"),
    )


SCHEMA = "n int, eps double, trial int, method string, dim int, resample int, covered int, width double"


def coefficient(x: np.ndarray, w: np.ndarray, dim: int, start: np.ndarray) -> np.ndarray:
    """One coefficient of each row of weights; the last column of x is y."""
    return np.concatenate([weighted_newton(x[:, :-1], x[:, -1], w[lo : lo + BLOCK], start)[:, dim] for lo in range(0, len(w), BLOCK)])


def zcdp_row(n: int, eps: float, trial: int, dim: int, rows: np.ndarray, truth: np.ndarray, alpha: float) -> tuple:
    lo, hi = zcdp_set(rows, eps, alpha, lambda c, w: coefficient(c, w, dim, truth), np.random.default_rng([n, round(eps * 1000), trial, dim]))
    return n, eps, trial, "gvdp", dim, 0, int(lo <= truth[dim] <= hi), hi - lo


def run_zcdp_survey(population: DataFrame, key: str, ns: list[int], budgets: list[float], trials: int, dim: int = 0, alpha: float = 0.05) -> DataFrame:
    """The zCDP interval of one coefficient on rows drawn from a population of (key, x, y): all trials as one frame."""
    return zcdp_survey_of(Population(population, key), _cells(population.sparkSession, ns, budgets, trials), dim, alpha)


def _cells(spark: SparkSession, ns: list[int], budgets: list[float], trials: int) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(e)).alias("eps")) for n in ns for e in budgets])
    return spark.range(trials).select(F.col("id").cast("int").alias("trial"), F.explode(cases).alias("c")).select("c.n", "c.eps", "trial")


def zcdp_survey_of(population: Population, cells: DataFrame, dim: int = 0, alpha: float = 0.05) -> DataFrame:
    """The rows of the trials (n, eps, trial); the budgets of a trial share its rows."""
    truth = population.truth
    grid = cells.groupBy("n", "trial").agg(F.sort_array(F.collect_set("eps")).alias("budgets"))
    rows = population.drawn(grid.select("n", "trial", F.lit(-1).alias("resample"))).join(grid, ["n", "trial"])

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x, y = arrays(own)
        made = [zcdp_row(int(key[0]), float(e), int(key[1]), dim, np.hstack([x, y[:, None]]), truth, alpha) for e in own["budgets"].iloc[0]]
        return pd.DataFrame(made, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt(rows, grid.count(), "n", "trial").groupBy("n", "trial").applyInPandas(run, SCHEMA)


def run_zcdp_synthetic(spark: SparkSession, beta: list[float], ns: list[int], budgets: list[float], trials: int, dim: int = 0, dist: str = "uniform", alpha: float = 0.05) -> DataFrame:
    """The zCDP interval of one coefficient (the last of beta is the intercept) on rows made in each trial: all trials as one frame."""
    return zcdp_synthetic_of(_cells(spark, ns, budgets, trials), beta, dim, dist, alpha)


def zcdp_synthetic_of(cells: DataFrame, beta: list[float], dim: int = 0, dist: str = "uniform", alpha: float = 0.05) -> DataFrame:
    """The rows of the trials (n, eps, trial)."""
    if dist not in ("uniform", "normal"):
        raise ValueError(f"no distribution {dist!r}")
    truth = np.array(beta, float)

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        n, eps, t = int(key[0]), float(key[1]), int(key[2])
        rng = np.random.default_rng([n, round(eps * 1000), t, 3])
        x = rng.uniform(-1, 1, (n, len(truth) - 1)) if dist == "uniform" else rng.normal(size=(n, len(truth) - 1))
        x = np.hstack([x, np.ones((n, 1))])
        y = np.where(rng.random(n) < 1 / (1 + np.exp(-(x @ truth))), 1.0, -1.0)
        return pd.DataFrame([zcdp_row(n, eps, t, dim, np.hstack([x, y[:, None]]), truth, alpha)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt(cells, cells.count(), "n", "eps", "trial").groupBy("n", "eps", "trial").applyInPandas(run, SCHEMA)
