"""Monte-Carlo studies that can be stopped and go on, and add trials until the coverage of each cell is known well enough.

A cell is an (n, eps) of a study. Trials come in rounds of doubling size; a round's trials are written in parts to the study's folder, and a part counts
once its write is committed. A study that is started again reads what is there and runs the trials that are missing, nothing else;
trials are keyed by (n, eps, trial), so stopped or not, the rows are the same.

After each round a cell gets a confidence interval of the coverage of each of its estimates. Round k takes the share 6 / (pi k)^2 of the error, so all
intervals hold at once, whenever the study stops looking. A cell is done when the widest of its intervals has the stated half width, or at its bound
of trials.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.functions.session import children, exists
from veilstat.functions.special import beta_quantile

Simulate = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Goal:
    """Half width of the coverage's confidence interval, its level, trials of the first round, bound of trials, trials of a cell in a part."""

    half_width: float = 0.02
    level: float = 0.95
    first: int = 32
    most: int = 1000
    part: int = 64

    def rounds(self) -> list[tuple[int, int]]:
        """(first, last + 1) of each round's trials: as many as all before, up to the bound."""
        out, at = [], 0
        while at < self.most:
            end = min(self.most, at + max(self.first, at))
            out.append((at, end))
            at = end
        return out


def exact_interval(hits: int, n: int, error: float) -> tuple[float, float]:
    """Clopper and Pearson's interval of a chance from `hits` of n."""
    low = 0.0 if hits == 0 else beta_quantile(error / 2, hits, n - hits + 1)
    high = 1.0 if hits == n else beta_quantile(1 - error / 2, hits + 1, n - hits)
    return low, high


def entropy_interval(mean: float, n: int, error: float) -> tuple[float, float]:
    """Hoeffding's interval of the mean of values in [0, 1]: the chances whose relative entropy to the mean is at most ln(2 / error) / n."""
    most = math.log(2 / error) / n
    part = lambda a, b: 0.0 if a == 0 else math.inf if b == 0 else a * math.log(a / b)
    far = lambda p: part(mean, p) + part(1 - mean, 1 - p) > most

    def end(inside: float, outside: float) -> float:
        for _ in range(60):
            mid = (inside + outside) / 2
            inside, outside = (inside, mid) if far(mid) else (mid, outside)
        return outside

    return end(mean, 0.0), end(mean, 1.0)


def interval(n: int, mean: float, binary: bool, error: float) -> tuple[float, float]:
    """Of a coverage from n trials, each either covering or not, or each with a share of its resamples that cover."""
    return exact_interval(round(mean * n), n, error) if binary else entropy_interval(mean, n, error)


def by_trial(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., trials, coverage, binary, width, width_se): trials are what is independent, so a trial's resamples count as one share."""
    each = results.groupBy(*keys, "trial").agg(F.avg("covered").alias("c"), F.avg("width").alias("w"))
    return each.groupBy(*keys).agg(F.count("*").alias("trials"), F.avg("c").alias("coverage"), F.min((F.col("c") == 0) | (F.col("c") == 1)).alias("binary"), F.avg("w").alias("width"), (F.stddev_samp("w") / F.sqrt(F.count("*"))).alias("width_se"))


def round_error(k: int, level: float) -> float:
    """The share of the error that round k, from 1, takes."""
    return (1 - level) * 6 / (math.pi * k) ** 2


def parts(folder: str, spark: SparkSession) -> list[str]:
    """Committed parts of a study."""
    return [p for p in children(spark, folder) if exists(spark, f"{p}/_SUCCESS")]


def written(spark: SparkSession, folder: str) -> DataFrame | None:
    done = parts(folder, spark)
    return spark.read.parquet(*done) if done else None


def missing(wanted: DataFrame, there: DataFrame | None) -> DataFrame:
    """The (n, eps, trial) that no committed part holds."""
    return wanted if there is None else wanted.join(there.select("n", "eps", "trial").distinct(), ["n", "eps", "trial"], "left_anti")


def run_study(spark: SparkSession, folder: str, cells: list[tuple[int, float]], simulate: Simulate, goal: Goal, keys: list[str] | None = None, stop_after: int | None = None) -> DataFrame:
    """(n, eps, keys..., trials, coverage, low, high, width, width_se) of each cell; `keys` name its estimates (by default the method).

    `simulate` gives the rows (n, eps, trial, ..., covered, width) of a frame (n, eps, trial). The driver keeps a row an estimate of a cell. After
    `stop_after` parts the study stops with what it has, as if it had been interrupted.
    """
    group, open_cells, bounds, used = ["n", "eps", *(keys or ["method"])], list(cells), {}, 0
    for k, (lo, hi) in enumerate(goal.rounds(), 1):
        for at in range(lo, hi, goal.part):
            wanted = spark.createDataFrame(open_cells, "n int, eps double").withColumn("trial", F.explode(F.sequence(F.lit(at), F.lit(min(hi, at + goal.part) - 1))))
            todo = missing(wanted, written(spark, folder))
            if todo.isEmpty():
                continue
            if stop_after is not None and used >= stop_after:
                return _table(spark, bounds, group)
            simulate(todo).write.parquet(f"{folder}/round={k}-from={at}-{len(parts(folder, spark))}")
            used += 1
        own = written(spark, folder).filter(F.col("trial") < hi).join(F.broadcast(spark.createDataFrame(open_cells, "n int, eps double")), ["n", "eps"])
        widest: dict[tuple[int, float], float] = {}
        for r in by_trial(own, group).collect():  # a row an estimate of an open cell
            low, high = interval(r.trials, r.coverage, r.binary, round_error(k, goal.level))
            bounds[tuple(r[c] for c in group)] = (r.trials, r.coverage, low, high, r.width, r.width_se)
            widest[r.n, r.eps] = max(widest.get((r.n, r.eps), 0.0), (high - low) / 2)
        open_cells = [c for c in open_cells if widest.get((c[0], float(c[1])), 1.0) > goal.half_width]
        if not open_cells:
            break
    return _table(spark, bounds, group)


def _table(spark: SparkSession, bounds: dict[tuple, tuple], group: list[str]) -> DataFrame:
    kinds = {"n": "int", "eps": "double", "dim": "int"}
    schema = ", ".join([f"{c} {kinds.get(c, 'string')}" for c in group] + ["trials long, coverage double, low double, high double, width double, width_se double"])
    return spark.createDataFrame([(*k, *v) for k, v in bounds.items()], schema)
