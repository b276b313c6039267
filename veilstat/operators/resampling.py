"""Bootstrap and bag-of-little-bootstraps statistics of the mean and of any weighted estimator.

Two forms of one law: `boot_stats` draws every resampled row by a keyed index (the form that SQL engines
can repeat exactly) and counts the draws of a slot, `weighted_stats` gives each of a chunk's b rows a multinomial count instead of n copies and refits
the estimator on weights, so a resample of size n costs O(b).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.functions.keyed import uniforms_np
from veilstat.functions.session import checkpointed
from veilstat.operators.mechanisms import noisy, std_sensitivity
from veilstat.operators.selection import quantiles

RUNS = 256
PAGE = 1 << 17  # slots of a chunk that are counted together
RANGE = 1 << 22  # draws of a run that are made together
TASK = 1 << 23  # draws a task makes, about
SOME = 32  # runs whose counts of a page are one group


def packed(rows: DataFrame, x: str, by: list[str], page: int = PAGE) -> DataFrame:
    """(by..., page, x, missing): `page` values in the order of their slots, and the places of nulls, as packed numbers."""
    known = rows.select(*by, (F.col("slot") / F.lit(page)).cast("int").alias("page"), "slot", F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("x"), F.col(x).isNull().alias("missing"))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("slot")
        return pd.DataFrame([(*key, own["x"].to_numpy(float).tobytes(), np.flatnonzero(own["missing"]).astype(np.int32).tobytes())], columns=[*by, "page", "x", "missing"])

    return known.groupBy(*by, "page").applyInPandas(run, ", ".join([*(f"{c} int" for c in by), "page int, x binary, missing binary"]))


def drawn_counts(grid: DataFrame, n: int, tasks: int, seed: int = 0, page: int = PAGE, span: int = RANGE) -> DataFrame:
    """(chunk, run, part, page, dense, counts) of the grid (chunk, nb, run, part): how often a run's draws part * span, ... fall on the slots of a page.

    `counts` has a number a slot (dense), or a slot a draw where draws are fewer. A part's draws are sorted, so memory depends on `span` alone.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c, nb, r, part in frame.itertuples(index=False):
                first = part * span
                slots = np.sort(np.floor(uniforms_np(first, min(n, first + span), "boot", seed, c, r) * float(nb)).astype(np.int64))
                starts = np.flatnonzero(np.append(True, slots[1:] // page != slots[:-1] // page))
                out = []
                for a, z in zip(starts, np.append(starts[1:], len(slots)), strict=True):
                    k = slots[a] // page
                    size, own = min(page, nb - k * page), slots[a:z] - k * page
                    dense = 4 * len(own) > size
                    counts = np.bincount(own, minlength=size) if dense else own
                    out.append((c, r, part, k, dense, counts.astype(np.min_scalar_type(counts.max()) if dense else np.uint32).tobytes()))
                yield pd.DataFrame(out, columns=["chunk", "run", "part", "page", "dense", "counts"])

    return grid.select("chunk", "nb", "run", "part").repartition(tasks).mapInPandas(run, "chunk int, run int, part int, page int, dense boolean, counts binary")


@dataclass(frozen=True)
class Release:
    """How the estimate of a resample is released: the bounds of the values, the budget of the estimate (infinite: as it
    is), whether the statistic is divided by the resample's deviation, and the budget of that."""

    low: float = 0.0
    high: float = 1.0
    eps: float = math.inf
    studentize: bool = False
    eps_sigma: float = math.inf


def boot_stats(chunked: DataFrame, x: str, n: int, runs: int, seed: int = 0, release: Release = Release(), copies: int = 0, page: int = PAGE, span: int = RANGE) -> DataFrame:
    """(chunk, run, est, stat) with stat = sqrt(n) (mean of the chunk - released mean of the resample), over its released deviation if asked for.

    The chunk's own mean is never private: the bootstrap puts it in the place of the truth. Noise is keyed by chunk and run. With `copies` the rows
    (slot, x) are those of each of that many chunks.

    Draws stay where they are made: what moves is how often each slot of a page comes in a run, and the pages of values once for SOME runs.
    """
    spark, by = chunked.sparkSession, [] if copies else ["chunk"]
    each = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("chunk") if copies else "chunk"
    own = chunked.groupBy(*by).agg(F.count("*").alias("nb"), F.avg(x).alias("theta"))
    own = checkpointed(own.filter("nb > 0").select(each, "nb", "theta"))  # a row a chunk
    parts = -(-n // span)
    numbers = lambda k, name: F.broadcast(spark.range(k).select(F.col("id").cast("int").alias(name)))
    grid = own.crossJoin(numbers(runs, "run")).crossJoin(numbers(parts, "part"))
    counts = drawn_counts(grid, n, -(-own.count() * runs * n // TASK) or 1, seed, page, span).withColumn("some", (F.col("run") / F.lit(SOME)).cast("int"))
    pages = packed(chunked, x, by, page).select(each, "page", "x", "missing").join(own.select("chunk", F.coalesce("theta", F.lit(0.0)).alias("theta")), "chunk")
    pages = pages.crossJoin(numbers(-(-runs // SOME), "some")).crossJoin(numbers(parts, "part"))

    def sums(held: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        """Of each run's draws of a page: how many, their sum, and sums of their distances from the chunk's mean and of the squares."""
        if not len(held) or not len(drawn):
            return pd.DataFrame({"chunk": [], "run": [], "w": [], "s": [], "d": [], "q": []})
        v = np.frombuffer(held["x"].iloc[0])
        known, whole = np.ones(len(v)), np.isfinite(v).all()
        known[np.frombuffer(held["missing"].iloc[0], np.int32)] = 0
        gap = (v - held["theta"].iloc[0]) * known
        terms = np.stack([known, v, gap, gap * gap], axis=1)
        out = []
        for c, r, dense, counted in zip(drawn["chunk"], drawn["run"], drawn["dense"], drawn["counts"], strict=True):
            w = np.frombuffer(counted, f"u{len(counted) // len(v)}") if dense else np.bincount(np.frombuffer(counted, np.uint32), minlength=len(v))
            hit = slice(None) if whole else w > 0  # no count times an infinite value
            out.append((c, r, *(w[hit].astype(float) @ terms[hit])))
        return pd.DataFrame(out, columns=["chunk", "run", "w", "s", "d", "q"])

    key = ["chunk", "page", "part", "some"]
    found = pages.groupBy(*key).cogroup(counts.groupBy(*key)).applyInPandas(sums, "chunk int, run int, w double, s double, d double, q double")
    est = found.groupBy("chunk", "run").agg(*[F.sum(c).alias(c) for c in "wsdq"])
    w, spread = F.col("w"), F.greatest(F.col("q") - F.col("d") * F.try_divide("d", "w"), F.lit(0.0))
    est = est.select("chunk", "run", F.when(w > 0, F.try_divide("s", "w")).alias("_m"), F.when(w > 1, F.sqrt(F.try_divide(spread, w - 1))).alias("_s"))
    keys = (seed, F.col("chunk"), F.col("run"))
    est = est.select("chunk", "run", noisy(F.col("_m"), release.eps, (release.high - release.low) / n, "boot-est", *keys).alias("est"), noisy(F.col("_s"), release.eps_sigma, std_sensitivity(release.low, release.high, n), "boot-std", *keys).alias("_s"))
    gap = F.lit(float(n) ** 0.5) * (F.col("theta") - F.col("est"))
    return est.join(own, "chunk").select("chunk", "run", "est", (gap / F.col("_s") if release.studentize else gap).alias("stat"))


OFTEN = 8  # draws a row from which on a row's count is drawn as a binomial


def resample_counts(n: int, b: int, runs: int, rng: np.random.Generator) -> np.ndarray:
    """How often each of b rows comes in each of `runs` resamples of n: row by row where rows come often, else draw by draw."""
    if n > OFTEN * b:
        return rng.multinomial(n, np.full(b, 1 / b), size=runs).astype(float)
    place = rng.integers(0, b, (runs, n)) + np.arange(runs)[:, None] * b
    return np.bincount(place.ravel(), minlength=runs * b).reshape(runs, b).astype(float)


HELD = 1 << 21  # counts that a task holds at a time: 16 MB

Weighted = Callable[[np.ndarray, np.ndarray], np.ndarray]
Private = Callable[[np.ndarray, np.ndarray, np.random.Generator], np.ndarray]


def of_rows(estimator: Callable[[np.ndarray], np.ndarray | float]) -> Weighted:
    """The weighted form of a plain function of rows, which gets the rows of each resample, as often as they come, one resample at a time."""

    def run(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.stack([np.atleast_1d(np.asarray(estimator(np.repeat(x, row.astype(int), axis=0)), float)) for row in w])

    return run


def weighted_mean(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One row of estimates a row of weights."""
    return (w @ x) / w.sum(1, keepdims=True)


def weighted_median(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Median of the resample that the counts stand for; the midpoint of the two middle rows if their number is even."""
    order = np.argsort(x[:, 0], kind="stable")
    v, c = x[order, 0], w[:, order].cumsum(1)
    n = c[:, -1:]
    lower, upper = (c >= (n + 1) // 2).argmax(1), (c >= n // 2 + 1).argmax(1)
    return ((v[lower] + v[upper]) / 2)[:, None]


def weighted_stats(chunked: DataFrame, columns: list[str], n: int, runs: int, estimator: Weighted = weighted_mean, seed: int = 0, scale: Weighted | None = None, private: Private | None = None, held: int = HELD) -> DataFrame:
    """(chunk, run, dim, est, stat) by multinomial weights.

    `private`: the released estimates of the resamples, in place of the estimator's (which still gives the chunk's own).
    `scale`: estimates of the deviation that the statistic is multiplied by the inverse of: a number, or a matrix in
    several dimensions.

    A group is a chunk and a block of RUNS runs, so chunks fewer than cores still fill them; of a block `held` counts are in memory at a time. Each run's counts come from a generator
    of its own, keyed by (seed, chunk, run); the noise of `private` from one a block. Chunks larger than a task are for `tree_resampling`.
    """
    spark, block = chunked.sparkSession, RUNS
    blocks = spark.range(-(-runs // block)).select(F.col("id").cast("int").alias("block"))
    grouped = chunked.select("chunk", "slot", *columns).crossJoin(F.broadcast(blocks))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c, k = int(key[0]), int(key[1])
        x = rows.sort_values("slot")[columns].to_numpy(float)
        first = k * block
        count = min(block, runs - first)
        share, theta = np.full(len(x), 1 / len(x)), estimator(x, np.ones((1, len(x))))

        def counts(lo: int, hi: int) -> np.ndarray:
            return np.stack([np.random.default_rng([seed, c, r, 1]).multinomial(n, share) for r in range(lo, hi)]).astype(float)

        # Rows of weights do not depend on each other, so as many at a time as HELD numbers hold; the noise of `private` is one draw a block.
        step = count if private is not None else max(1, held // len(x))
        ests, stats = [], []
        for lo in range(first, first + count, step):
            w = counts(lo, min(first + count, lo + step))
            est = estimator(x, w) if private is None else private(x, w, np.random.default_rng([seed, c, k, 2]))
            stat = np.sqrt(n) * (theta - est)
            if scale is not None:
                sd = scale(x, w)
                stat = np.linalg.solve(sd, stat[:, :, None])[:, :, 0] if sd.ndim == 3 else stat / sd
            ests.append(est)
            stats.append(stat)
        est, stat = np.concatenate(ests), np.concatenate(stats)
        d = est.shape[1]
        return pd.DataFrame({"chunk": c, "run": np.repeat(np.arange(first, first + count), d), "dim": np.tile(np.arange(d), count), "est": est.ravel(), "stat": stat.ravel()})

    return grouped.groupBy("chunk", "block").applyInPandas(run, "chunk int, run int, dim int, est double, stat double")


def quantile_interval(stats: DataFrame, alpha: float, kind: str, by: list[str] | None = None, x: str = "stat") -> DataFrame:
    """(l, u) per group from the inverse-distribution quantiles: eqtail, symm, low or up; no group is held as a whole."""
    by, inf = by or [], F.lit(float("inf"))
    if kind == "eqtail":
        return quantiles(stats, x, by, {"l": alpha / 2, "u": 1 - alpha / 2})
    if kind == "symm":
        return quantiles(stats, F.abs(F.col(x)), by, {"u": 1 - alpha}).select(*by, (-F.col("u")).alias("l"), "u")
    if kind == "low":
        return quantiles(stats, x, by, {"l": alpha}).withColumn("u", inf)
    if kind == "up":
        return quantiles(stats, x, by, {"u": 1 - alpha}).select(*by, (-inf).alias("l"), "u")
    raise ValueError(f"no interval kind {kind!r}")


def means_and_variances(stats: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample variance of the bootstrap estimates per group."""
    return stats.groupBy(*by).agg(F.avg("est").alias("m"), F.var_samp("est").alias("v"))
