"""Private releases: Laplace, mean, deviation, median by the exponential mechanism, noisy order statistics.

All take eps = infinity for "no noise". Values are not clipped unless asked for: bounds are a promise of the caller,
and `check_bounds` counts the rows that break it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstat.functions.keyed import gumbel, laplace, uniform
from veilstat.functions.special import symmetric_root
from veilstat.operators.ranges import ordered
from veilstat.operators.selection import medians


def noisy(value: Column, eps: float, sensitivity: Column | float, purpose: str, *keys) -> Column:
    """value + Laplace(sensitivity / eps)."""
    if math.isinf(eps):
        return value
    scale = sensitivity / F.lit(eps) if isinstance(sensitivity, Column) else sensitivity / eps
    return value + laplace(scale, purpose, *keys)


def check_bounds(df: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """(rows, outside) of a column against its promised bounds."""
    return df.agg(F.count(x).alias("rows"), F.count_if((F.col(x) < low) | (F.col(x) > high)).alias("outside"))


def private_mean(df: DataFrame, x: str, low: float, high: float, eps: float, by: list[str], seed: int = 0) -> DataFrame:
    """Mean per group + Laplace((high - low) / (n eps))."""
    agg = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.count(x).alias("_n"))
    return agg.select(*by, noisy(F.col("_m"), eps, F.lit(high - low) / F.col("_n"), "mean", seed, *map(F.col, by)).alias("value"))


def private_std(df: DataFrame, x: str, low: float, high: float, eps: float, by: list[str], seed: int = 0) -> DataFrame:
    """Sample deviation per group + Laplace; the sensitivity is M^2/n + 2M(high - low)/(n(n - 1)), M the larger bound. May be negative."""
    agg = df.groupBy(*by).agg(F.stddev_samp(x).alias("_s"), F.count(x).alias("_n"))
    return agg.select(*by, noisy(F.col("_s"), eps, std_sensitivity(low, high, F.col("_n").cast("double")), "std", seed, *map(F.col, by)).alias("value"))


def std_sensitivity(low: float, high: float, n):
    """M^2 / n + 2 M (high - low) / (n (n - 1)) of the sample deviation, M the larger bound; n is a number or a column."""
    m = max(abs(low), abs(high))
    return float(m * m) / n + 2.0 * m * (high - low) / (n * (n - 1.0))


def deviation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Root of the sample covariance of columns; the driver holds one number a pair of them."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    found = {frozenset((a, b)): row[f"{a}|{b}"] for a, b in pairs}
    return symmetric_root(np.array([[found[frozenset((a, b))] for b in columns] for a in columns], float))


def below(high: Column, x: Column) -> Column:
    """An interval as a whole is below a number: its upper end is."""
    return (high < x).cast("int")


def above(low: Column, x: Column) -> Column:
    """An interval as a whole is above a number: its lower end is."""
    return (low > x).cast("int")


def private_median(df: DataFrame, x: str, low: float, high: float, eps: float, by: list[str], rho: float = 0.0, seed: int = 0) -> DataFrame:
    """Median per group by the exponential mechanism over the gaps between sorted values, then a uniform point in the gap.

    With rho > 0 the lower half is first moved down and the upper half up by rho, within bounds. Score of a gap:
    ln(width) - eps / 2 * distance in ranks from the median; zero-width gaps cannot be chosen. Choice by Gumbel-max.

    Equal values are counted first: between two of them a gap has a width only where one is moved and the other is not, at the
    ends of the halves. So a value is one row however often it comes, with its last gap and at most two more.
    """
    runs = ordered(df.select(*by, F.col(x).cast("double").alias("_x")).filter("_x is not null"), "_x", by)
    n, half = F.col("_n"), F.floor(F.col("_n") / 2)
    shift = lambda v, r: F.when(r < half, v - F.lit(rho)).when(r >= n - half, v + F.lit(rho)).otherwise(v)
    clipped = lambda v: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)) if rho > 0 else v
    size = n.cast("double")
    far = lambda i: F.when(n % 2 == 0, F.when((i > 0) & (i < n), F.abs(size / 2 - i)).otherwise(size / 2)).otherwise(
        F.when((i == 0) | (i == n), (size + 1) / 2).when(i < (size + 1) / 2, (size + 1) / 2 - i).otherwise(i - (size - 1) / 2)
    )
    first, last = F.col("_before"), F.col("_before") + F.col("_ct") - 1
    inner = F.filter(F.array(half, n - half), lambda i: (i > first) & (i <= last))  # gaps between two equal values
    starts = F.filter(F.array(F.lit(0).cast("bigint")), lambda i: first == i)  # the gap below the smallest
    each = runs.withColumn("_gap", F.explode(F.array_distinct(F.concat(starts, inner, F.array(last + 1)))))
    gap, v = F.col("_gap"), F.col("_x")
    lo = F.when(gap == 0, F.lit(float(low))).otherwise(clipped(shift(v, gap - 1)))
    hi = F.when(gap == n, F.lit(float(high))).when(gap > last, clipped(shift(F.col("_next"), gap))).otherwise(clipped(shift(v, gap)))
    gaps = each.select(*by, gap.alias("gap"), lo.alias("lo"), hi.alias("hi"), far(gap).alias("far"))
    scored = gaps.filter("hi > lo").withColumn("score", F.log(F.col("hi") - F.col("lo")) - F.col("far") * F.lit(eps / 2) + gumbel("median-gap", seed, *map(F.col, by), F.col("gap")))
    # max_by with the gap as tie-break is a partial aggregation; no group is sorted as a whole.
    best = scored.groupBy(*by).agg(F.max(F.struct("score", "gap", "lo", "hi")).alias("b"))
    return best.select(*by, (F.col("b.lo") + uniform("median-point", seed, *map(F.col, by)) * (F.col("b.hi") - F.col("b.lo"))).alias("value"))


def truncated(value: Column) -> Column:
    """Towards zero, as an integer."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("bigint")


def noisy_index(n: Column, global_eps: float, local_eps: float, seed: int, *keys, fixed: bool = False) -> Column:
    """trunc(n / 2 + Laplace(1 / global) + Laplace(1 / local)); the first noise is drawn anew for every key unless `fixed`."""
    return truncated(n / F.lit(2.0) + laplace(1 / global_eps, "order-g", seed, *(() if fixed else keys)) + laplace(1 / local_eps, "order-l", seed, *keys))


def noisy_order_statistic(df: DataFrame, x: str, by: list[str], global_eps: float, local_eps: float, top: float, seed: int = 0, fixed: bool = False, bins: int = 0) -> DataFrame:
    """Per group the order statistic at a noisy median rank: below 1 gives 0, above n gives `top`; the plain median if global_eps is infinite.

    With `bins`, for groups of any size: equal values are counted first, the counts of equal-width bins of a group's
    range tell the bin of the rank, and only that bin's distinct values are sorted. Else each group is sorted whole.
    """
    if math.isinf(global_eps):
        return medians(df, x, by)
    counts = df.groupBy(*by).agg(F.count(x).alias("_n"))
    index = counts.select(*by, "_n", noisy_index(F.col("_n"), global_eps, local_eps, seed, *map(F.col, by), fixed=fixed).alias("_ix"))
    if bins:
        hit = _ranked_by_bins(df.select(*by, F.col(x).cast("double").alias("_x")).filter("_x is not null"), index, by, bins)
        return index.join(hit, by, "left").select(*by, F.when(F.col("_ix") < 1, F.lit(0.0)).when(F.col("_ix") > F.col("_n"), F.lit(float(top))).otherwise(F.col("_x")).alias("value"))
    ranked = df.select(*by, F.col(x).alias("_x"), F.row_number().over(Window.partitionBy(*by).orderBy(x)).alias("_r"))
    hit = ranked.join(index, by).filter(F.col("_r") == F.col("_ix")).select(*by, "_x")
    return index.join(hit, by, "left").select(*by, F.when(F.col("_ix") < 1, F.lit(0.0)).when(F.col("_ix") > F.col("_n"), F.lit(float(top))).otherwise(F.col("_x").cast("double")).alias("value"))


def _ranked_by_bins(df: DataFrame, index: DataFrame, by: list[str], bins: int) -> DataFrame:
    """(by..., _x): the value at rank _ix of each group, by counts of bins and of the distinct values of one bin."""
    counts = df.groupBy(*by, "_x").agg(F.count("*").alias("_k"))
    ends = df.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).join(index, by)  # a row a group
    number = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(F.lit(0)).cast("int")
    binned = counts.join(ends, by).withColumn("_bin", number)
    sizes = binned.groupBy(*by, "_bin", "_ix").agg(F.sum("_k").alias("_m"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows a group
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    own = sizes.filter((F.col("_ix") > F.col("_before")) & (F.col("_ix") <= F.col("_before") + F.col("_m"))).select(*by, "_bin", "_before")
    upto = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)  # the distinct values of one bin
    reached = binned.join(own, [*by, "_bin"]).withColumn("_upto", F.col("_before") + F.sum("_k").over(upto))
    return reached.filter((F.col("_ix") <= F.col("_upto")) & (F.col("_ix") > F.col("_upto") - F.col("_k"))).select(*by, "_x")


def in_interval(x: Column, low: Column, high: Column) -> Column:
    """1 if x lies in the closed interval, else 0."""
    return x.between(low, high).cast("int")


def in_box(point: Column, low: Column, high: Column) -> Column:
    """Whether every coordinate lies in the closed box."""
    return F.forall(F.zip_with(F.zip_with(point, low, lambda p, l: p >= l), F.zip_with(point, high, lambda p, u: p <= u), lambda a, b: a & b), lambda ok: ok)


def clip_variance(v: Column, top: float) -> Column:
    """To [0, top]; NaN and null become top."""
    return F.least(F.greatest(F.nanvl(F.coalesce(v, F.lit(top)), F.lit(top)), F.lit(0.0)), F.lit(float(top)))


def to_ball(x: Column, radius: float, center: list[float] | None = None) -> Column:
    """The vector, moved to the sphere of the radius around the centre (0 if none is given) if it lies beyond."""
    if center is None:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
        return F.when(norm > F.lit(radius), F.transform(x, lambda v: v * F.lit(radius) / norm)).otherwise(x)
    middle = F.array(*[F.lit(float(c)) for c in center])
    far = F.zip_with(x, middle, lambda v, c: v - c)
    norm = F.sqrt(F.aggregate(far, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(norm > F.lit(radius), F.zip_with(far, middle, lambda v, c: c + v / norm * F.lit(radius))).otherwise(x)
