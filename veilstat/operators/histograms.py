"""Flat and dyadic histograms of statistics, and the mass they give to intervals.

Bins are half-open, [min, max); values outside count in the total only. Edges are rounded to 13 decimals. A dyadic
histogram has a row for every ancestor of a leaf, without a root. Counts are partial sums by (group, bin).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstat.functions.session import checkpointed


@dataclass(frozen=True)
class Bins:
    low: float
    high: float
    count: int

    @staticmethod
    def of_precision(low: float, high: float, precision: float, round_up: bool = False) -> Bins:
        """As many bins as the precision asks for; with round_up the next power of two."""
        n = int((high - low) / precision)
        return Bins(low, high, 2 ** math.ceil(math.log2(n)) if round_up else math.ceil(round((high - low) / precision, 9)))

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.count

    @property
    def depth(self) -> int:
        return max(1, math.ceil(math.log2(self.count)))

    def number(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.low)) * F.lit(float(self.count)) / F.lit(self.high - self.low)).cast("int")

    def left(self, b: Column) -> Column:
        return F.round(F.lit(self.low) + b * F.lit(self.width), 13)

    def right(self, b: Column) -> Column:
        return F.round(F.lit(self.low) + (b + 1) * F.lit(self.width), 13)


def flat(df: DataFrame, x: str, bins: Bins, by: list[str]) -> DataFrame:
    """(by..., bin, ct) of the values within the bounds."""
    inside = df.filter((F.col(x) >= bins.low) & (F.col(x) < bins.high))  # NaN falls out
    return inside.groupBy(*by, bins.number(F.col(x)).alias("bin")).agg(F.count("*").alias("ct"))


def totals(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group, in and out of the bounds."""
    return df.groupBy(*by).agg(F.count("*").alias("total"))


def normalized(hist: DataFrame, total: DataFrame, by: list[str]) -> DataFrame:
    """(by..., bin, p): counts over all values of the group."""
    joined = hist.join(total, by) if by else hist.crossJoin(total)
    return joined.select(*by, "bin", (F.col("ct") / F.col("total")).alias("p"))


def dyadic(df: DataFrame, x: str, bins: Bins, by: list[str]) -> DataFrame:
    """(by..., level, bin, ct): level depth - 1 holds the leaves, level 0 the largest bins. Leaves are counted first."""
    leaves = flat(df, x, bins, by)
    each = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bins.depth - 1))))
    return each.groupBy(*by, "level", F.expr(f"shiftright(bin, {bins.depth - 1} - level)").alias("_b")).agg(F.sum("ct").alias("ct")).withColumnRenamed("_b", "bin")


def cumulative(hist: DataFrame, groups: DataFrame, bins: Bins, by: list[str], value: str = "ct") -> DataFrame:
    """(by..., bin, cum) for every bin of every group: mass of the bins up to and including it."""
    grid = hist.sparkSession.range(bins.count).select(F.col("id").cast("int").alias("bin"))
    full = groups.select(*by).distinct().crossJoin(F.broadcast(grid)) if by else grid
    joined = full.join(hist, [*by, "bin"], "left")
    order = Window.partitionBy(*by).orderBy("bin") if by else Window.orderBy("bin")
    return joined.select(*by, "bin", F.sum(F.coalesce(F.col(value), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))


BLOCK = 4096


def prefix_sums(hist: DataFrame, bins: Bins) -> DataFrame:
    """(bin, ct, before, cum) of every bin: its count, the counts below it, and those with its own; blocks of bins first, so no task holds more
    than a block, or a number a block."""
    grid = hist.sparkSession.range(bins.count).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(hist, "bin", "left").select("bin", F.coalesce("ct", F.lit(0)).cast("bigint").alias("ct"), (F.col("bin") / BLOCK).cast("int").alias("_block"))
    blocks = full.groupBy("_block").agg(F.sum("ct").alias("_s"))
    below = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = blocks.select("_block", F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_offset"))
    own = Window.partitionBy("_block").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    out = full.join(blocks, "_block").withColumn("cum", F.col("_offset") + F.sum("ct").over(own))
    return checkpointed(out.select("bin", "ct", (F.col("cum") - F.col("ct")).alias("before"), "cum"))


def least_mass(share: float, total: int) -> int:
    """The smallest count whose share of the total is at least this one, as doubles compare."""
    m = max(0, int(share * total) - 2)
    while m / total < share:
        m += 1
    return m


def first_at_least(df: DataFrame, sums: DataFrame, bins: Bins, target: str) -> DataFrame:
    """df with `j`, the first bin whose prefix sum reaches the target; rows without one go.

    A binary search in the blocks' last sums, a number for BLOCK bins, which all tasks get; then an equi-join with the block and a binary
    search in it. No row meets more than one block.
    """
    blocks = sums.groupBy((F.col("bin") / BLOCK).cast("int").alias("_block")).agg(F.array_sort(F.collect_list("cum")).alias("_cums"))
    tops = np.array([r[0] for r in sums.groupBy((F.col("bin") / BLOCK).cast("int").alias("b")).agg(F.max("cum").alias("c")).orderBy("b").select("c").collect()], np.int64)

    @F.pandas_udf("int")
    def block_of(t: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(tops, t.to_numpy(np.int64)).astype(np.int32))

    @F.pandas_udf("int")
    def place_in(t: pd.Series, block: pd.Series, cums: pd.Series) -> pd.Series:
        return pd.Series([b * BLOCK + int(np.searchsorted(c, v)) for v, b, c in zip(t, block, cums, strict=True)], dtype="int32")

    near = df.withColumn("_block", block_of(F.col(target))).filter(F.col("_block") < len(tops))
    return near.join(blocks, "_block").withColumn("j", place_in(F.col(target), F.col("_block"), F.col("_cums"))).drop("_block", "_cums")


def range_mass(cum: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """Mass of bins first..last of every candidate in every group, by two look-ups in the prefix sums."""
    end = cum.withColumnRenamed("bin", "last").withColumnRenamed("cum", "_hi")
    start = cum.select(*by, (F.col("bin") + 1).alias("first"), F.col("cum").alias("_lo"))
    return candidates.join(end, "last").join(start, [*by, "first"], "left").withColumn("mass", F.col("_hi") - F.coalesce("_lo", F.lit(0))).drop("_hi", "_lo")


def bins_inside(bins: Bins, low: Column, high: Column) -> tuple[Column, Column]:
    """First and last bin wholly inside [low, high], by the rounded edges."""
    edges = F.sequence(F.lit(0), F.lit(bins.count - 1))
    first = F.array_min(F.filter(edges, lambda b: bins.left(b) >= low))
    last = F.array_max(F.filter(edges, lambda b: bins.right(b) <= high))
    return first, last


def cover_nodes(candidates: DataFrame, bins: Bins) -> DataFrame:
    """(ord, level, bin): the dyadic nodes that tile each candidate's leaves; at most two a level."""
    top = bins.depth - 1
    each = candidates.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(top))))
    # The last bin closes its ancestors even if the number of bins is not a power of two.
    stop = F.when(F.col("last") == bins.count - 1, F.lit(2**bins.depth)).otherwise(F.col("last") + 1)
    at = lambda h: (F.expr(f"shiftright(first + shiftleft(1, {h}) - 1, {h})"), F.floor(stop / F.expr(f"shiftleft(1, {h})")).cast("int") - 1)
    (lo, hi), (up_lo, up_hi) = at("h"), at("h + 1")
    each = each.select("ord", "h", lo.alias("lo"), hi.alias("hi"), up_lo.alias("ulo"), up_hi.alias("uhi")).filter("lo <= hi")
    ends = each.withColumn("bin", F.explode(F.array_distinct(F.array("lo", "hi"))))
    parent = F.expr("shiftright(bin, 1)")
    kept = ends.filter((F.col("h") == top) | ~((parent >= F.col("ulo")) & (parent <= F.col("uhi"))))
    return kept.select("ord", (F.lit(top) - F.col("h")).alias("level"), "bin")


def density(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, density) over a fixed range; the last bin is closed, values outside do not count."""
    w = (high - low) / bins
    inside = df.filter(F.col(x).between(low, high)).select(F.least(F.floor((F.col(x) - F.lit(low)) / F.lit(w)), F.lit(bins - 1)).cast("int").alias("bin"))
    counted = inside.groupBy("bin").agg(F.count("*").alias("ct"))
    total = counted.agg(F.sum("ct").alias("t"))
    return counted.crossJoin(F.broadcast(total)).select("bin", (F.col("ct") / (F.col("t") * F.lit(w))).alias("density"))


def set_counts(df: DataFrame, x: str, sets: list[tuple[float, float]], by: list[str]) -> DataFrame:
    """(by..., set, ct, total): rows in each of a short list of closed intervals, which may overlap; one aggregate."""
    inside = [F.count_if(F.col(x).between(F.lit(float(low)), F.lit(float(high)))) for low, high in sets]
    agg = df.groupBy(*by).agg(F.array(*inside).alias("_c"), F.count("*").alias("total"))
    return agg.select(*by, "total", F.posexplode("_c").alias("set", "ct")).select(*by, "set", "ct", "total")
