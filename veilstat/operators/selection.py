"""Exact medians and quantiles whose state does not grow with a group: radix selection on the ordered bits of doubles.

While a group has more than MOST rows left, a round counts the rows that share the bits found so far by their next 16
bits, at most 2^16 counts a group and rank whatever its size, and keeps the bits that hold the rank. Counts are partial sums,
so no row moves. At the latest after three rounds the values left differ in 16 bits only; they, or at most MOST rows, are
counted by value and the rank is read off. Groups of up to MOST rows need that last step alone.

Nulls do not count, NaN is above all numbers, minus zero is zero. Groups without values have a null, and so has a whole table
without rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstat.functions.session import checkpointed

BITS, MOST = 16, 1 << 16
MOST_BROADCAST = 100_000


def signed_bits(x: np.ndarray) -> np.ndarray:
    """Signed numbers in the order of the doubles."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def bits_of(x: Column) -> Column:
    """`signed_bits` of a column of doubles without nulls."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(signed_bits(values.to_numpy(np.float64)))

    return run(x)


def _narrowed(rows: DataFrame, wanted: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(rows, wanted) with the column `_p` (bits found): the rows that share them, ranks among these rows."""
    keyed = rows.withColumn("_k", bits_of(F.col("_x")))
    state, left = wanted.withColumn("_p", F.lit(0).cast("long")), rows
    for shift in range(64 - BITS, 0, -BITS):
        known = keyed if shift == 64 - BITS else _sharing(keyed, state, by, shift + BITS)
        top = F.lit(0).cast("long") if shift == 64 - BITS else F.shiftright("_k", shift + BITS)
        counts = known.groupBy(*by, top.alias("_p"), F.shiftright("_k", shift).alias("_b")).agg(F.count("*").alias("_ct"))
        upto = Window.partitionBy(*by, "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # at most 2^16 rows
        cum = counts.withColumn("_upto", F.sum("_ct").over(upto))
        hit = state.join(cum, [*by, "_p"]).filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_ct")))
        state = checkpointed(hit.select(*by, "_t", (F.col("_rank") - F.col("_upto") + F.col("_ct")).alias("_rank"), F.col("_b").alias("_p"), "_ct"))
        left = _sharing(keyed, state, by, shift)
        if state.agg(F.max("_ct")).first()[0] <= most:
            break
        state = state.drop("_ct")
    return left.select(*by, "_x", "_p"), state.select(*by, "_t", "_rank", "_p")


def _sharing(keyed: DataFrame, state: DataFrame, by: list[str], shift: int) -> DataFrame:
    """The rows whose bits above `shift` are those that some rank of their group looks for."""
    found = state.select(*by, "_p").distinct()
    small = state.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return keyed.withColumn("_p", F.shiftright("_k", shift)).join(F.broadcast(found) if small else found, [*by, "_p"], "left_semi")


def at_ranks(df: DataFrame, x: str | Column, by: list[str], ranks: dict[str, Column], most: int = MOST) -> DataFrame:
    """(by..., _n, names...): the values at the given ranks, from 1, of each group; a rank is a column over `_n`, the group's rows."""
    keys = by or ["_g"]
    rows = df.select(*(by or [F.lit(0).alias("_g")]), (F.col(x) if isinstance(x, str) else x).cast("double").alias("_x"))
    size = F.count("_x").alias("_n")
    sizes = rows.groupBy(*keys).agg(size) if by else rows.agg(size).select(F.lit(0).alias("_g"), "_n")
    rows = rows.filter(F.col("_x").isNotNull())
    each = F.array(*[F.struct(F.lit(name).alias("t"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    wanted = sizes.filter("_n > 0").withColumn("_w", F.explode(each)).select(*keys, F.col("_w.t").alias("_t"), F.col("_w.rank").alias("_rank"))
    group = keys
    if (sizes.agg(F.max("_n")).first()[0] or 0) > most:
        rows, wanted = _narrowed(rows, wanted, keys, most)
        group = [*keys, "_p"]
    counts = rows.groupBy(*group, "_x").agg(F.count("*").alias("_ct"))
    upto = Window.partitionBy(*group).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)  # at most `most` values, or 2^16
    cum = counts.withColumn("_upto", F.sum("_ct").over(upto))
    hit = cum.join(wanted, group).filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_ct")))
    picked = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_t") == name, F.col("_x"))).alias(name) for name in ranks])
    out = sizes.join(picked, keys, "left")
    return out if by else out.drop("_g")


def quantiles(df: DataFrame, x: str | Column, by: list[str], shares: dict[str, float], most: int = MOST) -> DataFrame:
    """(by..., names...): of each group the first value that this share of the values does not exceed."""
    ranks = {name: F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_n"))) for name, p in shares.items()}
    return at_ranks(df, x, by, ranks, most).drop("_n")


def medians(df: DataFrame, x: str | Column, by: list[str], most: int = MOST) -> DataFrame:
    """(by..., value): the middle value of each group, the midpoint of the two middle ones if their number is even."""
    n = F.col("_n")
    out = at_ranks(df, x, by, {"_a": F.floor((n + 1) / 2), "_b": F.floor(n / 2) + 1}, most)
    return out.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias("value"))
