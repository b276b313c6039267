"""Private deviation of an estimator from little-bootstrap variances, and the intervals built on it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.functions.special import normal_quantile, student_quantile
from veilstat.operators.mechanisms import clip_variance, private_median
from veilstat.operators.selection import medians


def private_deviation(stats: DataFrame, by: list[str], top: float, eps: float, rho: float = 0.0, seed: int = 0) -> DataFrame:
    """(by..., value): root of the private median, over chunks, of the variance of `stat`; infinite eps gives the plain median.

    Each group spends the whole eps, so d dimensions spend d times eps.
    """
    per_chunk = stats.groupBy(*by, "chunk").agg(F.var_samp("stat").alias("v"))
    if math.isinf(eps):
        return medians(per_chunk, "v", by).withColumn("value", F.sqrt("value"))
    clipped = per_chunk.withColumn("v", clip_variance(F.col("v"), top))
    return private_median(clipped, "v", 0.0, top, eps, by, rho, seed).withColumn("value", F.sqrt("value"))


def t_interval(deviation: DataFrame, df: int, alpha: float, by: list[str], extra: float = 0.0) -> DataFrame:
    """(by..., l, u): Student quantile with df degrees times the deviation, joined with another noise's deviation."""
    q = student_quantile(1 - alpha / 2, df)
    half = F.lit(q) * F.sqrt(F.col("value") * F.col("value") + F.lit(extra * extra))
    return deviation.select(*by, (-half).alias("l"), half.alias("u"))


def normal_interval(deviation: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    half = F.lit(normal_quantile(1 - alpha / 2)) * F.col("value")
    return deviation.select(*by, (-half).alias("l"), half.alias("u"))
