"""Random disjoint chunks of a table, at any size.

A row's place in the permutation is its rank by a keyed digest. The digest's first bits spread rows evenly over
fixed buckets, so the global rank is the bucket's offset (one row a bucket, a bounded table) plus the rank within the
bucket: no task ever sorts the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstat.functions.keyed import digest

BUCKET_DIGITS, BUCKET_ROWS = 3, 1_000_000  # 16^3 buckets; more digits where buckets would hold more rows


def bucket_digits(n: int) -> int:
    """Leading digits that make buckets of about BUCKET_ROWS rows at most."""
    return max(BUCKET_DIGITS, math.ceil(math.log(max(n / BUCKET_ROWS, 1), 16)))


def permutation_rank(df: DataFrame, id_col: str, seed: int = 0, purpose: str = "perm", n: int = 0) -> DataFrame:
    """df with `pos`, the 0-based rank of each row in a keyed permutation; ids are unique. `n`: about how many rows there are."""
    keyed = df.withColumn("_h", digest(purpose, seed, F.col(id_col))).withColumn("_bucket", F.substring("_h", 1, bucket_digits(n))).withColumn("_h", F.unhex("_h"))  # the same order in half the bytes
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # a row a bucket
    within = Window.partitionBy("_bucket").orderBy("_h", id_col)
    return keyed.join(F.broadcast(offsets), "_bucket").withColumn("pos", F.col("_offset") + F.row_number().over(within) - 1).drop("_h", "_bucket", "_offset")


def chunk_count(n: int, b: int, rule: str = "one_dim") -> int:
    """Chunks of n rows at size b. `one_dim` and `all_dim` differ in when a remainder gets its own chunk; `drop` drops it."""
    s = n // b
    if rule == "one_dim":
        return s + (s * b < n - 1)
    if rule == "all_dim":
        return s + (s * b < n - b / 2)
    if rule == "drop":
        return s
    raise ValueError(f"no chunk rule {rule!r}")


def chunk(df: DataFrame, id_col: str, n: int, b: int, seed: int = 0, rule: str = "one_dim") -> DataFrame:
    """df with `chunk` and `slot`; the last chunk takes all that remains, except under the rule `drop`."""
    s = chunk_count(n, b, rule)
    ranked = permutation_rank(df, id_col, seed, n=n)
    if rule == "drop":
        ranked = ranked.filter(F.col("pos") < s * b)
    number = F.least(F.floor(F.col("pos") / b), F.lit(s - 1)).cast("int")
    return ranked.withColumn("chunk", number).withColumn("slot", (F.col("pos") - number * b).cast("bigint")).drop("pos")


def whole_chunks(df: DataFrame, id_col: str, n: int, b: int, seed: int = 0, rule: str = "one_dim") -> DataFrame:
    """df once for each chunk, with `chunk` and `slot`: the ablation in which every chunk holds all rows."""
    ranked = permutation_rank(df, id_col, seed, n=n).withColumnRenamed("pos", "slot")
    return ranked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunk_count(n, b, rule) - 1))))


def chunk_subset(chunked: DataFrame, k: int, chunks: int, seed: int = 0, repeats: int = 1) -> DataFrame:
    """(repeat, chunk) and rows of k chunks drawn without replacement, for each repeat; keyed by chunk id throughout."""
    spark = chunked.sparkSession
    order = Window.partitionBy("repeat").orderBy(digest("subset", seed, F.col("repeat"), F.col("chunk")))
    picks = spark.range(repeats).select(F.col("id").cast("int").alias("repeat")).crossJoin(spark.range(chunks).select(F.col("id").cast("int").alias("chunk")))
    picks = picks.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).drop("_k")
    return chunked.join(F.broadcast(picks), "chunk")  # repeats x k rows


def random_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement: the n smallest digests."""
    return df.withColumn("_h", digest("sample", seed, F.col(id_col))).orderBy("_h", id_col).limit(n).drop("_h")


def sizing(n: int, eps_cdf: float, set_type: str = "symm") -> dict[str, float]:
    """Sizes of the one-dimensional study: chunks (twice as many for two sides), rows a chunk, resamples, bootstrap runs, bin width."""
    s = math.ceil((20 if set_type == "eqtail" else 10) * math.log(n) / eps_cdf)
    b = n // s
    clamp = lambda x: int(min(max(x, 100), 10_000))
    return {"chunks": s, "b": b, "runs": clamp(math.sqrt(n) * b / math.log(n)), "boot_runs": clamp(n**1.5 / math.log(n)), "precision": 1 / math.sqrt(n)}


def sizing_columns(n: Column, eps_cdf: Column, set_type: str = "symm") -> dict[str, Column]:
    """`sizing` of every row."""
    s = F.ceil(F.lit(20 if set_type == "eqtail" else 10) * F.log(n) / eps_cdf)
    b = F.floor(n / s)
    clamp = lambda x: F.floor(F.least(F.greatest(x, F.lit(100.0)), F.lit(10_000.0)))
    return {"chunks": s, "b": b, "runs": clamp(F.sqrt(n) * b / F.log(n)), "boot_runs": clamp(F.pow(n, F.lit(1.5)) / F.log(n)), "precision": F.lit(1.0) / F.sqrt(n)}


def zcdp_sizing_columns(n: Column, eps: Column) -> dict[str, Column]:
    """`zcdp_sizing` of every row."""
    s = F.ceil(F.least(F.lit(5.0) / eps * F.sqrt(n), n / F.lit(5.0)))
    b = F.floor(n / s)
    return {"chunks": s, "b": b, "runs": F.floor(F.sqrt(n) * b / F.log(n))}


def survey_runs_column(n: Column, eps_cdf: Column) -> Column:
    """Resamples of a chunk by `survey_sizing` of every row."""
    b = F.floor(n / F.ceil(F.lit(10) * F.log(n) / eps_cdf))
    return F.floor(F.least(F.sqrt(n) * b / F.log(n), F.lit(1e6) * b / n))


def zcdp_sizing(n: int, eps: float) -> dict[str, int]:
    """Sizes of the zCDP study."""
    s = math.ceil(min(5 / eps * math.sqrt(n), n / 5))
    b = n // s
    return {"chunks": s, "b": b, "runs": int(math.sqrt(n) * b / math.log(n))}


# Half widths of the survey study's search ranges, by coefficient, the intercept last.
SURVEY_RANGES = (70.0, 100.0, 120.0, 20.0, 100.0)


def survey_sizing(n: int, eps_cdf: float) -> dict[str, float]:
    """Sizes of the survey study: runs up to a million in all, without a floor, and wider bins."""
    s = math.ceil(10 * math.log(n) / eps_cdf)
    b = n // s
    return {"chunks": s, "b": b, "runs": int(min(math.sqrt(n) * b / math.log(n), 1e6 * b / n)), "boot_runs": int(min(n**1.5 / math.log(n), 1e6)), "precision": 10 / math.sqrt(n)}


def variance_bound(n, sd: float | None = None, width: float | None = None):
    """Upper limit of a chunk's variance in the private median: (50 sd)^2 / n, or ((width / 4) 10)^2 / n; n is a number or a column."""
    if (sd is None) == (width is None):
        raise ValueError("give either sd or width")
    return (50 * sd) ** 2 / n if sd is not None else (width / 4 * 10) ** 2 / n


def granularity(n):
    """How far the private median of variances spreads values apart: n^-1.5; n is a number or a column."""
    return n**-1.5

