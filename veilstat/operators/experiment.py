"""Result tables of coverage experiments: evaluation, runs, deduplication, relative widths, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilstat.functions.session import children, touched
from veilstat.operators.mechanisms import in_interval
from veilstat.operators.selection import medians


MOST_METHODS = 1000


def evaluate(estimates: DataFrame, intervals: DataFrame, on: list[str], truth: float, n: int, method: str = "method") -> DataFrame:
    """Per estimate and method: covered (truth in est + [l, u] / sqrt(n)) and width."""
    root = F.lit(float(n) ** 0.5)
    if not on and intervals.limit(MOST_METHODS + 1).count() > MOST_METHODS:
        raise ValueError(f"without keys there is one interval a method, at most {MOST_METHODS}")
    joined = estimates.join(intervals, on) if on else estimates.crossJoin(F.broadcast(intervals))
    return joined.select(
        *estimates.columns, method, in_interval(F.lit(float(truth)), F.col("est") + F.col("l") / root, F.col("est") + F.col("u") / root).alias("covered"), ((F.col("u") - F.col("l")) / root).alias("width")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def relative(df: DataFrame, methods: list[str], baseline: str) -> DataFrame:
    """Every method's column over the baseline's, the baseline's own too."""
    return df.withColumns({m: F.col(m) / F.col(baseline) for m in methods})


def long_form(df: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """(keys..., method, value)."""
    return df.unpivot(keys, methods, "method", "value")


def summary(df: DataFrame, by: list[str], x: str, center: str = "mean") -> DataFrame:
    """Mean or median per group with the standard error of the mean."""
    if center not in ("mean", "median"):
        raise ValueError(f"no centre {center!r}")
    out = df.groupBy(*by).agg(F.avg(x).alias("value"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"), F.count(x).alias("rows"))
    return out if center == "mean" else medians(df, x, by).join(out.drop("value"), by)


def write_run(df: DataFrame, path: str, run_id: str, kind: str) -> None:
    """Adds a run's table; run and kind are partitions, so a reader prunes by them instead of matching file names."""
    df.withColumn("run_id", F.lit(run_id)).withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind", "run_id", "n").parquet(path)


def read_runs(spark: SparkSession, path: str, kind: str, n: int | None = None) -> DataFrame:
    """All runs of a kind, of one n if given."""
    df = spark.read.parquet(path).filter(F.col("kind") == kind)
    return df.filter(F.col("n") == n) if n is not None else df


def next_run_id(existing: list[str], day: str) -> str:
    """day + v + the number after the largest used that day; exact match of the day, not a substring."""
    used = [int(r.rpartition("v")[2]) for r in existing if r.rpartition("v")[0] == day and r.rpartition("v")[2].isdigit()]
    return f"{day}v{max(used, default=-1) + 1}"


def claim_run_id(spark: SparkSession, path: str, day: str) -> str:
    """A run id of a day under a folder, after all used ones, for this writer alone.

    A writer puts a claim of its own on an id and looks again: alone on it, the id is its own; else all that see each other leave the id and
    go on. Of two claims the later one sees the earlier, so two writers never have the same id, on any store that lists what it holds; an id
    that several wanted may stay unused.
    """
    folder, token = f"{path}/_claims", uuid.uuid4().hex
    while True:
        own = next_run_id([p.rpartition("/")[2].partition(".")[0] for p in children(spark, folder)], day)
        touched(spark, f"{folder}/{own}.{token}")
        if sum(p.rpartition("/")[2].partition(".")[0] == own for p in children(spark, folder)) == 1:
            return own
