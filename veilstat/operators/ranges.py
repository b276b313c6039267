"""Running sums and ranks over tables of any size, by ranges of rows instead of one sorted group.

Rows are dealt to partitions by ranges of (group, order), whose bounds follow the data, so neither a large group nor a narrow cluster of values
is one task's. What comes before a row is the sum of the partitions before, a row a partition and group, plus the sum within
its own partition. The dealt rows are a checkpoint: which partition holds a row does not change if an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstat.functions.session import checkpointed

ROWS = 1_000_000  # rows of a range, about


def ranges_of(df: DataFrame, rows: int = ROWS) -> int:
    """How many ranges the rows of a frame are dealt to: as many as shuffles have partitions, more where these would be large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def running(df: DataFrame, by: list[str], order: list[str | Column], value: str, name: str, count: int | None = None) -> DataFrame:
    """df with `name`, the sum of `value` over the rows before in (by, order), and `_part`, its range. Rows that are equal in both come in no stated order."""
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    count = count or ranges_of(df)
    placed = checkpointed(df.repartitionByRange(count, *keys).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*by, "_part").agg(F.sum(value).alias("_s"))
    offsets = offsets.select(*by, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))  # a row a partition and group
    within = Window.partitionBy(*by, "_part").orderBy(*[c for c in keys[len(by) :]]).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.repartition(count, *by, "_part").join(offsets, [*by, "_part"])  # in as many tasks as there are ranges
    return joined.withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_offset")


def ordered(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by..., x, _ct, _before, _next, _n): each distinct value of a group, how often it comes, how many values are smaller, the next larger one
    (null for the largest), and the group's size."""
    group = by or ["_g"]
    rows = df if by else df.withColumn("_g", F.lit(0))
    counts = rows.groupBy(*group, x).agg(F.count("*").alias("_ct"))
    placed = running(counts, group, [x], "_ct", "_before")
    parts = placed.groupBy(*group, "_part").agg(F.min(x).alias("_first"), F.sum("_ct").alias("_k"))
    over, whole = Window.partitionBy(*group).orderBy("_part"), Window.partitionBy(*group)
    ends = parts.select(*group, "_part", F.lead("_first").over(over).alias("_after"), F.sum("_k").over(whole).alias("_n"))
    within = Window.partitionBy(*group, "_part").orderBy(x)
    out = placed.join(ends, [*group, "_part"]).withColumn("_next", F.coalesce(F.lead(x).over(within), F.col("_after"))).drop("_part", "_after")
    return out if by else out.drop("_g")


def within_sets(df: DataFrame, x: str, sets: DataFrame, by: list[str]) -> DataFrame:
    """(by..., set, ct, total): how many of a group's values lie in each closed interval of (set, low, high), for any number of sets.

    Values are counted, and each set asks twice in the order of values: for those below its low end, and for those up to its high end. One running
    sum over values and questions answers all; no value meets a set. Nulls count in the total only, NaN lies in no set.
    """
    group = by or ["_g"]
    rows = (df if by else df.withColumn("_g", F.lit(0))).select(*group, F.col(x).cast("double").alias("_x"))
    totals = rows.groupBy(*group).agg(F.count("*").alias("total"))
    values = rows.filter(F.col("_x").isNotNull() & ~F.isnan("_x")).groupBy(*group, "_x").agg(F.count("*").alias("_ct"))
    none = F.lit(None).cast("bigint")
    known = values.select(*group, (F.col("_x") + F.lit(0.0)).alias("_x"), F.lit(1).alias("_o"), none.alias("_set"), "_ct", none.alias("total"))
    ends = F.explode(F.array(F.struct(F.col("low").alias("x"), F.lit(0).alias("o")), F.struct(F.col("high").alias("x"), F.lit(2).alias("o"))))
    asked = sets.select(F.col("set").cast("bigint").alias("_set"), ends.alias("_e")).crossJoin(F.broadcast(totals) if not by else totals)
    asked = asked.select(*group, (F.col("_e.x").cast("double") + F.lit(0.0)).alias("_x"), F.col("_e.o").alias("_o"), "_set", F.lit(0).cast("bigint").alias("_ct"), "total")
    both = known.unionByName(asked)
    count = ranges_of(both)
    placed = running(both, group, ["_x", "_o", F.xxhash64("_set")], "_ct", "_before", count)
    # A question carries its group's size: a join with few groups would bring all their answers to few tasks.
    answers = placed.filter(F.col("_set").isNotNull()).repartition(count, *group, "_set").groupBy(*group, F.col("_set").alias("set"))
    out = answers.agg(F.greatest(F.lit(0), F.sum(F.when(F.col("_o") == 2, F.col("_before")).otherwise(-F.col("_before")))).alias("ct"), F.max("total").alias("total"))
    return out if by else out.drop("_g")
