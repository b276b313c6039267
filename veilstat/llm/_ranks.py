"""Gapless numbers in an order, for tables of any size and with any repeated keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstat.llm._spark import checkpointed


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's number and each row's number within the run of its group (column 0) in this partition."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        group = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        at = np.arange(n) - np.repeat(starts, np.diff([*starts, n]))
        if group[0] == last:
            first = starts[1] if len(starts) > 1 else n
            at[:first] += count
        last, count = group[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(at, pa.int64())], names=[*batch.schema.names, "_part", "_at"])


def numbered(rows: DataFrame, order: list[Column], name: str, group: str | None = None) -> DataFrame:
    """rows with `name`, 0, 1, 2, ... in the given order within each value of the integer column `group`.

    `rows` is a checkpoint or a projection of one: a row's place in it breaks ties, so it must not change. Rows are dealt to partitions by ranges of (group, order, place), so no two rows are equal and no
    repeated key, however frequent, is one task's. A number is the row's place in its partition's run of the group plus
    the group's rows in the partitions before; that table has a row a partition and group, groups being ranges of
    partitions, and is broadcast.
    """
    placed = rows.select(F.col(group) if group else F.lit(0).alias("_g"), *[c for c in rows.columns if c != group])
    first = placed.columns[0]
    keys = [F.col(first), *order, F.col("_tie")]
    dealt = placed.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    schema = T.StructType([*dealt.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    local = checkpointed(dealt.mapInArrow(_local, schema))
    before = Window.partitionBy(first).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    ends = local.groupBy(first, "_part").agg((F.max("_at") + 1).alias("_n"))
    offsets = ends.select(first, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = local.join(F.broadcast(offsets), [first, "_part"]).withColumn(name, F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset")
    return out if group else out.drop("_g")
