"""Generated samples as a Spark data source.

    samples(spark, "truncnorm_assym", rows=1_000_000, seed=5).filter("row_id < 1000")

The source makes the rows (row_id, x) of a study's distribution, `step` of them a partition, in the tasks that read them. The numbers are those of
`Distribution.sample`, keyed by row, so partitions decide nothing. Bounds on row_id are pushed: rows that a filter excludes are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from veilstat.sources.distributions import study_distribution

STEP, BATCH = 1 << 16, 1 << 13


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Samples(DataSource):
    """Options: dist (a name of the study's distributions), rows, seed, step."""

    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return "row_id long, x double"

    def reader(self, schema) -> DataSourceReader:
        return SamplesReader(dict(self.options))


class SamplesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.dist, self.seed = options.get("dist", "truncnorm_assym"), int(options.get("seed", 0))
        study_distribution(self.dist)  # an unknown name fails here
        self.first, self.last, self.step = 0, int(options.get("rows", 1000)), int(options.get("step", STEP))
        if self.last < 0 or self.step < 1:
            raise ValueError("rows and step must be positive")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of row_id are taken; all else is Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) != ("row_id",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                self.last = min(self.last, f.value + (not isinstance(f, LessThan)))

    def partitions(self) -> list[InputPartition]:
        return [Rows(a, min(a + self.step, self.last)) for a in range(self.first, self.last, self.step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        dist = study_distribution(self.dist)
        for at in range(partition.first, partition.last, BATCH):
            ids = np.arange(at, min(at + BATCH, partition.last))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dist.at(self.seed, ids))], names=["row_id", "x"])


def samples(spark: SparkSession, dist: str, rows: int, seed: int = 0, step: int = STEP) -> DataFrame:
    """(row_id, x) through the source, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Samples)
    return spark.read.format("samples").option("dist", dist).option("rows", rows).option("seed", seed).option("step", step).load()
