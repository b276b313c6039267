"""Session helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstat.functions.session import checkpointed  # noqa: F401
from veilstat.llm._arrow import byte_view, slices

BATCH_ROWS = 512
PART_ROWS = 1 << 17  # of a frame of a few numbers a row


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, unless the session asks for other than the default; long texts fill them soon."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(id_col.cast("string")) % 5


def held_out(id_col: Column) -> Column:
    """Whether an id is held out; rows without an id are not, and no fit uses them."""
    return F.coalesce(fold_of(id_col) == 0, F.lit(False))


def one_row_an_id(docs: DataFrame, ids: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """(doc_id, columns...) of the rows with a chosen id, one an id: the smallest by hash of the text and the columns.

    The bounded `ids` are broadcast. However often an id comes, its rows meet in partial aggregates; the result has at
    most as many rows as there are ids.
    """
    order = F.struct(F.xxhash64(text_col), F.xxhash64(*columns))
    return docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("r")).select("doc_id", "r.*")


def with_text_columns(df: DataFrame, text_col: str, added: T.StructType, compute: Callable, slice_bytes: int = 1 << 20) -> DataFrame:
    """df with columns computed from the bytes of a text column; columns of those names in df are replaced.

    compute(data, offsets) gets the UTF-8 bytes of a run of whole rows and returns one Arrow array a column.
    """
    small_batches(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c not in added.names or c == text_col])
    at, names = kept.columns.index(text_col), [*kept.columns, *added.names]

    def run(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column(at))
            for lo, hi in slices(offsets, slice_bytes):
                part = offsets[lo : hi + 1]
                arrays = compute(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *arrays], names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added.fields]))


def parts_for(rows: int) -> int:
    """Partitions that so many short rows need. A shuffle writes files for each partition it reads, however small."""
    return max(1, -(-rows // PART_ROWS))


def shared(spark: SparkSession, value):
    """A broadcast of a fitted model, whose size its parameters bound."""
    return spark.sparkContext.broadcast(value)
