"""CSV sources and sinks with stated schemas: no inference pass over the data, no positional pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstat.operators.survey import RAW, WEIGHT

FEATURES = T.StructType(
    [T.StructField("id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("AGEP", "SCHL", "WKHP", "SEX")]]
    + [T.StructField(c, T.IntegerType()) for c in ("MAR_married", "MAR_divorced", "COW_private", "COW_public", "COW_self", "PINCP")]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """The raw person survey, from Parquet or CSV by the path's ending: its columns by their names in the header, in any order and among others, and the
    person weights where the file has them."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    absent = [f.name for f in RAW.fields if f.name not in df.columns]
    if absent:
        raise ValueError(f"the survey lacks {', '.join(absent)}")
    return df.select(*[F.col(c).cast("double").alias(c) for c in [*RAW.names, *[c for c in (WEIGHT,) if c in df.columns]]])


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Prepared features and label, of which a fit reads only some columns."""
    df = read_csv(spark, path, FEATURES)
    return df.select("id", *columns, "PINCP") if columns else df
