"""Preparation of the survey table: filter, scaling, one-hot groups, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the person survey and the divisors of its numeric ones.
RAW = T.StructType([T.StructField(c, T.DoubleType()) for c in ("AGEP", "COW", "SCHL", "MAR", "WKHP", "SEX", "PINCP")])
WEIGHT = "PWGTP"  # weights of persons; not every file has them
SCALES = {"AGEP": 99.0, "WKHP": 99.0, "SCHL": 24.0}
GROUPS = {"MAR_married": ("MAR", (1, 2)), "MAR_divorced": ("MAR", (3, 4)), "COW_private": ("COW", (1, 2)), "COW_public": ("COW", (3, 4, 5)), "COW_self": ("COW", (6, 7))}


def adult_filter(df: DataFrame) -> DataFrame:
    """Persons over 16 with income over 100 who work; where the table has person weights, those of weight 1 or more."""
    kept = (F.col("AGEP") > 16) & (F.col("PINCP") > 100) & (F.col("WKHP") > 0)
    return df.filter(kept & (F.col(WEIGHT) >= 1) if WEIGHT in df.columns else kept)


def fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and null as 0."""
    return df.withColumns({c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})


def guarded_scale(df: DataFrame, scales: dict[str, float], shifts: dict[str, float] | None = None) -> DataFrame:
    """Divides a column by its scale, or moves it by its shift, only if its maximum exceeds 1; one aggregate for all."""
    shifts = shifts or {}
    top = df.agg(*[F.max(c).alias(c) for c in [*scales, *shifts]]).first()
    over = lambda c: top[c] is not None and top[c] > 1
    return df.withColumns({c: F.col(c) / F.lit(k) for c, k in scales.items() if over(c)} | {c: F.col(c) - F.lit(k) for c, k in shifts.items() if over(c)})


def one_hot(column: Column, codes: tuple) -> Column:
    """1 if the code is one of a group; categories are stated, so an absent one is a column of zeros."""
    return F.coalesce(column.cast("int").isin(*codes), F.lit(False)).cast("int")


def prepare(raw: DataFrame) -> DataFrame:
    """Features and label of the adult table: scaled numbers, grouped dummies, income over 30000 as 1 or -1."""
    df = fill(adult_filter(raw), [f.name for f in RAW.fields])
    df = guarded_scale(df, SCALES, {"SEX": 1.0})
    label = (F.when(F.col("PINCP") > 30000, 1).otherwise(-1)).alias("PINCP")
    keys = [c for c in raw.columns if c not in RAW.names and c != WEIGHT]
    return df.select(*keys, "AGEP", "SCHL", "WKHP", "SEX", *[one_hot(F.col(c), codes).alias(name) for name, (c, codes) in GROUPS.items()], label)


def feature_rows(df: DataFrame, columns: list[str], label: str, key: str) -> DataFrame:
    """(key, x array, y): features and labels meet by key, never by position."""
    return df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"))
