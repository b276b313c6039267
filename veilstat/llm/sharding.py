"""Shards by jump consistent hashing.

A row's key (the first 64 bits of the MD5 of its id as text) seeds a chain of pseudo-random jumps; the shard is the last
place that the chain reaches below the number of shards. No ring and no table is kept, and since the chain does not
depend on the number, one more shard takes 1 / (shards + 1) of the rows into itself and moves no other.

`with_shard` adds the shard to any frame, `plan` numbers the rows of every shard without gaps (by the key's digest, then
text checksum and size), `write` puts whole rows into a folder a shard.

Null ids: the key of the empty string, so all of them share a shard. Null texts count as empty: 8 bytes, checksum 0.
Repeated ids share a shard (the key decides), repeated rows stay, each with a slot of its own, in no stated order. Texts
of any length cost their row only. Columns of the names that are added are replaced in `with_shard`; `plan` returns its
own columns only. An empty table gives an empty plan. A hot id makes its shard larger, since `key` is the law, but no
task: slots are dealt by ranges of rows, not by key or shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.llm._crc import long_ctes
from veilstat.llm._ranks import numbered
from veilstat.llm._spark import checkpointed
from veilstat.sources.tables import table

SHARDS = 24
FACTOR = np.uint64(2862933555777941757)  # fixed value: the published multiplier of the chain


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    state, out, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    active = np.arange(len(keys))
    while len(active):
        out[active] = at[active]
        state[active] = state[active] * FACTOR + np.uint64(1)
        step = float(1 << 31) / ((state[active] >> np.uint64(33)).astype(np.float64) + 1.0)
        at[active] = np.floor((out[active] + 1) * step).astype(np.int64)
        active = active[at[active] < shards]
    return out.astype(np.int32)


def digest(id_col: Column) -> Column:
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")))


def shard_of(id_col: Column, shards: int) -> Column:
    """The shard of an id among `shards`; its digest's first 64 bits go to numpy as two numbers of 32."""
    if shards < 1:
        raise ValueError(f"no law for {shards} shards")

    @F.pandas_udf("int")
    def run(high: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series(jump((high.to_numpy().astype(np.uint64) << np.uint64(32)) | low.to_numpy().astype(np.uint64), shards))

    half = lambda at: F.conv(F.substring(digest(id_col), at, 8), 16, 10).cast("long")
    return run(half(1), half(9))


def with_shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """df with the shard of each row."""
    return df.withColumn(name, shard_of(F.col(id_col), shards))


def plan(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    rows = df.select(
        shard_of(own, shards).alias("shard"), own.cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(own, shards + 1).alias("grown_shard"), digest(own).alias("_h"),
    )
    out = numbered(checkpointed(rows), [F.col("_h"), F.col("text_crc32"), F.col("size")], "slot", "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write(df: DataFrame, path: str, shards: int = SHARDS, files: int = 1, id_col: str = "doc_id") -> None:
    """Whole rows as Parquet, a folder `shard=k` a shard, in about `files` files each; a hot id is spread over them."""
    salted = with_shard(df, shards, id_col).withColumn("_salt", F.floor(F.rand(7) * files).cast("int"))
    salted.repartition(shards * files, "shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23."""
    return plan(table(spark, sf_dir, "documents"))


# The chain of jumps as a recursion over the distinct ids, in unsigned 128-bit numbers modulo 2^64.
ORACLE_SQL = f"""WITH RECURSIVE own AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
walk AS (SELECT h, shards, CAST('0x' || substr(h, 1, 16) AS UHUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM (SELECT DISTINCT h FROM own), (SELECT unnest([{SHARDS}, {SHARDS + 1}]) AS shards)
  UNION ALL SELECT h, shards, k, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST((k >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT h, shards, j, CAST((k * 2862933555777941757 + 1) % 18446744073709551616 AS UHUGEINT) AS k FROM walk WHERE j < shards)),
law AS (SELECT h, CAST(max(b) FILTER (shards = {SHARDS} AND j >= shards) AS INTEGER) AS shard, CAST(max(b) FILTER (shards = {SHARDS + 1} AND j >= shards) AS INTEGER) AS grown_shard FROM walk GROUP BY h),
{long_ctes('sums', 'SELECT text FROM own')}
SELECT doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, shard,
row_number() OVER (PARTITION BY shard ORDER BY h, crc, octet_length(encode(text))) - 1 AS slot, grown_shard FROM own JOIN law USING (h) JOIN sums USING (text)"""
