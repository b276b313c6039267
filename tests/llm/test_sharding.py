import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstat.llm import _crc, sharding

SCHEMA = "doc_id long, text string"


def walk(key, shards):
    """The published chain, one step at a time."""
    at, out = 0, -1
    while at < shards:
        out = at
        key = (key * 2862933555777941757 + 1) % 2**64
        at = int((out + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return out


def key_of(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


def test_jump():
    keys = np.array([0, 1, 2**64 - 1, 256, 0xDEADBEEF, *np.random.default_rng(1).integers(0, 2**63, 300)], np.uint64)
    for shards in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, shards).tolist() == [walk(int(k), shards) for k in keys]
    assert len(sharding.jump(keys[:0], 5)) == 0


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.random.default_rng(2).integers(0, 2**63, 40_000).astype(np.uint64)
    for shards in (1, 7, 24):
        old, new = sharding.jump(keys, shards), sharding.jump(keys, shards + 1)
        moved = old != new
        assert (new[moved] == shards).all() and abs(moved.mean() - 1 / (shards + 1)) < 5 * np.sqrt(1 / (shards + 1) / 40_000)
        share = np.bincount(new, minlength=shards + 1) / 40_000
        assert np.abs(share * (shards + 1) - 1).max() < 0.25


def test_plan(spark):
    """Nulls, empty texts, repeated rows, one id in a third of the rows, clashing columns."""
    rows = [(i, f"text {i} é") for i in range(300)] + [(7, f"again {i}") for i in range(80)] + [(7, "same")] * 80 + [(None, None), (None, "x"), (400, ""), (401, None), (402, "long " * 30_000)]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], SCHEMA + ", shard int, _h string").repartition(5)
    got = sharding.plan(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and r.shard == walk(key_of(r.doc_id), 24) and r.grown_shard == walk(key_of(r.doc_id), 25) and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.shard, hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest(), r.text_crc32, r.size) for r in order]
    assert keys == sorted(keys)
    assert sharding.plan(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        sharding.plan(df, 0)


def test_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sharding.write(docs, f"{tmp_path}/out", 6, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.drop("shard").select(*docs.columns).exceptAll(docs).count() == 0 == docs.exceptAll(back.drop("shard").select(*docs.columns)).count()
    assert back.filter(F.col("shard") != sharding.shard_of(F.col("doc_id"), 6)).count() == 0


def test_sql(spark):
    """The SQL twin gives the same rows on a table of odd ones, too."""
    rows = [(1, None), (2, ""), (None, "é" * 100), (3, "a" * 63), (4, "b" * 64), (5, "c" * 65), (6, "d" * 1000), (7, "x")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(sharding.ORACLE_SQL).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in sharding.plan(spark.createDataFrame(rows, SCHEMA)).collect())


def test_checksums_extend():
    rng = np.random.default_rng(3)
    pairs = [(bytes(rng.integers(0, 256, a, np.uint8)), bytes(rng.integers(0, 256, b, np.uint8))) for a, b in rng.integers(0, 300, (200, 2))] + [(b"", b""), (b"x", b"y" * 70_000)]
    state, tail = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    assert _crc.extended(state, tail, np.array([len(b) for _, b in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]
