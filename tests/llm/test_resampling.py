import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstat.llm import resampling

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, buckets=10_000, least=20):
    """(doc_id, n_words, n_features, weight, score, rank) of every row, one feature at a time."""
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in features(text):
                side[f % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f % buckets] for f in features(text))
        out.append([i, len(words(text)), len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(drawn[: 5 * len(drawn) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


ODD = ["", None, " ", "a", "A b", "a b c", "É é 1x\x00y", "x" * 5000, "日本 語 x-y_z", "\t\n", "a " * 30, "- " * 4000 + "end"]


def test_tries_count_every_run_once():
    """Windows of long texts and pieces of many texts: the features of each text, whatever the size of a slice."""
    texts = [*ODD, "one two three four five " * 40, "w" * 70 + " " + "v " * 50]
    gain = np.arange(1, 998)
    for size in (1, 7, 64, 1 << 20):
        total, n, weight, fresh_words = np.zeros(997, int), np.zeros(len(texts), int), np.zeros(len(texts), int), np.zeros(len(texts), int)
        for trie, owner, fresh in resampling.tries(texts, size):
            total += trie.totals(997)
            for row, values in zip((fresh_words, n, weight), (fresh, *trie.walked(gain, len(owner))), strict=True):
                np.add.at(row, owner, values)
        want = [features(t) for t in texts]
        assert fresh_words.tolist() == [len(words(t)) for t in texts] and n.tolist() == [len(f) for f in want], size
        assert weight.tolist() == [sum(int(gain[v % 997]) for v in f) for f in want], size
        assert total.tolist() == np.bincount([v % 997 for f in want for v in f], minlength=997).tolist(), size


@pytest.mark.parametrize("size", [50, 1 << 21])
def test_resample(spark, size):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    # Repeated rows, one id in many rows, null ids and texts, long texts.
    docs += [(9000 + i, t) for i, t in enumerate(ODD)] + [docs[0]] * 60 + [(None, f"filler words number {i} " * 8) for i in range(40)] + [(9100, "long text " * 2000)]
    df = spark.createDataFrame([(*r, 1.5) for r in docs], SCHEMA + ", score double").repartition(5)
    other = spark.createDataFrame([(t,) for t in [*target, None, ""]], "text string")
    got = sorted((tuple(r) for r in resampling.resample(df, other, size=size).collect()), key=str)
    want = brute(docs, target)
    strip = lambda rows: [r[:5] for r in rows]
    assert strip(got) == strip(want)  # repeated rows may swap their ranks
    ranks = lambda rows: sorted((r[5], r[0] is None, r[0] or 0, r[4]) for r in rows if r[5])
    assert ranks(got) == ranks(want) and len(ranks(got)) > 5


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(i, "some words here " * 10) for i in range(40)], SCHEMA)
    assert resampling.resample(empty, some).count() == 0
    got = resampling.resample(some, empty)
    assert got.filter(F.col("rank").isNotNull()).count() == 2 and sorted(map(tuple, got.collect()), key=str) == brute([(i, "some words here " * 10) for i in range(40)], [])


def test_sql(spark):
    rows = [(i, f"w{i} " * (i % 50) + "common words of all") for i in range(120)] + [(200 + i, t) for i, t in enumerate(ODD) if t is None or "\x00" not in t]
    target = ["common words", "w3 w3 w3"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?)", [(t,) for t in target])
    want = sorted((tuple(None if v is None else int(v) for v in r) for r in con.execute(resampling.ORACLE_SQL).fetchall()), key=str)
    out = resampling.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == want


def test_draw_prefers_the_target(spark):
    """Documents made of the target's words are drawn far more often than their share."""
    rows = [(i, ("alpha beta gamma delta " if i % 10 == 0 else "other plain words only ") * 8) for i in range(1000)]
    got = resampling.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("alpha beta gamma delta " * 20,)], "text string")).filter("rank is not null")
    assert got.count() == 50 and got.filter("doc_id % 10 = 0").count() == 50
