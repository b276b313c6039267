"""Importance resampling towards a target distribution, by partition-local word tries.

Words of a run of rows are the first level of a trie, pairs of consecutive words the second, triples the third. A node
holds how often its path occurs and the CRC state of the path's bytes, which extends that of its parent by one blank and
one word: shifting the parent's state by as many zero bytes and adding the word's own state (CRCs are linear). A state
modulo the number of buckets is the node's bucket. The counts of all nodes go to bucket totals, added up in a partition and
then over all; target and documents do the same. Buckets' gains (a bounded table) are then attached to the nodes of the same
tries, and a document's weight is the sum along the paths it walks. Gumbel noise keyed by the id makes the highest
scores a sample without replacement.

A trie lives for SLICE_BYTES of text, so memory is bounded; longer texts go through in windows that take the last two
words along, which counts every run of words once. One word without end costs its bytes.

Null texts have no words: weight 0. Null ids: the key is that of the empty string, and they come last among equal scores.
Texts of fewer than `least` words are never drawn. Ties go to the smaller id, then to fewer features, then in no stated order; repeated
rows each count and are each drawn on their own. Extra columns are ignored. An empty table gives an empty result; with an
empty target all gains come from the documents alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.llm._crc import extended, short_sql
from veilstat.llm._ranks import numbered
from veilstat.llm._spark import checkpointed, shared, small_batches
from veilstat.sources.tables import table

BUCKETS, SEED, LEAST_WORDS = 10_000, 42, 20
SLICE_BYTES = 1 << 21
RUN = 3  # words of the longest feature

# Letters a to z, digits and bytes beyond ASCII are word bytes; A to Z are lower-cased, all others part words.
FOLDED = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for b in range(256))


class Trie:
    """The trie of runs of up to three words of pieces of texts: `piece` is the piece of each word, in order; words that
    are not `fresh` were counted with the piece before."""

    def __init__(self, words: list[bytes], piece: np.ndarray, fresh: np.ndarray):
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        state = np.fromiter(map(zlib.crc32, number), np.uint32, len(number))
        tail = np.fromiter((zlib.crc32(b" " + w) for w in number), np.uint32, len(number))
        length = np.fromiter((len(w) + 1 for w in number), np.int64, len(number))
        start, node = np.arange(len(ids)), ids
        self.levels = [(state, node[fresh], piece[fresh])]  # states of the nodes, node and piece of each counted place
        for depth in range(1, RUN):
            go = start + depth < len(ids)
            start, node = start[go], node[go]
            go = piece[start + depth] == piece[start]
            start, node = start[go], node[go]
            paths, node = np.unique(node * max(len(number), 1) + ids[start + depth], return_inverse=True)
            parent, last = np.divmod(paths, max(len(number), 1))
            state = extended(state[parent], tail[last], length[last])
            counted = fresh[start + depth]
            self.levels.append((state, node[counted], piece[start][counted]))

    def totals(self, buckets: int) -> np.ndarray:
        """Counts of all nodes by bucket."""
        out = np.zeros(buckets, np.int64)
        for state, node, _ in self.levels:
            out += np.bincount(state % np.uint32(buckets), np.bincount(node, minlength=len(state)), buckets).astype(np.int64)
        return out

    def walked(self, gains: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
        """(features, weight) of each piece: gains attached to the nodes, summed along the paths."""
        n, weight = np.zeros(pieces, np.int64), np.zeros(pieces, np.int64)
        for state, node, piece in self.levels:
            n += np.bincount(piece, minlength=pieces)
            weight += np.bincount(piece, gains[state % np.uint32(len(gains))][node], pieces).astype(np.int64)
        return n, weight


def windows(text: bytes, size: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of the first are taken along) of a folded text, cut at a blank after about `size` bytes."""
    at, last = 0, []
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        words = [*last, *text[at:end].split()]
        yield words, len(last)
        at, last = end, words[1 - RUN :]


def tries(texts: list[str | None], size: int = SLICE_BYTES) -> Iterator[tuple[Trie, list[int], np.ndarray]]:
    """(trie, text of each piece, fresh words of each piece) for about `size` bytes of texts at a time."""
    words: list[bytes] = []
    pieces: list[int] = []
    counts: list[tuple[int, int]] = []
    held = 0
    for k, text in enumerate(texts):
        for part, carried in windows((text or "").encode().translate(FOLDED), size):
            words += part
            pieces.append(k)
            counts.append((len(part), carried))
            held += sum(map(len, part))
            if held >= size:
                yield _trie(words, counts), pieces, np.array([n - c for n, c in counts])
                words, pieces, counts, held = [], [], [], 0
    if pieces:
        yield _trie(words, counts), pieces, np.array([n - c for n, c in counts])


def _trie(words: list[bytes], counts: list[tuple[int, int]]) -> Trie:
    n, carried = np.array(counts, np.int64).T
    at = np.arange(len(words)) - np.repeat(n.cumsum() - n, n)
    return Trie(words, np.repeat(np.arange(len(n)), n), at >= np.repeat(carried, n))


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS, size: int = SLICE_BYTES) -> DataFrame:
    """(bucket, n) of all features of a one-column frame of texts; a partition gives at most a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for trie, _, _ in tries(batch.column(0).to_pylist(), size):
                total += trie.totals(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source) of every bucket; one row a bucket comes to the driver."""
    counted = source.withColumn("side", F.lit("s")).unionByName(target.withColumn("side", F.lit("t"))).collect()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in counted:
        (s if r.side == "s" else t)[r.bucket] = r.n
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    held = shared(spark, gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for trie, texts, fresh in tries(batch.column(1).to_pylist(), size):
                for row, values in zip(out, (fresh, *trie.walked(held.value, len(texts))), strict=True):
                    np.add.at(row, texts, values)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): rank is null for the rows that are not drawn.

    Drawn are share[0] / share[1], rounded down, of the rows with at least `least` words.
    """
    texts = lambda df: df.select(F.col(text_col).alias("text"))
    gain = gains(bucket_totals(texts(docs), buckets, size), bucket_totals(texts(target), buckets, size), buckets)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u)))
    rows = checkpointed(weighed(docs, gain, id_col, text_col, size)).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("_few", (F.col("n_words") < least).cast("int"))
    n = rows.filter("_few = 0").count()
    out = numbered(rows, [F.col("_few"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")], "_pos")
    drawn = (F.col("_few") == 0) & (F.col("_pos") < F.lit(share[0] * n // share[1]))
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("_pos") + 1).cast("long").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of one in twenty documents towards the benchmark's texts."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_runs = " UNION ALL ".join(f"SELECT side, row, array_to_string(w[i : i + {k - 1}], ' ') AS f FROM (SELECT side, row, w, unnest(range(1, len(w) - {k - 1} + 1)) AS i FROM words)" for k in range(1, RUN + 1))
ORACLE_SQL = f"""WITH texts AS (SELECT 's' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS ({_runs}), counted AS (SELECT side, row, f, count(*) AS n FROM runs GROUP BY ALL),
bucket AS (SELECT f, {short_sql('f')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM counted)),
total AS (SELECT bucket, CAST(sum(CASE WHEN side = 's' THEN n ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN side = 't' THEN n ELSE 0 END) AS DOUBLE) AS t FROM counted JOIN bucket USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(CAST(1000 AS DOUBLE) * ln((t + 1) * ((SELECT sum(s) FROM total) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM total) + {BUCKETS})))) AS g FROM total),
weight AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM counted JOIN bucket USING (f) JOIN gain USING (bucket) WHERE side = 's' GROUP BY row),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
  coalesce(weight, 0) + CAST(floor(CAST(-1000 AS DOUBLE) * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM words LEFT JOIN weight ON weight.row = words.row WHERE side = 's'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= 5 * n // 100 THEN place END AS rank FROM placed"""
