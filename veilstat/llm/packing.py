"""Conflict-constrained best-fit packing of documents into training sequences.

Documents longer than a bin are cut into pieces of its capacity; nothing else is cut and nothing is dropped. Pieces
go to shards by a hash of document and piece, of about SHARD_CHARS characters and at most about SHARD_PIECES pieces
each, so a hot source or a group of copies spreads over all shards. In a shard, pieces are placed longest first, equal
ones by source, cluster, document and piece. Open bins are kept in order of their residual; each carries two bitmaps,
of the sources (a field of bits each, for the number of its pieces) and of the duplicate clusters it holds. The
search starts at the smallest residual that fits and goes on to successors until the tightest compatible bin is
found; if none is, a new bin opens. A piece that equals its forerunner in length, source and cluster resumes where
that one's search ended, since bins only gain bits; groups of copies therefore cost no more than other rows.

A bin never holds two pieces of one duplicate cluster, nor more than PER_SOURCE pieces of one source, unless the source
has more in an average bin: then its limit is SPREAD times that number, so that a corpus of few sources still fills its
bins. Null sources and null clusters conflict with nothing. Null and empty texts are pieces of length 0. Repeated rows
are packed each. Empty tables give empty results; extra columns are ignored. Of a text only its length and a digest are
kept, so very long texts cost their reading.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.llm._spark import checkpointed
from veilstat.sources.tables import table

CAPACITY = 32_768
PER_SOURCE, SPREAD = 4, 1.5
SHARD_CHARS, SHARD_PIECES = 64_000_000, 200_000
SCHEMA = "doc_id long, piece int, start long, stop long, shard long, bin int, slot int"


def limits(lengths: list[int], sources: list, capacity: int, per_source: int = PER_SOURCE, spread: float = SPREAD) -> dict:
    """The most pieces of each source in a bin: per_source, or `spread` times its pieces over the fewest bins that hold all."""
    bins = max(1, -(-sum(lengths) // capacity))
    return {s: max(per_source, math.ceil(spread * n / bins)) for s, n in Counter(sources).items() if s is not None}


def pack(lengths: list[int], sources: list, clusters: list, capacity: int, most: dict) -> list[tuple[int, int]]:
    """(bin, slot) of each piece, given longest first with equal (length, source, cluster) adjacent; `most`: the limit of each source."""
    lanes: dict = {}  # of each source: the place of its field in the bitmap, the field's mask, its limit
    top = 0
    for s, n in most.items():
        lanes[s] = (top, (1 << n.bit_length()) - 1, n)
        top += n.bit_length()
    cluster_bit: dict = {}
    many = {c for c, n in zip(*np.unique([c for c in clusters if c is not None], return_counts=True), strict=True) if n > 1} if clusters else set()
    open_bins: list[tuple[int, int]] = []  # (residual, bin) in order
    held: list[tuple[int, int, int]] = []  # per bin: source bitmap, cluster bitmap, pieces
    shortest = min(lengths, default=0)
    placed: list[tuple[int, int]] = []
    residuals: list[int] = []
    last, start, again = None, (0, -1), -1
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        lane = lanes[source] if source is not None else None
        bit = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if cluster in many else 0

        def fits(b: int, lane=lane, bit=bit) -> bool:
            return not held[b][1] & bit and (lane is None or held[b][0] >> lane[0] & lane[1] < lane[2])

        if (length, source, cluster) != last:
            last, start, again = (length, source, cluster), (length, -1), -1
        # Bins before `start` conflict with this kind of piece, but for the one that took the forerunner.
        if again >= 0 and residuals[again] >= length and fits(again):
            b = again
            open_bins.pop(bisect.bisect_left(open_bins, (residuals[b], b)))
        else:
            at = bisect.bisect_left(open_bins, start)
            while at < len(open_bins) and not fits(open_bins[at][1]):
                at += 1
            if at < len(open_bins):
                start = open_bins.pop(at)
                b = start[1]
            else:
                b, start = len(held), (capacity + 1, -1)
                held.append((0, 0, 0))
                residuals.append(capacity)
        sources_held, clusters_held, count = held[b]
        if lane is not None:
            sources_held += 1 << lane[0]
        held[b] = (sources_held, clusters_held | bit, count + 1)
        residuals[b] -= length
        if residuals[b] >= shortest:
            bisect.insort(open_bins, (residuals[b], b))
        again = b
        placed.append((b, count))
    return placed


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_chars: int = SHARD_CHARS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, stop (code points), shard, bin in the shard and slot in the bin, for every piece.

    `cluster`: the duplicate cluster of a row; by default the SHA-256 of its text with case and white space evened.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    even = F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)
    length = F.length(text).cast("long")
    key = F.when(length > 0, F.xxhash64(cluster if cluster is not None else even))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("length"), F.col(source_col).cast("string").alias("source"), key.alias("cluster"))
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / capacity)).cast("int"))
    cut = sized.withColumn("piece", F.explode(pieces)).select(
        "doc_id", "piece", "source", "cluster", (F.col("piece").cast("long") * capacity).alias("start"), F.least((F.col("piece").cast("long") + 1) * capacity, "length").alias("stop")
    )
    cut = checkpointed(cut)  # sizes only: the texts are read once
    total, count = cut.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // shard_chars), -(-count // shard_pieces))
    if shards > 1:  # rows of one id spread too, whatever their number
        cut = cut.withColumn("_row", F.monotonically_increasing_id())
    spread = [F.col(c) for c in ("doc_id", "piece", "_row") if c in cut.columns]

    def place(block: pa.Table) -> pa.Table:
        start, stop = block["start"].to_numpy(), block["stop"].to_numpy()
        source, cluster = block["source"].to_pylist(), block["cluster"].to_pylist()
        ids, piece = block["doc_id"].to_pylist(), block["piece"].to_pylist()
        order = sorted(range(len(start)), key=lambda i: (int(start[i] - stop[i]), source[i] or "", cluster[i] or 0, ids[i] or 0, piece[i]))
        block = block.take(pa.array(order, pa.int64()))
        sizes, sources = [int(stop[i] - start[i]) for i in order], [source[i] for i in order]
        placed = pack(sizes, sources, [cluster[i] for i in order], capacity, limits(sizes, sources, capacity, per_source))
        return pa.table({**{c: block[c] for c in ("doc_id", "piece", "start", "stop", "shard")}, "bin": pa.array([b for b, _ in placed], pa.int32()), "slot": pa.array([s for _, s in placed], pa.int32())})

    return cut.withColumn("shard", F.pmod(F.xxhash64(*spread), F.lit(shards))).drop("_row").groupBy("shard").applyInArrow(place, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place."""
    return best_fit(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of docs: one row for every piece."""
    return best_fit(docs)
