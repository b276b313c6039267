"""Resamples of chunks that are larger than a task: a multinomial tree over blocks of rows, and statistics that add up.

A resample of n out of a chunk's b rows is a multinomial vector of counts. Its tree halves the chunk's leaves of LEAF
slots: a node's count goes left by a binomial with the left side's share of the slots, and a leaf deals its count over
its own slots. Every node and leaf has a generator of its own, keyed by (seed, chunk, node), that goes through the runs in order, so a
run's counts depend neither on the number of runs nor on which rows a task holds, and any task finds the counts of its
leaves by walking down from the root.

A group is a chunk and a block of BLOCK_LEAVES leaves: at most BLOCK_LEAVES * LEAF rows, and RUNS runs' counts of one leaf at a
time. Blocks are packed once (`packed`) and stay where they are. What a block gives are partial sums a run; one chunk is spread over as many tasks as it has blocks. Estimators are sums
(mean), rounds of counts by digits of the values' bits (median), or rounds of gradients and Hessians (logistic).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstat.functions.session import checkpointed
from veilstat.operators.logistic import NEWTON_RIDGE
from veilstat.operators.selection import MOST_BROADCAST, medians

LEAF, BLOCK_LEAVES, RUNS = 4096, 32, 128
OFTEN = 8  # draws a slot from which on a slot's count is drawn as a binomial
DIGIT = 8  # bits of a round of the median
Partial = Callable[[np.ndarray, np.ndarray, int, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _generator(seed: int, chunk: int, *node: int) -> np.random.Generator:
    return np.random.default_rng([seed, chunk, *node])


@dataclass(frozen=True)
class Tree:
    """n rows of each of `runs` resamples. Seed and leaf size key the numbers; the block is how many leaves a task holds, and decides none."""

    n: int
    runs: int
    seed: int = 0
    leaf: int = LEAF
    block: int = BLOCK_LEAVES

    @property
    def block_rows(self) -> int:
        return self.leaf * self.block

    def block_of(self) -> Column:
        return (F.col("slot") / F.lit(self.block_rows)).cast("int")


def leaf_counts(tree: Tree, chunk: int, b: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, count of each run) of the leaves first..last - 1 of a chunk of b slots."""

    def walk(lo: int, hi: int, count: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, count
            return
        mid = (lo + hi) // 2
        left = _generator(tree.seed, chunk, lo, hi).binomial(count, (mid - lo) * tree.leaf / (min(hi * tree.leaf, b) - lo * tree.leaf))
        yield from walk(lo, mid, left)
        yield from walk(mid, hi, count - left)

    yield from walk(0, -(-b // tree.leaf), np.full(tree.runs, tree.n, np.int64))


def leaf_weights(tree: Tree, chunk: int, b: int, leaf: int, count: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first run, counts of the leaf's slots) for RUNS runs at a time: slot by slot where a slot is drawn often, else draw by draw."""
    size = min(tree.leaf, b - leaf * tree.leaf)
    rng = _generator(tree.seed, chunk, leaf)
    for at in range(0, len(count), RUNS):
        own = count[at : at + RUNS]
        if tree.n > OFTEN * b:
            yield at, rng.multinomial(own, np.full(size, 1 / size))
        else:
            place = rng.integers(0, size, own.sum()) + np.repeat(np.arange(len(own)) * size, own)
            yield at, np.bincount(place, minlength=len(own) * size).reshape(len(own), size)


PAGES = 4  # blocks of a partition, about


def packed(chunked: DataFrame, columns: list[str], tree: Tree) -> DataFrame:
    """(chunk, block, size, x) of each block: its rows in the order of their slots, as packed doubles; a checkpoint, so that a round reads numbers and moves none."""
    spark, d = chunked.sparkSession, len(columns)
    tasks = max(spark.sparkContext.defaultParallelism, -(-tree.n // (PAGES * tree.block_rows)))
    rows = chunked.select("chunk", tree.block_of().alias("block"), "slot", *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).repartition(tasks, "chunk", "block")

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x = own.sort_values("slot")[[f"_{i}" for i in range(d)]].to_numpy(float)
        return pd.DataFrame([(*key, len(x), np.ascontiguousarray(x).tobytes())], columns=["chunk", "block", "size", "x"])

    return checkpointed(rows.groupBy("chunk", "block").applyInPandas(run, "chunk int, block int, size long, x binary"))


def unpacked(held: DataFrame, columns: list[str]) -> DataFrame:
    """(chunk, columns...) of packed blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, x in zip(frame["chunk"], frame["x"], strict=True):
                yield pd.DataFrame(np.frombuffer(x).reshape(-1, len(columns)), columns=columns).assign(chunk=chunk)[["chunk", *columns]]

    return held.select("chunk", "x").mapInPandas(run, ", ".join(["chunk int", *(f"{c} double" for c in columns)]))


def chunk_sizes(held: DataFrame) -> DataFrame:
    return held.groupBy("chunk").agg(F.sum("size").alias("b"))


def on_blocks(held: DataFrame, d: int, state: DataFrame, find: Callable[[int, int, int, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    """(chunk, run, k, value): the sums of what find(chunk, block, b, x, runs, states) gives for each block.

    `state` is (chunk, b, run, state array). A chunk's runs are one row, and go to the blocks; the blocks move only where chunks are many.
    """
    each = F.sort_array(F.collect_list(F.struct("run", "state")))
    of_chunk = state.groupBy("chunk", "b").agg(each.alias("_s")).select("chunk", "b", F.col("_s.run").alias("runs"), F.flatten(F.col("_s.state")).alias("state"))
    small = state.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = held.select("chunk", "block", "x").join(F.broadcast(of_chunk) if small else of_chunk, "chunk")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                runs = np.asarray(r.runs, int)
                found = find(int(r.chunk), int(r.block), int(r.b), np.frombuffer(r.x).reshape(-1, d), runs, np.asarray(r.state, float).reshape(len(runs), -1))
                yield found.assign(chunk=int(r.chunk))[["chunk", "run", "k", "value"]]

    parts = rows.mapInPandas(run, "chunk int, run int, k long, value double")
    return parts.groupBy("chunk", "run", "k").agg(F.sum("value").alias("value"))


def block_sums(held: DataFrame, d: int, tree: Tree, partial: Partial, state: DataFrame) -> DataFrame:
    """(chunk, run, k, value): the sums over a chunk's packed blocks of d columns of what `partial` finds in each; no row where nothing was found.

    `state` is (chunk, b, run, state array). partial(x, w, first run, state of these runs) gives rows of runs, numbers k and values; equal ones add up.
    """

    def find(chunk: int, block: int, b: int, x: np.ndarray, active: np.ndarray, known: np.ndarray) -> pd.DataFrame:
        first = block * tree.block
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for leaf, count in leaf_counts(tree, chunk, b, first, first + tree.block):
            at = (leaf - first) * tree.leaf
            for lo, w in leaf_weights(tree, chunk, b, leaf, count):
                a, z = np.searchsorted(active, [lo, lo + len(w)])
                if z > a:
                    r, k, v = partial(x[at : at + w.shape[1]], w[active[a:z] - lo], a, known[a:z])
                    found.append((active[r + a], k, v))
        r, k, v = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        return pd.DataFrame({"run": r, "k": k, "value": np.asarray(v, float)}).groupby(["run", "k"], as_index=False).sum()

    return on_blocks(held, d, state, find)


def all_runs(held: DataFrame, runs: int) -> DataFrame:
    """(chunk, b, run) of every chunk and run."""
    return chunk_sizes(held).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def _dense(rows: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A matrix (run, k) as rows."""
    return np.repeat(np.arange(rows), values.shape[1]), np.tile(np.arange(values.shape[1]), rows), values.ravel()


def tree_means(chunked: DataFrame, columns: list[str], tree: Tree) -> DataFrame:
    """(chunk, run, dim, weight, est, sd, stat): mean and sample deviation of each resample, and root of n times (chunk's mean - est)."""
    d = len(columns)

    def partial(x, w, _, __):
        return _dense(len(w), np.hstack([w.sum(1, keepdims=True), w @ x, w @ (x * x)]))

    held = packed(chunked, columns, tree)
    state = all_runs(held, tree.runs).withColumn("state", F.array().cast("array<double>"))
    sums = block_sums(held, d, tree, partial, state)
    wide = sums.groupBy("chunk", "run").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m"))  # 2 d + 1 numbers a run
    own = unpacked(held, columns).groupBy("chunk").agg(F.array(*[F.avg(c) for c in columns]).alias("theta"))
    each = wide.join(own, "chunk").withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    at = lambda k: F.coalesce(F.try_element_at("m", k.cast("bigint")), F.lit(0.0))
    weight, total, square = at(F.lit(0)), at(F.col("dim") + 1), at(F.col("dim") + 1 + d)
    est = total / weight
    sd = F.sqrt(F.greatest(F.lit(0.0), square - total * est) / (weight - 1))
    return each.select("chunk", "run", "dim", weight.cast("long").alias("weight"), est.alias("est"), sd.alias("sd"), (F.sqrt(F.lit(float(tree.n))) * (F.col("theta")[F.col("dim")] - est)).alias("stat"))


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; minus zero is zero."""
    bits = (x + 0.0).view(np.uint64)
    sign = np.uint64(1) << np.uint64(63)
    return np.where(bits & sign, ~bits, bits | sign)


def from_bits(bits: np.ndarray) -> np.ndarray:
    sign = np.uint64(1) << np.uint64(63)
    return np.where(bits & sign, bits ^ sign, ~bits).view(np.float64)


def tree_medians(chunked: DataFrame, column: str, tree: Tree) -> DataFrame:
    """(chunk, run, est, stat): median of each resample, the midpoint of the two middle rows if n is even.

    Both middle ranks are found digit by digit of the values' ordered bits. A round counts the values that share the digits found
    so far by their next digit, at most 256 counts a run and rank from a block, and keeps the digit that holds the rank.
    The digits found and the rank left are two numbers a run and rank; a number of 64 bits travels as two of 32.
    """
    ranks = [(tree.n + 1) // 2, tree.n // 2 + 1]
    held = packed(chunked, [column], tree)
    targets = all_runs(held, tree.runs).withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(r).alias("left")) for i, r in enumerate(ranks)])))
    state = targets.select("chunk", "b", "run", F.col("t.t").alias("t"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"), F.col("t.left").cast("long").alias("left"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        # One row a run: the digits found for both ranks.
        digits = state.groupBy("chunk", "b", "run").agg(F.sort_array(F.collect_list(F.struct("t", "high", "low"))).alias("s")).select("chunk", "b", "run", F.flatten(F.transform("s", lambda v: F.array(v["high"].cast("double"), v["low"].cast("double")))).alias("state"))

        def partial(x, w, _, known, shift=shift):
            bits = ordered_bits(x[:, 0])
            order = np.argsort(bits, kind="stable")
            bits, w = bits[order], w[:, order]
            out = []
            for t in range(2):
                prefix = (known[:, 2 * t].astype(np.uint64) << np.uint64(32)) | known[:, 2 * t + 1].astype(np.uint64)
                for p in np.unique(prefix):
                    mine = np.flatnonzero(prefix == p)
                    top = np.uint64(shift + DIGIT)
                    lo, hi = (0, len(bits)) if top == 64 else np.searchsorted(bits >> top, [p >> top, (p >> top) + np.uint64(1)])
                    if hi == lo:
                        continue
                    digit = (bits[lo:hi] >> np.uint64(shift)).astype(np.int64) & (2**DIGIT - 1)
                    starts = np.flatnonzero(np.append(True, digit[1:] != digit[:-1]))
                    counts = np.add.reduceat(w[mine, lo:hi], starts, axis=1)
                    r, k, v = _dense(len(mine), counts)
                    keep = v > 0
                    out.append((mine[r[keep]], t * 2**DIGIT + digit[starts][k[keep]], v[keep]))
            return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3

        counts = block_sums(held, 1, tree, partial, digits)
        # At most 256 digits a run and rank: the first whose counts reach the rank.
        listed = counts.groupBy("chunk", "run", F.floor(F.col("k") / 2**DIGIT).cast("int").alias("t")).agg(F.sort_array(F.collect_list(F.struct((F.col("k") % 2**DIGIT).alias("digit"), F.col("value").cast("long").alias("ct")))).alias("c"))
        start = F.struct(F.col("left").alias("left"), F.lit(-1).cast("long").alias("digit"))
        step = lambda a, v: F.when(a["digit"] >= 0, a).when(a["left"] <= v["ct"], F.struct(a["left"].alias("left"), v["digit"].alias("digit"))).otherwise(F.struct((a["left"] - v["ct"]).alias("left"), a["digit"].alias("digit")))
        found = state.join(listed, ["chunk", "run", "t"]).withColumn("f", F.aggregate("c", start, step))
        digit = F.shiftleft(F.col("f.digit"), shift % 32)
        high, low = (F.col("high") + digit, F.col("low")) if shift >= 32 else (F.col("high"), F.col("low") + digit)
        state = checkpointed(found.select("chunk", "b", "run", "t", high.alias("high"), low.alias("low"), F.col("f.left").alias("left")))

    @F.pandas_udf("double")
    def value(high: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series(from_bits((high.to_numpy().astype(np.uint64) << np.uint64(32)) | low.to_numpy().astype(np.uint64)))

    est = state.select("chunk", "run", value("high", "low").alias("v")).groupBy("chunk", "run").agg(F.avg("v").alias("est"))
    own = medians(unpacked(held, [column]), column, ["chunk"]).withColumnRenamed("value", "theta")
    return est.join(own, "chunk").select("chunk", "run", "est", (F.sqrt(F.lit(float(tree.n))) * (F.col("theta") - F.col("est"))).alias("stat"))


def tree_logistic(chunked: DataFrame, columns: list[str], label: str, tree: Tree, start: list[float] | None = None, tolerance: float = 1e-6, steps: int = 100) -> DataFrame:
    """(chunk, run, dim, est, stat): Newton fits of each resample; a round is one sum of gradients and Hessians over the blocks.

    Run -1 is the chunk itself, every row once. A fit stops when its step is shorter than the tolerance. An iteration keeps
    d numbers a run.
    """
    d = len(columns)
    pairs = np.triu_indices(d)
    width = d + len(pairs[0])
    first = F.array(*[F.lit(float(v)) for v in start or [0.0] * d])

    def terms(x: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Sums of gradients and of the Hessians' upper triangles, a row a run."""
        y, x = x[:, -1], x[:, :-1]
        s = 1 / (1 + np.exp(np.clip(y * (beta @ x.T), -700, 700)))
        return np.hstack([-(w * s * y) @ x, (w * s * (1 - s)) @ (x[:, pairs[0]] * x[:, pairs[1]])])

    def stepped(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The next point of some runs of a chunk from their sums."""
        out = []
        for (chunk, b, run), own in rows.groupby(["chunk", "b", "run"]):
            v = np.zeros(width)
            v[own["k"].to_numpy(int)] = own["value"]
            h = np.zeros((d, d))
            h[pairs] = v[d:] / (b if run < 0 else tree.n)
            h = h + np.triu(h, 1).T + NEWTON_RIDGE * np.eye(d)
            step = np.linalg.solve(h, v[:d] / (b if run < 0 else tree.n))
            out.append((chunk, b, run, (own["state"].iloc[0] - step).tolist(), float(np.linalg.norm(step))))
        return pd.DataFrame(out, columns=["chunk", "b", "run", "state", "step"])

    def resampled(x, w, _, beta):
        return _dense(len(w), terms(x, w, beta))

    held = packed(chunked, [*columns, label], tree)
    sizes = all_runs(held, tree.runs).withColumn("state", first)
    state, done = checkpointed(sizes.unionByName(chunk_sizes(held).select("chunk", "b", F.lit(-1).alias("run"), first.alias("state")))), None
    for _ in range(steps):
        sums = block_sums(held, d + 1, tree, resampled, state.filter("run >= 0"))
        whole = plain_sums(held, d + 1, terms, state.filter("run < 0"))
        joined = state.join(sums.unionByName(whole), ["chunk", "run"]).withColumn("_r", F.floor(F.col("run") / RUNS))
        moved = checkpointed(joined.groupBy("chunk", "_r").applyInPandas(stepped, "chunk int, b long, run int, state array<double>, step double"))
        ended = moved.filter(F.col("step") <= tolerance).drop("step")
        done = ended if done is None else done.unionByName(ended)
        state = moved.filter(F.col("step") > tolerance).drop("step")
        if state.isEmpty():
            break
    else:
        done = done.unionByName(state)
    own = done.filter("run < 0").select("chunk", F.col("state").alias("theta"))
    each = done.filter("run >= 0").join(own, "chunk").select("chunk", "run", F.posexplode("state").alias("dim", "est"), "theta")
    return each.select("chunk", "run", "dim", "est", (F.sqrt(F.lit(float(tree.n))) * (F.col("theta")[F.col("dim")] - F.col("est"))).alias("stat"))


def plain_sums(held: DataFrame, d: int, terms: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], state: DataFrame) -> DataFrame:
    """(chunk, run, k, value) of each chunk with every row once; `state` has one row a chunk at most."""

    def find(_: int, __: int, ___: int, x: np.ndarray, runs: np.ndarray, states: np.ndarray) -> pd.DataFrame:
        v = terms(x, np.ones((1, len(x))), states)[0]
        return pd.DataFrame({"run": runs[0], "k": np.arange(len(v)), "value": v})

    return on_blocks(held, d, state, find)
