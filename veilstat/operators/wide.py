"""Logistic regression over many features: Newton steps by conjugate gradients, and Gram matrices in tiles.

Rows are sparse: (idx array<int>, val array<double>, y), labels -1 and 1. No plan has an expression a pair of features: a pass is d partial sums a
partition, a row a feature that occurs. Beyond HELD features a Newton step solves H s = g by preconditioned conjugate gradients, which never build H: products
H v = X' (w (X v)) + ridge v are one pass each, with the Hessian's diagonal from the gradient's pass, and the driver keeps vectors of d numbers.

A Gram matrix X' W X, as the sandwich needs, comes in tiles of TILE x TILE, each summed over the partitions in two steps, so that a group is never more than
FAN matrices at the second.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.operators.logistic import NEWTON_RIDGE

TILE, FAN, ROWS = 256, 64, 2048
SPARSE = 1.0  # pairs of values a row and feature up to which products go pair by pair
HELD = 2048  # features up to which the driver holds a Hessian: 32 MB


class Block:
    """Some sparse rows in numpy."""

    def __init__(self, batch: pa.RecordBatch):
        lists, values = batch.column(0), batch.column(1)
        offsets = lists.offsets.to_numpy()
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        self.idx, self.val = lists.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False).astype(float)
        self.y, self.n = batch.column(2).to_numpy(zero_copy_only=False), batch.num_rows

    def times(self, v: np.ndarray) -> np.ndarray:
        """X v."""
        return np.bincount(self.row, self.val * v[self.idx], self.n)

    def back(self, r: np.ndarray, d: int, power: int = 1) -> np.ndarray:
        """X' r; with power 2 the squares of the values."""
        return np.bincount(self.idx, self.val**power * r[self.row], d)

    def dense(self, d: int) -> np.ndarray:
        out = np.zeros((self.n, d))
        np.add.at(out, (self.row, self.idx), self.val)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places a, b of all pairs of a row's values, in either order and with itself."""
        size = np.bincount(self.row, minlength=self.n)
        each = size[self.row]
        first, end = np.cumsum(size) - size, np.cumsum(each)
        a = np.repeat(np.arange(len(self.row)), each)
        return a, np.repeat(first[self.row] - end + each, each) + np.arange(len(a))

    def square(self, d: int, weight: np.ndarray) -> np.ndarray:
        """X' W X from the pairs of each row's values; what is not there costs nothing."""
        a, b = self.pairs()
        return np.bincount(self.idx[a].astype(np.int64) * d + self.idx[b], self.val[a] * self.val[b] * weight[self.row[a]], d * d).reshape(d, d)

    def chances(self, beta: np.ndarray) -> np.ndarray:
        """Of the label that a row does not have."""
        return 1 / (1 + np.exp(np.clip(self.y * self.times(beta), -700, 700)))


def pass_sums(df: DataFrame, d: int, vectors: int, terms: Callable[[Block], np.ndarray]) -> tuple[np.ndarray, int]:
    """(sums of `terms`, rows): vectors x d numbers, by one pass of partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((vectors, d)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                block = Block(batch.slice(at, ROWS))
                total += terms(block)
                n += block.n
        k = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1), pa.int32()), *[pa.array(np.append(row[k], n)) for row in total]], names=["k", *[f"v{i}" for i in range(vectors)]])

    schema = "k int, " + ", ".join(f"v{i} double" for i in range(vectors))
    rows = df.select("idx", "val", F.col("y").cast("double")).mapInArrow(run, schema).groupBy("k").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(vectors)]).toPandas()  # d + 1 rows
    out = np.zeros((vectors, d))
    own = rows[rows["k"] >= 0]
    out[:, own["k"].to_numpy()] = own.drop(columns="k").to_numpy().T
    n = rows.loc[rows["k"] < 0, "v0"]
    return out, int(n.iloc[0]) if len(n) else 0


def wide_fit(df: DataFrame, d: int, start: np.ndarray | None = None, tolerance: float = 1e-6, steps: int = 50, inner: int = 200, ridge: float = NEWTON_RIDGE, held: int = HELD) -> np.ndarray:
    """The estimate of d coefficients: Newton steps until one is shorter than the tolerance. Rows without features and features without rows are allowed.

    Up to `held` features the driver solves with the Hessian's tiles, two passes a step; beyond it a step is conjugate gradients, a pass a product.
    """
    beta = np.zeros(d) if start is None else np.asarray(start, float).copy()
    first = None
    for _ in range(steps):

        def slopes(block: Block, beta=beta) -> np.ndarray:
            s = block.chances(beta)
            return np.stack([-block.back(s * block.y, d), block.back(s * (1 - s), d, 2)])

        (g, diagonal), n = pass_sums(df, d, 2, slopes)
        if n == 0:
            return beta
        g, diagonal = g / n, diagonal / n + ridge
        if d <= held:
            step = np.linalg.solve(matrix(gram_tiles(df, d, curvature(beta)), d) / n + ridge * np.eye(d), g)
        else:

            def product(v: np.ndarray, beta=beta, n=n) -> np.ndarray:
                def terms(block: Block) -> np.ndarray:
                    s = block.chances(beta)
                    return block.back(s * (1 - s) * block.times(v), d)[None, :]

                return pass_sums(df, d, 1, terms)[0][0] / n + ridge * v

            first = first or float(np.linalg.norm(g))
            step = conjugate(product, g, diagonal, min(0.5, math.sqrt(float(np.linalg.norm(g)) / first)) if first else 0.5, inner)
        beta = beta - step
        if float(np.linalg.norm(step)) <= tolerance:
            break
    return beta


def conjugate(product: Callable[[np.ndarray], np.ndarray], g: np.ndarray, diagonal: np.ndarray, share: float, most: int) -> np.ndarray:
    """s with |H s - g| at most `share` of |g|, preconditioned by the diagonal; a smaller share near the end makes Newton's convergence quick."""
    s, r = np.zeros_like(g), g.copy()
    z = r / diagonal
    p, rz, goal = z.copy(), float(r @ z), share * float(np.linalg.norm(g))
    for _ in range(most):
        if float(np.linalg.norm(r)) <= goal or rz == 0:
            break
        hp = product(p)
        a = rz / float(p @ hp)
        s, r = s + a * p, r - a * hp
        z = r / diagonal
        rz, last = float(r @ z), rz
        p = z + rz / last * p
    return s


def gram_tiles(df: DataFrame, d: int, weight: Callable[[Block], np.ndarray] | None = None, tile: int = TILE) -> DataFrame:
    """(ti, tj, tile): the tiles ti <= tj of X' W X, row by row as packed doubles; tiles at the border are smaller. Without a weight every row counts once."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows, whole = {}, False, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                block, any_rows = Block(batch.slice(at, ROWS)), True
                if d <= HELD and np.square(np.bincount(block.row, minlength=1)).sum() <= SPARSE * block.n * d:
                    own = block.square(d, np.ones(block.n) if weight is None else weight(block))
                    whole = own if whole is None else whole + own
                    continue
                x = block.dense(d)
                wx = x if weight is None else x * weight(block)[:, None]
                for i in range(0, d, tile):
                    for j in range(i, d, tile):
                        part = x[:, i : i + tile].T @ wx[:, j : j + tile]
                        total[i // tile, j // tile] = part if (i // tile, j // tile) not in total else total[i // tile, j // tile] + part
        for i in range(0, d, tile) if whole is not None else ():
            for j in range(i, d, tile):
                part = whole[i : i + tile, j : j + tile].copy()
                total[i // tile, j // tile] = part if (i // tile, j // tile) not in total else total[i // tile, j // tile] + part
        fan = TaskContext.get().partitionId() % FAN
        for (i, j), m in total.items() if any_rows else ():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([fan], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["ti", "tj", "fan", "tile"])

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One matrix of a group's, which come one after another."""
        total = None
        for batch in batches:
            for cell in batch.column("tile"):
                m = np.frombuffer(cell.as_buffer(), float)
                total = m.copy() if total is None else total + m
        yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()], pa.int32()) for k in key], pa.array([total.tobytes()], pa.binary())], names=["ti", "tj", "fan", "tile"][: len(key)] + ["tile"])

    parts = df.select("idx", "val", F.col("y").cast("double")).mapInArrow(partial, "ti int, tj int, fan int, tile binary")
    some = parts.groupBy("ti", "tj", "fan").applyInArrow(added, "ti int, tj int, fan int, tile binary")
    return some.groupBy("ti", "tj").applyInArrow(added, "ti int, tj int, tile binary")


def tile_entries(tiles: DataFrame, d: int, tile: int = TILE) -> DataFrame:
    """(i, j, value) of all entries i <= j that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ti, tj, cell in zip(*[batch.column(c).to_pylist() for c in ("ti", "tj", "tile")], strict=True):
                m = np.frombuffer(cell, float).reshape(min(tile, d - ti * tile), -1)
                i, j = np.nonzero(m)
                keep = i + ti * tile <= j + tj * tile
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(i + ti * tile, pa.int32()), pa.array(j + tj * tile, pa.int32()), pa.array(m[i, j])], names=["i", "j", "value"])

    return tiles.mapInArrow(run, "i int, j int, value double")


def curvature(beta: np.ndarray) -> Callable[[Block], np.ndarray]:
    """The weight of a row in the Hessian at beta."""
    return lambda block: (s := block.chances(beta)) * (1 - s)


def squared_slope(beta: np.ndarray) -> Callable[[Block], np.ndarray]:
    """The weight of a row in the sandwich's middle at beta."""
    return lambda block: block.chances(beta) ** 2


def matrix(tiles: DataFrame, d: int, tile: int = TILE) -> np.ndarray:
    """The whole symmetric matrix on the driver, for d that it can hold."""
    out = np.zeros((d, d))
    for r in tiles.collect():
        i, j = r.ti * tile, r.tj * tile
        m = np.frombuffer(r.tile, float).reshape(min(tile, d - i), -1)
        out[i : i + m.shape[0], j : j + m.shape[1]] = m
    return np.triu(out) + np.triu(out, 1).T


def wide_sandwich(df: DataFrame, beta: np.ndarray, ridge: float = 1e-10) -> np.ndarray:
    """H^-1 G H^-1 at beta, from tiles; d x d numbers on the driver."""
    d, n = len(beta), df.count()
    inverse = np.linalg.inv(matrix(gram_tiles(df, d, curvature(beta)), d) / n + ridge * np.eye(d))
    return inverse @ (matrix(gram_tiles(df, d, squared_slope(beta)), d) / n) @ inverse
