"""Exact top-k inner products by dual-tree search over cover trees.

Components become floor(256 * x), scores are integer inner products. The top of the data tree is shared: pivots, spread
out over a bounded sample, give each row the cell of its nearest one, and every cell gets its covering radius and, by
its rows, blocks of at most BLOCK_VALUES numbers (dealt by place in the input, so copies of a row or an id spread). A
query first searches one block of its own cell. The k-th score it finds there goes with it: it visits only the cells
whose bound <q, c> + r |q| reaches that score.

In a block the rows get a cover tree, once: a node's children cover its points within half its radius and lie further
apart than that from each other; what MAX_CHILDREN children leave uncovered is halved into leaves of the node, so
points far from each other do not make a node per point. The block's queries come after its rows, those of one cell
together, and get a tree for each QUERY_BATCH of them, with leaves of QUERY_LEAF. Node pairs are visited best bound
first and pruned when <cq, cd> + rq |cd| + rd |cq| + rq rd is below the worst k-th score of the query node. A last
ranking per query merges the blocks. Ties go to the smaller id at every step.

Vectors that are null or hold null or non-finite components take no part. Only vectors of equal dimension meet. An id
counts once as a candidate (with its best row if rows repeat) and once as a query; a query's own id is no candidate.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilstat.llm._spark import checkpointed, shared, small_batches
from veilstat.sources.tables import table

K, EVERY = 5, 50
SAMPLE, CELLS, CELL_ROWS = 4096, 64, 512
BLOCK_VALUES, BROADCAST_ROWS = 1 << 22, 100_000
LEAF, MAX_CHILDREN = 128, 24
QUERY_BATCH, QUERY_LEAF = 4096, 16


class Node:
    __slots__ = ("children", "center", "norm", "points", "radius", "worst")

    def __init__(self, center: np.ndarray, radius: float):
        self.center, self.radius, self.norm = center, radius, float(np.linalg.norm(center))
        self.children: list[Node] = []
        self.points: np.ndarray | None = None  # rows of a leaf
        self.worst = -np.inf


def cover_tree(x: np.ndarray, leaf: int = LEAF, width: int = MAX_CHILDREN) -> Node:
    """Cover tree of the rows of x; each node's radius is the largest distance from its centre to a point below it."""

    def build(center: int, rows: np.ndarray, far: np.ndarray) -> Node:
        node = Node(x[center], float(far.max(initial=0.0)))
        if len(rows) <= leaf or node.radius == 0:
            node.points = rows
            return node
        reach = node.radius / 2
        near = far <= reach
        parts, rest = ([(center, rows[near], far[near])] if near.any() else []), rows[~near]
        while len(rest) and len(parts) < width:
            d = np.sqrt(((x[rest] - x[rest[0]]) ** 2).sum(1))
            own = d <= reach
            parts.append((rest[0], rest[own], d[own]))
            rest = rest[~own]
        # Singletons are leaves like the uncovered rest; together they make few leaves instead of many.
        alone = [p[1] for p in parts if len(p[1]) < 4]
        node.children = [build(*p) for p in parts if len(p[1]) >= 4]
        loose = np.concatenate([*alone, rest]).astype(np.int64)
        if len(loose):
            node.children += halves(loose)
        return node

    def halves(rows: np.ndarray) -> list[Node]:
        """Leaves of rows that no child covers: cut between two far rows, at the widest gap near the middle."""
        d = np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(1))
        if len(rows) <= leaf:
            own = Node(x[rows[0]], float(d.max()))
            own.points = rows
            return [own]
        one = x[rows[d.argmax()]]
        far = np.sqrt(((x[rows] - one) ** 2).sum(1))
        side = far - np.sqrt(((x[rows] - x[rows[far.argmax()]]) ** 2).sum(1))
        order = np.argsort(side, kind="stable")
        low = max(1, len(rows) // 4)
        high = max(low + 1, len(rows) - low)
        cut = low + int(np.diff(side[order][low - 1 : high]).argmax())
        return halves(rows[order[:cut]]) + halves(rows[order[cut:]])

    rows = np.arange(len(x))
    return build(0, rows, np.sqrt(((x - x[0]) ** 2).sum(1)))


def products(q: np.ndarray, d: np.ndarray, wide: bool) -> np.ndarray:
    """Integer inner products; beyond the exact range of doubles by Python integers, saturated to 64 bits."""
    if not wide:
        return q @ d.T
    exact = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in d], object).T
    return np.clip(exact, -(2**63), 2**63 - 1)


class Search:
    """The k best of the data rows for every query row; `known`: for each query a score that k candidates elsewhere reach."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, known: np.ndarray | None = None, tree: Node | None = None):
        self.q, self.q_ids, self.d, self.d_ids, self.k, self.tree = q, q_ids, d, d_ids, k, tree
        self.top: list[list[tuple]] = [[] for _ in q_ids]  # (-score, id), best first
        self.kth = np.full(len(q_ids), -np.inf) if known is None else known.astype(float)
        peak = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(q.shape[1], 1)
        self.wide, self.slack = peak >= 2**53, 1e-3 + peak * 1e-9
        self.scored = 0  # pairs whose product was formed

    def run(self) -> None:
        root = cover_tree(self.q, QUERY_LEAF)
        self.mark(root)
        self.visit(root, [self.tree or cover_tree(self.d)])

    def mark(self, q: Node) -> None:
        """The worst k-th score known below each query node."""
        for c in q.children:
            self.mark(c)
        q.worst = min((c.worst for c in q.children), default=np.inf) if q.points is None else float(self.kth[q.points].min(initial=np.inf))

    def bounds(self, q: Node, data: list[Node]) -> np.ndarray:
        centers, radii, norms = np.array([n.center for n in data]), np.array([n.radius for n in data]), np.array([n.norm for n in data])
        return centers @ q.center + q.radius * norms + radii * q.norm + q.radius * radii + self.slack

    def visit(self, q: Node, data: list[Node]) -> None:
        """Meet every data node with a query node: split the data side down to leaves, then the query side."""
        bound = self.bounds(q, data)
        queue = sorted(zip(bound.tolist(), range(len(data)), data, strict=True), key=lambda t: (-t[0], t[1]))
        if q.points is None:
            # All children share what could not be pruned for the parent; split data nodes wider than the query node.
            opened = [c for b, _, n in queue if b >= q.worst for c in (n.children if n.points is None else [n])]
            for child in q.children:
                child.worst = max(child.worst, q.worst)
                self.visit(child, opened)
            q.worst = min((c.worst for c in q.children), default=np.inf)
            return
        while queue:
            b, _, node = queue.pop(0)
            if b < q.worst:
                break  # the rest have no better bound
            if node.points is not None:
                self.base(q, node)
                continue
            for inner, at in zip(self.bounds(q, node.children).tolist(), node.children, strict=True):
                if inner >= q.worst:
                    bisect.insort(queue, (inner, id(at), at), key=lambda t: (-t[0], t[1]))

    def base(self, q: Node, node: Node) -> None:
        scores = products(self.q[q.points], self.d[node.points], self.wide)
        self.scored += scores.size
        ids = self.d_ids[node.points]
        hit = scores >= self.kth[q.points][:, None]
        for i in np.flatnonzero(hit.any(1)):
            row = int(q.points[i])
            at = np.flatnonzero(hit[i])
            at = at[ids[at] != self.q_ids[row]]
            if len(at) > 4 * self.k:
                # The best row of each id, then ids at least as good as the k-th; ties at the k-th score stay in.
                at = at[np.argsort(-scores[i, at], kind="stable")]
                at = at[np.argsort(ids[at], kind="stable")]
                at = at[np.flatnonzero(np.append(True, ids[at][1:] != ids[at][:-1]))]
                if len(at) > self.k:
                    own = scores[i, at]
                    at = at[own >= np.sort(own)[len(at) - self.k]]
            found = [(-int(s), int(v)) for s, v in zip(scores[i, at].tolist(), ids[at].tolist(), strict=True)]
            best = sorted({*self.top[row], *found})
            seen: set[int] = set()
            self.top[row] = [t for t in best if not (t[1] in seen or seen.add(t[1]))][: self.k]
            if len(self.top[row]) == self.k:
                self.kth[row] = max(self.kth[row], -self.top[row][-1][0])
        q.worst = float(self.kth[q.points].min())


def quantized(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """floor(256 * x) of a column of equally long lists, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(256 * flat), -1e300, 1e300).reshape(len(column), -1)


def pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of x that lie far apart: each next one is the farthest from those before."""
    chosen, far = [0], np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
    return x[chosen]


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distance of every row from every centre."""
    return np.sqrt(np.stack([((x - c) ** 2).sum(1) for c in centers], 1))


def _dealt(centers):
    """(dim, cell, far, place) and the row: the nearest pivot, the distance from it, and a number that spreads the rows of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() * 7919
        for batch in batches:
            dim = batch.column(3).to_numpy()
            cell, far = np.full(len(dim), -1, np.int32), np.zeros(len(dim))
            for d in np.unique(dim):
                if int(d) in centers.value:
                    own = np.flatnonzero(dim == d)
                    apart = distances(quantized(batch.column(1).take(pa.array(own))), centers.value[int(d)])
                    cell[own], far[own] = apart.argmin(1), apart.min(1)
            place = np.arange(seen, seen + len(dim))
            seen += len(dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(place)], names=[*batch.schema.names, "cell", "far", "place"])

    return run


def _routed(cells):
    """(dim, cell, block) of every block that a query (dim, cell, block, id, v, kth) still has to visit, with the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, own, block, kth = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 5))
            for d in np.unique(dim):
                centers, radius, blocks = cells.value[int(d)]
                at = np.flatnonzero(dim == d)
                q = quantized(batch.column(4).take(pa.array(at)))
                bound = q @ centers.T + np.linalg.norm(q, axis=1)[:, None] * radius
                open_ = bound * (1 + 1e-9) + 1 >= kth[at][:, None]
                for c in np.flatnonzero(open_.any(0)):
                    asks = at[open_[:, c]]
                    for b in range(blocks[c]):
                        go = asks[(own[asks] != c) | (block[asks] != b)]
                        if len(go):
                            rows = batch.take(pa.array(go))
                            yield pa.RecordBatch.from_arrays(
                                [rows.column(0), pa.array(np.full(len(go), c, np.int32)), pa.array(np.full(len(go), b, np.int64)), *rows.columns[3:], rows.column(1)], names=["dim", "cell", "block", "id", "v", "kth", "home"]
                            )

    return run


class _Block:
    """The rows of a block, then its queries, batch by batch."""

    def __init__(self, k: int):
        self.k, self.parts, self.ids, self.tree = k, [], [], None
        self.asks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, x: np.ndarray, ids: np.ndarray, asks: bool, kth: np.ndarray) -> Iterator[tuple[int, int, int]]:
        if not asks:
            self.parts.append(x)
            self.ids.append(ids)
        elif self.parts:
            self.asks.append((x, ids, kth))
            self.waiting += len(ids)
            if self.waiting >= QUERY_BATCH:
                yield from self.answers()

    def answers(self) -> Iterator[tuple[int, int, int]]:
        """(query, row, score) of what has come so far."""
        if not self.waiting:
            return
        if self.tree is None:
            self.parts, self.ids = [np.concatenate(self.parts)], [np.concatenate(self.ids)]
            self.tree = cover_tree(self.parts[0])
        q, q_ids, known = (np.concatenate(c) for c in zip(*self.asks, strict=True))
        self.asks, self.waiting = [], 0
        run = Search(q, q_ids, self.parts[0], self.ids[0], self.k, known, self.tree)
        run.run()
        yield from ((int(i), v, -s) for i, top in zip(q_ids, run.top, strict=True) for s, v in top)


def _searched(k: int):
    """(query_id, vec_id, score) from rows (dim, cell, block, asks, home, id, v, kth) sorted by these; a block's queries come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, _Block(k)
        found: list[tuple[int, int, int]] = []

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])
            found.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(4)], 1)
            kth, ids = batch.column(7).to_numpy(zero_copy_only=False), batch.column(5).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                own = tuple(keys[lo, :3].tolist())
                if own != key:
                    found += held.answers()
                    key, held = own, _Block(k)
                found += held.add(quantized(batch.column(6).slice(lo, hi - lo)), ids[lo:hi], bool(keys[lo, 3]), kth[lo:hi])
            yield rows()
        found += held.answers()
        yield rows()

    return run


def search(rows: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for the queries sent to it."""
    names = ["dim", "cell", "block", "asks", "home", "id", "v", "kth"]
    data = rows.select("dim", "cell", "block", F.lit(0).alias("asks"), F.lit(0).alias("home"), "id", "v", F.lit(0.0).alias("kth"))
    both = data.union(asks.select("dim", "cell", "block", F.lit(1).alias("asks"), "home", "id", "v", "kth"))
    dealt = both.repartition("dim", "cell", "block").sortWithinPartitions(*names[:5])
    return dealt.mapInArrow(_searched(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block_values: int = BLOCK_VALUES, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every row where the column `is_query` holds."""
    spark = vectors.sparkSession
    small_batches(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks"), F.size(vector_col).alias("dim")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.col("dim") > 0) & F.forall("v", finite)
    )
    # The pivots come from a bounded sample; all rows are dealt, and radii and blocks count all of them.
    seen: dict[int, list] = {}
    drawn = usable.select("id", "v", "dim").orderBy(F.xxhash64("id", F.lit(23)), "id", "v").limit(SAMPLE).toArrow()
    for d in sorted(set(drawn["dim"].to_pylist())):
        x = quantized(drawn.filter(pc.equal(drawn["dim"], d))["v"])
        seen[d] = pivots(x, max(1, min(cells, len(x) * cells // SAMPLE if drawn.num_rows == SAMPLE else len(x) // CELL_ROWS)))
    kind = usable.schema["v"].dataType.simpleString()
    dealt = checkpointed(usable.mapInArrow(_dealt(shared(spark, seen)), f"id long, v {kind}, asks boolean, dim int, cell int, far double, place long"))
    blocks = F.ceil(F.count("*") * F.col("dim") / F.lit(block_values)).cast("long")
    sizes = checkpointed(dealt.groupBy("dim", "cell").agg(blocks.alias("blocks"), F.max("far").alias("radius")))
    # A row a cell: broadcast under a checked size, so that a cell with most rows is not dealt to one task.
    small = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    rows = dealt.join(small.select("dim", "cell", "blocks"), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("place"), "blocks"))
    asks = rows.filter("asks").groupBy("dim", "cell", "id", "v").agg(F.min("block").alias("block"))
    first = checkpointed(search(rows, asks.withColumn("home", F.col("cell")).withColumn("kth", F.lit(float("-inf"))), k))
    # The k-th of the own block is a bound for a query's row; an id with several vectors takes the bounds of all for each.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    reached = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    known = asks.join(reached, "id", "left").select("dim", "cell", "block", "id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    # At most CELLS cells a dimension of the sample come to the driver.
    found = {d: (c, np.full(len(c), -np.inf), np.zeros(len(c), int)) for d, c in seen.items()}
    for r in sizes.filter("cell >= 0").collect():
        found[r["dim"]][1][r["cell"]], found[r["dim"]][2][r["cell"]] = r["radius"], r["blocks"]
    route = f"dim int, cell int, block long, id long, v {kind}, kth double, home int"
    further = known.filter("cell >= 0").mapInArrow(_routed(shared(spark, found)), route)
    # Vectors of a dimension that the sample lacks: one cell, all blocks.
    other = known.filter("cell < 0").join(small.select("dim", "cell", "blocks"), ["dim", "cell"]).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("o <> block")
    second = search(rows, further.unionByName(other.select("dim", "cell", F.col("o").alias("block"), "id", "v", "kth", F.col("cell").alias("home"))), k)
    best = first.union(second).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all rows for every row whose id divides by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False)))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % {EVERY} = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= {K}
"""
