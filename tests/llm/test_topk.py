import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstat.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, every, k):
    out = []
    kept = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            kept.setdefault(i, []).append(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int))
    for q in kept:
        if q % every:
            continue
        best = []
        for d, vs in kept.items():
            if d != q:
                s = [int(a @ b) for a in kept[q] for b in vs if len(a) == len(b)]
                if s:
                    best.append((-max(s), d))
        out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(best)[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1 << 22, 64), (256, 3)])
def test_like_brute_force(spark, blocks, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", 20)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 8))
    x = [(i, [float(v) for v in centers[i % 6] + 0.1 * rng.normal(size=8)], "s") for i in range(500)]
    x += [(1000 + i, x[3][1], "s") for i in range(120)]  # many copies: ties
    x += [(3, x[3][1], "s"), (2001, None, "s"), (2002, [1.0, None], "s"), (2003, [float("nan")] * 8, "s"), (2004, [float("inf")] * 8, "s"), (2010, [1.0, 2.0], "s"), (2011, [2.0, 1.0], "s"), (None, [1.0] * 8, "s"), (2020, [], "s")]
    df = spark.createDataFrame(x, SCHEMA).repartition(3)
    got = topk.top_k(df, F.coalesce(F.col("vec_id") % 10 == 0, F.lit(False)), block_values=blocks[0], cells=blocks[1])
    assert sorted(tuple(r) for r in got.collect()) == brute(x, 10, 5)


@pytest.mark.parametrize("times", [2, 7])
def test_every_row_repeated(spark, times):
    rng = np.random.default_rng(3)
    x = [(i, [float(v) for v in rng.normal(size=6)], "s") for i in range(300)]  # leaves with far more than 4k hits
    rows = [r for r in x for _ in range(times)] + [(i, [float(v) for v in rng.normal(size=6)], "s") for i in range(0, 300, 3)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.coalesce(F.col("vec_id") % 10 == 0, F.lit(False)))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 5)


def test_empty_and_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none, F.col("vec_id") % 10 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], ""), (1, [0.5, 0.5], "")], SCHEMA)
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 10 == 0).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]


def test_large_values():
    q = np.array([[2.0**40, -(2.0**41)]])
    assert topk.products(q, q, True)[0, 0] == 2**63 - 1
    assert topk.products(q, -q, True)[0, 0] == -(2**63)


def test_repeated_rows_beyond_doubles():
    rng = np.random.default_rng(4)
    d = rng.integers(-(2**30), 2**30, (60, 2)).astype(float)
    run = topk.Search(d[:1], np.array([0]), np.repeat(d, 2, 0), np.repeat(np.arange(60), 2), 5)
    run.run()
    exact = sorted((-sum(int(a) * int(b) for a, b in zip(d[0], v, strict=True)), i) for i, v in enumerate(d) if i)
    assert run.wide and run.top[0] == exact[:5]


def test_tree_covers():
    x = np.random.default_rng(2).normal(size=(3000, 3))
    x[:500] = x[0]
    seen = []

    def walk(n):
        points = n.points if n.points is not None else np.concatenate([walk(c) for c in n.children])
        assert np.sqrt(((x[points] - n.center) ** 2).sum(1)).max() <= n.radius + 1e-9
        if n.points is not None:
            seen.extend(points.tolist())
        return points

    walk(topk.cover_tree(x, leaf=16, width=5))
    assert sorted(seen) == list(range(3000))


def test_share_of_pairs_scored():
    """Clusters are pruned; vectors spread evenly over many dimensions cannot be."""
    rng = np.random.default_rng(6)

    def share(x):
        run = topk.Search(x[::5], np.arange(0, len(x), 5), x, np.arange(len(x)), 5)
        run.run()
        exact = np.argsort(-(x[::5] @ x.T), axis=1, kind="stable")
        assert [[v for _, v in t] for t in run.top] == [[int(v) for v in row if v != i][:5] for i, row in zip(range(0, len(x), 5), exact, strict=True)]
        return run.scored / (len(x[::5]) * len(x))

    centers = rng.normal(size=(40, 16))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    tight = np.floor(256 * (centers[rng.integers(0, 40, 6000)] + 0.02 * rng.normal(size=(6000, 16))))
    flat = rng.normal(size=(2000, 64))
    assert share(tight) < 0.15
    assert share(np.floor(256 * rng.normal(size=(6000, 2)))) < 0.2
    assert share(np.floor(256 * flat / np.linalg.norm(flat, axis=1)[:, None])) > 0.9


def test_cells_are_pruned(spark, monkeypatch):
    """The k-th score of the own block keeps queries out of cells that cannot hold better rows."""
    monkeypatch.setattr(topk, "CELL_ROWS", 20)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 8))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    x = [(i, [float(v) for v in centers[i % 12] + 0.01 * rng.normal(size=8)], "s") for i in range(1200)]
    df = spark.createDataFrame(x, SCHEMA).repartition(4)
    sent = []
    whole = topk.search
    monkeypatch.setattr(topk, "search", lambda rows, asks, k: sent.append(asks.count()) or whole(rows, asks, k))
    got = topk.top_k(df, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(x, 10, 5)
    assert sent[0] == 120 and sent[1] < 120 * 59 / 5  # 60 cells


def share(x, q, leaf):
    ids = np.arange(len(x))
    s = topk.Search(x[q], ids[q], x, ids, 5, tree=topk.cover_tree(x, leaf))
    s.run()
    return s.scored / (q.sum() * len(x))


def test_what_the_bounds_prune(spark):
    """Tight clusters in few dimensions let node pairs go; the given vectors, which have none, let nothing go (README)."""
    rng = np.random.default_rng(0)
    clusters = np.floor(256 * (rng.normal(0, 1, (40, 3))[rng.integers(0, 40, 4000)] + 0.01 * rng.normal(0, 1, (4000, 3))))
    assert share(clusters, np.arange(4000) % 50 == 0, 16) < 0.6  # 0.51 when this was written
    given = np.floor(256 * np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()], float))
    assert share(given, np.arange(len(given)) % 50 == 0, 16) > 0.9


def test_leaves_of_any_size():
    x = np.random.default_rng(1).normal(0, 1, (200, 8))
    for leaf in (1, 2, 3, 7):
        found: list[int] = []

        def walk(node, found=found):
            found += node.points.tolist() if node.points is not None else []
            for c in node.children:
                walk(c)

        walk(topk.cover_tree(x, leaf))
        assert sorted(found) == list(range(200))
