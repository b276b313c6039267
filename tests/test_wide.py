"""Fits and Gram matrices of many features against numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilstat.operators import logistic, wide
from veilstat.plans import large


def dense(rows, d):
    x = np.zeros((len(rows), d))
    for k, r in enumerate(rows):
        for i, v in zip(r.idx, r.val, strict=True):
            x[k, i] += v
    return x, np.array([r.y for r in rows])


@pytest.fixture(scope="module")
def lines(spark):
    df = large.wide_lines(spark, "/root/testdata/sf0.001").repartition(5).cache()
    return df, *dense(df.collect(), large.WIDE)


def newton(x, y, ridge):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        s = 1 / (1 + np.exp(y * (x @ beta)))
        g, h = -(x.T @ (s * y)) / len(y), x.T @ (x * (s * (1 - s))[:, None]) / len(y) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        beta -= step
        if np.linalg.norm(step) < 1e-10:
            break
    return beta


def test_500_features_of_the_lines(lines):
    """With a ridge in the steps only, both stop at the likelihood's maximum; compared are the linear predictors, as indicators of one kind add up to one."""
    df, x, y = lines
    got, want = wide.wide_fit(df, large.WIDE, ridge=1e-3, tolerance=1e-7), newton(x, y, 1e-3)
    assert np.abs(x @ got - x @ want).max() < 1e-3
    assert np.abs(x.T @ (y / (1 + np.exp(y * (x @ got))))).max() / len(y) < 1e-6


def test_conjugate_steps_of_the_lines(lines, monkeypatch):
    """Without a Hessian: the same predictors, in a bounded number of passes."""
    df, x, y = lines
    passes, plain = [0], wide.pass_sums

    def counted(*a):
        passes[0] += 1
        return plain(*a)

    monkeypatch.setattr(wide, "pass_sums", counted)
    got = wide.wide_fit(df, large.WIDE, ridge=1e-2, tolerance=1e-2, held=0)
    assert np.abs(x @ got - x @ newton(x, y, 1e-2)).max() < 0.05 and passes[0] < 200, passes  # 144 when this was written


def test_tiles(lines, spark):
    df, x, y = lines
    beta = np.random.default_rng(1).normal(0, 0.3, large.WIDE)
    s = 1 / (1 + np.exp(y * (x @ beta)))
    for weight, w in ((None, np.ones(len(y))), (wide.curvature(beta), s * (1 - s)), (wide.squared_slope(beta), s * s)):
        for tile in (64, 256, 1000):
            got = wide.matrix(wide.gram_tiles(df, large.WIDE, weight, tile), large.WIDE, tile)
            assert np.allclose(got, x.T @ (x * w[:, None]))
    entries = wide.tile_entries(wide.gram_tiles(df, large.WIDE, None, 64), large.WIDE, 64).toPandas()
    full = np.triu(x.T @ x)
    assert len(entries) == (full != 0).sum() and all(full[i, j] == v for i, j, v in entries.itertuples(index=False))
    empty = df.filter("false")
    assert wide.gram_tiles(empty, 10).count() == 0 and (wide.matrix(wide.gram_tiles(empty, 10), 10) == 0).all() and (wide.wide_fit(empty, 3) == 0).all()


def test_narrow_designs_agree_with_the_plain_fit(spark):
    rng = np.random.default_rng(2)
    rows = [([0, 1, 2], [float(a), float(b), 1.0], float(rng.choice([-1, 1], p=[0.3, 0.7]))) for a, b in rng.normal(0, 1, (400, 2))]
    df = spark.createDataFrame(rows, "idx array<int>, val array<double>, y double").repartition(3)
    plain = df.select(F.col("val").alias("x"), "y")
    beta = wide.wide_fit(df, 3, tolerance=1e-9)
    for other in (logistic.fit(plain, 3, tolerance=1e-9), wide.wide_fit(df, 3, tolerance=1e-6, held=0)):
        assert np.allclose(beta, other, atol=1e-5)
    assert np.allclose(wide.wide_sandwich(df, beta), logistic.sandwich(plain, beta.tolist()), rtol=1e-6)


def test_conjugate_gradients():
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, (30, 30))
    h, g = a @ a.T + np.eye(30), rng.normal(0, 1, 30)
    assert np.allclose(wide.conjugate(lambda v: h @ v, g, np.diag(h), 1e-12, 500), np.linalg.solve(h, g)) and (wide.conjugate(lambda v: h @ v, np.zeros(30), np.diag(h), 0.1, 9) == 0).all()


def test_products_of_sparse_rows_go_pair_by_pair():
    """Rows without values, with one, with a value twice."""
    idx, val = [[0, 3], [], [2], [3, 3, 1]], [[1.0, 2.0], [], [-1.5], [1.0, 0.5, 2.0]]
    block = wide.Block(pa.RecordBatch.from_arrays([pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float64())), pa.array([1.0, -1.0, 1.0, 1.0])], names=["idx", "val", "y"]))
    x, w = block.dense(5), np.array([1.0, 2.0, 3.0, 0.5])
    assert np.allclose(block.square(5, w), x.T @ (x * w[:, None]))
