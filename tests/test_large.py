"""Operators whose groups are larger than a task, against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilstat.operators import histograms, intervals, logistic, mechanisms, ranges, selection, tree_resampling
from veilstat.operators.histograms import Bins
from veilstat.operators.tree_resampling import Tree

SIZES = (500, 200)
TREE = Tree(700, 60, 0, 64, 2)


def weights(tree, chunk, b):
    """All counts of a chunk, by leaves in one go."""
    out = np.zeros((tree.runs, b), int)
    for leaf, count in tree_resampling.leaf_counts(tree, chunk, b, 0, -(-b // tree.leaf)):
        for at, w in tree_resampling.leaf_weights(tree, chunk, b, leaf, count):
            out[at : at + len(w), leaf * tree.leaf : leaf * tree.leaf + w.shape[1]] = w
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = [rng.normal(3, 2, b).round(1) for b in SIZES]
    y = [np.where(rng.random(b) < 0.6, 1.0, -1.0) for b in SIZES]
    frame = pd.concat([pd.DataFrame({"chunk": np.int32(c), "slot": np.arange(b), "x": x[c], "one": 1.0, "y": y[c]}) for c, b in enumerate(SIZES)])
    return spark.createDataFrame(frame).repartition(3).cache(), x, y


def test_tree_weights_are_multinomial():
    """Counts add up to n; means, variances and covariances of slots in one leaf, in one block and in different blocks are the multinomial's."""
    for n in (700, 20_000):  # draw by draw, and slot by slot
        tree = Tree(n, 4000, 5, 16, 2)
        w = weights(tree, 0, 70)
        assert (w.sum(1) == n).all()
        p = 1 / 70
        assert np.abs(w.mean(0) - n * p).max() < 5 * math.sqrt(n * p / 4000)
        assert np.abs(w.var(0) / (n * p * (1 - p)) - 1).max() < 0.15
        for a, b in ((0, 1), (3, 20), (5, 60), (68, 69)):
            assert abs(np.cov(w[:, a], w[:, b])[0, 1] + n * p * p) < 5 * n * p / math.sqrt(4000)


def test_a_run_depends_on_its_number_alone():
    whole = weights(TREE, 0, 500)
    assert (weights(Tree(700, 20, 0, 64, 2), 0, 500) == whole[:20]).all() and (weights(Tree(700, 60, 0, 64, 9), 0, 500) == whole).all()
    some = dict(tree_resampling.leaf_counts(TREE, 0, 500, 3, 5))
    assert set(some) == {3, 4} and (some[3] == whole[:, 192:256].sum(1)).all()


def test_tree_means(rows):
    df, x, y = rows
    for r in tree_resampling.tree_means(df, ["x", "y"], TREE).collect():
        v, w = (x, y)[r.dim][r.chunk], weights(TREE, r.chunk, SIZES[r.chunk])[r.run]
        assert r.weight == 700 and r.est == pytest.approx(w @ v / 700) and r.sd == pytest.approx(np.repeat(v, w).std(ddof=1))
        assert r.stat == pytest.approx(math.sqrt(700) * (v.mean() - r.est), abs=1e-9)


@pytest.mark.parametrize("n", [700, 701])
def test_tree_medians(rows, n):
    df, x, _ = rows
    tree = Tree(n, 20, 0, 64, 2)
    got = tree_resampling.tree_medians(df, "x", tree).collect()
    assert len(got) == 40
    for r in got:
        assert r.est == np.median(np.repeat(x[r.chunk], weights(tree, r.chunk, SIZES[r.chunk])[r.run]))
        assert r.stat == pytest.approx(math.sqrt(n) * (np.median(x[r.chunk]) - r.est), abs=1e-9)


def test_tree_logistic(rows):
    df, x, y = rows
    got = tree_resampling.tree_logistic(df, ["x", "one"], "y", TREE).toPandas()
    for c, b in enumerate(SIZES):
        design, w = np.c_[x[c], np.ones(b)], weights(TREE, c, b).astype(float)
        want, theta = logistic.weighted_newton(design, y[c], w, np.zeros(2)), logistic.weighted_newton(design, y[c], np.ones((1, b)), np.zeros(2))
        own = got[got.chunk == c].pivot(index="run", columns="dim", values=["est", "stat"]).to_numpy()
        assert np.allclose(own[:, :2], want, atol=1e-6) and np.allclose(own[:, 2:], math.sqrt(700) * (theta - want), atol=1e-4)


def test_ordered_bits():
    x = np.array([-np.inf, -1e300, -1.0, -1e-300, -0.0, 0.0, 1e-300, 1.0, 1e300, np.inf])
    assert (np.diff(tree_resampling.ordered_bits(x).astype(object)) >= 0).all() and (np.diff(selection.signed_bits(x).astype(object)) >= 0).all()
    assert (tree_resampling.from_bits(tree_resampling.ordered_bits(x)) == x).all()
    assert selection.signed_bits(np.array([np.nan, -np.nan]))[0] > selection.signed_bits(np.array([np.inf]))[0]


@pytest.fixture(scope="module")
def values(spark):
    """Numbers over all magnitudes, one value in a third of the rows, nulls, a group of nulls only."""
    rng = np.random.default_rng(1)
    v = np.r_[rng.normal(0, 1e6, 900), np.full(900, 7.0), -np.abs(rng.normal(0, 1e-200, 300)), [0.0, -0.0, np.inf, -np.inf]]
    g = rng.integers(0, 3, len(v))
    g[:900] = 0
    pairs = [(int(a), float(b)) for a, b in zip(g, v, strict=True)] + [(0, None), (9, None)]
    return spark.createDataFrame(pairs, "g int, v double").cache(), g, v


@pytest.mark.parametrize("most", [1 << 16, 100, 5])
def test_selection(values, most):
    df, g, v = values
    shares = {"a": 0.025, "b": 0.5, "c": 0.999, "z": 0.0}
    got = {r.g: r for r in selection.quantiles(df, "v", ["g"], shares, most).collect()}
    assert set(got) == {0, 1, 2, 9} and tuple(got[9])[1:] == (None,) * 4
    for k in range(3):
        own = np.sort(v[g == k])
        assert [got[k][s] for s in shares] == [own[max(1, math.ceil(p * len(own))) - 1] for p in shares.values()]
    medians = {r.g: r.value for r in selection.medians(df, "v", ["g"], most).collect()}
    assert medians[9] is None and all(medians[k] == np.median(v[g == k]) for k in range(3))
    assert selection.medians(df, "v", [], most).first()[0] == np.median(v)
    assert selection.quantiles(df.filter("false"), "v", [], {"a": 0.5}).first()[0] is None and selection.medians(df.filter("false"), "v", ["g"]).count() == 0


def test_ordered_values(spark, values):
    """Ranks by ranges, though one value is most rows: it is one row."""
    df, g, v = values
    spread = spark.range(20_000).select(F.lit(0).alias("g"), F.lit(7.0).alias("v")).union(df.filter("v is not null"))
    got = ranges.ordered(spread, "v", ["g"]).collect()
    for k in range(3):
        own = np.sort(np.r_[v[g == k] + 0.0, np.full(20_000, 7.0) if k == 0 else []])
        distinct, first, count = np.unique(own, return_index=True, return_counts=True)
        mine = sorted((r for r in got if r.g == k), key=lambda r: r.v)
        assert [(r.v, r._before, r._ct, r._next, r._n) for r in mine] == [(a, i, c, b, len(own)) for a, i, c, b in zip(distinct, first, count, [*distinct[1:], None], strict=True)]


@pytest.mark.parametrize(("n", "rho"), [(40, 0.0), (41, 0.0), (40, 0.3), (41, 0.3), (1, 0.3), (2, 0.3)])
def test_private_median_over_runs_of_equal_values(spark, n, rho):
    """The gaps of distinct values are those of the sorted rows, whatever the rows' order."""
    rng = np.random.default_rng(n)
    x = np.sort(rng.choice([1.0, 2.0, 2.5, 4.0], n))
    half, low, high = n // 2, 0.0, 5.0
    moved = np.clip(np.where(np.arange(n) < half, x - rho, np.where(np.arange(n) >= n - half, x + rho, x)), low, high) if rho else x
    edges = np.r_[low, moved, high]
    from veilstat.functions.keyed import uniform_py
    from veilstat.operators.trial import rank_distance

    gaps = [(math.log(b - a) - 0.5 * f - math.log(-math.log(uniform_py("median-gap", 3, i))), a, b) for i, (a, b, f) in enumerate(zip(edges[:-1], edges[1:], rank_distance(np.arange(n + 1), n), strict=True)) if b > a]
    _, a, b = max(gaps)
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(x)] + [(None,)], "x double")
    assert mechanisms.private_median(df, "x", low, high, 1.0, [], rho, 3).first()["value"] == pytest.approx(a + uniform_py("median-point", 3) * (b - a))


def test_within_sets(spark, values):
    df, g, v = values
    rng = np.random.default_rng(4)
    ends = [(i, float(a), float(a + w)) for i, (a, w) in enumerate(zip(rng.choice(v[np.isfinite(v)], 60), rng.exponential(1e6, 60), strict=True))] + [(60, 7.0, 7.0), (61, 8.0, 6.0), (62, -math.inf, math.inf), (63, 0.0, 0.0)]
    got = {(r.g, r.set): (r.ct, r.total) for r in ranges.within_sets(df, "v", spark.createDataFrame(ends, "set long, low double, high double"), ["g"]).collect()}
    assert len(got) == 4 * len(ends)
    for k, total in ((0, int((g == 0).sum()) + 1), (1, int((g == 1).sum())), (2, int((g == 2).sum())), (9, 1)):
        for i, low, high in ends:
            assert got[k, i] == (int(((v >= low) & (v <= high) & (g == k)).sum()), total)
    whole = ranges.within_sets(df, "v", spark.createDataFrame([(1, 7.0, 7.0)], "set long, low double, high double"), []).first()
    assert (whole.ct, whole.total) == (int((v == 7).sum()), len(v) + 2)


def short_by_scan(ct, total, alpha):
    """(shortest, middle) by scanning all pairs as the method has it."""
    m, need = len(ct), 1 - alpha
    cum = np.cumsum(ct)
    mass = lambda i, j: (cum[j] - cum[i] + ct[i]) / total
    found, before = [], (0, m - 1, 1.0)
    for i in range(m):
        for j in range(m - 1, i, -1):
            cov, (pi, pj, pcov) = mass(i, j), before
            if cov < need <= pcov and (cum[pj] - cum[pi]) / total < need:
                found.append((pj - pi, len(found), pi, pj))
            before = (i, j, cov)
    found.sort()
    return [found[0][2:], found[len(found) // 2][2:]] if found else []


@pytest.mark.parametrize("seed", range(6))
def test_short_sets(spark, seed, monkeypatch):
    monkeypatch.setattr(histograms, "BLOCK", 5)
    rng = np.random.default_rng(seed)
    m = int(rng.integers(9, 40))
    bins = Bins(0.0, float(m), m)
    ct = rng.integers(0, 9, m) if seed else np.r_[0, 50, 50, np.zeros(m - 3, int)]
    total, alpha = int(ct.sum()) + (seed % 3), (0.1, 0.3, 0.02)[seed % 3]
    hist = spark.createDataFrame([(i, int(c)) for i, c in enumerate(ct) if c], "bin int, ct long")
    got = {r.kind: (r.l, r.u) for r in intervals.short_sets(hist, bins, total, alpha).collect()}
    want = short_by_scan(ct, total, alpha)
    assert got == ({"shortest": (want[0][0], want[0][1] + 1.0), "middle": (want[1][0], want[1][1] + 1.0)} if want else {})


@pytest.mark.parametrize("kind", ["symm", "short", "low", "up"])
def test_search_stops(spark, kind, monkeypatch):
    """The first accepted candidate is the same however candidates are dealt to ranges, and at most twice as many are scored."""
    rng = np.random.default_rng(3)
    stats = spark.createDataFrame([(c, float(v)) for c in range(9) for v in rng.normal(0, 3, 60)], "chunk int, stat double").cache()
    bins = Bins(-8.0, 8.0, 24)
    hist = histograms.flat(stats, "stat", bins, ["chunk"]).cache()
    scored = []
    plain = intervals.candidates

    def counted(spark, kind, m, least=0, lo=0, hi=None):
        out = plain(spark, kind, m, least, lo, hi)
        scored.append(hi - lo)
        assert out.count() == hi - lo
        return out

    monkeypatch.setattr(intervals, "candidates", counted)
    rows = []
    for first in (1, 3, 4096):
        scored.clear()
        rows.append(intervals.search(stats, hist, bins, 60, 0.3, 30.0, kind, seed=2, first=first).first())
        if first < 4096:
            assert rows[0].ord is not None and sum(scored) <= max(first, 2 * (rows[0].ord + 1))
    assert rows[0] == rows[1] == rows[2]


@pytest.mark.parametrize(("m", "least"), [(7, 0), (12, 3), (5, 5)])
def test_candidates_by_number(spark, m, least):
    for kind in ("symm", "short", "low", "up"):
        own = least if kind in ("symm", "short") else 0
        start, stop = intervals.numbers(kind, m, own)
        whole = sorted(intervals.candidates(spark, kind, m, own).collect())
        assert [r.ord for r in whole] == list(range(start, stop))
        got = [r for lo, hi in intervals.frontier(start, stop, 2) for r in sorted(intervals.candidates(spark, kind, m, own, lo, hi).collect())]
        assert got == whole


def test_search_of_dimensions_stops(spark):
    rng = np.random.default_rng(5)
    stats = spark.createDataFrame([(c, d, float(v)) for c in range(9) for d in range(2) for v in rng.normal(0, 1 + d, 60)], "chunk int, dim int, stat double").cache()
    bins = {0: Bins(-8.0, 8.0, 16), 1: Bins(-0.1, 0.1, 8)}  # nothing is accepted in the second
    for tree in (False, True):
        few, all_ = (intervals.search_dims(stats, bins, 60, 0.3, 30.0, "short", {0: 2}, seed=2, tree=tree, first=n).orderBy("dim").collect() for n in (2, 4096))
        assert few == all_ and few[0].ord is not None and few[1].ord is None and (few[1].l, few[1].u) == (-0.1, 0.1)


def test_rounds_move_no_rows(rows, spark):
    """The blocks are written once: neither the chunks' window nor a row's exchange is part of a later round."""
    df = rows[0]
    held = tree_resampling.packed(df, ["x"], TREE)
    state = tree_resampling.all_runs(held, TREE.runs).withColumn("state", F.array().cast("array<double>"))
    plan = tree_resampling.block_sums(held, 1, TREE, lambda x, w, *_: (np.arange(len(w)), np.zeros(len(w), int), w.sum(1)), state)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "CoGroup" not in plan
    assert sorted(r.x for r in tree_resampling.unpacked(held, ["x"]).collect()) == sorted(r.x for r in df.collect())


def test_ranges_grow_in_number_with_the_rows(spark):
    """No task gets a larger share when there are more rows, and the few totals are not joined to the answers."""
    assert ranges.ranges_of(spark.range(5000), rows=100) == 50 and ranges.ranges_of(spark.range(10)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 101).cast("double").alias("x"))
    assert ranges.running(df.withColumn("v", F.lit(1)), ["g"], ["x"], "v", "before", 40).select("_part").distinct().count() > 10
    sets = spark.range(200).select(F.col("id").alias("set"), (F.col("id") % 50).alias("low"), (F.col("id") % 50 + 20).alias("high"))
    out = ranges.within_sets(df, "x", sets, ["g"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and out.count() == 600
    assert out.filter("g = 1 and set = 7").first().ct == df.filter("g = 1 and x between 7 and 27").count()
