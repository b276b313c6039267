"""Queries without a SQL twin against numpy on the collected rows."""

import math

import numpy as np
import pytest

from veilstat.operators import chunking, logistic, tree_resampling
from veilstat.operators.tree_resampling import Tree
from veilstat.plans import large, models, sqltext
from veilstat.plans import resampling as R
from veilstat.plans.registry import load_all

FOLDER = "/root/testdata/sf0.001"


def answers(spark, name):
    return load_all()[name][0](spark, FOLDER).toPandas()


def chunks_of(df, columns):
    """Rows of each chunk in the order of their slots."""
    rows = df.select("chunk", "slot", *columns).toPandas().sort_values(["chunk", "slot"])
    return {int(c): own[columns].to_numpy(float) for c, own in rows.groupby("chunk")}


def counts(chunk, b, n, runs, seed=sqltext.SEED):
    return np.stack([np.random.default_rng([seed, chunk, r, 1]).multinomial(n, np.full(b, 1 / b)) for r in range(runs)])


def trimmed(x):
    return np.sort(x)[len(x) // 10 : len(x) - len(x) // 10].mean()


@pytest.mark.parametrize(("name", "middle", "runs"), [("blb_weighted_mean", np.mean, 200), ("blb_weighted_median", np.median, 200), ("blb_plain_estimator", trimmed, 100)])
def test_weighted_bootstrap(spark, name, middle, runs):
    df, n = models.weighted_chunks(spark, FOLDER)
    got = answers(spark, name).set_index("chunk")
    for c, x in chunks_of(df, ["v"]).items():
        est = np.array([middle(np.repeat(x[:, 0], w)) for w in counts(c, len(x), n, runs)])
        assert got.m[c] == pytest.approx(est.mean()) and got.v[c] == pytest.approx((math.sqrt(n) * (middle(x[:, 0]) - est)).var(ddof=1))


def plain_fits(x, y, w):
    """Newton's method run by run, with the fit's ridge."""
    out = []
    for row in w:
        beta = np.zeros(x.shape[1])
        for _ in range(100):
            s = 1 / (1 + np.exp(y * (x @ beta)))
            h = x.T @ (x * (row * s * (1 - s))[:, None]) / row.sum() + logistic.NEWTON_RIDGE * np.eye(len(beta))
            step = np.linalg.solve(h, -(x.T @ (row * s * y)) / row.sum())
            beta = beta - step
            if np.linalg.norm(step) < 1e-9:
                break
        out.append(beta)
    return np.array(out)


def test_weighted_fits(spark):
    stats = models.logistic_stats(spark, FOLDER).toPandas()
    mean, ci = answers(spark, "blb_logreg_alldim").set_index(["chunk", "dim"]), answers(spark, "boot_ci_alldim").set_index(["chunk", "dim"])
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet").toPandas()
    n = len(customers)
    rows = spark.createDataFrame(customers.assign(id=customers.c_custkey, x0=customers.c_acctbal / 10000, x1=1.0, y=np.where(customers.c_mktsegment.isin(["BUILDING", "MACHINERY"]), 1.0, -1.0))[["id", "x0", "x1", "y"]])
    for c, x in chunks_of(chunking.chunk(rows, "id", n, n // sqltext.CHUNKS, sqltext.SEED, "all_dim"), ["x0", "x1", "y"]).items():
        est, theta = plain_fits(x[:, :2], x[:, 2], counts(c, len(x), n, 24, 0)), plain_fits(x[:, :2], x[:, 2], np.ones((1, len(x))))
        for d in range(2):
            stat = math.sqrt(n) * (theta[0, d] - est[:, d])
            own = stats[(stats.chunk == c) & (stats.dim == d)].sort_values("run")
            assert own.stat.to_numpy() == pytest.approx(stat, rel=1e-4, abs=1e-4)
            assert mean.m[c, d] == pytest.approx(est[:, d].mean(), rel=1e-5) and mean.v[c, d] == pytest.approx(stat.var(ddof=1), rel=1e-4)
            low, high = (np.quantile(stat, q, method="inverted_cdf") for q in (0.025, 0.975))
            assert (ci.l[c, d], ci.u[c, d]) == (pytest.approx(low, rel=1e-4, abs=1e-4), pytest.approx(high, rel=1e-4, abs=1e-4))


def tree_weights(tree, chunk, b):
    out = np.zeros((tree.runs, b), int)
    for leaf, count in tree_resampling.leaf_counts(tree, chunk, b, 0, -(-b // tree.leaf)):
        for at, w in tree_resampling.leaf_weights(tree, chunk, b, leaf, count):
            out[at : at + len(w), leaf * tree.leaf : leaf * tree.leaf + w.shape[1]] = w
    return out


def test_trees(spark):
    """All lines in two chunks: mean, median and logistic fits of every run, from the counts of all slots."""
    df, n = large.halves(spark, FOLDER)
    mean, median, fits = answers(spark, "tree_boot_mean").set_index(["chunk", "dim"]), answers(spark, "tree_boot_median").set_index("chunk"), answers(spark, "tree_boot_logreg").set_index(["chunk", "dim"])
    for c, x in chunks_of(df, ["q", "c", "one", "y"]).items():
        w = tree_weights(Tree(n, large.MEANS), c, len(x))
        assert (w.sum(1) == n).all() and w.shape[1] == n // 2
        for d in range(2):
            est = w @ x[:, d] / n
            assert mean.m[c, d] == pytest.approx(est.mean()) and mean.v[c, d] == pytest.approx((math.sqrt(n) * (x[:, d].mean() - est)).var(ddof=1))
        est = np.array([np.median(np.repeat(x[:, 0], row)) for row in w[: large.MEDIANS]])
        assert median.m[c] == pytest.approx(est.mean()) and median.v[c] == pytest.approx((math.sqrt(n) * (np.median(x[:, 0]) - est)).var(ddof=1))
        design = np.c_[x[:, 0] / 50, x[:, 1] / 10, x[:, 2]]
        est, theta = plain_fits(design, x[:, 3], w[: large.FITS]), plain_fits(design, x[:, 3], np.ones((1, len(x))))
        for d in range(3):
            assert fits.m[c, d] == pytest.approx(est[:, d].mean(), rel=1e-5, abs=1e-6) and fits.v[c, d] == pytest.approx((math.sqrt(n) * (theta[0, d] - est[:, d])).var(ddof=1), rel=1e-4)


def test_wide_fit_is_at_the_maximum(spark):
    got = answers(spark, "logreg_wide")
    assert len(got) == large.WIDE and got.slope.abs().max() < 1e-5


def test_projected_sgd(spark):
    got = answers(spark, "projected_sgd").sort_values("dim").value.to_numpy()
    rows = models.documents_rows(spark, FOLDER).orderBy("row_id").collect()
    n = len(rows)
    beta, total, rate, halve = np.zeros(2), np.zeros(2), 1 / math.sqrt(n), set(logistic.halvings(n))
    for i, r in enumerate(rows):
        x = np.array(r.x)
        beta = beta + rate * r.y * x / (1 + math.exp(r.y * (beta @ x)))
        beta = beta * min(1.0, 5.0 / np.linalg.norm(beta)) if np.linalg.norm(beta) > 0 else beta
        total += beta
        rate = rate / 2 if i in halve else rate
    assert got == pytest.approx(total / n)


def test_metropolis_draws_are_near_the_estimate(spark):
    """The released point costs at most what the density allows: its gradient is within the noise of the mechanism's scale."""
    got = answers(spark, "metropolis_logreg").sort_values("dim").value.to_numpy()
    rows = models.documents_rows(spark, FOLDER).collect()
    x, y = np.array([[*r.x, 1.0] for r in rows]), np.array([r.y for r in rows])
    slope = lambda b: np.linalg.norm(x.T @ (y / (1 + np.exp(y * (x @ b)))))
    best = plain_fits(x, y, np.ones((1, len(y))))[0]
    assert slope(best) < 1e-3 and slope(got) / 1.5 * 8 / 2 < 25  # cost eps / 2 ceil(n |grad| / bound), an exponential of a few
