"""Deterministic limits, laws and odd inputs of the statistical operators."""

import math
import statistics
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstat.functions import keyed, special
from veilstat.operators import chunking, experiment, histograms, intervals, logistic, mechanisms, private_logistic, resampling, survey, variance, zcdp
from veilstat.operators.histograms import Bins
from veilstat.operators.ledger import Ledger, split, study_ledger
from veilstat.sources import distributions, files


def numbers(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, x double")


def test_special_functions():
    assert special.student_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert special.student_quantile(0.025, 3) == pytest.approx(-3.182446305284263, abs=1e-9)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert special.gamma_regularized(3, 2.5) == pytest.approx(1 - math.exp(-2.5) * (1 + 2.5 + 2.5**2 / 2))
    assert special.gamma_regularized(2, 9) == pytest.approx(1 - math.exp(-9) * 10)
    m = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert np.allclose(special.symmetric_root(m) @ special.symmetric_root(m), m)


def test_keyed_numbers_agree(spark):
    rows = spark.range(50).select("id", keyed.uniform("p", 3, F.col("id")).alias("u"), keyed.laplace(2.0, "p", 3, F.col("id")).alias("l"), keyed.normal("p", 3, F.col("id")).alias("z")).collect()
    for r in rows:
        assert r.u == keyed.uniform_py("p", 3, r.id)
        assert r.l == pytest.approx(keyed.laplace_py(2.0, "p", 3, r.id), rel=1e-12)
        assert r.z == pytest.approx(keyed.normal_py("p", 3, r.id), rel=1e-9)


def test_noise_moments(spark):
    row = spark.range(200_000).agg(F.avg(keyed.laplace(2.0, "m", F.col("id"))), F.var_samp(keyed.laplace(2.0, "m", F.col("id"))), F.avg(keyed.gumbel("m", F.col("id"))), F.avg(keyed.gamma_int(3, "m", F.col("id")))).first()
    assert abs(row[0]) < 0.05 and row[1] == pytest.approx(8, rel=0.05) and row[2] == pytest.approx(0.5772, abs=0.02) and row[3] == pytest.approx(3, abs=0.03)


@pytest.mark.parametrize("name", sorted(distributions.STUDY))
def test_distributions(spark, name):
    dist = distributions.study_distribution(name)
    df = dist.sample(spark, 20_000, 3)
    r = df.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.median("x").alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    assert r.m == pytest.approx(dist.mean, abs=5 * dist.std / 140) and r.s == pytest.approx(dist.std, rel=0.04) and r.d == pytest.approx(dist.median, abs=6 * dist.median_std / 141)
    assert dist.bounds[0] <= r.lo and r.hi <= dist.bounds[1]


def test_other_distributions(spark):
    for dist in (distributions.Weibull(1.5), distributions.ChiSquare(4), distributions.SkewNormal(3), distributions.GaussMixture(4, 0.5, 0.3), distributions.Pareto(5)):
        r = dist.sample(spark, 20_000, 1).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.median("x").alias("d")).first()
        assert r.m == pytest.approx(dist.mean, abs=6 * r.s / 141)
        if not math.isnan(dist.median):
            assert r.d == pytest.approx(dist.median, abs=0.1)
    with pytest.raises(ValueError):
        distributions.study_distribution("uniform")


@pytest.mark.parametrize(("n", "b", "rule", "s"), [(500, 38, "one_dim", 14), (500, 38, "all_dim", 13), (500, 38, "drop", 13), (100, 25, "one_dim", 4), (101, 25, "one_dim", 4), (102, 25, "one_dim", 5)])
def test_chunks_partition_the_rows(spark, n, b, rule, s):
    assert chunking.chunk_count(n, b, rule) == s
    rows = chunking.chunk(numbers(spark, range(n)), "id", n, b, 1, rule).collect()
    assert len({r.id for r in rows}) == len(rows) == (s * b if rule == "drop" else n)
    for c in range(s):
        assert sorted(r.slot for r in rows if r.chunk == c) == list(range(sum(r.chunk == c for r in rows)))


def test_permutation_rank_is_a_rank(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    rows = chunking.permutation_rank(df, "k", 4).collect()
    assert sorted(r.pos for r in rows) == list(range(20_000))


def test_private_median_limits(spark):
    for values in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [3, 3, 3, 3], [0, 10]):
        df = numbers(spark, values).withColumn("g", F.lit("a"))
        got = mechanisms.private_median(df, "x", 0.0, 10.0, 1e6, ["g"], seed=1).first().value
        s = sorted(values)
        around = [v for v in (s[(len(s) - 1) // 2 - (len(s) % 2)] if len(s) > 1 else 0, s[len(s) // 2])]
        assert min([0, *around]) <= got <= 10 if len(set(values)) == 1 else s[0] <= got <= s[-1]


def test_order_statistic_limits(spark):
    df = numbers(spark, range(1, 12)).withColumn("g", F.lit(0))
    assert mechanisms.noisy_order_statistic(df, "x", ["g"], math.inf, 1.0, 99.0).first().value == 6
    assert mechanisms.noisy_order_statistic(df, "x", ["g"], 1e9, 1e9, 99.0).first().value == 5  # trunc(5.5)
    wild = [mechanisms.noisy_order_statistic(df, "x", ["g"], 1e-6, 1e-6, 99.0, seed=i).first().value for i in range(6)]
    assert set(wild) <= {0.0, 99.0}


def test_infinite_budget_means_no_noise(spark):
    df = numbers(spark, [1, 2, 6]).withColumn("g", F.lit(0))
    assert mechanisms.private_mean(df, "x", 0, 10, math.inf, ["g"]).first().value == 3


def test_histograms_agree(spark):
    rng = np.random.default_rng(1)
    df = numbers(spark, [*rng.normal(0, 3, 2000), -8.0, 8.0, 7.999, float("nan"), 100.0]).withColumn("chunk", F.col("id") % 3)
    for count in (16, 12, 13):
        bins = Bins(-8.0, 8.0, count)
        cand = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in range(count) for b in range(a, count))]
        cand = spark.createDataFrame(cand, "ord long, first int, last int")
        groups = df.select("chunk").distinct()
        one = intervals.coverages(df, histograms.flat(df, "x", bins, ["chunk"]), cand, bins, 10, [])
        two = intervals.dyadic_coverages(histograms.dyadic(df, "x", bins, ["chunk"]), groups, cand, bins, 10)
        assert one.exceptAll(two.select(one.columns)).count() == 0 and one.count() == two.count()
    inside = histograms.flat(df, "x", Bins(-8.0, 8.0, 16), []).agg(F.sum("ct")).first()[0]
    assert inside == df.filter("x >= -8 and x < 8").count()  # the upper bound itself is out


def test_bins():
    assert Bins.of_precision(-5, 5, 0.3, True).count == 64
    assert Bins.of_precision(0, 1, 0.1).count == 10


@pytest.mark.parametrize("m", [8, 9])
def test_candidate_orders(spark, m):
    short = [(r["first"], r["last"]) for r in intervals.candidates(spark, "short", m).orderBy("ord").collect()]
    want = []
    for w in range(m):
        ends = list(range(w, m))
        q, odd = divmod(len(ends), 2)
        order = [ends[q]] + [e for i in range(1, q + 1) for e in (ends[q - i], ends[q + i])] if odd else [e for i in range(q) for e in (ends[q - i], ends[q + i])]
        want += [(e - w, e) for e in order]
    assert short == want
    symm = [(r["first"], r["last"]) for r in intervals.candidates(spark, "symm", m).orderBy("ord").collect()]
    q, odd = divmod(m, 2)
    assert symm == [((q if odd else q - 1) - i, q + i) for i in range(q if odd else q - 1)]
    with pytest.raises(ValueError):
        intervals.candidates(spark, "wide", m)


def test_weighted_and_drawn_resamples_have_one_law(spark):
    df = numbers(spark, np.random.default_rng(2).normal(0, 2, 60))
    chunked = chunking.chunk(df, "id", 60, 20, 1)
    drawn = resampling.boot_stats(chunked, "x", 60, 400, 1).groupBy("chunk").agg(F.var_samp("stat").alias("v"), F.avg("stat").alias("m"))
    weighted = resampling.weighted_stats(chunked, ["x"], 60, 400, seed=1).groupBy("chunk").agg(F.var_samp("stat").alias("w"), F.avg("stat").alias("k"))
    for r in drawn.join(weighted, "chunk").collect():
        assert r.v == pytest.approx(r.w, rel=0.35) and abs(r.m) < 0.6 and abs(r.k) < 0.6


def test_weighted_median_is_the_median_of_the_copies():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (12, 1)).astype(float)
    w = rng.multinomial(31, np.full(12, 1 / 12), size=20).astype(float)
    got = resampling.weighted_median(x, w)[:, 0]
    assert got.tolist() == [statistics.median(np.repeat(x[:, 0], row.astype(int)).tolist()) for row in w]
    even = rng.multinomial(30, np.full(12, 1 / 12), size=20).astype(float)
    assert resampling.weighted_median(x, even)[:, 0].tolist() == [statistics.median(np.repeat(x[:, 0], row.astype(int)).tolist()) for row in even]


def test_weighted_newton_is_newton(spark):
    rows = distributions.logistic_rows(spark, 400, [1.0, -2.0], 0.0, "normal", 1).cache()
    beta = logistic.fit(rows, 2, tolerance=1e-10)
    local = rows.orderBy("row_id").collect()
    x, y = np.array([r.x for r in local]), np.array([r.y for r in local])
    assert np.allclose(logistic.weighted_newton(x, y, np.ones((1, 400)), np.zeros(2), 1e-10)[0], beta, atol=1e-6)
    g, h = logistic.derivatives(rows, beta)
    assert np.linalg.norm(g) < 1e-6 and np.all(np.linalg.eigvalsh(h) > 0)
    assert np.allclose(logistic.fit(rows, 2, solver="lbfgs", steps=200), beta, atol=1e-3)
    assert logistic.fit(rows, 2, solver="newton", start=beta, tolerance=1e-3) == pytest.approx(beta, abs=1e-3)
    private = private_logistic.private_fit(rows, 2, math.inf, 5.0, estimate=beta)
    assert private == beta
    far = private_logistic.private_fit(rows, 2, 1e9, 5.0, estimate=beta)
    assert far == pytest.approx(beta, abs=1e-6)


def test_separable_labels_do_not_diverge(spark):
    rows = spark.createDataFrame([(i, [float(i - 5)], 1.0 if i > 5 else -1.0) for i in range(11) if i != 5], "row_id long, x array<double>, y double")
    assert math.isfinite(logistic.fit(rows, 1, steps=20)[0])


def test_zcdp():
    assert zcdp.eps_to_rho(1.0, 1e-6) == pytest.approx((math.sqrt(1 + math.log(1e6)) - math.sqrt(math.log(1e6))) ** 2)
    assert sum(zcdp.budgets(0.8, 5)) == pytest.approx(0.8)
    est, var = zcdp.weighted([{"est": 2.0, "noise_var": 4.0}, {"est": 4.0, "noise_var": 4.0}])
    assert (est, var) == (3.0, 2.0)


def test_zcdp_interval_with_large_budget(spark):
    rng = np.random.default_rng(4)
    chunks = spark.createDataFrame([(float(v), 0.04) for v in rng.normal(1.0, 0.2, 40)], "m double, v double").cache()
    out = zcdp.private_interval(chunks, 40, 0.0, 1.0, 0.01, 0.0, 10.0, 5, 1e6, 0.01, 0.05)
    assert out["l"] < 1.0 < out["u"] and out["u"] - out["l"] < 2
    given = zcdp.mean_iterative(chunks, "m", 0.0, 10.0, 0.04, [0.01], [1e9], 40, "k", center=0.0)
    assert given[0]["est"] == pytest.approx(chunks.agg(F.avg("m")).first()[0], abs=1e-3)


def test_private_deviation_limit(spark):
    rows = [(c, float(v)) for c in range(5) for v in (0, c + 1)]
    df = spark.createDataFrame(rows, "chunk int, stat double").withColumn("g", F.lit(0))
    assert variance.private_deviation(df, ["g"], 100.0, math.inf).first().value == pytest.approx(math.sqrt(9 / 2))


def test_clip_and_ball(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (-1.0,), (3.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(mechanisms.clip_variance(F.col("v"), 5.0)).collect()] == [5.0, 5.0, 0.0, 3.0, 5.0]


def test_survey_and_results(spark, tmp_path):
    raw = spark.createDataFrame([(1, 40.0, 1.0, 12.0, 1.0, 40.0, 2.0, 40000.0), (2, 17.0, 6.0, 24.0, 5.0, 99.0, 1.0, 500.0), (3, 12.0, 6.0, 24.0, 5.0, 99.0, 1.0, 500.0)], "id long, AGEP double, COW double, SCHL double, MAR double, WKHP double, SEX double, PINCP double")
    out = {r.id: r for r in survey.prepare(raw).collect()}
    assert set(out) == {1, 2} and out[1].PINCP == 1 and out[2].PINCP == -1 and out[1].SEX == 1 and out[1].COW_private == 1 and out[2].COW_self == 1
    files.write_csv(survey.prepare(raw), str(tmp_path / "csv"))
    again = files.read_features(spark, str(tmp_path / "csv"))
    assert again.exceptAll(survey.prepare(raw)).count() == 0 and again.count() == 2
    assert files.read_features(spark, str(tmp_path / "csv"), ["AGEP"]).columns == ["id", "AGEP", "PINCP"]
    files.write_csv(raw.select(*[f.name for f in survey.RAW.fields]), str(tmp_path / "raw"))
    assert files.read_survey(spark, str(tmp_path / "raw")).count() == 3
    run = spark.createDataFrame([(300, 1, 0.5), (500, 1, 0.7)], "n int, trial int, w double")
    experiment.write_run(run, str(tmp_path / "runs"), "m1d1v0", "len")
    experiment.write_run(run, str(tmp_path / "runs"), "m1d12v0", "len")
    assert experiment.read_runs(spark, str(tmp_path / "runs"), "len", 300).count() == 2
    assert experiment.next_run_id(["m1d1v0", "m1d12v3"], "m1d1") == "m1d1v1"


def test_ledger(spark):
    assert split(10.0, 0.3) == (3.0, 7.0)
    book = study_ledger(8.0, 0.5, 10, dims=5, fixed=True)
    assert book.total_eps() == pytest.approx(40.0)
    assert book.table(spark).count() == 3
    assert study_ledger(8.0, 0.5, 10, dims=5).total_eps() == pytest.approx(5 * (4 + 10 * 2 + 2))  # each redraw is charged
    with pytest.raises(ValueError):
        Ledger().spend("x", "y", eps=-1)


@pytest.mark.parametrize("kind", ["symm", "low", "up", "eqtail", "short"])
def test_search_covers(spark, kind):
    """Interval ends are bin edges, and an unreachable threshold gives the whole range."""
    df = numbers(spark, np.random.default_rng(6).normal(0, 1, 120).round(2))
    chunked = chunking.chunk(df, "id", 120, 20, 1)
    stats = resampling.weighted_stats(chunked, ["x"], 120, 200, seed=2).cache()
    bins = Bins(-8.0, 8.0, 32)
    hist = histograms.flat(stats, "stat", bins, ["chunk"])
    got = intervals.search(stats, hist, bins, 200, 0.1, 1e6, kind).first()
    assert -8 <= got.l < got.u <= 8 and (got.l * 2).is_integer() and (got.u * 2).is_integer() and got.ord is not None
    none = intervals.search(stats, hist, bins, 200, 0.1, 1e6, kind, error=1.0).first()
    assert (none.l, none.u, none.ord) == (-8.0, 8.0, None)


def test_coverage_of_the_mean_interval(spark):
    """Private intervals by the engine's own chunks, resamples and search cover the mean about as often as asked."""
    dist, hits, trials, n = distributions.study_distribution("truncnorm_assym"), 0, 5, 240
    bins = Bins(-10.0, 10.0, 128)
    for t in range(trials):
        df = dist.sample(spark, n, 100 + t)
        chunked = chunking.chunk(df, "row_id", n, 30, t)
        release = lambda x, w, rng: resampling.weighted_mean(x, w) + rng.laplace(0, 10 / (n * 5.0), (len(w), 1))
        stats = resampling.weighted_stats(chunked, ["x"], n, 150, seed=t, private=release).cache()
        got = intervals.search(stats, histograms.flat(stats, "stat", bins, ["chunk"]), bins, 150, 0.05, 20.0, "symm", seed=t).first()
        est = df.agg(F.avg("x")).first()[0] + keyed.laplace_py(10 / (n * 5.0), "t", t)
        hits += est + got.l / math.sqrt(n) <= dist.mean <= est + got.u / math.sqrt(n)
        assert 2 * 1.96 * dist.std * 0.7 < got.u - got.l < 2 * 1.96 * dist.std * 2
    assert hits / trials >= 0.95 - 4 * math.sqrt(0.95 * 0.05 / trials)


def test_normal_quantile_as_a_column(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.074, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-12]
    got = spark.createDataFrame([(v,) for v in p], "p double").select(special.normal_quantile_column(F.col("p"))).collect()
    for v, r in zip(p, got, strict=True):
        assert r[0] == pytest.approx(special.normal_quantile(v), rel=1e-9, abs=1e-12)


def test_halvings_come_after_the_row():
    assert list(logistic.halvings(10)) == [5, 7, 8, 9] and list(logistic.halvings(1)) == [0]


def plain_sgd(x, y, step, start, center, radius):
    beta, total, rate, k, n = np.array(start, float), np.zeros(len(start)), step, 1, len(y)
    for i in range(n):
        beta = beta + rate * y[i] * x[i] / (1 + math.exp(y[i] * float(beta @ x[i])))
        far = np.linalg.norm(beta - center)
        beta = center + (beta - center) * min(1, radius / far) if far else beta
        total += beta
        if i == n - math.ceil(n / 2**k):
            rate, k = rate / 2, k + 1
    return total / n


def test_projected_sgd(spark):
    rows = distributions.logistic_rows(spark, 57, [1.0, -2.0], 0.0, "normal", 3).cache()
    local = rows.orderBy("row_id").collect()
    x, y = np.array([r.x for r in local]), np.array([r.y for r in local])
    for args in ({}, {"step": 0.5, "start": [1.0, 1.0], "center": [0.5, 0.5]}):
        got = [r.value for r in logistic.projected_sgd(rows, 2, 0.8, **args).orderBy("dim").collect()]
        want = plain_sgd(x, y, args.get("step", 1 / math.sqrt(57)), args.get("start", [0, 0]), np.array(args.get("center", [0, 0])), 0.8)
        assert got == pytest.approx(want.tolist())


def test_gradients_of_many_points(spark):
    rows = distributions.logistic_rows(spark, 300, [1.0, -2.0], 0.0, "normal", 1).repartition(3).cache()
    points = np.array([[0.0, 0.0], [1.0, -2.0], [0.3, 0.1]])
    got = {(r.step, r.dim): r.value for r in logistic.gradients(rows, points).collect()}
    for k, b in enumerate(points.tolist()):
        g = logistic.gradient(rows, b).first()
        assert [got[k, i] for i in range(2)] == pytest.approx([g.g0, g.g1])


def test_metropolis_stays_near_the_estimate(spark):
    rows = distributions.logistic_rows(spark, 500, [1.0, -1.0], 0.0, "uniform", 1).cache()
    beta = logistic.fit(rows, 2, tolerance=1e-8)
    near = [r.value for r in private_logistic.metropolis(rows, 2, 1e5, 1.5, steps=30, seed=1).orderBy("dim").collect()]
    assert near == pytest.approx(beta, abs=0.01)
    with pytest.raises(ValueError):
        private_logistic.metropolis(rows, 2, 8.0, 1.5, center=[0.0])


def test_remainder_of_the_zcdp_chunks(spark):
    """1,510 rows in chunks of 125: twelve chunks and ten rows left, which the means and variances do without."""
    df = numbers(spark, range(1510))
    chunked = chunking.chunk(df, "id", 1510, 125, 1, "drop")
    assert chunked.groupBy("chunk").count().filter("count = 125").count() == 12 and chunked.count() == 1500
    stats = resampling.boot_stats(chunked, "x", 1510, 3, 1)
    assert resampling.means_and_variances(stats, ["chunk"]).count() == 12


def test_zcdp_without_variance_and_with_a_centre(spark):
    chunks = spark.createDataFrame([(5.0, 0.0)] * 20, "m double, v double").cache()
    out = zcdp.private_interval(chunks, 20, 0.0, 1e-9, 1e-12, 0.0, 10.0, 3, 1e9, 0.01, 0.05)
    assert math.isfinite(out["l"]) and out["l"] <= 5.0 <= out["u"]
    rng = np.random.default_rng(4)
    chunks = spark.createDataFrame([(float(v), 0.04) for v in rng.normal(1.0, 0.2, 40)], "m double, v double").cache()
    mean = chunks.agg(F.avg("m")).first()[0]
    far = zcdp.private_interval(chunks, 40, 0.0, 1.0, 0.01, 0.0, 10.0, 5, 1e6, 0.01, 0.05, center=0.5, cov_center=0.04)
    assert far["est"] == pytest.approx(mean, abs=0.1) and far["l"] < 1.0 < far["u"]


def test_columns_and_numbers_of_the_zcdp_scalars(spark):
    row = spark.range(1).select(zcdp.eps_to_rho(F.lit(3.0), F.lit(1e-6)), zcdp.gaussian_tailbound(2, F.lit(0.01))).first()
    assert row[0] == pytest.approx(zcdp.eps_to_rho(3.0, 1e-6)) and row[1] == pytest.approx(zcdp.gaussian_tailbound(2, 0.01))


def test_order_statistics_by_bins(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in range(3) for v in ([7.0] * 400 if g == 0 else rng.integers(0, 50, 333) if g == 1 else rng.lognormal(0, 3, 501))]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    for seed in range(4):
        one = mechanisms.noisy_order_statistic(df, "x", ["g"], 0.02, 0.02, 99.0, seed).orderBy("g").collect()
        two = mechanisms.noisy_order_statistic(df, "x", ["g"], 0.02, 0.02, 99.0, seed, bins=16).orderBy("g").collect()
        assert one == two


def test_ball_around_a_centre(spark):
    got = spark.createDataFrame([([4.0, 1.0],), ([1.5, 1.0],)], "x array<double>").select(mechanisms.to_ball(F.col("x"), 2.0, [1.0, 1.0])).collect()
    assert [r[0] for r in got] == [[3.0, 1.0], [1.5, 1.0]]


def test_released_statistics(spark):
    """Infinite budgets change nothing; a small one spreads the statistic by the noise of the mean."""
    chunked = chunking.chunk(numbers(spark, np.random.default_rng(2).normal(0, 2, 60)), "id", 60, 20, 1)
    plain = resampling.boot_stats(chunked, "x", 60, 50, 1)
    same = resampling.boot_stats(chunked, "x", 60, 50, 1, resampling.Release(-9, 9))
    assert plain.exceptAll(same).count() == 0
    noisy = resampling.boot_stats(chunked, "x", 60, 50, 1, resampling.Release(-9, 9, 0.5))
    v = lambda df: df.agg(F.var_samp("stat")).first()[0]
    assert v(noisy) - v(plain) == pytest.approx(60 * 2 * (18 / (60 * 0.5)) ** 2, rel=0.6)
    student = resampling.boot_stats(chunked, "x", 60, 50, 1, resampling.Release(-9, 9, studentize=True))
    assert 0.5 < v(student) < 2


def test_studentized_coefficients(spark):
    """Divided by the root of the sandwich, the coefficients of all dimensions have about unit deviation."""
    rows = distributions.logistic_rows(spark, 600, [1.0, -1.0], 0.0, "uniform", 1).select("row_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), "y")
    chunked = rows.withColumn("chunk", F.lit(0)).withColumn("slot", F.col("row_id"))
    out = resampling.weighted_stats(chunked, ["a", "b", "y"], 600, 200, logistic.weighted_estimator([0.0, 0.0]), scale=logistic.weighted_deviation([0.0, 0.0]))
    assert all(0.6 < r.v < 1.6 for r in out.groupBy("dim").agg(F.var_samp("stat").alias("v")).collect())
    private = resampling.weighted_stats(chunked, ["a", "b", "y"], 600, 200, logistic.weighted_estimator([0.0, 0.0]), private=logistic.private_estimator([0.0, 0.0], 0.5, 1.5))
    plain = resampling.weighted_stats(chunked, ["a", "b", "y"], 600, 200, logistic.weighted_estimator([0.0, 0.0]))
    spread = lambda df: df.agg(F.var_samp("stat")).first()[0]
    assert spread(private) > 1.3 * spread(plain)


def test_person_weights(spark):
    raw = spark.createDataFrame([(1, 40.0, 500.0, 40.0, 0), (2, 40.0, 500.0, 40.0, 3)], "id long, AGEP double, PINCP double, WKHP double, PWGTP int")
    assert [r.id for r in survey.adult_filter(raw).collect()] == [2] and survey.adult_filter(raw.drop("PWGTP")).count() == 2


def test_shared_folder_of_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from veilstat.functions.session import shared_folder

    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: named), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("spark://x:7077", "hdfs://y/c")) == "hdfs://y/c"
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://x:7077", None))
    assert shared_folder(session("local[2]", None)) == shared_folder(session("local", None))


def test_draws_are_counted_where_they_are_made(spark):
    """Pages of 8 slots and parts of 50 draws, dense and sparse, nulls, copies of the whole table: as index by index; no join has a row a draw."""
    x = [None if i % 7 == 0 else float(i * i % 23) for i in range(60)]
    chunked = spark.createDataFrame(list(enumerate(x)), "id long, x double").select((F.col("id") % 2).cast("int").alias("chunk"), F.floor(F.col("id") / 2).alias("slot"), "x")
    whole = spark.createDataFrame(list(enumerate(x)), "slot long, x double")
    for df, copies, of in ((chunked, 0, lambda c: x[c::2]), (whole, 3, lambda c: x)):
        got = resampling.boot_stats(df, "x", 130, 40, 5, resampling.Release(0, 23, studentize=True), copies=copies, page=8, span=50)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(sequence(0, 129" not in plan
        rows = got.collect()
        assert len(rows) == 40 * (copies or 2)
        for r in rows:
            own = of(r.chunk)
            drawn = [own[math.floor(keyed.uniform_py("boot", 5, r.chunk, r.run, k) * len(own))] for k in range(130)]
            drawn, known = np.array([v for v in drawn if v is not None]), [v for v in own if v is not None]
            assert r.est == pytest.approx(drawn.mean(), rel=1e-12) and r.stat == pytest.approx(math.sqrt(130) * (np.mean(known) - drawn.mean()) / drawn.std(ddof=1), rel=1e-9, abs=1e-9)


def test_uniforms_as_an_array():
    for first, last in ((0, 1), (7, 1203), (99_990, 100_020), (1_234_567, 1_234_999)):
        assert keyed.uniforms_np(first, last, "boot", 0, 3, 17).tolist() == [keyed.uniform_py("boot", 0, 3, 17, k) for k in range(first, last)]
    assert keyed.uniforms_np(5, 8, "boot", "a seed of more than fifty bytes, which is more than a block holds").tolist() == [keyed.uniform_py("boot", "a seed of more than fifty bytes, which is more than a block holds", k) for k in range(5, 8)]


def test_uniforms_are_made_in_small_blocks():
    """Steps of the digest work on arrays that a core's cache holds, whatever the length of a word's prefix; the numbers across a block's ends are as ever."""
    for keys in (("boot", 0, 3, 17), ("boot", 0, 3, 171), ("boot", 0, 31, 171), ("boot", 10, 31, 171)):
        for first in (keyed.BLOCK, 100_000 + keyed.BLOCK, 1_000_000):
            assert keyed.uniforms_np(first - 2, first + 2, *keys).tolist() == [keyed.uniform_py(*keys, k) for k in range(first - 2, first + 2)]
    keyed._chars.cache_clear()
    tracemalloc.start()
    out = keyed.uniforms_np(100_000, 300_000, "boot", 0, 3, 17)
    peak = tracemalloc.get_traced_memory()[1] - out.nbytes
    tracemalloc.stop()
    assert peak < 4_000_000


def test_a_block_of_runs_is_weighted_in_steps(spark):
    """What a task holds of a block's counts is bounded, and decides no result."""
    chunked = chunking.chunk(numbers(spark, np.random.default_rng(6).normal(0, 2, 90)), "id", 90, 30, 1)

    def counted(x, w):
        if w.size > 100:
            raise ValueError("more counts at a time than asked for")
        return resampling.weighted_median(x, w)

    rows = lambda f, **k: sorted(resampling.weighted_stats(chunked, ["x"], 90, 20, f, seed=3, **k).collect())
    assert rows(counted, held=100) == rows(resampling.weighted_median)
