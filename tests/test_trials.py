import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstat.functions.special import student_quantile
from veilstat.operators import logistic_trial, trial
from veilstat.operators.study import exact_interval
from veilstat.sources.distributions import logistic_rows, study_distribution


def within(coverage, rows, level=0.95, trials=40):
    """Whether a coverage is within four standard errors of the level, or above it (the noise of privacy widens)."""
    return coverage >= level - 4 * math.sqrt(level * (1 - level) / trials)


@pytest.mark.parametrize("task", ["mean", "median"])
def test_coverage_and_width(spark, task):
    study = trial.Study(task=task, resamples=8, max_boot=200)
    rows = trial.run_trials(spark, study, [300], [10.0], 40).cache()
    out = {r.method: r for r in trial.study_summary(rows).collect()}
    assert set(out) == set(study.methods)
    sd = study.truth(study_distribution(study.dist))[1] if task == "mean" else study_distribution(study.dist).median_std
    least = 2 * student_quantile(0.975, 299) * sd / math.sqrt(300)  # without any noise
    # Medians: the private median of few chunks can give its upper bound, which a mean would be full of.
    width = {r.method: r.w for r in rows.groupBy("method").agg(F.median("width").alias("w")).collect()}
    for r in out.values():
        assert r.rows == 320 and within(r.coverage, r.rows), r
        assert 0.8 * least < width[r.method] < 2.5 * least, (r, least)
    if task == "mean":  # the noise of the mean is known: the normal interval is its deviation with n - 1 degrees
        noise = math.sqrt(2) * 10 / (300 * 5)
        want = 2 * student_quantile(0.975, 299) * math.hypot(sd / math.sqrt(300), noise)
        assert width["normal_proper_blb"] == pytest.approx(want, rel=0.15)
        assert width["normal_proper_adhoc"] == pytest.approx(want, rel=0.08)


@pytest.mark.parametrize("kind", ["eqtail", "short", "low", "up"])
def test_set_types(spark, kind):
    study = trial.Study(set_type=kind, resamples=4, max_boot=150)
    out = {r.method: r for r in trial.study_summary(trial.run_trials(spark, study, [300], [10.0], 16)).collect()}
    for m in ("proper_unstud", "boot_unstud_priv"):
        # The shortest set tries thousands of candidates, each with noise of its own, and takes the first accepted.
        assert out[m].coverage >= 0.8 or (kind == "short" and m == "proper_unstud")
        assert math.isinf(out[m].width) == (m == "boot_unstud_priv" and kind in ("low", "up"))


@pytest.mark.parametrize("task", ["mean", "median"])
def test_zcdp_intervals(spark, task):
    study = trial.Study(task=task, resamples=1, zcdp=True)
    out = {r.n: r for r in trial.study_summary(trial.run_trials(spark, study, [300, 2000], [10.0], 40)).collect()}
    dist = study_distribution(study.dist)
    sd = dist.std if task == "mean" else dist.median_std
    for n, r in out.items():
        assert r.method == "gvdp" and r.rows == 40 and r.coverage >= 0.9 and r.width > 2 * 1.96 * sd / n**0.5
    assert out[2000].width < out[300].width / 2  # the noise of few chunks is most of the width


def test_clipped_means_without_noise():
    x = np.random.default_rng(1).normal(7, 2, 50)
    for r in trial.clipped_means(x, 7.0, 70.0, 4.0, [0.01] * 3, [1e12] * 3, np.random.default_rng(2)):
        assert abs(r["est"] - x.mean()) < 1e-3 and 0 < r["noise_var"] < 1e-6


def test_logistic_trials(spark):
    """All coefficients: coverage within error of the level, widths near those of the estimate's own deviation and noise."""
    rows = logistic_rows(spark, 4000, [1.0, -0.5], 0.2, "uniform", 2)
    study = logistic_trial.LogisticStudy(ranges=(60.0, 60.0, 40.0), resamples=10)
    got = logistic_trial.run_logistic_trials(rows, "row_id", study, [800], 16).cache()
    assert got.count() == 3 * 3 * 16 * 10
    out = {(r.method, r.dim): r for r in got.groupBy("method", "dim").agg(F.avg("covered").alias("c"), F.avg("width").alias("w")).collect()}
    assert set(out) == {(m, d) for m in logistic_trial.METHODS for d in range(3)}
    for (m, d), r in out.items():
        assert within(r.c, 0, trials=16) and 0.5 * out["boot_unstud_priv", d].w < r.w < 2 * out["boot_unstud_priv", d].w, (m, d, r)
    again = logistic_trial.run_logistic_trials(rows.repartition(3), "row_id", study, [800], 2)
    short = lambda df: df.filter("trial < 2").withColumn("width", F.round("width", 6))
    assert again.count() == 3 * 3 * 2 * 10 and short(again).exceptAll(short(got)).count() == 0  # the partitions of the population decide nothing
    with pytest.raises(ValueError):
        logistic_trial.LogisticStudy(set_type="eqtail")


def test_zcdp_logistic_trials(spark):
    rows = logistic_rows(spark, 3000, [1.0, -0.5], 0.2, "uniform", 2)
    one = logistic_trial.run_zcdp_survey(rows, "row_id", [2500], [10.0], 60).collect()
    two = logistic_trial.run_zcdp_synthetic(spark, [0.5, -0.5, 0.0], [2500], [10.0], 60, dist="normal").collect()
    for own in (one, two):
        assert all(r.method == "gvdp" and r.width > 0 and r.covered in (0, 1) for r in own)
        low, high = exact_interval(sum(r.covered for r in own), 60, 0.001)
        assert high >= 0.95, (low, high)  # an interval that is too narrow to cover 0.95 is seen
    with pytest.raises(ValueError):
        logistic_trial.run_zcdp_synthetic(spark, [0.5, 0.0], [100], [1.0], 1, dist="cauchy")


def test_draws_without_replacement(spark):
    rows = logistic_rows(spark, 300, [1.0], 0.0, "uniform", 4)
    cases = spark.createDataFrame([(200, 0, -1), (200, 1, 0)], "n int, trial int, resample int")
    population = logistic_trial.Population(rows, "row_id")
    got = population.drawn(cases)
    assert {(r.trial, r.n_, r.d_) for r in got.groupBy("trial").agg(F.count("*").alias("n_"), F.countDistinct("x").alias("d_")).collect()} == {(0, 200, 200), (1, 200, 200)}
    with pytest.raises(Exception, match="300 rows"):
        population.drawn(spark.createDataFrame([(400, 0, 0)], "n int, trial int, resample int")).count()


def test_few_draws_leave_the_population_where_it_is(spark):
    """Draws up to the bound are broadcast, so no round sorts or sends the population; more meet it by a merge join, with the same rows."""
    rows = logistic_rows(spark, 300, [1.0], 0.0, "uniform", 4)
    cases = spark.createDataFrame([(200, 0, -1), (150, 1, 0)], "n int, trial int, resample int")
    found, plans = [], []
    for few in (350, 349):
        got = logistic_trial.Population(rows, "row_id", few).drawn(cases)
        found.append(sorted(map(tuple, got.collect())))
        plans.append(got._jdf.queryExecution().sparkPlan().toString())
    assert found[0] == found[1] and len(found[0]) == 350
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]


def test_rank_distance():
    assert trial.rank_distance(np.arange(5), 4).tolist() == [2, 1, 0, 1, 2]
    assert trial.rank_distance(np.arange(6), 5).tolist() == [3, 2, 1, 1, 2, 3]


def test_spread_apart():
    assert trial.spread_apart(np.array([3.0, 1.0, 2.0]), 0.5, 0.0, 3.2).tolist() == [0.5, 2.0, 3.2]
    assert trial.spread_apart(np.array([4.0, 1.0, 2.0, 3.0]), 0.5, 0.0, 9.0).tolist() == [0.5, 1.5, 3.5, 4.5]


@pytest.mark.parametrize("m", [8, 9])
def test_orders_are_those_of_the_search(spark, m):
    from veilstat.operators import intervals

    for kind in ("symm", "short", "low", "up"):
        want = [(r["first"], r["last"]) for r in intervals.candidates(spark, kind, m).orderBy("ord").collect()]
        assert [(int(a), int(b)) for first, last in trial.orders(kind, m) for a, b in zip(first, last, strict=True)] == want


def test_names_are_checked():
    for bad in ({"task": "mode"}, {"dist": "uniform"}, {"dist": "normal"}, {"set_type": "wide"}):
        with pytest.raises(ValueError):
            trial.Study(**bad)
    with pytest.raises(ValueError):
        list(trial.orders("wide", 4))


def test_draws():
    for name in ("truncnorm_assym", "triang_assym", "normal"):
        d = study_distribution(name)
        x = d.draw(np.random.default_rng(1), 20_000)
        assert abs(x.mean() - d.mean) < 0.1 and abs(x.std() - d.std) < 0.1
