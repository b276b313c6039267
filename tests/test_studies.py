"""Studies that stop and go on, and that know their coverage; sizes and budgets as columns."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilstat.functions.special import beta_quantile, beta_regularized
from veilstat.operators import chunking, experiment, study, trial
from veilstat.operators.ledger import study_ledger, study_releases
from veilstat.operators.logistic_trial import Population
from veilstat.operators.study import Goal
from veilstat.sources import files


def coin(chance, width=1.0):
    """A study whose trials cover with a known chance, keyed by (n, trial)."""

    def simulate(cells):
        def run(frames):
            for f in frames:
                hit = [int(np.random.default_rng([n, t]).random() < chance) for n, t in zip(f["n"], f["trial"], strict=True)]
                yield pd.DataFrame({"n": f["n"], "eps": f["eps"], "trial": f["trial"], "method": "coin", "covered": hit, "width": width})

        return cells.mapInPandas(run, "n int, eps double, trial int, method string, covered int, width double")

    return simulate


def test_exact_interval():
    assert beta_regularized(3, 5, beta_quantile(0.2, 3, 5)) == pytest.approx(0.2)
    low, high = study.exact_interval(8, 10, 0.05)
    assert (low, high) == (pytest.approx(0.4439, abs=1e-4), pytest.approx(0.9748, abs=1e-4))
    assert study.exact_interval(0, 10, 0.05)[0] == 0 and study.exact_interval(10, 10, 0.05) == (pytest.approx(0.025**0.1), 1.0)


@pytest.mark.parametrize("chance", [0.5, 0.95, 1.0])
def test_confidence_sequence_holds_in_all_rounds(chance):
    """In at most the stated share of studies does any round's interval miss the chance; the intervals of shares of resamples, too."""
    goal, rng, missed = Goal(half_width=0.01, first=16, most=1024), np.random.default_rng(1), np.zeros(2, int)
    for _ in range(400):
        hit = rng.random((1024, 4)) < chance
        own, shares, bad = hit[:, 0].cumsum(), hit.mean(1).cumsum(), np.zeros(2, bool)
        for k, (_, n) in enumerate(goal.rounds(), 1):
            for j, (mean, binary) in enumerate(((own[n - 1] / n, True), (shares[n - 1] / n, False))):
                low, high = study.interval(n, float(mean), binary, study.round_error(k, goal.level))
                bad[j] |= not low - 1e-12 <= chance <= high + 1e-12
        missed += bad
    assert (missed <= 0.05 * 400 + 3 * math.sqrt(0.05 * 0.95 * 400)).all()


def test_rounds_double():
    assert Goal(first=4, most=30).rounds() == [(0, 4), (4, 8), (8, 16), (16, 30)] and Goal(first=8, most=5).rounds() == [(0, 5)]


def test_trials_are_added_until_the_half_width(spark, tmp_path):
    goal = Goal(half_width=0.1, first=16, most=2000)
    out = study.run_study(spark, f"{tmp_path}/s", [(1, 1.0), (2, 1.0)], coin(0.95), goal).collect()
    for r in out:
        assert (r.high - r.low) / 2 <= 0.1 and r.trials < 2000 and r.low <= 0.95 <= r.high and r.coverage == pytest.approx(0.95, abs=0.1)
    # A study at its bound says so by its width; one that is far too narrow is told from the nominal level.
    bound = study.run_study(spark, f"{tmp_path}/b", [(1, 1.0)], coin(0.5), Goal(half_width=0.01, first=16, most=64)).first()
    assert bound.trials == 64 and (bound.high - bound.low) / 2 > 0.01 and bound.high < 0.95


def test_two_stops_give_the_rows_of_one_run(spark, tmp_path):
    goal, cells, own = Goal(half_width=0.08, first=8, most=100, part=5), [(3, 2.0), (4, 2.0)], coin(0.9)
    whole = study.run_study(spark, f"{tmp_path}/whole", cells, own, goal)
    for n in (2, 3):
        study.run_study(spark, f"{tmp_path}/parts", cells, own, goal, stop_after=n)
    # A part whose write was not committed counts for nothing.
    (tmp_path / "parts" / "round=1-from=0-broken").mkdir()
    (tmp_path / "parts" / "round=1-from=0-broken" / "part-0.parquet").write_bytes(b"half a file")
    before = len(study.parts(f"{tmp_path}/parts", spark))
    again = study.run_study(spark, f"{tmp_path}/parts", cells, own, goal)
    assert before == 5 and sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
    rows = [study.written(spark, f"{tmp_path}/{f}") for f in ("whole", "parts")]
    assert rows[0].exceptAll(rows[1]).count() == rows[1].exceptAll(rows[0]).count() == 0
    runs = [0]

    def never(c):
        runs[0] += 1
        return own(c)

    assert sorted(map(tuple, study.run_study(spark, f"{tmp_path}/parts", cells, never, goal).collect())) == sorted(map(tuple, whole.collect())) and runs[0] == 0


def test_a_small_study_of_the_mean(spark, tmp_path):
    out = study.run_study(spark, f"{tmp_path}/m", [(300, 10.0)], lambda c: trial.trials_of(c, trial.Study(resamples=10, max_boot=150)), Goal(half_width=0.2, first=16, most=32)).collect()
    assert {r.method for r in out} == set(trial.METHODS) and all(r.high >= 0.9 and r.width > 0 for r in out)


def test_run_ids_are_claimed_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda _: experiment.claim_run_id(spark, f"{tmp_path}/runs", "m1d1"), range(12)))
    assert len(set(ids)) == 12 and all(i.startswith("m1d1v") for i in ids)
    one = [experiment.claim_run_id(spark, f"{tmp_path}/alone", "m1d1") for _ in range(3)]
    assert one == ["m1d1v0", "m1d1v1", "m1d1v2"]
    assert experiment.claim_run_id(spark, f"{tmp_path}/runs", "m1d2") == "m1d2v0"


def test_sizes_as_columns(spark):
    cases = [(n, e) for n in (10, 300, 500, 1000, 2000, 8000, 1_000_000) for e in (10.0, 8.0, 5.0, 0.7)]
    n, eps = F.col("n").cast("double"), F.col("eps")
    named = lambda p, c: [v.alias(p + k) for k, v in c.items() if k != "precision"]
    got = spark.createDataFrame(cases, "n long, eps double").select("n", "eps", *named("a_", chunking.sizing_columns(n, eps)), *named("b_", chunking.sizing_columns(n, eps, "eqtail")), *named("z_", chunking.zcdp_sizing_columns(n, eps)), chunking.survey_runs_column(n, eps).alias("r"))
    for r in got.collect():
        one, two, z = chunking.sizing(r.n, r.eps), chunking.sizing(r.n, r.eps, "eqtail"), chunking.zcdp_sizing(r.n, r.eps)
        assert (r.a_chunks, r.a_b, r.a_runs, r.a_boot_runs, r.b_chunks) == (one["chunks"], one["b"], one["runs"], one["boot_runs"], two["chunks"])
        assert (r.z_chunks, r.z_b, r.z_runs, r.r) == (z["chunks"], z["b"], z["runs"], chunking.survey_sizing(r.n, r.eps)["runs"])


def test_releases_as_columns(spark):
    for fixed in (False, True):
        rows = spark.createDataFrame([(8.0,)], "eps double").select(F.explode(study_releases(F.col("eps"), 0.5, 31, 5, fixed)).alias("e")).select("e.*").collect()
        assert [(r.release, r.each, r.uses) for r in rows] == [(a, e, u) for a, _, e, _, u in study_ledger(8.0, 0.5, 31, 5, fixed).entries]
        assert sum(r.spent for r in rows) == study_ledger(8.0, 0.5, 31, 5, fixed).total_eps()


def test_survey_by_header(spark, tmp_path):
    rows = [(1.0, 30.0, 1.0, 20.0, 1.0, 40.0, 1.0, 50_000.0, "x"), (0.0, 40.0, 2.0, 10.0, 3.0, 20.0, 2.0, 10_000.0, "y")]
    names = ["PWGTP", "AGEP", "COW", "SCHL", "MAR", "WKHP", "SEX", "PINCP", "SERIALNO"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'SERIALNO' else 'double'}" for c in names))
    files.write_csv(df.select(*reversed(names)), f"{tmp_path}/with")
    got = files.read_survey(spark, f"{tmp_path}/with")
    assert got.columns == ["AGEP", "COW", "SCHL", "MAR", "WKHP", "SEX", "PINCP", "PWGTP"] and sorted(r.PWGTP for r in got.collect()) == [0.0, 1.0]
    files.write_csv(df.drop("PWGTP"), f"{tmp_path}/without")
    assert "PWGTP" not in files.read_survey(spark, f"{tmp_path}/without").columns
    files.write_csv(df.drop("WKHP"), f"{tmp_path}/less")
    with pytest.raises(ValueError, match="WKHP"):
        files.read_survey(spark, f"{tmp_path}/less")


def test_drawn_rows_are_not_broadcast(spark):
    """The plan's estimate of the draws is that of their cases; a broadcast of them, or of the population, would go through the driver."""
    rows = spark.range(200).select("id", F.array(F.col("id") / 200).alias("x"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("y"))
    cases = spark.createDataFrame([(20, t, k) for t in range(2) for k in range(3)], "n int, trial int, resample int")
    out = Population(rows, "id").drawn(cases)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.groupBy("trial", "resample").count().filter("count = 20").count() == 6
