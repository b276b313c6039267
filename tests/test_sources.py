"""The sample source, and pruning of result folders."""

import pytest
from pyspark.sql import functions as F

from veilstat.operators import experiment
from veilstat.sources.datasource import samples
from veilstat.sources.distributions import STUDY, study_distribution


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(STUDY))
def test_samples_are_the_distribution_s(spark, name):
    got = samples(spark, name, 300, 7, step=64)
    want = study_distribution(name).sample(spark, 300, 7)
    far = got.join(want.withColumnRenamed("x", "w"), "row_id").agg(F.count("*"), F.max(F.abs(F.col("x") - F.col("w")))).first()
    assert far[0] == 300 and far[1] < 1e-7 and got.rdd.getNumPartitions() == 5


def test_filters_are_pushed(spark):
    df = samples(spark, "triang_sym", 1_000_000_000_000, 7, step=64)  # too many to make
    some = df.filter("row_id >= 5000000000 and row_id < 5000000100 and x > -9")
    assert some.count() == 100 and some.rdd.getNumPartitions() == 2
    assert [r.row_id for r in df.filter("row_id = 12").collect()] == [12] and df.filter("row_id > 8 and row_id <= 3").count() == 0
    assert df.filter("row_id <= 3").count() == 4
    for bad in ({"dist": "uniform"}, {"rows": -1}):
        with pytest.raises(Exception, match="no distribution|positive"):
            samples(spark, **({"dist": "normal", "rows": 3} | bad)).count()


def test_runs_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(n, k, 1.0 * k) for n in (300, 500) for k in range(4)], "n int, trial int, width double")
    for run in ("m1d1v0", "m1d1v1"):
        experiment.write_run(df, f"{tmp_path}/r", run, "len")
    one = experiment.read_runs(spark, f"{tmp_path}/r", "len", 500).filter("run_id = 'm1d1v1'")
    text = plan_of(one)
    assert one.count() == 4 and "PartitionFilters" in text and all(c in text.split("PartitionFilters")[1].split("PushedFilters")[0] for c in ("kind", "run_id", "n#"))
    assert len(one.inputFiles()) <= len(spark.read.parquet(f"{tmp_path}/r").inputFiles())
