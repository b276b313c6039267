"""Every query with a SQL twin gives the same rows in both engines, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from veilstat.plans.registry import load_all

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple("" if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n, (_, sql) in load_all().items() if sql])
def test_same_rows(spark, engine, name):
    query, sql = load_all()[name]
    assert plain(query(spark, FOLDER).toPandas()) == plain(engine.sql(sql).df())


# tests/test_answers.py has numpy answers for the others without a twin; tests/test_trials.py and tests/test_studies.py run the studies, which
# take minutes at the queries' sizes.
@pytest.mark.parametrize("name", ["abthresh_alldim", "blb_std_alldim"])
def test_others_run(spark, name):
    assert load_all()[name][0](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].l < rows[0].u
    assert set(entry.oracle_sql()) <= set(entry.queries())
