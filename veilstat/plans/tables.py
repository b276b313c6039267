"""Queries of sources, generators, survey preparation and result tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from veilstat.functions.keyed import KeyedSql as K
from veilstat.functions.session import checkpointed, removed, shared_folder
from veilstat.functions.special import normal_quantile_sql
from veilstat.operators import chunking, experiment, mechanisms, survey
from veilstat.operators.ledger import study_releases
from veilstat.plans.registry import query
from veilstat.sources import distributions as D
from veilstat.sources import files
from veilstat.sources.datasource import samples
from veilstat.sources.tables import table

_r = lambda c, n=6: F.round(c, n)
_u = lambda p, *k: K.uniform(p, "5", *k, "row_id")
_z = lambda p, *k: K.normal(p, "5", *k, "row_id")
_delta = 2 / math.sqrt(5)


def keys(spark, d):
    """A key an order: generators make a row for each, in the task that reads it."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))


@query(
    "dist_samples",
    f"""SELECT row_id, round(1 + 2 * {_z('gauss')}, 6) AS gauss,
round(CASE WHEN {_u('triang')} < 0.2 THEN -5 + 10 * sqrt({_u('triang')} * 0.2) ELSE 5 - 10 * sqrt((1 - {_u('triang')}) * 0.8) END, 6) AS triang,
round(CASE WHEN {_u('mixture-side')} <= 0.3 THEN 4 + 0.5 * {_z('mixture')} ELSE {_z('mixture')} END, 6) AS mixture,
round(pow(-ln(1 - {_u('weibull')}), CAST({1 / 1.5!r} AS DOUBLE)), 6) AS weibull, round(pow(1 - {_u('pareto')}, CAST({-1 / 3!r} AS DOUBLE)), 6) AS pareto,
round(pow({K.normal('chi2', '5', '0', 'row_id')}, 2) + pow({K.normal('chi2', '5', '1', 'row_id')}, 2), 6) AS chi2,
round({_delta!r} * abs({_z('skew-0')}) + {math.sqrt(1 - _delta**2)!r} * {_z('skew-1')}, 6) AS skew
FROM (SELECT o_orderkey AS row_id FROM orders)""",
)
def dist_samples(spark, d):
    kinds = {"gauss": D.Gauss(1, 2), "triang": D.Triangular(0.2, -5, 5), "mixture": D.GaussMixture(4, 0.5, 0.3), "weibull": D.Weibull(1.5), "pareto": D.Pareto(3), "chi2": D.ChiSquare(2), "skew": D.SkewNormal(2)}
    return keys(spark, d).select("row_id", *[_r(k.expression(5, F.col("row_id"))).alias(name) for name, k in kinds.items()])


_trunc = D.study_distribution("truncnorm_assym")
_trunc_u = f"(CAST({_trunc._lo!r} AS DOUBLE) + {_u('trunc')} * CAST({_trunc._hi - _trunc._lo!r} AS DOUBLE))"


@query("truncated_gauss", f"SELECT row_id, round({_trunc.mu!r} + {_trunc.sigma!r} * ({normal_quantile_sql('p')}), 6) AS x FROM (SELECT row_id, {_trunc_u} AS p FROM (SELECT o_orderkey AS row_id FROM orders))")
def truncated_gauss(spark, d):
    return keys(spark, d).select("row_id", _r(_trunc.expression(5, F.col("row_id"))).alias("x"))


@query(
    "samples_joined",
    f"SELECT o_orderkey, round(o_totalprice + {_trunc.mu!r} + {_trunc.sigma!r} * ({normal_quantile_sql('p')}), 4) AS noisy FROM (SELECT o_orderkey, o_totalprice, {_trunc_u.replace('row_id', 'o_orderkey')} AS p FROM orders WHERE o_orderkey >= 100)",
)
def samples_joined(spark, d):
    """Rows of the sample source next to the orders with their number; those below 100 are never made."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    made = samples(spark, "truncnorm_assym", (last or 0) + 1, 5).filter("row_id >= 100")
    return orders.join(made, F.col("o_orderkey") == F.col("row_id")).select("o_orderkey", F.round(F.col("o_totalprice") + F.col("x"), 4).alias("noisy"))


@query("gauss_vectors", f"SELECT row_id, round(1 + {K.normal('gauss-d', '5', '0', 'row_id')}, 6) AS x0, round(0.5 * {K.normal('gauss-d', '5', '0', 'row_id')} + {math.sqrt(0.75)!r} * {K.normal('gauss-d', '5', '1', 'row_id')}, 6) AS x1 FROM (SELECT o_orderkey AS row_id FROM orders)")
def gauss_vectors(spark, d):
    return keys(spark, d).withColumn("x", D.gauss_vector([1.0, 0.0], [[1.0, 0.5], [0.5, 1.0]], 5, F.col("row_id"))).select("row_id", _r(F.col("x")[0]).alias("x0"), _r(F.col("x")[1]).alias("x1"))


@query("mixture_vectors", f"SELECT row_id, round(CASE WHEN {_u('mixture-d-side')} <= 0.3 THEN 4 + 0.5 * {K.normal('mixture-d', '5', '0', 'row_id')} ELSE {K.normal('mixture-d', '5', '0', 'row_id')} END, 6) AS x0, round(CASE WHEN {_u('mixture-d-side')} <= 0.3 THEN 4 + 0.5 * {K.normal('mixture-d', '5', '1', 'row_id')} ELSE {K.normal('mixture-d', '5', '1', 'row_id')} END, 6) AS x1 FROM (SELECT o_orderkey AS row_id FROM orders)")
def mixture_vectors(spark, d):
    return keys(spark, d).withColumn("x", D.mixture_vector(2, 4.0, 0.5, 0.3, 5, F.col("row_id"))).select("row_id", _r(F.col("x")[0]).alias("x0"), _r(F.col("x")[1]).alias("x1"))


_x = lambda i: f"(2 * {K.uniform('logreg-x', '5', str(i), 'row_id')} - 1)"


@query(
    "logreg_data",
    f"SELECT row_id, round({_x(0)}, 6) AS x0, round({_x(1)}, 6) AS x1, CAST(CASE WHEN {K.uniform('logreg-y', '5', 'row_id')} < 1 / (1 + exp(-({_x(0)} - 2 * {_x(1)} + CAST(0.5 AS DOUBLE)))) THEN 1 ELSE -1 END AS DOUBLE) AS y FROM (SELECT o_orderkey AS row_id FROM orders)",
)
def logreg_data(spark, d):
    return made_rows(spark, d, 0.5, "uniform")


def made_rows(spark, d, intercept: float, kind: str):
    x, y = D.logistic_row([1.0, -2.0], intercept, kind, 5, F.col("row_id"))
    return keys(spark, d).select("row_id", _r(x[0]).alias("x0"), _r(x[1]).alias("x1"), y.alias("y"))


_n = lambda i: K.normal("logreg-x", "5", str(i), "row_id")


@query(
    "logreg_data_normal",
    f"SELECT row_id, round({_n(0)}, 6) AS x0, round({_n(1)}, 6) AS x1, CAST(CASE WHEN {K.uniform('logreg-y', '5', 'row_id')} < 1 / (1 + exp(-({_n(0)} - 2 * {_n(1)}))) THEN 1 ELSE -1 END AS DOUBLE) AS y FROM (SELECT o_orderkey AS row_id FROM orders)",
)
def logreg_data_normal(spark, d):
    """Normal rows without an intercept."""
    return made_rows(spark, d, 0.0, "normal")


_raw = """raw AS (SELECT c_custkey AS id, CAST(17 + c_custkey % 70 AS DOUBLE) AS "AGEP", CAST(1 + c_custkey % 8 AS DOUBLE) AS "COW", CAST(c_custkey % 25 AS DOUBLE) AS "SCHL", CAST(1 + c_custkey % 5 AS DOUBLE) AS "MAR",
CAST(c_custkey % 90 AS DOUBLE) AS "WKHP", CAST(1 + c_custkey % 2 AS DOUBLE) AS "SEX", CASE WHEN c_acctbal < 0 THEN CAST('nan' AS DOUBLE) ELSE c_acctbal * 6 END AS "PINCP" FROM customer)"""


def raw(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), (F.lit(17) + k % 70).cast("double").alias("AGEP"), (F.lit(1) + k % 8).cast("double").alias("COW"), (k % 25).cast("double").alias("SCHL"), (F.lit(1) + k % 5).cast("double").alias("MAR"),
        (k % 90).cast("double").alias("WKHP"), (F.lit(1) + k % 2).cast("double").alias("SEX"), F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(F.col("c_acctbal") * 6).alias("PINCP"),
    )


_dummies = ", ".join(f'CAST("{c}" IN ({", ".join(map(str, codes))}) AS INTEGER) AS "{name}"' for name, (c, codes) in survey.GROUPS.items())


@query(
    "survey_prepare",
    f"""WITH {_raw}, f AS (SELECT * FROM raw WHERE "AGEP" > 16 AND ("PINCP" > 100 OR isnan("PINCP")) AND "WKHP" > 0), g AS (SELECT * REPLACE (CASE WHEN isnan("PINCP") THEN 0 ELSE "PINCP" END AS "PINCP") FROM f)
SELECT id, round("AGEP" / 99, 9) AS "AGEP", round("SCHL" / 24, 9) AS "SCHL", round("WKHP" / 99, 9) AS "WKHP", "SEX" - 1 AS "SEX", {_dummies}, CAST(CASE WHEN "PINCP" > 30000 THEN 1 ELSE -1 END AS INTEGER) AS "PINCP" FROM g""",
)
def survey_prepare(spark, d):
    out = survey.prepare(raw(spark, d))
    return out.withColumns({c: _r(F.col(c), 9) for c in ("AGEP", "SCHL", "WKHP")})


@query("scale_guard", 'SELECT l_linestatus, round(sum(l_quantity / 50), 6) AS q, round(sum(l_discount), 6) AS d FROM lineitem GROUP BY l_linestatus')
def scale_guard(spark, d):
    out = survey.guarded_scale(table(spark, d, "lineitem").select("l_linestatus", "l_quantity", "l_discount"), {"l_quantity": 50.0, "l_discount": 0.1})
    return out.groupBy("l_linestatus").agg(_r(F.sum("l_quantity")).alias("q"), _r(F.sum("l_discount")).alias("d"))


@query("onehot_regroup", "SELECT c_custkey, CAST(c_nationkey IN (1, 2) AS INTEGER) AS a, CAST(c_nationkey IN (3, 4, 5) AS INTEGER) AS b FROM customer")
def onehot_regroup(spark, d):
    k = F.col("c_nationkey")
    return table(spark, d, "customer").select("c_custkey", survey.one_hot(k, (1, 2)).alias("a"), survey.one_hot(k, (3, 4, 5)).alias("b"))


@query("key_join", "SELECT o_orderkey, c_acctbal, CAST(CASE WHEN o_totalprice > 150000 THEN 1 ELSE -1 END AS DOUBLE) AS y FROM orders JOIN customer ON c_custkey = o_custkey")
def key_join(spark, d):
    features = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = survey.feature_rows(features.withColumn("label", F.when(F.col("o_totalprice") > 150000, 1).otherwise(-1)), ["c_acctbal"], "label", "o_orderkey")
    return rows.select("o_orderkey", F.col("x")[0].alias("c_acctbal"), "y")


@query("label_sums", "SELECT l_returnflag, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS positive, round(sum(l_tax), 6) AS tax FROM lineitem GROUP BY l_returnflag")
def label_sums(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum((F.col("l_discount") > 0.05).cast("int")).alias("positive"), _r(F.sum("l_tax")).alias("tax"))


# Result tables: every order is one row of an experiment's width table.
_trials = "t AS (SELECT o_orderkey AS id, 300 + 100 * (o_orderkey % 5) AS n, o_custkey % 200 AS trial, o_orderkey % 3 AS resamp, floor(o_totalprice) / 1000 AS proper_unstud, floor(o_totalprice) / 900 + 1 AS boot_unstud_priv FROM orders)"


def trials(spark, d):
    k, p = F.col("o_orderkey"), F.floor("o_totalprice")
    return table(spark, d, "orders").select(
        k.alias("id"), (F.lit(300) + F.lit(100) * (k % 5)).alias("n"), (F.col("o_custkey") % 200).alias("trial"), (k % 3).alias("resamp"),
        (p / F.lit(1000.0)).alias("proper_unstud"), (p / F.lit(900.0) + F.lit(1.0)).alias("boot_unstud_priv"),
    )


_dedup = f"{_trials}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, trial, resamp ORDER BY id) AS k FROM t) WHERE k = 1)"


def unique_trials(spark, d):
    return experiment.first_per_key(trials(spark, d), ["n", "trial", "resamp"], ["id"])


@query("dedup_first", f"WITH {_dedup} SELECT n, trial, resamp, id FROM u")
def dedup_first(spark, d):
    return unique_trials(spark, d).select("n", "trial", "resamp", "id")


@query("rel_width", f"WITH {_dedup} SELECT id, round(proper_unstud / boot_unstud_priv, 6) AS proper_unstud, round(boot_unstud_priv / boot_unstud_priv, 6) AS boot_unstud_priv FROM u")
def rel_width(spark, d):
    m = ["proper_unstud", "boot_unstud_priv"]
    return experiment.relative(unique_trials(spark, d), m, "boot_unstud_priv").select("id", *[_r(F.col(c)).alias(c) for c in m])


for _center, _f in (("mean", "avg"), ("median", "median")):

    query(f"summary_{_center}_se", f"WITH {_dedup} SELECT n, round({_f}(proper_unstud), 6) AS value, round(stddev_samp(proper_unstud) / sqrt(count(*)), 6) AS se, count(*) AS rows FROM u GROUP BY n")(
        lambda spark, d, center=_center: experiment.summary(unique_trials(spark, d), ["n"], "proper_unstud", center).select("n", _r(F.col("value")).alias("value"), _r(F.col("se")).alias("se"), F.col("rows"))
    )


@query("long_results", f"WITH {_dedup} SELECT id, 'proper_unstud' AS method, round(proper_unstud, 6) AS value FROM u UNION ALL SELECT id, 'boot_unstud_priv', round(boot_unstud_priv, 6) FROM u")
def long_results(spark, d):
    out = experiment.long_form(unique_trials(spark, d), ["id"], ["proper_unstud", "boot_unstud_priv"])
    return out.select("id", "method", _r(F.col("value")).alias("value"))


@query("filtered_min", f"WITH {_trials} SELECT round(min(proper_unstud), 6) AS value FROM t WHERE n = 500")
def filtered_min(spark, d):
    return trials(spark, d).filter("n = 500").agg(_r(F.min("proper_unstud")).alias("value"))


@query("union_runs", f"WITH {_trials} SELECT run, count(*) AS rows, round(sum(proper_unstud), 3) AS total FROM (SELECT 'a' AS run, proper_unstud FROM t WHERE resamp = 0 UNION ALL SELECT 'b', proper_unstud FROM t WHERE resamp <> 0) GROUP BY run")
def union_runs(spark, d):
    t = trials(spark, d)
    both = t.filter("resamp = 0").withColumn("run", F.lit("a")).unionByName(t.filter("resamp <> 0").withColumn("run", F.lit("b")))
    return both.groupBy("run").agg(F.count("*").alias("rows"), _r(F.sum("proper_unstud"), 3).alias("total"))


@query(
    "coverage_eval",
    f"""WITH {_trials}, e AS (SELECT id, n, proper_unstud AS est FROM t), i AS (SELECT * FROM (VALUES ('narrow', -400.0, 400.0), ('wide', -900.0, 1200.0), ('low', -600.0, CAST('infinity' AS DOUBLE))) v(method, l, u))
SELECT method, n, round(avg(CASE WHEN 150 BETWEEN est + l / 20 AND est + CAST(u AS DOUBLE) / 20 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg((CAST(u AS DOUBLE) - l) / 20), 6) AS width FROM e, i GROUP BY method, n""",
)
def coverage_eval(spark, d):
    intervals = spark.createDataFrame([("narrow", -400.0, 400.0), ("wide", -900.0, 1200.0), ("low", -600.0, float("inf"))], "method string, l double, u double")
    out = experiment.evaluate(trials(spark, d).select("id", "n", F.col("proper_unstud").alias("est")), intervals, [], 150.0, 400)
    return out.groupBy("method", "n").agg(_r(F.avg("covered")).alias("coverage"), _r(F.avg("width")).alias("width"))


# Files: written to the shared folder, read back, and cut from it by a checkpoint before the folder goes.
def through_files(spark, write, read):
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    write(folder)
    out = checkpointed(read(folder))
    removed(spark, folder)
    return out


@query("csv_scan", f"""WITH {_raw} SELECT id, "AGEP", "SCHL", "WKHP" FROM raw""")
def csv_scan(spark, d):
    """Sink and scan of CSV with a choice of columns."""
    return through_files(spark, lambda f: files.write_csv(raw(spark, d), f), lambda f: files.read_csv(spark, f, raw(spark, d).schema).select("id", "AGEP", "SCHL", "WKHP"))


@query("survey_scan", f"""WITH {_raw} SELECT "AGEP", "COW", "SCHL", "MAR", "WKHP", "SEX", "PINCP", CAST(id % 3 AS DOUBLE) AS "PWGTP" FROM raw""")
def survey_scan(spark, d):
    """A survey file with columns in another order, one that is not asked for, and person weights."""
    own = raw(spark, d).select((F.col("id") % 3).alias("PWGTP"), F.col("id").alias("SERIALNO"), *reversed(survey.RAW.names))
    return through_files(spark, lambda f: files.write_csv(own, f), lambda f: files.read_survey(spark, f))


@query(
    "survey_weighted",
    f"""WITH {_raw} SELECT CAST("SEX" - 1 AS INTEGER) AS sex, count(*) AS persons, CAST(sum(CASE WHEN "PINCP" > 30000 AND NOT isnan("PINCP") THEN 1 ELSE 0 END) AS BIGINT) AS high FROM raw WHERE "AGEP" > 16 AND ("PINCP" > 100 OR isnan("PINCP")) AND "WKHP" > 0 AND id % 3 >= 1 GROUP BY 1""",
)
def survey_weighted(spark, d):
    """The prepared survey of a file with person weights: persons without weight are out."""
    own = raw(spark, d).withColumn("PWGTP", F.col("id") % 3)
    read = through_files(spark, lambda f: files.write_csv(own, f), lambda f: files.read_survey(spark, f))
    return survey.prepare(read).groupBy(F.col("SEX").cast("int").alias("sex")).agg(F.count("*").alias("persons"), F.count_if(F.col("PINCP") == 1).alias("high"))


@query("run_directory", f"WITH {_trials} SELECT n, kind, run_id, count(*) AS rows, round(sum(proper_unstud), 3) AS total FROM (SELECT n, 'len' AS kind, CASE WHEN resamp = 0 THEN 'm1d1v0' ELSE 'm1d1v1' END AS run_id, proper_unstud FROM t) WHERE n = 500 GROUP BY ALL")
def run_directory(spark, d):
    """Runs written one after another under the next free id, partitioned by kind, run and n; one n read back."""
    t = trials(spark, d)

    def write(folder):
        for part in ("resamp = 0", "resamp <> 0"):
            experiment.write_run(t.filter(part), folder, experiment.claim_run_id(spark, folder, "m1d1"), "len")

    out = through_files(spark, write, lambda f: experiment.read_runs(spark, f, "len", 500))
    return out.groupBy(F.col("n").cast("long").alias("n"), "kind", "run_id").agg(F.count("*").alias("rows"), _r(F.sum("proper_unstud"), 3).alias("total"))


# Sizes of studies on the lines of each ship date and flag: n is how many there are.
_budgets = [10.0, 8.0, 5.0]
_cases = f"c AS (SELECT l_shipdate, l_returnflag, CAST(count(*) AS DOUBLE) AS n, CAST(e AS DOUBLE) AS eps FROM lineitem, (VALUES {', '.join(f'({e})' for e in _budgets)}) v(e) GROUP BY 1, 2, 4 HAVING count(*) >= 10)"
_clamp = lambda x: f"CAST(floor(least(greatest({x}, 100), 10000)) AS BIGINT)"


@query(
    "study_sizes",
    f"""WITH {_cases}, k AS (SELECT *, CAST(ceil(10 * ln(n) / (eps / 2)) AS BIGINT) AS s, CAST(ceil(20 * ln(n) / (eps / 2)) AS BIGINT) AS s2, CAST(ceil(least(5 / eps * sqrt(n), n / 5.0)) AS BIGINT) AS z FROM c),
m AS (SELECT *, floor(n / s) AS b, floor(n / z) AS bz FROM k)
SELECT l_shipdate, l_returnflag, CAST(n AS BIGINT) AS n, eps, s AS chunks, CAST(b AS BIGINT) AS b, {_clamp('sqrt(n) * b / ln(n)')} AS runs, {_clamp('pow(n, 1.5) / ln(n)')} AS boot_runs, s2 AS chunks_eqtail, z AS chunks_zcdp, CAST(bz AS BIGINT) AS b_zcdp, CAST(floor(sqrt(n) * bz / ln(n)) AS BIGINT) AS runs_zcdp,
CAST(floor(least(sqrt(n) * b / ln(n), 1e6 * b / n)) AS BIGINT) AS runs_survey, round(2500 * 4.0 / n, 9) AS bound_by_sd, round(pow(140.0 / 4 * 10, 2) / n, 6) AS bound_by_width, round(pow(n, -1.5), 12) AS granularity FROM m""",
)
def study_sizes(spark, d):
    """The sizing rules of all studies for every group of lines and every budget."""
    groups = table(spark, d, "lineitem").groupBy("l_shipdate", "l_returnflag").agg(F.count("*").alias("n")).filter("n >= 10")
    cases = groups.withColumn("eps", F.explode(F.array(*[F.lit(e) for e in _budgets])))
    n, eps = F.col("n").cast("double"), F.col("eps")
    one, two, z = chunking.sizing_columns(n, eps / 2), chunking.sizing_columns(n, eps / 2, "eqtail"), chunking.zcdp_sizing_columns(n, eps)
    whole = {"chunks": one["chunks"], "b": one["b"], "runs": one["runs"], "boot_runs": one["boot_runs"], "chunks_eqtail": two["chunks"], "chunks_zcdp": z["chunks"], "b_zcdp": z["b"], "runs_zcdp": z["runs"], "runs_survey": chunking.survey_runs_column(n, eps / 2)}
    bounds = {"bound_by_sd": _r(chunking.variance_bound(n, sd=2.0), 9), "bound_by_width": _r(chunking.variance_bound(n, width=140.0)), "granularity": _r(chunking.granularity(n), 12)}
    return cases.select("l_shipdate", "l_returnflag", "n", "eps", *[c.cast("long").alias(k) for k, c in whole.items()], *[c.alias(k) for k, c in bounds.items()])


@query(
    "budget_ledger",
    """WITH d AS (SELECT c_custkey, 1 + (c_custkey % 20) / CAST(2 AS DOUBLE) AS eps FROM customer)
SELECT c_custkey, eps, 'estimate' AS release, eps * 0.5 AS each, CAST(5 AS INTEGER) AS uses, eps * 0.5 * 5 AS spent FROM d UNION ALL SELECT c_custkey, eps, 'threshold', eps / 4, CAST(155 AS INTEGER), eps / 4 * 155 FROM d UNION ALL SELECT c_custkey, eps, 'queries', eps / 4, CAST(5 AS INTEGER), eps / 4 * 5 FROM d""",
)
def budget_ledger(spark, d):
    """What a search over 31 candidates in five dimensions spends for the budget of each customer, threshold redraws charged."""
    rows = table(spark, d, "customer").select("c_custkey", (F.lit(1.0) + (F.col("c_custkey") % 20) / F.lit(2.0)).alias("eps"))
    return rows.select("c_custkey", "eps", F.explode(study_releases(F.col("eps"), 0.5, 31, 5)).alias("e")).select("c_custkey", "eps", "e.*")


@query("interval_order", "SELECT o_orderkey, CAST(o_totalprice * 1.1 < 150000 AS INTEGER) AS below, CAST(o_totalprice * 0.9 > 150000 AS INTEGER) AS above, CAST(150000 BETWEEN o_totalprice * 0.9 AND o_totalprice * 1.1 AS INTEGER) AS holds FROM orders")
def interval_order(spark, d):
    low, high, x = F.col("o_totalprice") * F.lit(0.9), F.col("o_totalprice") * F.lit(1.1), F.lit(150000.0)
    return table(spark, d, "orders").select("o_orderkey", mechanisms.below(high, x).alias("below"), mechanisms.above(low, x).alias("above"), mechanisms.in_interval(x, low, high).alias("holds"))
