"""Queries of logistic regression, zCDP intervals and the estimators refitted per resample."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from veilstat.functions.keyed import KeyedSql as K
from veilstat.functions.session import checkpointed, removed, shared_folder
from veilstat.functions.special import normal_quantile
from veilstat.operators import chunking, intervals, logistic, private_logistic, resampling, survey, variance, zcdp
from veilstat.operators.histograms import Bins
from veilstat.operators.logistic_trial import LogisticStudy, Population, logistic_trials_of, zcdp_survey_of, zcdp_synthetic_of
from veilstat.operators.study import Goal, run_study
from veilstat.operators.trial import Study, trials_of
from veilstat.plans import resampling as R
from veilstat.plans import sqltext as S
from veilstat.plans.registry import query
from veilstat.sources.tables import table

_r = lambda c, n=6: F.round(c, n)
BETA = [0.4, -0.7]
_rows = "rows AS (SELECT l_quantity / 50 AS x0, l_discount * 10 AS x1, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS DOUBLE) AS y FROM lineitem)"
_m = "(y * (CAST(0.4 AS DOUBLE) * x0 - CAST(0.7 AS DOUBLE) * x1))"
_s = f"(1 / (1 + exp({_m})))"  # sigmoid of minus the margin


def lines(spark, d):
    x = F.array(F.col("l_quantity") / F.lit(50.0), F.col("l_discount") * F.lit(10.0))
    return table(spark, d, "lineitem").select(x.alias("x"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"))


@query("logreg_obj", f"WITH {_rows} SELECT round(avg(ln(1 + exp(-{_m}))), 6) AS objective FROM rows")
def logreg_obj(spark, d):
    return logistic.objective(lines(spark, d), BETA).withColumn("objective", _r(F.col("objective")))


@query("logreg_grad", f"WITH {_rows} SELECT round(-avg({_s} * y * x0), 6) AS g0, round(-avg({_s} * y * x1), 6) AS g1 FROM rows")
def logreg_grad(spark, d):
    return logistic.gradient(lines(spark, d), BETA).select(_r(F.col("g0")).alias("g0"), _r(F.col("g1")).alias("g1"))


_w = f"({_s} * (1 - {_s}))"


@query("logreg_hess", f"WITH {_rows} SELECT round(avg({_w} * x0 * x0), 6) AS h0_0, round(avg({_w} * x0 * x1), 6) AS h0_1, round(avg({_w} * x1 * x1), 6) AS h1_1 FROM rows")
def logreg_hess(spark, d):
    h = logistic.hessian(lines(spark, d), BETA)
    return h.select(*[_r(F.col(c)).alias(c) for c in h.columns])


_gh = f"{_rows}, a AS (SELECT -avg({_s} * y * x0) AS g0, -avg({_s} * y * x1) AS g1, avg({_w} * x0 * x0) + 1e-6 AS h00, avg({_w} * x0 * x1) AS h01, avg({_w} * x1 * x1) + 1e-6 AS h11, avg({_s} * {_s} * x0 * x0) AS o00, avg({_s} * {_s} * x0 * x1) AS o01, avg({_s} * {_s} * x1 * x1) AS o11 FROM rows)"


@query("newton_step", f"WITH {_gh} SELECT round(0.4 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), 6) AS b0, round(-0.7 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), 6) AS b1 FROM a")
def newton_step(spark, d):
    b = logistic.newton_step(lines(spark, d), BETA)
    return spark.createDataFrame([(round(b[0], 6), round(b[1], 6))], "b0 double, b1 double")


@query(
    "sandwich",
    f"""WITH {_gh}, i AS (SELECT h11 / (h00 * h11 - h01 * h01) AS a, -h01 / (h00 * h11 - h01 * h01) AS b, h00 / (h00 * h11 - h01 * h01) AS c, o00, o01, o11 FROM a)
SELECT round(a * a * o00 + 2 * a * b * o01 + b * b * o11, 4) AS s00, round(a * b * o00 + (a * c + b * b) * o01 + b * c * o11, 4) AS s01, round(b * b * o00 + 2 * b * c * o01 + c * c * o11, 4) AS s11 FROM i""",
)
def sandwich(spark, d):
    s = logistic.sandwich(lines(spark, d), BETA, 1e-6)
    return spark.createDataFrame([(round(float(s[0, 0]), 4), round(float(s[0, 1]), 4), round(float(s[1, 1]), 4))], "s00 double, s01 double, s11 double")


_root2 = lambda a, b, c: (f"sqrt({a} * {c} - {b} * {b})", f"sqrt({a} + {c} + 2 * sqrt({a} * {c} - {b} * {b}))")


@query("hess_inv_square", f"WITH {_gh.replace('1e-6', '1e-10')}, i AS (SELECT h11 / (h00 * h11 - h01 * h01) AS a, -h01 / (h00 * h11 - h01 * h01) AS b, h00 / (h00 * h11 - h01 * h01) AS c FROM a) SELECT round(a * a + b * b, 4) AS q00, round(a * b + b * c, 4) AS q01, round(b * b + c * c, 4) AS q11 FROM i")
def hess_inv_square(spark, d):
    q = logistic.inverse_hessian_square(lines(spark, d), BETA)
    return spark.createDataFrame([(round(float(q[0, 0]), 4), round(float(q[0, 1]), 4), round(float(q[1, 1]), 4))], "q00 double, q01 double, q11 double")


_sand = f"""WITH {_gh.replace('1e-6', '1e-10')}, i AS (SELECT h11 / (h00 * h11 - h01 * h01) AS a, -h01 / (h00 * h11 - h01 * h01) AS b, h00 / (h00 * h11 - h01 * h01) AS c, o00, o01, o11 FROM a),
s AS (SELECT a * a * o00 + 2 * a * b * o01 + b * b * o11 AS x, a * b * o00 + (a * c + b * b) * o01 + b * c * o11 AS y, b * b * o00 + 2 * b * c * o01 + c * c * o11 AS z FROM i)"""


@query("logreg_std", f"{_sand} SELECT round((x + {_root2('x', 'y', 'z')[0]}) / {_root2('x', 'y', 'z')[1]}, 4) AS r00, round(y / {_root2('x', 'y', 'z')[1]}, 4) AS r01, round((z + {_root2('x', 'y', 'z')[0]}) / {_root2('x', 'y', 'z')[1]}, 4) AS r11 FROM s")
def logreg_std(spark, d):
    r = logistic.deviation(lines(spark, d), BETA)
    return spark.createDataFrame([(round(float(r[0, 0]), 4), round(float(r[0, 1]), 4), round(float(r[1, 1]), 4))], "r00 double, r01 double, r11 double")


_steps = [[0.1 * k - 0.4, 0.3 - 0.05 * k] for k in range(8)]
_each = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, CAST({i} AS INTEGER) AS dim, round(-avg(y * x{i} / (1 + exp(y * (CAST({b[0]!r} AS DOUBLE) * x0 + CAST({b[1]!r} AS DOUBLE) * x1)))), 6) AS value FROM rows" for k, b in enumerate(_steps) for i in (0, 1))


@query("logreg_gradients", f"WITH {_rows} {_each}")
def logreg_gradients(spark, d):
    return logistic.gradients(lines(spark, d), np.array(_steps)).withColumn("value", _r(F.col("value")))


# Newton steps unrolled: each is one aggregate at the point of the step before, solved by cofactors.
_wide_rows = f"{_rows}, data AS (SELECT x0, x1, CAST(1 AS DOUBLE) AS x2, y FROM rows)"


def derivative_sql(name: str, point: str, d: int, source: str = "data") -> str:
    """CTE `name`: the point b0.., gradient g0.. and Hessian h00.. at it, and the sandwich's middle o00..; means over the rows."""
    m = " + ".join(f"b{i} * x{i}" for i in range(d))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    columns = [f"avg(-s * y * x{i}) AS g{i}" for i in range(d)] + [f"avg(s * (1 - s) * x{i} * x{j}) AS h{i}{j}" for i, j in pairs] + [f"avg(s * s * x{i} * x{j}) AS o{i}{j}" for i, j in pairs]
    at = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(d))
    return f"{name} AS (SELECT {at}, {', '.join(columns)} FROM (SELECT *, 1 / (1 + exp(y * ({m}))) AS s FROM {source}, {point}))"


def solved_sql(name: str, source: str, d: int, ridge: str, right: list[str], out: list[str]) -> str:
    """CTE `name`: all of `source`, and as `out` the solution for the Hessian h00.. plus ridge and a right side."""
    h = lambda i, j: f"(h{min(i, j)}{max(i, j)}{f' + {ridge}' if i == j else ''})"
    if d == 2:
        det, inverse = f"({h(0, 0)} * {h(1, 1)} - {h(0, 1)} * {h(0, 1)})", {(0, 0): h(1, 1), (0, 1): f"(-{h(0, 1)})", (1, 1): h(0, 0)}
    else:
        minor = lambda a, b, c, e: f"({h(*a)} * {h(*b)} - {h(*c)} * {h(*e)})"
        inverse = {
            (0, 0): minor((1, 1), (2, 2), (1, 2), (1, 2)), (0, 1): minor((0, 2), (1, 2), (0, 1), (2, 2)), (0, 2): minor((0, 1), (1, 2), (0, 2), (1, 1)),
            (1, 1): minor((0, 0), (2, 2), (0, 2), (0, 2)), (1, 2): minor((0, 1), (0, 2), (0, 0), (1, 2)), (2, 2): minor((0, 0), (1, 1), (0, 1), (0, 1)),
        }
        det = "(" + " + ".join(f"{h(0, j)} * {inverse[0, j]}" for j in range(3)) + ")"
    rows = [" + ".join(f"{inverse[min(i, j), max(i, j)]} * ({right[j]})" for j in range(d)) for i in range(d)]
    return f"{name} AS (SELECT *, {', '.join(f'({r}) / {det} AS {o}' for r, o in zip(rows, out, strict=True))} FROM {source})"


def fitted_sql(d: int, steps: int = 9) -> str:
    """CTEs up to `fitted` (b0..): Newton steps from zero with the fit's ridge."""
    out, point = [], f"(SELECT {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(d))})"
    for k in range(steps):
        out += [derivative_sql(f"d{k}", point, d), solved_sql(f"s{k}", f"d{k}", d, "1e-6", [f"g{i}" for i in range(d)], [f"q{i}" for i in range(d)])]
        out.append(f"p{k} AS (SELECT {', '.join(f'b{i} - q{i} AS b{i}' for i in range(d))} FROM s{k})")
        point = f"p{k}"
    return ", ".join([*out, f"fitted AS (SELECT * FROM {point})"])


def _dims(spark, values):
    return spark.createDataFrame([(i, round(float(v), 5)) for i, v in enumerate(values)], "dim int, value double")


@query("logreg_fit", f"WITH {_wide_rows}, {fitted_sql(3)} {' UNION ALL '.join(f'SELECT CAST({i} AS INTEGER) AS dim, round(b{i}, 5) AS value FROM fitted' for i in range(3))}")
def logreg_fit(spark, d):
    return _dims(spark, logistic.fit(logistic.with_intercept(lines(spark, d)), 3, tolerance=1e-8))


_at_fit = f"WITH {_wide_rows}, {fitted_sql(2)}, {derivative_sql('a', 'fitted', 2)}, i AS (SELECT *, (h11 + 1e-10) / v AS u, -h01 / v AS m, (h00 + 1e-10) / v AS w FROM (SELECT *, (h00 + 1e-10) * (h11 + 1e-10) - h01 * h01 AS v FROM a)), s AS (SELECT *, u * u * o00 + 2 * u * m * o01 + m * m * o11 AS x, u * m * o00 + (u * w + m * m) * o01 + m * w * o11 AS y, m * m * o00 + 2 * m * w * o01 + w * w * o11 AS z FROM i)"
_roots = _root2("x", "y", "z")
_cells = [(0, 0, f"(x + {_roots[0]}) / {_roots[1]}", "u * u + m * m"), (0, 1, f"y / {_roots[1]}", "u * m + m * w"), (1, 0, f"y / {_roots[1]}", "u * m + m * w"), (1, 1, f"(z + {_roots[0]}) / {_roots[1]}", "m * m + w * w")]


@query("logreg_deviation", f"{_at_fit} {' UNION ALL '.join(f'SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round({a}, 4) AS deviation, round({b}, 4) AS hess_inv_square FROM s' for i, j, a, b in _cells)}")
def logreg_deviation(spark, d):
    rows = lines(spark, d)
    b = logistic.fit(rows, 2, tolerance=1e-8)
    dev, square = logistic.deviation(rows, b), logistic.inverse_hessian_square(rows, b)
    return spark.createDataFrame([(i, j, round(float(dev[i, j]), 4), round(float(square[i, j]), 4)) for i in range(2) for j in range(2)], "i int, j int, deviation double, hess_inv_square double")


_gamma = "gamma"
_z = [K.normal("sphere", "1", str(i)) for i in range(3)]
_scale = f"(2 * 1.5 / ((SELECT count(*) FROM rows) * CAST(8 AS DOUBLE)) * ({' + '.join(f'(-ln({K.uniform(_gamma, str(1), str(i))}))' for i in range(3))}) / sqrt({' + '.join(f'{z} * {z}' for z in _z)}))"
_private = f"WITH {_wide_rows}, {fitted_sql(3)}, {derivative_sql('a', 'fitted', 3)}, {solved_sql('r', 'a', 3, '1e-7', _z, ['q0', 'q1', 'q2'])}"


@query("private_logreg", f"{_private} {' UNION ALL '.join(f'SELECT CAST({i} AS INTEGER) AS dim, round(b{i} + {_scale} * q{i}, 5) AS value FROM r' for i in range(3))}")
def private_logreg(spark, d):
    return _dims(spark, private_logistic.private_fit(lines(spark, d), 2, 8.0, 1.5, 1, intercept=True, tolerance=1e-8))


def documents_rows(spark, d):
    """Labelled documents as regression rows; an inner join by id."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars"))
    x = F.array(F.log1p("n_chars") / F.lit(12.0), F.col("toxic").cast("double"))
    return docs.join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("row_id"), x.alias("x"), F.when(F.col("quality") == 1, 1.0).otherwise(-1.0).alias("y"))


@query("projected_sgd")
def projected_sgd(spark, d):
    return logistic.projected_sgd(documents_rows(spark, d), 2, 5.0)


@query("metropolis_logreg")
def metropolis_logreg(spark, d):
    return private_logistic.metropolis(documents_rows(spark, d), 2, 8.0, 1.5, seed=2, intercept=True, steps=100)


# Refits per resample by multinomial weights: no SQL form; tests compare their law with the drawn form.


def weighted_chunks(spark, d):
    df = R.base(spark, d)
    n, b = R.sized(df)
    return chunking.chunk(df, "id", n, b, S.SEED), n


@query("blb_weighted_mean")
def blb_weighted_mean(spark, d):
    df, n = weighted_chunks(spark, d)
    return resampling.weighted_stats(df, ["v"], n, 200).groupBy("chunk", "dim").agg(F.avg("est").alias("m"), F.var_samp("stat").alias("v"))


@query("blb_weighted_median")
def blb_weighted_median(spark, d):
    df, n = weighted_chunks(spark, d)
    return resampling.weighted_stats(df, ["v"], n, 200, resampling.weighted_median).groupBy("chunk", "dim").agg(F.avg("est").alias("m"), F.var_samp("stat").alias("v"))


def trimmed_mean(rows: np.ndarray) -> float:
    """The mean without the least and the largest tenth of the rows."""
    x = np.sort(rows[:, 0])
    cut = len(x) // 10
    return float(x[cut : len(x) - cut].mean())


@query("blb_plain_estimator")
def blb_plain_estimator(spark, d):
    """An estimator that is a plain function of rows, on each resample's own rows."""
    df, n = weighted_chunks(spark, d)
    return resampling.weighted_stats(df, ["v"], n, 100, resampling.of_rows(trimmed_mean)).groupBy("chunk", "dim").agg(F.avg("est").alias("m"), F.var_samp("stat").alias("v"))


def logistic_stats(spark, d, runs=24):
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / F.lit(10000.0)).alias("x0"), F.lit(1.0).alias("x1"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 1.0).otherwise(-1.0).alias("y")
    )
    n, b = R.sized(rows)
    return resampling.weighted_stats(chunking.chunk(rows, "id", n, b, S.SEED, "all_dim"), ["x0", "x1", "y"], n, runs, logistic.weighted_estimator([0.0, 0.0]))


@query("blb_logreg_alldim")
def blb_logreg_alldim(spark, d):
    return logistic_stats(spark, d).groupBy("chunk", "dim").agg(F.avg("est").alias("m"), F.var_samp("stat").alias("v"))


@query("abthresh_alldim")
def abthresh_alldim(spark, d):
    stats = checkpointed(logistic_stats(spark, d))
    bins = {0: Bins(-40.0, 40.0, 64), 1: Bins(-20.0, 20.0, 64)}
    return intervals.search_dims(stats, bins, 24, S.ALPHA, S.EPS, "symm", seed=4)


@query("blb_std_alldim")
def blb_std_alldim(spark, d):
    return variance.private_deviation(logistic_stats(spark, d), ["dim"], 500.0, 8.0, 0.01, 5)


@query("boot_ci_alldim")
def boot_ci_alldim(spark, d):
    return resampling.quantile_interval(checkpointed(logistic_stats(spark, d)), S.ALPHA, "eqtail", ["chunk", "dim"])


# zCDP: one value a chunk.

_vals = f"{S.statistics(source=S.DROPPED)}, mv AS (SELECT chunk, avg(est) AS m, var_samp(est) AS v FROM stats GROUP BY chunk), k AS (SELECT CAST(count(*) AS DOUBLE) AS s FROM mv)"
_tail = lambda b: f"sqrt(1 + 2 * sqrt(ln(1 / ({b}))) + 2 * ln(1 / ({b})))"


def iterated(prefix: str, x: str, c: str, r: str, cov: str, betas: list[float], rhos: list[float], key: list[str]) -> str:
    """CTEs <prefix>_0.. of a CoinPress run: (c, r, nv) in the scaled values, and <prefix>_all (est, nv) in the values'."""
    out = [f"{prefix}_z AS (SELECT (m.{x} - a.mid) / sqrt({cov}) AS z FROM mv m, (SELECT avg({x}) AS mid FROM mv) a)"]
    last = f"(SELECT ({c}) / sqrt({cov}) AS c, ({r}) / sqrt({cov}) AS r)"
    for i, (beta, rho) in enumerate(zip(betas, rhos, strict=True)):
        half = repr(beta / 2)
        noise = K.normal("coinpress", *key, str(i))
        out.append(f"{prefix}_p{i} AS (SELECT c, r + {_tail(f'{half} / s')} AS clip, s FROM {last} p, k)")
        out.append(
            f"""{prefix}_{i} AS (SELECT sum(greatest(p.c - p.clip, least(p.c + p.clip, z))) / max(p.s) + max(2 * p.clip / p.s / sqrt(2 * CAST({rho!r} AS DOUBLE))) * {noise} AS c,
max({_tail(half)} * sqrt(1 / p.s + 2 * p.clip * p.clip / (p.s * p.s * {rho!r}))) AS r, max(pow(2 * p.clip / p.s / sqrt(2 * CAST({rho!r} AS DOUBLE)), 2)) AS nv FROM {prefix}_z, {prefix}_p{i} p)"""
        )
        last = f"{prefix}_{i}"
    union = " UNION ALL ".join(f"SELECT {i} AS step, c * sqrt({cov}) + (SELECT avg({x}) FROM mv) AS est, nv * ({cov}) AS nv FROM {prefix}_{i}" for i in range(len(betas)))
    return ", ".join([*out, f"{prefix}_all AS ({union})"])


def chunk_values(spark, d):
    return checkpointed(resampling.means_and_variances(R.dropped_stats(spark, d), ["chunk"]))


_three = (zcdp.budgets(0.01, 3), zcdp.budgets(0.5, 3))


@query("coinpress_step", f"WITH {_vals}, {iterated('a', 'm', '40.0', '30.0', '4.0', [0.01], [0.5], ['1', chr(39) + 'step' + chr(39)])} SELECT CAST(step AS INTEGER) AS step, round(est, 5) AS est, round(nv, 5) AS noise_var FROM a_all")
def coinpress_step(spark, d):
    v = chunk_values(spark, d)
    out = zcdp.mean_iterative(v, "m", 40.0, 30.0, 4.0, [0.01], [0.5], v.count(), 1, "step")
    return spark.createDataFrame([(i, round(x["est"], 5), round(x["noise_var"], 5)) for i, x in enumerate(out)], "step int, est double, noise_var double")


@query("coinpress_iter", f"WITH {_vals}, {iterated('a', 'm', '40.0', '30.0', '4.0', *_three, ['1', chr(39) + 'iter' + chr(39)])} SELECT CAST(step AS INTEGER) AS step, round(est, 5) AS est, round(nv, 5) AS noise_var FROM a_all")
def coinpress_iter(spark, d):
    v = chunk_values(spark, d)
    out = zcdp.mean_iterative(v, "m", 40.0, 30.0, 4.0, *_three, v.count(), 1, "iter")
    return spark.createDataFrame([(i, round(x["est"], 5), round(x["noise_var"], 5)) for i, x in enumerate(out)], "step int, est double, noise_var double")


@query("inverse_variance", "SELECT event_type, round(sum(value / (1 + value)) / sum(1 / (1 + value)), 6) AS est, round(1 / sum(1 / (1 + value)), 9) AS var FROM events GROUP BY event_type")
def inverse_variance(spark, d):
    out = zcdp.inverse_variance(table(spark, d, "events").withColumn("w", F.lit(1.0) + F.col("value")), ["event_type"], "value", "w")
    return out.select("event_type", _r(F.col("est")).alias("est"), _r(F.col("var"), 9).alias("var"))


@query("zcdp_scalars", "SELECT c_custkey, round(pow(sqrt(8 + ln(1.0 * c_custkey + 2)) - sqrt(ln(1.0 * c_custkey + 2)), 2), 7) AS rho, round(sqrt(3 + 2 * sqrt(3 * ln(1.0 * c_custkey + 2)) + 2 * ln(1.0 * c_custkey + 2)), 7) AS tail FROM customer")
def zcdp_scalars(spark, d):
    chance = F.lit(1.0) / (F.col("c_custkey").cast("double") + F.lit(2.0))
    return table(spark, d, "customer").select("c_custkey", _r(zcdp.eps_to_rho(8.0, chance), 7).alias("rho"), _r(zcdp.gaussian_tailbound(3, chance), 7).alias("tail"))


_rho, _b = 0.8, 0.01
_cov_key, _mean_key = ["2", "'cov'"], ["2", "'mean'"]
_ci = f"""WITH {_vals}, {iterated('q', 'v', '1.0', '5.0', '1.0', zcdp.budgets(_b / 8, 5), zcdp.budgets(_rho / 2, 5), _cov_key)},
w AS (SELECT sum(est / nv) / sum(1 / nv) AS est, 1 / sum(1 / nv) AS var FROM q_all),
e AS (SELECT greatest(0, greatest(0, est) + CAST({normal_quantile(1 - _b / 4)!r} AS DOUBLE) * sqrt(var)) AS cov FROM w),
{iterated('p', 'm', '45.0', '30.0', '(SELECT s * cov FROM k, e)', zcdp.budgets(_b / 2, 5), zcdp.budgets(_rho / 2, 5), _mean_key)},
f AS (SELECT sum(est / (nv + cov)) / sum(1 / (nv + cov)) AS est, 1 / sum(1 / (nv + cov)) AS var, max(cov) AS cov FROM p_all, e)
SELECT round(est, 4) AS est, round(est - {normal_quantile(0.975)!r} * sqrt(cov + var), 4) AS l, round(est + {normal_quantile(0.975)!r} * sqrt(cov + var), 4) AS u FROM f"""


@query("gvdp_ci", _ci)
def gvdp_ci(spark, d):
    v = chunk_values(spark, d)
    out = zcdp.private_interval(v, v.count(), 1.0, 5.0, 1.0, 45.0, 30.0, 5, _rho, _b, 0.05, seed=2)
    return spark.createDataFrame([tuple(round(out[c], 4) for c in ("est", "l", "u"))], "est double, l double, u double")


STUDY_ROWS, STUDY_BUDGETS = [300, 500, 1000, 1500, 2000], [10.0, 8.0, 5.0]
# Half widths that the queries ask for, and the reference's numbers of trials as bounds; see the README for what a smaller half width costs.
STUDY_GOAL, ZCDP_GOAL = Goal(half_width=0.14, most=1000), Goal(half_width=0.12, most=10_000)


def through_study(spark, name: str, cells, simulate, goal: Goal, keys=None):
    """A study in a folder of its own, which goes when the study is done; with a folder that stays, a stopped study goes on."""
    folder = f"{shared_folder(spark)}/study-{name}-{uuid.uuid4().hex}"
    out = run_study(spark, folder, cells, simulate, goal, keys)
    removed(spark, folder)
    return out


def one_dim_study(spark, task: str):
    cells = [(n, e) for n in STUDY_ROWS for e in STUDY_BUDGETS]
    first = through_study(spark, task, cells, lambda c: trials_of(c, Study(task=task)), STUDY_GOAL)
    return first.unionByName(through_study(spark, f"{task}-zcdp", cells, lambda c: trials_of(c, Study(task=task, resamples=1, zcdp=True)), ZCDP_GOAL))


@query("study_mean")
def study_mean(spark, d):
    """Coverage with its confidence interval and width of the five one-dimensional methods on generated samples."""
    return one_dim_study(spark, "mean")


@query("study_median")
def study_median(spark, d):
    """Coverage with its confidence interval and width of the four one-dimensional methods for the median on generated samples."""
    return one_dim_study(spark, "median")


def survey_population(spark, d):
    """Survey rows made from the orders, prepared, as (o_orderkey, x, y): x of age, schooling, hours and sex, y whether the income is high."""
    k = F.col("o_orderkey")
    age, school, hours, sex = F.lit(17) + F.col("o_custkey") % 70, k % 25, F.lit(1) + F.floor(F.col("o_totalprice")).cast("long") % 89, F.lit(1) + k % 2
    income = F.lit(8000.0) + F.lit(300.0) * age + F.lit(900.0) * school + F.lit(100.0) * hours + F.lit(9000.0) * (F.col("o_totalprice") % 7.0 - F.lit(3.0))
    raw = table(spark, d, "orders").select(
        "o_orderkey", age.cast("double").alias("AGEP"), F.lit(1.0).alias("COW"), school.cast("double").alias("SCHL"), F.lit(1.0).alias("MAR"), hours.cast("double").alias("WKHP"), sex.cast("double").alias("SEX"),
        F.greatest(F.lit(101.0), income).alias("PINCP"),
    )
    return survey.feature_rows(survey.prepare(raw), ["AGEP", "SCHL", "WKHP", "SEX"], "PINCP", "o_orderkey")


SURVEY_ROWS, SURVEY_BUDGETS, MADE_ROWS = [2000, 4000, 6000, 8000], [8.0, 5.0], [1000, 2000, 4000, 6000]
ALLDIM_GOAL, SURVEY_GOAL, MADE_GOAL = Goal(half_width=0.1, first=4, most=4), Goal(half_width=0.12, first=16, most=100), Goal(half_width=0.12, first=16, most=1000)


def sample_sizes(total: int, sizes: list[int]) -> list[int]:
    """The sizes that a population of this many rows holds; half of a population that is smaller than all."""
    return [n for n in sizes if n <= total] or [total // 2]


@query("study_logreg_alldim")
def study_logreg_alldim(spark, d):
    """Coverage and width of the three methods for all logistic coefficients, on rows drawn from the survey population."""
    rows = Population(survey_population(spark, d), "o_orderkey")
    cells = [(n, 8.0) for n in sample_sizes(rows.total, SURVEY_ROWS)]
    return through_study(spark, "alldim", cells, lambda c: logistic_trials_of(rows, LogisticStudy(), c.select("n", "trial")), ALLDIM_GOAL, ["method", "dim"])


@query("study_logreg_gvdp")
def study_logreg_gvdp(spark, d):
    """Coverage and width of the zCDP interval of a logistic coefficient: survey rows, and made ones."""
    rows = Population(survey_population(spark, d), "o_orderkey")
    cells = [(n, e) for n in sample_sizes(rows.total, SURVEY_ROWS) for e in SURVEY_BUDGETS]
    one = through_study(spark, "survey", cells, lambda c: zcdp_survey_of(rows, c).withColumn("method", F.lit("gvdp-survey")), SURVEY_GOAL)
    made = [(n, e) for n in MADE_ROWS for e in STUDY_BUDGETS]
    two = through_study(spark, "made", made, lambda c: zcdp_synthetic_of(c, [0.5, -1.0, 0.8, 0.0]).withColumn("method", F.lit("gvdp-synthetic")), MADE_GOAL)
    return one.unionByName(two)
