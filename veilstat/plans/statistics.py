"""Queries of the point estimators, quantiles and private releases over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilstat.functions.keyed import KeyedSql as K
from veilstat.functions.keyed import laplace
from veilstat.operators import histograms, mechanisms, selection
from veilstat.operators.histograms import Bins
from veilstat.plans.registry import query
from veilstat.sources.tables import table

_r = lambda c, n=6: F.round(c, n)


@query("mean_by_group", "SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def mean_by_group(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(_r(F.avg("value")).alias("mean"), F.count("*").alias("n"))


@query("std_by_group", "SELECT event_type, round(stddev_samp(value), 6) AS std FROM events GROUP BY event_type")
def std_by_group(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(_r(F.stddev_samp("value")).alias("std"))


@query("median_by_group", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def median_by_group(spark, d):
    return selection.medians(table(spark, d, "events"), "value", ["event_type"]).select("event_type", _r(F.col("value")).alias("median"))


@query("quantile_disc", "SELECT event_type, quantile_disc(value, 0.025) AS q025, quantile_disc(value, 0.5) AS q500, quantile_disc(value, 0.975) AS q975 FROM events GROUP BY event_type")
def quantile_disc(spark, d):
    return selection.quantiles(table(spark, d, "events"), "value", ["event_type"], {"q025": 0.025, "q500": 0.5, "q975": 0.975})


@query(
    "cov_matrix",
    "SELECT round(covar_samp(l_quantity, l_quantity), 6) AS c00, round(covar_samp(l_quantity, l_extendedprice), 4) AS c01, round(covar_samp(l_extendedprice, l_extendedprice) / 1000000, 4) AS c11_millions FROM lineitem",
)
def cov_matrix(spark, d):
    c = lambda a, b: F.covar_samp(f"l_{a}", f"l_{b}")
    return table(spark, d, "lineitem").agg(
        _r(c("quantity", "quantity")).alias("c00"), _r(c("quantity", "extendedprice"), 4).alias("c01"), _r(c("extendedprice", "extendedprice") / F.lit(1000000), 4).alias("c11_millions")
    )


@query(
    "cov_root",
    """WITH c AS (SELECT covar_samp(l_quantity, l_quantity) AS x, covar_samp(l_quantity, l_discount * 100) AS y, covar_samp(l_discount * 100, l_discount * 100) AS z FROM lineitem)
SELECT round((x + sqrt(x * z - y * y)) / sqrt(x + z + 2 * sqrt(x * z - y * y)), 5) AS r00, round(y / sqrt(x + z + 2 * sqrt(x * z - y * y)), 5) AS r01, round((z + sqrt(x * z - y * y)) / sqrt(x + z + 2 * sqrt(x * z - y * y)), 5) AS r11 FROM c""",
)
def cov_root(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("l_discount"))
    r = mechanisms.deviation_matrix(rows, ["l_quantity", "l_discount"])
    return spark.createDataFrame([(round(float(r[0, 0]), 5), round(float(r[0, 1]), 5), round(float(r[1, 1]), 5))], "r00 double, r01 double, r11 double")


@query("laplace_noise", f"SELECT c_custkey, round({K.laplace('0.5', 'lap', '7', 'c_custkey')}, 6) AS noise FROM customer")
def laplace_noise(spark, d):
    return table(spark, d, "customer").select("c_custkey", _r(laplace(0.5, "lap", 7, F.col("c_custkey"))).alias("noise"))


_scale = "CAST(49 AS DOUBLE) / count(l_quantity) / CAST(2 AS DOUBLE)"


@query("priv_mean", f"SELECT l_returnflag, round(m + {K.laplace('s', 'mean', '0', 'l_returnflag')}, 6) AS value FROM (SELECT l_returnflag, avg(l_quantity) AS m, {_scale} AS s FROM lineitem GROUP BY l_returnflag)")
def priv_mean(spark, d):
    return mechanisms.private_mean(table(spark, d, "lineitem"), "l_quantity", 1.0, 50.0, 2.0, ["l_returnflag"]).withColumn("value", _r(F.col("value")))


@query(
    "priv_std",
    f"""SELECT l_returnflag, round(m + {K.laplace('(2500.0 / n + 4900.0 / (n * (n - 1))) / 2', 'std', '0', 'l_returnflag')}, 6) AS value
FROM (SELECT l_returnflag, stddev_samp(l_quantity) AS m, CAST(count(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY l_returnflag)""",
)
def priv_std(spark, d):
    return mechanisms.private_std(table(spark, d, "lineitem"), "l_quantity", 1.0, 50.0, 2.0, ["l_returnflag"]).withColumn("value", _r(F.col("value")))


def median_sql(source: str, x: str, by: str, low: float, high: float, eps: float, rho: float, seed: int = 0) -> str:
    """The exponential-mechanism median per group, over a whole table."""
    shifted = f"""SELECT g, i, n, CASE WHEN i < n // 2 THEN x - {rho} WHEN i >= n - n // 2 THEN x + {rho} ELSE x END AS x FROM ranked""" if rho else "SELECT g, i, n, x FROM ranked"
    clip = f"SELECT g, i, n, greatest(CAST({low} AS DOUBLE), least(CAST({high} AS DOUBLE), x)) AS x FROM moved" if rho else "SELECT * FROM moved"
    far = "CASE WHEN n % 2 = 0 THEN CASE WHEN k > 0 AND k < n THEN abs(n / CAST(2 AS DOUBLE) - k) ELSE n / CAST(2 AS DOUBLE) END WHEN k = 0 OR k = n THEN (n + 1) / CAST(2 AS DOUBLE) WHEN k < (n + 1) / CAST(2 AS DOUBLE) THEN (n + 1) / CAST(2 AS DOUBLE) - k ELSE k - (n - 1) / CAST(2 AS DOUBLE) END"
    return f"""WITH src AS ({source}),
ranked AS (SELECT {by} AS g, CAST({x} AS DOUBLE) AS x, row_number() OVER (PARTITION BY {by} ORDER BY {x}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM src),
moved AS ({shifted}), clipped AS ({clip}),
gaps AS (SELECT g, n, i + 1 AS k, x AS lo, CASE WHEN i = n - 1 THEN CAST({high} AS DOUBLE) ELSE lead(x) OVER (PARTITION BY g ORDER BY i) END AS hi FROM clipped
  UNION ALL SELECT g, n, 0, CAST({low} AS DOUBLE), x FROM clipped WHERE i = 0),
scored AS (SELECT g, k, lo, hi, ln(hi - lo) - ({far}) * CAST({eps / 2} AS DOUBLE) + {K.gumbel('median-gap', str(seed), 'g', 'k')} AS score FROM gaps WHERE hi > lo),
best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, k DESC) AS r FROM scored)
SELECT g AS {by}, round(lo + {K.uniform('median-point', str(seed), 'g')} * (hi - lo), 6) AS value FROM best WHERE r = 1"""


@query("priv_median", median_sql("SELECT p_size + p_partkey / CAST(1000 AS DOUBLE) AS x, p_brand FROM part", "x", "p_brand", 0.0, 300.0, 1.0, 0.001))
def priv_median(spark, d):
    rows = table(spark, d, "part").select("p_brand", (F.col("p_size") + F.col("p_partkey") / F.lit(1000.0)).alias("x"))
    return mechanisms.private_median(rows, "x", 0.0, 300.0, 1.0, ["p_brand"], 0.001).withColumn("value", _r(F.col("value")))


@query(
    "noisy_order_stat",
    f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r FROM events),
i AS (SELECT event_type, n, CAST(CASE WHEN z < 0 THEN ceil(z) ELSE floor(z) END AS BIGINT) AS ix FROM
  (SELECT event_type, n, n / CAST(2 AS DOUBLE) + {K.laplace('20.0', 'order-g', '0', 'event_type')} + {K.laplace('40.0', 'order-l', '0', 'event_type')} AS z FROM (SELECT event_type, count(value) AS n FROM events GROUP BY event_type)))
SELECT i.event_type, round(CASE WHEN ix < 1 THEN CAST(0 AS DOUBLE) WHEN ix > n THEN CAST(500 AS DOUBLE) ELSE r.value END, 6) AS value FROM i LEFT JOIN r ON r.event_type = i.event_type AND r.r = i.ix""",
)
def noisy_order_stat(spark, d):
    return mechanisms.noisy_order_statistic(table(spark, d, "events"), "value", ["event_type"], 0.05, 0.025, 500.0, bins=1024).withColumn("value", _r(F.col("value")))


@query("interval_membership", "SELECT event_type, CAST(sum(CASE WHEN value BETWEEN 50 AND 100 THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM events GROUP BY event_type")
def interval_membership(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(mechanisms.in_interval(F.col("value"), F.lit(50.0), F.lit(100.0))).alias("inside"))


@query(
    "ball_projection",
    "SELECT vec_id, round(CASE WHEN n > 0.5 THEN 0.5 / n ELSE 1 END * x0, 6) AS x0, round(least(n, 0.5), 6) AS norm FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x0, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)",
)
def ball_projection(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", mechanisms.to_ball(F.transform("embedding", lambda x: x.cast("double")), 0.5).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("vec_id", _r(F.col("x")[0]).alias("x0"), _r(norm).alias("norm"))


@query("box_membership", "SELECT vec_id, len(list_filter(embedding, lambda x: x < -0.3 OR x > 0.3)) = 0 AS inside FROM embeddings")
def box_membership(spark, d):
    side = lambda v: F.transform("embedding", lambda _: F.lit(v).cast("float"))
    return table(spark, d, "embeddings").select("vec_id", mechanisms.in_box(F.col("embedding"), side(-0.3), side(0.3)).alias("inside"))


@query("clip_variance", "SELECT event_id, CASE WHEN value > 250 THEN CAST(250 AS DOUBLE) ELSE value END AS v FROM events")
def clip_variance(spark, d):
    return table(spark, d, "events").select("event_id", mechanisms.clip_variance(F.col("value"), 250.0).alias("v"))


_q = Bins(0.0, 64.0, 32)


@query("flat_hist", "SELECT l_linestatus, CAST(floor(l_quantity * 32 / 64) AS INTEGER) AS bin, count(*) AS ct FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 64 GROUP BY 1, 2")
def flat_hist(spark, d):
    return histograms.flat(table(spark, d, "lineitem"), "l_quantity", _q, ["l_linestatus"])


@query(
    "dyadic_hist",
    "SELECT level, CAST(leaf >> (4 - level) AS INTEGER) AS bin, CAST(sum(ct) AS BIGINT) AS ct FROM (SELECT CAST(floor(l_quantity * 32 / 64) AS INTEGER) AS leaf, count(*) AS ct FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 64 GROUP BY 1), (SELECT CAST(unnest(generate_series(0, 4)) AS INTEGER) AS level) GROUP BY 1, 2",
)
def dyadic_hist(spark, d):
    return histograms.dyadic(table(spark, d, "lineitem"), "l_quantity", _q, [])


_candidates = [(i, a, b) for i, (a, b) in enumerate([(0, 31), (1, 30), (3, 17), (7, 8), (8, 15), (5, 5), (12, 31), (16, 31), (2, 29)])]
_values = ", ".join(map(str, _candidates))


@query(
    "hist_coverage",
    f"SELECT CAST(ord AS BIGINT) AS ord, l_linestatus, round(sum(CASE WHEN floor(l_quantity / 2) BETWEEN f AND l THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 9) AS cov FROM lineitem, (VALUES {_values}) c(ord, f, l) GROUP BY 1, 2",
)
def hist_coverage(spark, d):
    rows = table(spark, d, "lineitem")
    hist, total = histograms.flat(rows, "l_quantity", _q, ["l_linestatus"]), histograms.totals(rows, ["l_linestatus"])
    cand = spark.createDataFrame(_candidates, "ord long, first int, last int")
    mass = histograms.range_mass(histograms.cumulative(hist, total, _q, ["l_linestatus"]), cand, ["l_linestatus"])
    return mass.join(total, "l_linestatus").select("ord", "l_linestatus", _r(F.col("mass") / F.col("total"), 9).alias("cov"))


@query(
    "dyadic_coverage",
    f"SELECT CAST(ord AS BIGINT) AS ord, CAST(sum(CASE WHEN floor(l_quantity / 2) BETWEEN f AND l THEN 1 ELSE 0 END) AS BIGINT) AS ct FROM lineitem, (VALUES {_values}) c(ord, f, l) GROUP BY 1",
)
def dyadic_coverage(spark, d):
    tree = histograms.dyadic(table(spark, d, "lineitem"), "l_quantity", _q, [])
    cand = spark.createDataFrame(_candidates, "ord long, first int, last int")
    nodes = histograms.cover_nodes(cand, _q)
    hit = nodes.join(tree, ["level", "bin"]).groupBy("ord").agg(F.sum("ct").alias("ct"))
    return cand.select("ord").join(hit, "ord", "left").select("ord", F.coalesce("ct", F.lit(0)).alias("ct"))


@query("bin_edges", "SELECT p_partkey, CAST(floor((p_retailprice - 900) * 1000 / 100) AS INTEGER) AS bin, round(900 + floor((p_retailprice - 900) * 1000 / 100) * CAST(0.1 AS DOUBLE), 9) AS l, round(900 + (floor((p_retailprice - 900) * 1000 / 100) + 1) * CAST(0.1 AS DOUBLE), 9) AS u FROM part")
def bin_edges(spark, d):
    """The bin of each price and its edges."""
    bins = Bins.of_precision(900.0, 1000.0, 0.1)
    rows = table(spark, d, "part").select("p_partkey", bins.number(F.col("p_retailprice")).alias("bin"))
    return rows.select("p_partkey", "bin", _r(bins.left(F.col("bin")), 9).alias("l"), _r(bins.right(F.col("bin")), 9).alias("u"))


@query("density_hist", "SELECT bin, round(ct / (sum(ct) OVER () * CAST(5 AS DOUBLE)), 9) AS density FROM (SELECT CAST(least(floor(l_quantity / 5), 9) AS INTEGER) AS bin, count(*) AS ct FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1)")
def density_hist(spark, d):
    return histograms.density(table(spark, d, "lineitem"), "l_quantity", 0.0, 50.0, 10).withColumn("density", _r(F.col("density"), 9))


_sets = [(0.0, 10.0), (5.0, 20.0), (20.0, 20.0), (0.0, float("inf"))]


@query(
    "set_hist",
    "SELECT l_returnflag, CAST(i AS INTEGER) AS set, count(*) FILTER (l_quantity BETWEEN lo AND hi) AS ct, count(*) AS total FROM lineitem, (VALUES (0, 0, 10), (1, 5, 20), (2, 20, 20), (3, 0, CAST('infinity' AS DOUBLE))) s(i, lo, hi) GROUP BY 1, 2",
)
def set_hist(spark, d):
    return histograms.set_counts(table(spark, d, "lineitem"), "l_quantity", _sets, ["l_returnflag"])
