"""Queries of chunks, bootstrap statistics, confidence sets and interval search over the whole customer table.

Values are whole numbers, so sums are exact in any order and both engines give the same bins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veilstat.functions.keyed import KeyedSql as K
from veilstat.functions.session import checkpointed
from veilstat.operators import chunking, intervals, resampling, variance
from veilstat.operators.histograms import Bins, dyadic, flat, normalized, totals
from veilstat.plans import sqltext as S
from veilstat.plans.registry import query
from veilstat.plans.statistics import median_sql
from veilstat.sources.tables import table

BINS = Bins(S.LOW, S.HIGH, S.BINS)
_r = lambda c, n=6: F.round(c, n)


def base(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 100).cast("double").alias("v"))


def sized(df):
    """(n, b) of a table in S.CHUNKS chunks."""
    n = df.count()
    return n, n // S.CHUNKS


def chunked(spark, d):
    df = base(spark, d)
    n, b = sized(df)
    return chunking.chunk(df, "id", n, b, S.SEED), n


PRIVATE = resampling.Release(S.VALUE_LOW, S.VALUE_HIGH, S.EPS_PARAM)
STUDENT = resampling.Release(S.VALUE_LOW, S.VALUE_HIGH, S.EPS_PARAM, True, S.EPS_SIGMA)


def stats(spark, d, release=resampling.Release()):
    df, n = chunked(spark, d)
    return resampling.boot_stats(df, "v", n, S.RUNS, S.SEED, release)


def dropped_stats(spark, d):
    """Statistics of the chunks without a remainder."""
    df = base(spark, d)
    n, b = sized(df)
    return resampling.boot_stats(chunking.chunk(df, "id", n, b, S.SEED, "drop"), "v", n, S.RUNS, S.SEED)


def ablation_stats(spark, d):
    """Statistics with the whole table in the place of each chunk."""
    df = base(spark, d)
    n, b = sized(df)
    rows = chunking.permutation_rank(df, "id", S.SEED, n=n).withColumnRenamed("pos", "slot")
    return resampling.boot_stats(rows, "v", n, S.RUNS, S.SEED, PRIVATE, copies=chunking.chunk_count(n, b))


@query("chunk_assign", f"WITH {S.CHUNKED} SELECT id, chunk, slot FROM chunked")
def chunk_assign(spark, d):
    return chunked(spark, d)[0].select("id", "chunk", "slot")


_alldim = S.CHUNKED.replace("(n // b) * b < n - 1 THEN", "(n // b) * b < n - b / 2.0 THEN")


@query("chunk_sizes_alldim", f"WITH {_alldim} SELECT chunk, count(*) AS n, round(avg(v), 6) AS mean FROM chunked GROUP BY chunk")
def chunk_sizes_alldim(spark, d):
    df = base(spark, d)
    n, b = sized(df)
    return chunking.chunk(df, "id", n, b, S.SEED, "all_dim").groupBy("chunk").agg(F.count("*").alias("n"), _r(F.avg("v")).alias("mean"))


@query("chunk_sizes", f"WITH {S.CHUNKED} SELECT chunk, count(*) AS n, round(avg(v), 6) AS mean FROM chunked GROUP BY chunk")
def chunk_sizes(spark, d):
    return chunked(spark, d)[0].groupBy("chunk").agg(F.count("*").alias("n"), _r(F.avg("v")).alias("mean"))


@query("chunk_drop_rest", f"WITH {S.BASE}, {S.POS} SELECT id, CAST(pos // b AS INTEGER) AS chunk, pos % b AS slot FROM pos, size WHERE pos < (n // b) * b")
def chunk_drop_rest(spark, d):
    df = base(spark, d)
    n, b = sized(df)
    return chunking.chunk(df, "id", n, b, S.SEED, "drop").select("id", "chunk", "slot")


@query(
    "chunk_subset",
    f"WITH {S.CHUNKED}, pick AS (SELECT repeat, chunk, row_number() OVER (PARTITION BY repeat ORDER BY {K.digest('subset', '0', 'repeat', 'chunk')}) AS k FROM (SELECT DISTINCT chunk FROM chunked), (SELECT CAST(unnest(generate_series(0, 2)) AS INTEGER) AS repeat)) "
    "SELECT p.repeat, p.chunk, count(*) AS n FROM pick p JOIN chunked c ON c.chunk = p.chunk WHERE k <= 4 GROUP BY 1, 2",
)
def chunk_subset(spark, d):
    df, n = chunked(spark, d)
    s = chunking.chunk_count(n, n // S.CHUNKS)
    return chunking.chunk_subset(df, 4, s, 0, 3).groupBy("repeat", "chunk").agg(F.count("*").alias("n"))


@query("random_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {K.digest('sample', '3', 'o_orderkey')}, o_orderkey LIMIT 500")
def random_sample(spark, d):
    return chunking.random_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 3)


@query("bootstrap_stats", f"WITH {S.STATS} SELECT chunk, run, round(est, 6) AS est, round(stat, 6) AS stat FROM stats")
def bootstrap_stats(spark, d):
    return stats(spark, d).select("chunk", "run", _r(F.col("est")).alias("est"), _r(F.col("stat")).alias("stat"))


@query("bootstrap_stats_private", f"WITH {S.PRIVATE} SELECT chunk, run, round(est, 6) AS est, round(stat, 5) AS stat FROM stats")
def bootstrap_stats_private(spark, d):
    return stats(spark, d, PRIVATE).select("chunk", "run", _r(F.col("est")).alias("est"), _r(F.col("stat"), 5).alias("stat"))


@query("bootstrap_stats_studentized", f"WITH {S.statistics(True, True)} SELECT chunk, run, round(est, 6) AS est, round(stat, 5) AS stat FROM stats")
def bootstrap_stats_studentized(spark, d):
    return stats(spark, d, STUDENT).select("chunk", "run", _r(F.col("est")).alias("est"), _r(F.col("stat"), 5).alias("stat"))


_q = lambda p, x: f"quantile_disc({x}, {p})"
_inf = "CAST('infinity' AS DOUBLE)"
_kinds = {
    "eqtail": (_q(0.025, "stat"), _q(0.975, "stat")),
    "symm": (f"-{_q(0.95, 'abs(stat)')}", _q(0.95, "abs(stat)")),
    "low": (_q(0.05, "stat"), _inf),
    "up": (f"-{_inf}", _q(0.95, "stat")),
}
for _kind, (_low, _high) in _kinds.items():

    def boot_ci(spark, d, kind=_kind):
        out = resampling.quantile_interval(checkpointed(stats(spark, d, PRIVATE)), S.ALPHA, kind, ["chunk"])  # read twice
        return out.select("chunk", _r(F.col("l"), 5).alias("l"), _r(F.col("u"), 5).alias("u"))

    query(f"boot_ci_{_kind}", f"WITH {S.PRIVATE} SELECT chunk, round({_low}, 5) AS l, round({_high}, 5) AS u FROM stats GROUP BY chunk")(boot_ci)


@query("blb_hist", f"WITH {S.HIST} SELECT chunk, bin, ct FROM hist")
def blb_hist(spark, d):
    return flat(stats(spark, d), "stat", BINS, ["chunk"])


@query("blb_hist_private", f"WITH {S.PRIVATE_HIST} SELECT chunk, bin, ct FROM hist")
def blb_hist_private(spark, d):
    return flat(stats(spark, d, PRIVATE), "stat", BINS, ["chunk"])


@query("blb_hist_normalized", f"WITH {S.PRIVATE_HIST} SELECT chunk, bin, round(ct / CAST({S.RUNS} AS DOUBLE), 9) AS p FROM hist")
def blb_hist_normalized(spark, d):
    st = checkpointed(stats(spark, d, PRIVATE))  # read twice
    out = normalized(flat(st, "stat", BINS, ["chunk"]), totals(st, ["chunk"]), ["chunk"])
    return out.withColumn("p", _r(F.col("p"), 9))


@query("blb_hist_pooled", f"WITH {S.HIST} SELECT bin, CAST(sum(ct) AS BIGINT) AS ct FROM hist GROUP BY bin")
def blb_hist_pooled(spark, d):
    return flat(stats(spark, d), "stat", BINS, [])


@query("blb_means_covs", f"WITH {S.statistics(source=S.DROPPED)} SELECT chunk, round(avg(est), 6) AS m, round(var_samp(est), 6) AS v FROM stats GROUP BY chunk")
def blb_means_covs(spark, d):
    return resampling.means_and_variances(dropped_stats(spark, d), ["chunk"]).select("chunk", _r(F.col("m")).alias("m"), _r(F.col("v")).alias("v"))


TOP = 5000.0
_std_sql = median_sql(f"WITH {S.PRIVATE} SELECT 'all' AS side, least(greatest(var_samp(stat), 0), {TOP}) AS v FROM stats GROUP BY chunk", "v", "side", 0.0, TOP, 4.0, 0.01)


@query("blb_std", f"SELECT side, round(sqrt(value), 3) AS value FROM ({_std_sql})")
def blb_std(spark, d):
    out = variance.private_deviation(stats(spark, d, PRIVATE).withColumn("side", F.lit("all")), ["side"], TOP, 4.0, 0.01)
    return out.withColumn("value", _r(F.col("value"), 3))


_std_whole = median_sql(f"WITH {S.statistics(True, source=S.WHOLE)} SELECT 'all' AS side, least(greatest(var_samp(stat), 0), {TOP}) AS v FROM stats GROUP BY chunk", "v", "side", 0.0, TOP, 4.0, 0.01)


@query("blb_std_ablation", f"SELECT side, round(sqrt(value), 3) AS value FROM ({_std_whole})")
def blb_std_ablation(spark, d):
    out = variance.private_deviation(ablation_stats(spark, d).withColumn("side", F.lit("all")), ["side"], TOP, 4.0, 0.01)
    return out.withColumn("value", _r(F.col("value"), 3))


def _search(kind: str, tree: bool, source=lambda spark, d: stats(spark, d, PRIVATE)):
    def run(spark, d):
        st = checkpointed(source(spark, d))  # a row a run: read for the counts, the chunks and the search
        hist = dyadic(st, "stat", BINS, ["chunk"]) if tree else flat(st, "stat", BINS, ["chunk"])
        out = intervals.search(st, hist, BINS, S.RUNS, S.ALPHA, S.EPS, kind, seed=S.SEED, tree=tree)
        return out.withColumn("released", _r(F.col("released")))

    return run


for _kind in ("symm", "short", "low", "up", "eqtail"):
    if _kind == "eqtail":
        _ctes = f"{S.searched('low', 'low', S.ALPHA / 2, S.EPS / 2)}, {S.searched('up', 'up', S.ALPHA / 2, S.EPS / 2)}"
        _first, _last = "low", "up"
    else:
        _ctes, _first, _last = S.searched(_kind, _kind), _kind, _kind
    _sql = f"""WITH {S.PRIVATE_HIST}, {_ctes}
SELECT coalesce((SELECT {S.left_edge('f')} FROM best_{_first}), CAST({S.LOW} AS DOUBLE)) AS l, coalesce((SELECT {S.left_edge('(l + 1)')} FROM best_{_last}), CAST({S.HIGH} AS DOUBLE)) AS u,
(SELECT ord FROM best_{_first}) AS ord, (SELECT round(released, 6) FROM best_{_first}) AS released"""
    query(f"abthresh_{_kind}", _sql)(_search(_kind, False))
    query(f"abthresh_dyadic_{_kind}", _sql)(_search(_kind, True))
    if _kind == "symm":
        query("abthresh_ablation_symm", _sql.replace(S.PRIVATE_HIST, S.ABLATION_HIST))(_search(_kind, False, ablation_stats))

# Confidence sets of one histogram: quantities of all lines.
Q = Bins(0.0, 64.0, 32)
_cum = """h AS (SELECT CAST(floor(l_quantity / 2) AS INTEGER) AS bin, count(*) AS ct FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 64 GROUP BY 1),
t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM lineitem), g AS (SELECT CAST(unnest(generate_series(0, 31)) AS INTEGER) AS bin),
s AS (SELECT g.bin, sum(coalesce(ct, 0)) OVER (ORDER BY g.bin) / t AS below, sum(coalesce(ct, 0)) OVER (ORDER BY g.bin DESC) / t AS above, CAST(sum(coalesce(ct, 0)) OVER (ORDER BY g.bin) AS BIGINT) AS cum FROM g LEFT JOIN h ON h.bin = g.bin, t)"""


def _one(spark, d):
    rows = table(spark, d, "lineitem")
    return flat(rows, "l_quantity", Q, []), rows.count()


@query("conf_quick", f"WITH {_cum} SELECT CAST(coalesce(min(CASE WHEN below >= 0.05 THEN bin END), 0) * 2 AS DOUBLE) AS l, CAST(coalesce(max(CASE WHEN above >= 0.05 THEN bin END), 31) * 2 + 2 AS DOUBLE) AS u FROM s")
def conf_quick(spark, d):
    hist, total = _one(spark, d)
    return intervals.quick_set(hist, Q, total, 0.1)


@query(
    "conf_mid",
    f"""WITH {_cum}, m AS (SELECT bin, below >= 0.05 AND coalesce(lag(below) OVER (ORDER BY bin), 0) <= 0.05 AS lo, above >= 0.05 AND coalesce(lag(above) OVER (ORDER BY bin DESC), 0) <= 0.05 AS hi FROM s),
a AS (SELECT coalesce(list(bin ORDER BY bin) FILTER (lo), []) AS lo, coalesce(list(bin ORDER BY bin DESC) FILTER (hi), []) AS hi FROM m),
k AS (SELECT 'first' AS kind, 1 AS i, 1 AS j, lo, hi FROM a UNION ALL SELECT 'middle', len(lo) // 2 + 1, len(hi) // 2 + 1, lo, hi FROM a)
SELECT kind, CAST(coalesce(lo[i], 0) * 2 AS DOUBLE) AS l, CAST(coalesce(hi[j], 31) * 2 + 2 AS DOUBLE) AS u FROM k""",
)
def conf_mid(spark, d):
    hist, total = _one(spark, d)
    return intervals.middle_sets(hist, Q, total, 0.1)


@query(
    "conf_short",
    f"""WITH {_cum}, c AS (SELECT bin, cum, coalesce(lag(cum) OVER (ORDER BY bin), 0) AS before FROM s),
p AS (SELECT i.bin AS i, j.bin AS j, (j.cum - i.before) / t AS cov FROM c i, c j, t WHERE j.bin > i.bin),
q AS (SELECT i, j, cov, coalesce(lag(i) OVER w, 0) AS pi, coalesce(lag(j) OVER w, 31) AS pj, coalesce(lag(cov) OVER w, 1) AS pcov FROM p WINDOW w AS (ORDER BY i, j DESC)),
v AS (SELECT pi, pj, row_number() OVER (ORDER BY pj - pi, i, j DESC) - 1 AS k, count(*) OVER () AS n FROM q JOIN c a ON a.bin = pi JOIN c b ON b.bin = pj, t WHERE cov < CAST(0.9 AS DOUBLE) AND pcov >= CAST(0.9 AS DOUBLE) AND (b.cum - a.cum) / t < CAST(0.9 AS DOUBLE))
SELECT 'shortest' AS kind, CAST(pi * 2 AS DOUBLE) AS l, CAST(pj * 2 + 2 AS DOUBLE) AS u FROM v WHERE k = 0 UNION ALL SELECT 'middle', CAST(pi * 2 AS DOUBLE), CAST(pj * 2 + 2 AS DOUBLE) FROM v WHERE k = n // 2""",
)
def conf_short(spark, d):
    hist, total = _one(spark, d)
    return intervals.short_sets(hist, Q, total, 0.1)


@query(
    "conf_symm",
    f"""WITH {_cum}, c AS (SELECT i, 15 - i AS f, 16 + i AS l FROM (SELECT unnest(generate_series(0, 14)) AS i)),
m AS (SELECT c.i, c.f, c.l, (b.cum - coalesce(a.cum, 0)) / t AS cov FROM c JOIN s b ON b.bin = c.l LEFT JOIN s a ON a.bin = c.f - 1, t),
o AS (SELECT f, l FROM m WHERE cov > CAST(0.6 AS DOUBLE) ORDER BY i LIMIT 1)
SELECT CAST(coalesce((SELECT f FROM o), 0) * 2 AS DOUBLE) AS l, CAST(coalesce((SELECT l FROM o), 31) * 2 + 2 AS DOUBLE) AS u""",
)
def conf_symm(spark, d):
    hist, total = _one(spark, d)
    return intervals.symmetric_set(hist, Q, total, 0.4)


# All dimensions at once: two columns of the customers as the statistics of two dimensions, ten chunks of equal size.
DIMS = {0: Bins(-64.0, 64.0, 64), 1: Bins(-16.0, 16.0, 32)}
_dim_stats = """st AS (SELECT CAST(c_custkey % 10 AS INTEGER) AS chunk, CAST(0 AS INTEGER) AS dim, floor(c_acctbal / 100) - 45 AS stat FROM customer
UNION ALL SELECT CAST(c_custkey % 10 AS INTEGER), 1, CAST(c_nationkey - 12 AS DOUBLE) FROM customer), runs AS (SELECT count(*) / CAST(10 AS DOUBLE) AS r FROM customer)"""


def dim_stats(spark, d):
    c = table(spark, d, "customer")
    rows = F.explode(F.array(F.struct(F.lit(0).alias("dim"), (F.floor(F.col("c_acctbal") / 100) - 45).cast("double").alias("stat")), F.struct(F.lit(1).alias("dim"), (F.col("c_nationkey") - 12).cast("double").alias("stat"))))
    return c.select((F.col("c_custkey") % 10).cast("int").alias("chunk"), rows.alias("r")).select("chunk", "r.dim", "r.stat")


def _dims_sql(kind: str, alpha: float, eps: float) -> str:
    each = " UNION ALL ".join(f"SELECT CAST({d} AS INTEGER) AS dim, ord, f, l FROM ({S.candidates(kind, b.count)})" for d, b in DIMS.items())
    table_ = ", ".join(f"({d}, {b.low}, {b.high}, {b.count})" for d, b in DIMS.items())
    noise = f"(n / CAST(2 AS DOUBLE) + {K.laplace(repr(2 / eps), 'order-g', '4', 'dim', 'ord')} + {K.laplace(repr(4 / eps), 'order-l', '4', 'dim', 'ord')})"
    return f"""WITH {_dim_stats}, dims AS (SELECT CAST(dim AS INTEGER) AS dim, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, m FROM (VALUES {table_}) v(dim, low, high, m)), cand AS ({each}),
h AS (SELECT dim, chunk, CAST(floor((stat - low) * m / (high - low)) AS INTEGER) AS bin FROM st JOIN dims USING (dim) WHERE stat >= low AND stat < high),
cov AS (SELECT c.dim, c.ord, k.chunk, (SELECT count(*) FROM h WHERE h.dim = c.dim AND h.chunk = k.chunk AND h.bin BETWEEN c.f AND c.l) / (SELECT r FROM runs) AS cov FROM cand c, (SELECT DISTINCT chunk FROM st) k),
ranked AS (SELECT dim, ord, cov, row_number() OVER (PARTITION BY dim, ord ORDER BY cov) AS r FROM cov),
ix AS (SELECT dim, ord, n, CAST(CASE WHEN z < 0 THEN ceil(z) ELSE floor(z) END AS BIGINT) AS i FROM (SELECT dim, ord, n, {noise} AS z FROM (SELECT dim, ord, count(*) AS n FROM cov GROUP BY dim, ord))),
rel AS (SELECT ix.dim, ix.ord, CASE WHEN i < 1 THEN CAST(0 AS DOUBLE) WHEN i > n THEN CAST(1 AS DOUBLE) ELSE cov END AS released FROM ix LEFT JOIN ranked ON ranked.dim = ix.dim AND ranked.ord = ix.ord AND r = i),
best AS (SELECT rel.dim, rel.ord, f, l, released, row_number() OVER (PARTITION BY rel.dim ORDER BY rel.ord) AS k FROM rel JOIN cand ON rel.dim = cand.dim AND rel.ord = cand.ord WHERE released > CAST({1 - alpha!r} AS DOUBLE))
SELECT dims.dim, coalesce(round(low + f * (high - low) / m, 13), low) AS l, coalesce(round(low + (l + 1) * (high - low) / m, 13), high) AS u, ord, round(released, 6) AS released FROM dims LEFT JOIN best ON best.dim = dims.dim AND k = 1"""


for _kind in ("symm", "short"):
    for _tree in (False, True):

        def dims_search(spark, d, kind=_kind, tree=_tree):
            st = dim_stats(spark, d)
            out = intervals.search_dims(st, DIMS, table(spark, d, "customer").count() / 10, 0.2, S.EPS, kind, seed=4, tree=tree)
            return out.withColumn("released", _r(F.col("released")))

        query(f"abthresh_dims_{'dyadic_' if _tree else ''}{_kind}", _dims_sql(_kind, 0.2, S.EPS))(dims_search)


@query("boot_ci_dims", f"WITH {_dim_stats} SELECT chunk, dim, {_q(0.025, 'stat')} AS l, {_q(0.975, 'stat')} AS u FROM st GROUP BY chunk, dim")
def boot_ci_dims(spark, d):
    return resampling.quantile_interval(dim_stats(spark, d), S.ALPHA, "eqtail", ["chunk", "dim"])


_dim_var = median_sql(f"WITH {_dim_stats} SELECT dim, var_samp(stat) AS v FROM st GROUP BY dim, chunk", "v", "dim", 0.0, TOP, 4.0, 0.01, 5)


@query("blb_std_dims", f"SELECT dim, round(sqrt(value), 3) AS value FROM ({_dim_var})")
def blb_std_dims(spark, d):
    return variance.private_deviation(dim_stats(spark, d), ["dim"], TOP, 4.0, 0.01, 5).withColumn("value", _r(F.col("value"), 3))
