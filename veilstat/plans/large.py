"""Queries of operators whose groups are larger than a task: resamples by multinomial trees, many sets, wide designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilstat.functions.keyed import KeyedSql as K
from veilstat.operators import chunking, ranges, wide
from veilstat.operators.tree_resampling import Tree, tree_logistic, tree_means, tree_medians
from veilstat.plans.registry import query
from veilstat.sources.tables import table

_r = lambda c, n=6: F.round(c, n)
HALVES = 2  # chunks of the line items; at scale factor 0.1 each has 300,000 rows
# Lines have no key: rows that agree in all of these columns are equal for every statistic here, so their order decides nothing.
LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_shipdate")
MEANS, MEDIANS, FITS = 100, 20, 10


def lines(spark, d):
    """(id, q, c, y) of every line: quantity, discount in hundredths, whether it was returned; whole numbers, so sums are exact in any order."""
    rows = table(spark, d, "lineitem")
    q, c, y = F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0)
    text = F.concat_ws("-", *[F.col(k).cast("string") for k in LINE], q.cast("int"), c.cast("int"))
    return rows.select(text.alias("id"), q.alias("q"), c.alias("c"), y.alias("y"), F.lit(1.0).alias("one"))


def halves(spark, d):
    rows = lines(spark, d)
    n = rows.count()
    return chunking.chunk(rows, "id", n, -(-n // HALVES), 0, "drop" if n % HALVES == 0 else "one_dim"), n


_id = f"concat_ws('-', {', '.join(f'CAST({k} AS VARCHAR)' for k in LINE)}, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR))"
_halves = f"""base AS (SELECT {_id} AS id, l_quantity AS q, round(l_discount * 100) AS c FROM lineitem), size AS (SELECT count(*) AS n, CAST(ceil(count(*) / {HALVES}.0) AS BIGINT) AS b FROM base),
chunked AS (SELECT q, c, CAST((row_number() OVER (ORDER BY {K.digest('perm', '0', 'id')}, id) - 1) // b AS INTEGER) AS chunk FROM base, size)"""


@query(
    "tree_boot_weights",
    f"""WITH {_halves} SELECT chunk, CAST({MEANS} AS BIGINT) AS runs, (SELECT n FROM size) AS least, (SELECT n FROM size) AS most, round(avg(q), 6) AS q, round(avg(c), 6) AS c FROM chunked GROUP BY chunk""",
)
def tree_boot_weights(spark, d):
    """What a multinomial tree must keep: in each run the counts add up to n over all blocks, and each statistic is around the chunk's own mean."""
    df, n = halves(spark, d)
    out = tree_means(df, ["q", "c"], Tree(n, MEANS))
    own = F.col("stat") / F.sqrt(F.lit(float(n))) + F.col("est")
    at = lambda k: _r(F.max(F.when(F.col("dim") == k, own)))
    return out.groupBy("chunk").agg(F.countDistinct("run").alias("runs"), F.min("weight").alias("least"), F.max("weight").alias("most"), at(0).alias("q"), at(1).alias("c"))


@query("tree_boot_mean")
def tree_boot_mean(spark, d):
    """Bootstrap means of two columns over chunks that are spread over tasks."""
    df, n = halves(spark, d)
    out = tree_means(df, ["q", "c"], Tree(n, MEANS))
    return out.groupBy("chunk", "dim").agg(F.avg("est").alias("m"), F.var_samp("stat").alias("v"), F.avg("sd").alias("sd"))


@query("tree_boot_median")
def tree_boot_median(spark, d):
    """Bootstrap medians over chunks that are spread over tasks."""
    df, n = halves(spark, d)
    return tree_medians(df, "q", Tree(n, MEDIANS)).groupBy("chunk").agg(F.avg("est").alias("m"), F.var_samp("stat").alias("v"))


@query("tree_boot_logreg")
def tree_boot_logreg(spark, d):
    """Bootstrap logistic fits over chunks that are spread over tasks."""
    df, n = halves(spark, d)
    scaled = df.withColumn("q", F.col("q") / 50).withColumn("c", F.col("c") / 10)
    return tree_logistic(scaled, ["q", "c", "one"], "y", Tree(n, FITS)).groupBy("chunk", "dim").agg(F.avg("est").alias("m"), F.var_samp("stat").alias("v"))


# A set an order, each counted in the lines of each return flag.
_sets = "sets AS (SELECT o_orderkey AS set, floor(o_totalprice / 10) AS low, floor(o_totalprice / 10) + 1000 + o_custkey % 500 AS high FROM orders)"


@query(
    "set_hist_many",
    f"""WITH {_sets}, g AS (SELECT l_returnflag, count(*) AS total FROM lineitem GROUP BY 1), v AS (SELECT l_returnflag, l_extendedprice AS x, count(*) AS k FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_returnflag, x, CAST(sum(k) OVER (PARTITION BY l_returnflag ORDER BY x) AS BIGINT) AS cum FROM v), q AS (SELECT * FROM sets, g),
h AS (SELECT q.*, coalesce(c.cum, 0) AS upto FROM q ASOF LEFT JOIN c ON q.l_returnflag = c.l_returnflag AND q.high >= c.x)
SELECT h.l_returnflag, h.set, h.upto - coalesce(c.cum, 0) AS ct, h.total FROM h ASOF LEFT JOIN c ON h.l_returnflag = c.l_returnflag AND h.low > c.x""",
)
def set_hist_many(spark, d):
    """How many lines of each flag have a price in each of as many intervals as there are orders."""
    low = F.floor(F.col("o_totalprice") / 10)
    sets = table(spark, d, "orders").select(F.col("o_orderkey").alias("set"), low.alias("low"), (low + 1000 + F.col("o_custkey") % 500).alias("high"))
    return ranges.within_sets(table(spark, d, "lineitem"), "l_extendedprice", sets, ["l_returnflag"])


# 500 indicators of a line: part, supplier, quantity, discount, and one for all.
WIDE = 500


def wide_lines(spark, d):
    rows = table(spark, d, "lineitem")
    idx = F.array(*[c.cast("int") for c in (F.col("l_partkey") % 300, F.lit(300) + F.col("l_suppkey") % 100, F.lit(399) + F.col("l_quantity"), F.lit(450) + F.round(F.col("l_discount") * 100), F.lit(WIDE - 1))])
    return rows.select(idx.alias("idx"), F.array(*[F.lit(1.0)] * 5).alias("val"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"))


_ones = "o AS (SELECT row, unnest([CAST(l_partkey % 300 AS INTEGER), CAST(300 + l_suppkey % 100 AS INTEGER), CAST(399 + l_quantity AS INTEGER), CAST(450 + round(l_discount * 100) AS INTEGER), 499]) AS k FROM (SELECT *, row_number() OVER () AS row FROM lineitem))"


@query("gram_wide", f"WITH {_ones} SELECT a.k AS i, b.k AS j, CAST(count(*) AS DOUBLE) AS value FROM o a JOIN o b ON a.row = b.row AND a.k <= b.k GROUP BY 1, 2")
def gram_wide(spark, d):
    """The Gram matrix of 500 indicators of the lines, in tiles."""
    return wide.tile_entries(wide.gram_tiles(wide_lines(spark, d), WIDE), WIDE)


@query("logreg_wide")
def logreg_wide(spark, d):
    """The fit of 500 coefficients on all lines, with the gradient's largest entry there."""
    rows = wide_lines(spark, d)
    beta = wide.wide_fit(rows, WIDE, tolerance=1e-4)
    (g,), n = wide.pass_sums(rows, WIDE, 1, lambda block: -block.back(block.chances(beta) * block.y, WIDE)[None, :])
    return spark.createDataFrame([(k, float(b), float(s / n)) for k, (b, s) in enumerate(zip(beta, g, strict=True))], "dim int, value double, slope double")
