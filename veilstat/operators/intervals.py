"""Confidence sets read off a histogram, and private interval search by AboveThreshold.

The search scores candidate intervals in every chunk by prefix sums, takes a noisy order statistic of the chunk
coverages per candidate, and keeps the first candidate over the threshold. The noise of a candidate depends on its
number alone, so scoring candidates in ranges of doubling size has the law of stopping at the first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from veilstat.functions.session import checkpointed
from veilstat.operators.histograms import Bins, cover_nodes, cumulative, first_at_least, least_mass, prefix_sums, range_mass
from veilstat.operators.mechanisms import noisy_order_statistic
from veilstat.operators.selection import at_ranks

FIRST = 4096  # candidates that a search scores at first


def shares(hist: DataFrame, bins: Bins, total: int) -> DataFrame:
    """(bin, p, below, above) of every bin: its share, and the shares up to it and from it on, each with it."""
    grid = hist.sparkSession.range(bins.count).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(hist, "bin", "left").select("bin", (F.coalesce("ct", F.lit(0))).alias("ct"))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    down = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = F.lit(float(total))
    return full.select("bin", (F.col("ct") / t).alias("p"), (F.sum("ct").over(up) / t).alias("below"), (F.sum("ct").over(down) / t).alias("above"))


def quick_set(hist: DataFrame, bins: Bins, total: int, alpha: float) -> DataFrame:
    """First bin whose left mass reaches alpha / 2, and its mirror; the whole range where there is none."""
    s = shares(hist, bins, total)
    first = F.min(F.when(F.col("below") >= F.lit(alpha / 2), F.col("bin")))
    last = F.max(F.when(F.col("above") >= F.lit(alpha / 2), F.col("bin")))
    return s.agg(F.coalesce(first, F.lit(0)).alias("f"), F.coalesce(last, F.lit(bins.count - 1)).alias("g")).select(bins.left(F.col("f")).alias("l"), bins.right(F.col("g")).alias("u"))


def middle_sets(hist: DataFrame, bins: Bins, total: int, alpha: float, error: float = 0.0) -> DataFrame:
    """(kind, l, u): the first crossings of (alpha + error) / 2 from either side, and the middle ones."""
    s, a = shares(hist, bins, total), F.lit((alpha + error) / 2)
    up, down = Window.orderBy("bin"), Window.orderBy(F.col("bin").desc())
    crossing = lambda side, w: (F.col(side) >= a) & (F.coalesce(F.lag(side).over(w), F.lit(0.0)) <= a)
    marked = s.select("bin", crossing("below", up).alias("low"), crossing("above", down).alias("high"))
    lows = marked.agg(F.sort_array(F.collect_list(F.when(F.col("low"), F.col("bin")))).alias("lo"), F.sort_array(F.collect_list(F.when(F.col("high"), F.col("bin"))), asc=False).alias("hi"))
    pick = lambda c, at, other: F.coalesce(F.try_element_at(F.col(c), at), F.lit(other))
    middle = lambda c: F.floor(F.size(c) / 2).cast("int") + 1
    out = lows.select(
        F.explode(
            F.array(
                F.struct(F.lit("first").alias("kind"), pick("lo", F.lit(1), 0).alias("f"), pick("hi", F.lit(1), bins.count - 1).alias("g")),
                F.struct(F.lit("middle").alias("kind"), pick("lo", middle("lo"), 0).alias("f"), pick("hi", middle("hi"), bins.count - 1).alias("g")),
            )
        ).alias("r")
    )
    return out.select("r.kind", bins.left(F.col("r.f")).alias("l"), bins.right(F.col("r.g")).alias("u"))


def short_sets(hist: DataFrame, bins: Bins, total: int, alpha: float) -> DataFrame:
    """(kind, l, u): of the sets whose coverage falls under 1 - alpha if either end moves in, the shortest and the one of middle length.

    For each left end the first right end that covers enough comes from a binary search in the prefix sums, so there are at most two sets
    a bin: that one, and the set of the bin with its left neighbour where the range on its right does not cover enough. The
    middle one in the order of (length, left end) is found by counts. Nothing where no set qualifies.
    """
    sums = prefix_sums(hist, bins)
    need = least_mass(1 - alpha, total)
    own = sums.select(F.col("bin").alias("i"), "before", F.col("cum").alias("upto"), F.col("ct").alias("own"))
    found = first_at_least(own.withColumn("target", F.col("before") + F.lit(need)), sums, bins, "target")
    # Moving in the right end is the search's own condition; moving in the left end must lose too much as well.
    reach = found.filter("j >= i + 2").join(sums.select(F.col("bin").alias("j"), F.col("cum").alias("end")), "j").filter(F.col("end") - F.col("before") - F.col("own") < need)
    one = reach.select(F.col("i").alias("pi"), F.col("j").alias("pj"), (F.col("i") * 2 + 1).alias("turn"))
    # Where the range from a bin on does not cover enough: the bin with its left neighbour; for the first bin the whole range.
    all_mass = sums.agg(F.max("cum").alias("all"))
    left = own.select((F.col("i") + 1).alias("i"), F.col("before").alias("lbefore"))
    tails = own.filter(F.col("i") < bins.count - 1).join(left, "i", "left").crossJoin(F.broadcast(all_mass)).filter(F.col("all") - F.col("before") < need)
    first = F.col("i") == 0
    kept = tails.filter(F.when(first, F.col("all") - F.col("own") < need).otherwise((F.col("upto") - F.col("lbefore") >= need) & (F.col("own") < need)))
    two = kept.select(F.greatest(F.col("i") - 1, F.lit(0)).alias("pi"), F.when(first, F.lit(bins.count - 1)).otherwise(F.col("i")).alias("pj"), (F.col("i") * 2).alias("turn"))
    valid = checkpointed(one.unionByName(two).withColumn("long", (F.col("pj") - F.col("pi")).cast("long")))
    short = valid.agg(F.min(F.struct("long", "turn", "pi", "pj")).alias("r")).filter("r is not null").select(F.lit("shortest").alias("kind"), "r.pi", "r.pj")
    half = at_ranks(valid, "long", [], {"w": F.floor(F.col("_n") / 2) + 1}).select("w", F.floor(F.col("_n") / 2).alias("k"))
    below = valid.crossJoin(F.broadcast(half)).agg(F.count_if(F.col("long") < F.col("w")).alias("less"), F.max("k").alias("k"), F.max("w").cast("long").alias("w"))
    alike = valid.crossJoin(F.broadcast(below)).filter(F.col("long") == F.col("w"))
    place = (below.first()["k"] or 0) - below.first()["less"] + 1
    turn = at_ranks(alike, "turn", [], {"turn": F.lit(place)}).select(F.col("turn").cast("int").alias("turn"))
    middle = alike.withColumn("turn", F.col("turn").cast("int")).join(F.broadcast(turn), "turn").select(F.lit("middle").alias("kind"), "pi", "pj")
    return short.unionByName(middle).select("kind", bins.left(F.col("pi")).alias("l"), bins.right(F.col("pj")).alias("u"))


def candidates(spark: SparkSession, kind: str, m: int, least: int = 0, lo: int = 0, hi: int | None = None) -> DataFrame:
    """(ord, first, last) of the intervals that a search tries, in its order, over m bins; those numbered lo to hi - 1 only if given.

    symm: growing around the centre, without the outermost pair. short: by width from `least`, each width from the
    middle outwards; where a width has an even number of places the middle is tried twice and the first never. low:
    [bin, max] from the middle leftwards. up: [min, bin] from the middle rightwards.
    """
    if kind == "symm":
        q, odd = divmod(m, 2)
        start, a, b, stop = least // 2, q if odd else q - 1, q, q if odd else q - 1
        base = spark.range(start, max(start, stop)).select(F.col("id").alias("ord"), (F.lit(a) - F.col("id")).cast("int").alias("first"), (F.lit(b) + F.col("id")).cast("int").alias("last"))
    elif kind == "low":
        base = spark.range(m // 2 + 1).select(F.col("id").alias("ord"), (F.lit(m // 2) - F.col("id")).cast("int").alias("first"), F.lit(m - 1).alias("last"))
    elif kind == "up":
        base = spark.range(m - m // 2).select(F.col("id").alias("ord"), F.lit(0).alias("first"), (F.lit(m // 2) + F.col("id")).cast("int").alias("last"))
    elif kind == "short":
        a, b = (least, m) if hi is None else (width_of(lo, m, least), min(m, width_of(hi - 1, m, least) + 1))
        widths = spark.range(a, b).select(F.col("id").cast("int").alias("w"), (F.lit(m) - F.col("id")).cast("int").alias("k"))
        each = widths.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        q = F.floor(F.col("k") / 2).cast("int")
        even = F.when(F.col("t") % 2 == 0, q - F.floor(F.col("t") / 2)).otherwise(q + F.floor(F.col("t") / 2))
        odd = F.when(F.col("t") == 0, q).when(F.col("t") % 2 == 1, q - F.floor((F.col("t") + 1) / 2)).otherwise(q + F.floor(F.col("t") / 2))
        place = F.when(F.col("k") % 2 == 0, even).otherwise(odd).cast("int")
        before = (F.col("w") - least) * F.lit(m) - (F.col("w") * (F.col("w") - 1) / 2 - F.lit(least * (least - 1) / 2))
        base = each.select((before + F.col("t")).cast("long").alias("ord"), place.alias("first"), (place + F.col("w")).alias("last"))
    else:
        raise ValueError(f"no set type {kind!r}")
    return base if hi is None else base.filter((F.col("ord") >= lo) & (F.col("ord") < hi))


def before_width(w: int, m: int, least: int) -> int:
    """How many candidates of `short` are narrower than w bins more than one."""
    return (w - least) * m - (w * (w - 1) - least * (least - 1)) // 2


def width_of(at: int, m: int, least: int) -> int:
    """The width of the candidate of `short` with this number."""
    lo, hi = least, m
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if before_width(mid, m, least) <= at else (lo, mid)
    return lo


def numbers(kind: str, m: int, least: int = 0) -> tuple[int, int]:
    """The number of the first candidate and that after the last."""
    if kind == "symm":
        q, odd = divmod(m, 2)
        start = least // 2
        return start, max(start, q if odd else q - 1)
    if kind == "short":
        return 0, before_width(m, m, least) if m > least else 0
    if kind in ("low", "up"):
        return 0, m // 2 + 1 if kind == "low" else m - m // 2
    raise ValueError(f"no set type {kind!r}")


def frontier(start: int, stop: int, first: int = FIRST) -> Iterator[tuple[int, int]]:
    """Ranges of candidates to score one after another: at first `first`, then as many as before, so at most twice those up to any of them."""
    at = start
    while at < stop:
        end = min(stop, at + max(first, at - start))
        yield at, end
        at = end


def accepted(coverage: DataFrame, alpha: float, global_eps: float, local_eps: float, error: float, seed, fixed: bool = False) -> DataFrame:
    """The (ord, released) of candidates over the threshold, from (ord, chunk, cov)."""
    released = noisy_order_statistic(coverage, "cov", ["ord"], global_eps, local_eps, 1.0, seed, fixed)
    return released.filter(F.col("value") > F.lit(1 - alpha + error)).select("ord", F.col("value").alias("released"))


def coverages(stats: DataFrame, hist: DataFrame, cand: DataFrame, bins: Bins, runs: int, by: list[str]) -> DataFrame:
    """(by..., ord, chunk, cov) from flat histograms (by..., chunk, bin, ct); chunks without mass in a candidate stay."""
    keys = [*by, "chunk"]
    return covered(cumulative(hist, stats.select(*keys), bins, keys), cand, runs, by)


def covered(cum: DataFrame, cand: DataFrame, runs: int, by: list[str]) -> DataFrame:
    """`coverages` from prefix sums (by..., chunk, bin, cum)."""
    mass = range_mass(cum, cand, [*by, "chunk"])
    return mass.select(*by, "ord", "chunk", (F.col("mass") / F.lit(float(runs))).alias("cov"))


def dyadic_coverages(hist: DataFrame, groups: DataFrame, cand: DataFrame, bins: Bins, runs: int) -> DataFrame:
    """(ord, chunk, cov) from dyadic histograms (chunk, level, bin, ct), by the nodes that tile each candidate."""
    nodes = cover_nodes(cand, bins)
    grid = cand.select("ord").crossJoin(F.broadcast(groups.select("chunk").distinct()))
    hit = nodes.join(hist, ["level", "bin"]).groupBy("ord", "chunk").agg(F.sum("ct").alias("ct"))
    return grid.join(hit, ["ord", "chunk"], "left").select("ord", "chunk", (F.coalesce("ct", F.lit(0)) / F.lit(float(runs))).alias("cov"))


def search(stats: DataFrame, hist: DataFrame, bins: Bins, runs: int, alpha: float, eps: float, kind: str, least: int = 0, error: float = 0.0, seed: int = 0, tree: bool = False, fixed: bool = False, first: int = FIRST) -> DataFrame:
    """One row (l, u, ord, released): the first accepted candidate, else the whole range with nulls.

    Candidates are scored range by range (`frontier`) until one is accepted; the histograms are a checkpoint, so a range costs its own candidates
    only. eqtail halves eps and alpha and searches both sides on their own; then ord and released are those of the low side.
    """
    spark = stats.sparkSession
    sides = [("low", alpha / 2, eps / 2), ("up", alpha / 2, eps / 2)] if kind == "eqtail" else [(kind, alpha, eps)]
    groups = checkpointed(stats.select("chunk").distinct())
    held = checkpointed(hist if tree else cumulative(hist, groups, bins, ["chunk"]))
    found: dict[str, Row | None] = {}
    for side, a, e in sides:
        found[side] = None
        for lo, hi in frontier(*numbers(side, bins.count, least), first):
            cand = candidates(spark, side, bins.count, least, lo, hi)
            cov = dyadic_coverages(held, groups, cand, bins, runs) if tree else covered(held, cand, runs, [])
            best = accepted(cov, a, e / 2, e / 4, error, f"{seed}-{side}", fixed).join(cand, "ord").agg(F.min(F.struct("ord", "first", "last", "released")).alias("b")).first()["b"]
            if best is not None:
                found[side] = best
                break
    low, high = found[sides[0][0]], found[sides[-1][0]]
    number = lambda row, name, kind: F.lit(None if row is None else row[name]).cast(kind)
    return spark.range(1).select(
        F.coalesce(bins.left(number(low, "first", "int")), F.lit(float(bins.low))).alias("l"), F.coalesce(bins.right(number(high, "last", "int")), F.lit(float(bins.high))).alias("u"),
        number(low, "ord", "bigint").alias("ord"), number(low, "released", "double").alias("released"),
    )


def search_dims(
    stats: DataFrame, bins: dict[int, Bins], runs: int, alpha: float, eps: float, kind: str, least: dict[int, int] | None = None, error: float = 0.0, seed: int = 0, tree: bool = False, fixed: bool = False, first: int = FIRST
) -> DataFrame:
    """(dim, l, u, ord, released) from (chunk, dim, stat): every dimension with its own bins and least length; each spends the whole eps.

    All dimensions go through the same aggregates, keyed by `dim`; with `tree` the coverages come from dyadic histograms. Candidates are
    scored range by range (`frontier`), and a dimension leaves the search when one of its own is accepted.
    """
    if kind not in ("symm", "short"):
        raise ValueError(f"set type {kind!r} is not for all dimensions")
    spark = stats.sparkSession
    dims = F.broadcast(spark.createDataFrame([(d, float(b.low), float(b.high), b.count, b.depth) for d, b in sorted(bins.items())], "dim int, low double, high double, bins int, depth int"))
    known = stats.join(dims, "dim").filter((F.col("stat") >= F.col("low")) & (F.col("stat") < F.col("high")))
    number = F.floor((F.col("stat") - F.col("low")) * F.col("bins") / (F.col("high") - F.col("low"))).cast("int")
    hist = known.groupBy("dim", "chunk", "depth", number.alias("bin")).agg(F.count("*").alias("ct"))
    groups = checkpointed(stats.join(dims, "dim").select("dim", "chunk", "bins").distinct())
    if tree:
        each = hist.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
        held = each.groupBy("dim", "chunk", "level", F.expr("shiftright(bin, depth - 1 - level)").alias("_b")).agg(F.sum("ct").alias("ct")).withColumnRenamed("_b", "bin")
    else:
        full = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))).join(hist, ["dim", "chunk", "bin"], "left")
        upto = Window.partitionBy("dim", "chunk").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin
        held = full.select("dim", "chunk", "bin", F.sum(F.coalesce("ct", F.lit(0))).over(upto).alias("cum"))
    held = checkpointed(held)
    left = {d: frontier(*numbers(kind, own.count, (least or {}).get(d, 0)), first) for d, own in bins.items()}
    found: list[tuple] = []
    while left:
        cand = nodes = None
        for d, ranges in sorted(left.items()):
            if (own := next(ranges, None)) is None:
                del left[d]
                continue
            mine = candidates(spark, kind, bins[d].count, (least or {}).get(d, 0), *own)
            one = mine.select(F.lit(d).alias("dim"), "ord", "first", "last")
            cand = one if cand is None else cand.union(one)
            if tree:
                one = cover_nodes(mine, bins[d]).select(F.lit(d).alias("dim"), "ord", "level", "bin")
                nodes = one if nodes is None else nodes.union(one)
        if cand is None:
            break
        if tree:
            hit = nodes.join(held, ["dim", "level", "bin"]).groupBy("dim", "ord", "chunk").agg(F.sum("ct").alias("mass"))
            cov = cand.join(groups, "dim").join(hit, ["dim", "ord", "chunk"], "left")
        else:
            end = held.select("dim", "chunk", F.col("bin").alias("last"), F.col("cum").alias("_hi"))
            start = held.select("dim", "chunk", (F.col("bin") + 1).alias("first"), F.col("cum").alias("_lo"))
            cov = cand.join(end, ["dim", "last"]).join(start, ["dim", "chunk", "first"], "left").withColumn("mass", F.col("_hi") - F.coalesce("_lo", F.lit(0)))
        cov = cov.select("dim", "ord", "chunk", (F.coalesce("mass", F.lit(0)) / F.lit(float(runs))).alias("cov"))
        released = noisy_order_statistic(cov, "cov", ["dim", "ord"], eps / 2, eps / 4, 1.0, seed, fixed).filter(F.col("value") > F.lit(1 - alpha + error))
        for r in released.join(cand, ["dim", "ord"]).groupBy("dim").agg(F.min(F.struct("ord", "first", "last", "value")).alias("b")).collect():  # a row a dimension
            found.append((r.dim, *r.b))
            del left[r.dim]
    best = spark.createDataFrame(found, "dim int, ord long, first int, last int, value double")
    width = (F.col("high") - F.col("low")) / F.col("bins")
    edge = lambda b: F.round(F.col("low") + b * width, 13)
    return dims.join(best, "dim", "left").select(
        "dim", F.coalesce(edge(F.col("first")), F.col("low")).alias("l"), F.coalesce(edge(F.col("last") + 1), F.col("high")).alias("u"), "ord", F.col("value").alias("released")
    )


def symmetric_set(hist: DataFrame, bins: Bins, total: int, alpha: float, least: int = 0, error: float = 0.0) -> DataFrame:
    """(l, u): the smallest centred candidate with more than 1 - alpha + error of the mass, else the whole range."""
    cand = candidates(hist.sparkSession, "symm", bins.count, least)
    mass = range_mass(cumulative(hist, hist, bins, []), cand, [])
    hit = mass.filter(F.col("mass") / F.lit(float(total)) > F.lit(1 - alpha + error)).agg(F.min(F.struct("ord", "first", "last")).alias("c"))
    return hit.select(F.coalesce(bins.left(F.col("c.first")), F.lit(bins.low)).alias("l"), F.coalesce(bins.right(F.col("c.last")), F.lit(bins.high)).alias("u"))
