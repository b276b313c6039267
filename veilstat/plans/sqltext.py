"""SQL fragments shared by the queries' SQL twins: whole tables, chunks, draws and histograms in CTEs."""

from __future__ import annotations

from veilstat.functions.keyed import KeyedSql as K

CHUNKS, RUNS, SEED = 12, 100, 0  # 100 runs: the least of the sizing rule
LOW, HIGH, BINS = -160.0, 160.0, 64
ALPHA, EPS = 0.05, 20.0
VALUE_LOW, VALUE_HIGH, EPS_PARAM, EPS_SIGMA = -10.0, 100.0, 0.5, 0.5

BASE = "base AS (SELECT c_custkey AS id, floor(c_acctbal / 100) AS v FROM customer), size AS (SELECT count(*) AS n, CAST(floor(count(*) / 12) AS BIGINT) AS b FROM base)"
POS = f"pos AS (SELECT id, v, row_number() OVER (ORDER BY {K.digest('perm', str(SEED), 'id')}, id) - 1 AS pos FROM base)"
CHUNKED = f"""{BASE}, {POS}, sized AS (SELECT n, b, n // b + CASE WHEN (n // b) * b < n - 1 THEN 1 ELSE 0 END AS s FROM size),
chunked AS (SELECT id, v, CAST(least(pos // b, s - 1) AS INTEGER) AS chunk, pos - b * least(pos // b, s - 1) AS slot FROM pos, sized)"""
DROPPED = f"{BASE}, {POS}, chunked AS (SELECT id, v, CAST(pos // b AS INTEGER) AS chunk, pos % b AS slot FROM pos, size WHERE pos < (n // b) * b)"
WHOLE = f"""{BASE}, {POS}, sized AS (SELECT n // b + CASE WHEN (n // b) * b < n - 1 THEN 1 ELSE 0 END AS s FROM size),
chunked AS (SELECT id, v, CAST(chunk AS INTEGER) AS chunk, pos AS slot FROM pos, (SELECT unnest(generate_series(0, (SELECT s - 1 FROM sized))) AS chunk))"""


def statistics(private: bool = False, studentize: bool = False, source: str = CHUNKED) -> str:
    """CTEs up to `stats` (chunk, run, est, stat) of the drawn resamples of the mean; private: the estimate and the deviation are released."""
    m = max(abs(VALUE_LOW), abs(VALUE_HIGH))
    width = f"CAST({VALUE_HIGH - VALUE_LOW} AS DOUBLE) / n"
    deviation = f"({m * m} / CAST(n AS DOUBLE) + {2 * m * (VALUE_HIGH - VALUE_LOW)} / (CAST(n AS DOUBLE) * (n - CAST(1 AS DOUBLE))))"
    noise = lambda scale, eps, purpose: f" + {K.laplace(f'({scale}) / CAST({eps} AS DOUBLE)', purpose, str(SEED), 'chunk', 'run')}" if private else ""
    return f"""{source}, chunk_stat AS (SELECT chunk, avg(v) AS theta, count(*) AS nb FROM chunked GROUP BY chunk),
draw AS (SELECT chunk, run, {K.index('nb', 'boot', str(SEED), 'chunk', 'run', 'k')} AS slot
  FROM chunk_stat, (SELECT CAST(unnest(generate_series(0, {RUNS - 1})) AS INTEGER) AS run), (SELECT CAST(unnest(generate_series(0, (SELECT n - 1 FROM size))) AS INTEGER) AS k)),
raw_est AS (SELECT d.chunk, d.run, avg(c.v) AS m, stddev_samp(c.v) AS s FROM draw d JOIN chunked c ON d.chunk = c.chunk AND d.slot = c.slot GROUP BY d.chunk, d.run),
est AS (SELECT chunk, run, m{noise(width, EPS_PARAM, 'boot-est')} AS est, s{noise(deviation, EPS_SIGMA, 'boot-std')} AS s FROM raw_est, size),
stats AS (SELECT e.chunk, e.run, e.est, sqrt(CAST((SELECT n FROM size) AS DOUBLE)) * (t.theta - e.est){" / e.s" if studentize else ""} AS stat FROM est e JOIN chunk_stat t ON e.chunk = t.chunk)"""


STATS = statistics()
PRIVATE = statistics(True)


def bin_of(x: str, low: float = LOW, high: float = HIGH, count: int = BINS) -> str:
    return f"CAST(floor(({x} - CAST({low} AS DOUBLE)) * CAST({count} AS DOUBLE) / CAST({high - low} AS DOUBLE)) AS INTEGER)"


HISTOGRAM = f"""hist AS (SELECT chunk, {bin_of('stat')} AS bin, count(*) AS ct FROM stats WHERE stat >= {LOW} AND stat < {HIGH} GROUP BY 1, 2),
grid AS (SELECT c.chunk, CAST(g AS INTEGER) AS bin FROM (SELECT DISTINCT chunk FROM stats) c, (SELECT unnest(generate_series(0, {BINS - 1})) AS g)),
cum AS (SELECT grid.chunk, grid.bin, CAST(sum(coalesce(ct, 0)) OVER (PARTITION BY grid.chunk ORDER BY grid.bin) AS BIGINT) AS cum FROM grid LEFT JOIN hist ON grid.chunk = hist.chunk AND grid.bin = hist.bin)"""
HIST = f"{STATS}, {HISTOGRAM}"
PRIVATE_HIST = f"{PRIVATE}, {HISTOGRAM}"
ABLATION_HIST = f"{statistics(True, source=WHOLE)}, {HISTOGRAM}"


def candidates(kind: str, m: int = BINS) -> str:
    """SELECT of (ord, f, l) in the order that a search tries them."""
    if kind == "symm":
        q = m // 2
        return f"SELECT i AS ord, {q - 1} - i AS f, {q} + i AS l FROM (SELECT unnest(generate_series(0, {q - 2})) AS i)"
    if kind == "low":
        return f"SELECT i AS ord, {m // 2} - i AS f, {m - 1} AS l FROM (SELECT unnest(generate_series(0, {m // 2})) AS i)"
    if kind == "up":
        return f"SELECT i AS ord, 0 AS f, {m // 2} + i AS l FROM (SELECT unnest(generate_series(0, {m - m // 2 - 1})) AS i)"
    places = f"""SELECT w, k, t, CASE WHEN k % 2 = 0 THEN CASE WHEN t % 2 = 0 THEN k // 2 - t // 2 ELSE k // 2 + t // 2 END
      WHEN t = 0 THEN k // 2 WHEN t % 2 = 1 THEN k // 2 - (t + 1) // 2 ELSE k // 2 + t // 2 END AS p
      FROM (SELECT w, {m} - w AS k, unnest(generate_series(0, {m} - w - 1)) AS t FROM (SELECT unnest(generate_series(0, {m - 1})) AS w))"""
    return f"SELECT w * {m} - w * (w - 1) // 2 + t AS ord, p AS f, p + w AS l FROM ({places})"


def searched(kind: str, side: str, alpha: float = ALPHA, eps: float = EPS) -> str:
    """CTEs `cand_<side>` to `best_<side>` (ord, f, l, released) on top of `cum`; at most one row."""
    g, l_ = eps / 2, eps / 4
    noise = f"(n / CAST(2 AS DOUBLE) + {K.laplace(repr(1 / g), 'order-g', chr(39) + f'{SEED}-{side}' + chr(39), 'ord')} + {K.laplace(repr(1 / l_), 'order-l', chr(39) + f'{SEED}-{side}' + chr(39), 'ord')})"
    return f"""cand_{side} AS ({candidates(kind)}),
cov_{side} AS (SELECT c.ord, h.chunk, (h.cum - coalesce(a.cum, 0)) / CAST({RUNS} AS DOUBLE) AS cov FROM cand_{side} c JOIN cum h ON h.bin = c.l LEFT JOIN cum a ON a.bin = c.f - 1 AND a.chunk = h.chunk),
rank_{side} AS (SELECT ord, cov, row_number() OVER (PARTITION BY ord ORDER BY cov) AS r FROM cov_{side}),
idx_{side} AS (SELECT ord, n, CAST(CASE WHEN z < 0 THEN ceil(z) ELSE floor(z) END AS BIGINT) AS ix FROM (SELECT ord, n, {noise} AS z FROM (SELECT ord, count(*) AS n FROM cov_{side} GROUP BY ord))),
rel_{side} AS (SELECT i.ord, CASE WHEN ix < 1 THEN CAST(0 AS DOUBLE) WHEN ix > n THEN CAST(1 AS DOUBLE) ELSE r.cov END AS released FROM idx_{side} i LEFT JOIN rank_{side} r ON r.ord = i.ord AND r.r = i.ix),
best_{side} AS (SELECT c.ord, c.f, c.l, rel.released FROM rel_{side} rel JOIN cand_{side} c ON c.ord = rel.ord WHERE rel.released > CAST({1 - alpha!r} AS DOUBLE) ORDER BY c.ord LIMIT 1)"""


def left_edge(b: str, low: float = LOW, width: float = (HIGH - LOW) / BINS) -> str:
    return f"round(CAST({low} AS DOUBLE) + {b} * CAST({width} AS DOUBLE), 13)"
