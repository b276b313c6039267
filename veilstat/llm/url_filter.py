"""URL filter by a path-template tree, in DataFrame operations only.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the
end. Explicit rules decide first: a rule fits its host and all subdomains if the path starts with the rule's path;
the longest (host, then path) wins.

Other URLs get the verdict of their path template. Per host, the segments of the paths form a tree, of any depth:
1. segments that vary by form (numbers, hexadecimal keys, dates, file names of these) become wildcards;
2. segments that vary by statistics do too: from the host down, a node with many different children for its rows has
   them replaced by `*`, which pools what lies below them;
3. branches of a node whose distribution of sub-templates is near (total variation distance) that of all its branches
   with the same most frequent sub-template together are merged into one branch `~`, again from the host down; a
   branch is compared with the pooled ones, never pairwise, and one that has no like keeps its name;
4. a template is rejected if the smoothed share of blocked rows among its labelled ones (those that a rule decides)
   reaches REJECT. A template without labels has the prior share.

Only nodes of MIN_ROWS rows or more are generalised or merged, so a level is worked on only while there are any: the
number of rounds is the depth down to which paths repeat, not that of the deepest path. All counts are partial sums
by node, so a host with a third of all rows costs no more than its number of templates; the pages meet the tree again
in one equi-join.

Null or malformed URLs: host and path empty, no rule, verdict allow. Empty table: empty result. Repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.llm._spark import checkpointed
from veilstat.sources.tables import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MIN_ROWS = 20
VARIETY = 0.3
NEAR = 0.2
PRIOR_ROWS, PRIOR_SHARE, REJECT = 10.0, 0.1, 0.6
SQL_LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def general(segment: Column) -> Column:
    """A segment with what varies by form replaced by a wildcard that keeps the form."""
    s = F.regexp_replace(segment, r"^[0-9]+(\.[A-Za-z]{1,5})?$", "{n}$1")
    s = F.regexp_replace(s, r"^[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?(\.[A-Za-z]{1,5})?$", "{d}$1")
    s = F.when(s.rlike("[0-9]"), F.regexp_replace(s, r"^[0-9A-Fa-f-]{8,}(\.[A-Za-z]{1,5})?$", "{x}$1")).otherwise(s)
    return F.regexp_replace(s, r"[0-9]{3,}", "{n}")


def with_parts(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, rule verdict, and the generalised segments after the first slash."""
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    parts = F.transform(F.split(F.col("path"), "/"), general)
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("segs"))


def template_verdicts(parts: DataFrame) -> DataFrame:
    """(host, segs) of every generalised path with its template, purity and the method's verdict."""
    labelled, blocked = F.count("verdict"), F.count(F.when(F.col("verdict") == "block", 1))
    none = F.array().cast("array<string>")
    paths = parts.groupBy("host", "segs").agg(F.count("*").alias("n"), labelled.alias("labelled"), blocked.alias("blocked"))
    # A row a path: the pages are not read again for each level.
    tree = descended(checkpointed(paths.withColumns({"done": none, "rest": F.col("segs")})), starred)
    tree = descended(checkpointed(tree.withColumns({"rest": F.concat("done", "rest"), "done": none})), merged)
    tree = tree.withColumn("template", F.concat("done", "rest"))
    purity = (F.sum("blocked") + F.lit(PRIOR_ROWS * PRIOR_SHARE)) / (F.sum("labelled") + F.lit(PRIOR_ROWS))
    judged = tree.groupBy("host", "template").agg(purity.alias("purity"))
    verdict = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return tree.select("host", "segs", "template").join(judged, ["host", "template"]).select("host", "segs", F.concat(F.col("host"), F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", verdict.alias("method_verdict"))


def descended(tree: DataFrame, label) -> DataFrame:
    """The tree after `label` has gone down the levels, moving a segment a level from `rest` to `done`."""
    while True:
        nodes, marked = label(tree)
        if nodes.filter(F.col("total") >= MIN_ROWS).isEmpty():
            return tree
        moved = tree.withColumn("head", F.try_element_at("rest", F.lit(1))).join(marked, ["host", "done", "head"], "left")
        tree = checkpointed(
            moved.select(
                "host", "segs", "n", "labelled", "blocked",
                F.when(F.col("head").isNull(), F.col("done")).otherwise(F.array_append("done", F.coalesce("label", "head"))).alias("done"),
                F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"),
            )
        )


def starred(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (host, done, total), and the children (host, done, head, label) of those with many kinds for their rows."""
    children = tree.filter(F.size("rest") > 0).groupBy("host", "done", F.col("rest")[0].alias("head")).agg(F.sum("n").alias("n"))
    nodes = children.groupBy("host", "done").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    many = nodes.filter((F.col("total") >= MIN_ROWS) & (F.col("kinds") >= VARIETY * F.col("total"))).select("host", "done")
    return nodes, children.join(many, ["host", "done"]).filter("head <> ''").select("host", "done", "head", F.lit("*").alias("label"))


def merged(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (host, done, total), and the branches (host, done, head, label) that are like the rest of their node."""
    below = tree.filter(F.size("rest") > 1).select("host", "done", F.col("rest")[0].alias("head"), F.slice("rest", 2, F.size("rest") - 1).alias("tail"), F.col("n").cast("double").alias("n"))
    own = below.groupBy("host", "done", "head", "tail").agg(F.sum("n").alias("n"))
    # The branches of a node by their most frequent sub-template.
    branches = own.groupBy("host", "done", "head").agg(F.sum("n").alias("branch"), F.max(F.struct("n", "tail")).alias("most")).select("host", "done", "head", "branch", F.col("most.tail").alias("lead"))
    nodes = branches.groupBy("host", "done", "lead").agg(F.sum("branch").alias("total"))
    large = nodes.filter(F.col("total") >= MIN_ROWS)
    led = own.join(branches, ["host", "done", "head"])
    pooled = led.groupBy("host", "done", "lead", "tail").agg(F.sum("n").alias("pooled"))
    both = led.filter(F.col("branch") >= MIN_ROWS).join(large, ["host", "done", "lead"]).join(pooled, ["host", "done", "lead", "tail"])
    # Twice the distance times branch and total, in whole numbers; sub-templates that a branch lacks add their pooled share.
    apart = F.sum(F.abs(F.col("n") * F.col("total") - F.col("pooled") * F.col("branch"))) + F.max(F.col("branch") * F.col("total")) - F.sum(F.col("pooled") * F.col("branch"))
    far = both.groupBy("host", "done", "lead", "head").agg(apart.alias("apart"), F.max(F.col("branch") * F.col("total")).alias("unit"))
    near = far.filter(F.col("apart") <= F.lit(2 * NEAR) * F.col("unit"))
    several = near.groupBy("host", "done", "lead").agg(F.count("*").alias("k")).filter("k > 1").select("host", "done", "lead")
    return nodes, near.join(several, ["host", "done", "lead"]).select("host", "done", "head", F.lit("~").alias("label"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and its purity for every row."""
    parts = with_parts(pages, rules)
    found = template_verdicts(parts)
    return parts.join(found, ["host", "segs"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "method_verdict", F.lit("allow")).alias("verdict"), "template", F.round("purity", 6).alias("purity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return url_filter(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The whole filter as SQL for another engine, down to SQL_LEVELS segments."""
    g = "regexp_replace(x, '^[0-9]+(\\.[A-Za-z]{1,5})?$', '{n}\\1')"
    g = f"regexp_replace({g}, '^[0-9]{{4}}-[0-9]{{2}}(?:-[0-9]{{2}})?(\\.[A-Za-z]{{1,5}})?$', '{{d}}\\1')"
    g = f"CASE WHEN regexp_matches({g}, '[0-9]') THEN regexp_replace({g}, '^[0-9A-Fa-f-]{{8,}}(\\.[A-Za-z]{{1,5}})?$', '{{x}}\\1') ELSE {g} END"
    g = f"regexp_replace({g}, '[0-9]{{3,}}', '{{n}}', 'g')"
    rule, verdict = "NULL", "NULL"
    for h, p, v in sorted(RULES, key=lambda r: (len(r[0]), len(r[1]))):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h + p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    ctes = [
        f"u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"p AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, list_transform(string_split(path, '/')[2:], lambda x: {g}) AS segs FROM u)",
        "t0 AS (SELECT host, segs, CAST(count(*) AS DOUBLE) AS n, count(verdict) AS labelled, count(*) FILTER (verdict = 'block') AS blocked, CAST([] AS VARCHAR[]) AS done, segs AS rest FROM p GROUP BY host, segs)",
    ]
    step = "SELECT t.host, t.segs, t.n, t.labelled, t.blocked, CASE WHEN len(t.rest) = 0 THEN t.done ELSE list_append(t.done, coalesce(m.label, t.rest[1])) END AS done, t.rest[2:] AS rest"
    for i in range(SQL_LEVELS):
        ctes += [
            f"c{i} AS (SELECT host, done, rest[1] AS head, sum(n) AS n FROM t{i} WHERE len(rest) > 0 GROUP BY ALL)",
            f"k{i} AS (SELECT host, done, sum(n) AS total, count(*) AS kinds FROM c{i} GROUP BY ALL)",
            f"m{i} AS (SELECT c.host, c.done, c.head, '*' AS label FROM c{i} c JOIN k{i} k ON c.host = k.host AND c.done = k.done WHERE total >= {MIN_ROWS} AND kinds >= {VARIETY} * total AND head <> '')",
            f"t{i + 1} AS ({step} FROM t{i} t LEFT JOIN m{i} m ON t.host = m.host AND t.done = m.done AND t.rest[1] = m.head)",
        ]
    ctes.append(f"g0 AS (SELECT host, segs, n, labelled, blocked, CAST([] AS VARCHAR[]) AS done, list_concat(done, rest) AS rest FROM t{SQL_LEVELS})")
    for i in range(SQL_LEVELS):
        ctes += [
            f"o{i} AS (SELECT host, done, rest[1] AS head, rest[2:] AS tail, sum(n) AS n FROM g{i} WHERE len(rest) > 1 GROUP BY ALL)",
            f"r{i} AS (SELECT *, row_number() OVER (PARTITION BY host, done, head ORDER BY n DESC, tail DESC) AS place, sum(n) OVER (PARTITION BY host, done, head) AS branch FROM o{i})",
            f"l{i} AS (SELECT r.*, b.tail AS lead FROM r{i} r JOIN r{i} b ON r.host = b.host AND r.done = b.done AND r.head = b.head AND b.place = 1)",
            f"q{i} AS (SELECT host, done, lead, tail, sum(n) AS pooled FROM l{i} GROUP BY ALL)",
            f"a{i} AS (SELECT host, done, lead, sum(pooled) AS total FROM q{i} GROUP BY ALL)",
            f"""f{i} AS (SELECT o.host, o.done, o.lead, o.head, sum(abs(o.n * total - pooled * branch)) + max(branch * total) - sum(pooled * branch) AS apart, max(branch * total) AS unit
FROM l{i} o JOIN a{i} a ON o.host = a.host AND o.done = a.done AND o.lead = a.lead JOIN q{i} q ON o.host = q.host AND o.done = q.done AND o.lead = q.lead AND o.tail = q.tail
WHERE total >= {MIN_ROWS} AND branch >= {MIN_ROWS} GROUP BY o.host, o.done, o.lead, o.head)""",
            f"s{i} AS (SELECT *, count(*) OVER (PARTITION BY host, done, lead) AS k FROM f{i} WHERE apart <= CAST({2 * NEAR} AS DOUBLE) * unit)",
            f"g{i + 1} AS ({step} FROM g{i} t LEFT JOIN (SELECT host, done, head, '~' AS label FROM s{i} WHERE k > 1) m ON t.host = m.host AND t.done = m.done AND t.rest[1] = m.head)",
        ]
    ctes += [
        f"e AS (SELECT host, segs, labelled, blocked, list_concat(done, rest) AS template FROM g{SQL_LEVELS})",
        f"j AS (SELECT host, template, (sum(blocked) + CAST({PRIOR_ROWS * PRIOR_SHARE} AS DOUBLE)) / (sum(labelled) + CAST({PRIOR_ROWS} AS DOUBLE)) AS purity FROM e GROUP BY host, template)",
    ]
    return f"""WITH {", ".join(ctes)}
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.verdict, CASE WHEN j.purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, p.host || '/' || array_to_string(e.template, '/') AS template, round(j.purity, 6) AS purity
FROM p LEFT JOIN e ON p.host = e.host AND p.segs = e.segs LEFT JOIN j ON e.host = j.host AND e.template = j.template"""


ORACLE_SQL = _sql()
