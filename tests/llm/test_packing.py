import random
from collections import Counter, defaultdict

from veilstat.llm import packing


def brute(lengths, sources, clusters, capacity, most):
    """Best fit by trying every open bin."""
    bins, out = [], []
    for length, s, c in zip(lengths, sources, clusters):
        fits = [(cap, i) for i, (cap, ss, cs) in enumerate(bins) if cap >= length and (c is None or c not in cs) and (s is None or ss[s] < most[s])]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append((capacity, Counter(), set()))
        cap, ss, cs = bins[i]
        if s is not None:
            ss[s] += 1
        if c is not None:
            cs.add(c)
        bins[i] = (cap - length, ss, cs)
        out.append(i)
    return out


def test_like_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        n, per = rng.randint(0, 120), rng.randint(1, 4)
        rows = [(rng.choice([0, 3, 7, rng.randint(0, 40)]), rng.choice([None, "a", "a", "b", "c"]), rng.choice([None, 1, 2, rng.randint(3, 90)])) for _ in range(n)]
        rows.sort(key=lambda r: (-r[0], r[2] or 0, r[1] or ""))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], []]
        most = packing.limits(columns[0], columns[1], 40, per, rng.choice([0, 1.5]))
        assert [b for b, _ in packing.pack(*columns, 40, most)] == brute(*columns, 40, most)


def test_rows(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    rows = [(i, text(rng.choice([0, 5, 30, 170])), rng.choice(["hot", "hot", "x", None]), 1) for i in range(200)]
    rows += [(1000 + i, "one copied text", "hot", 1) for i in range(60)] + [(7, rows[7][1], "x", 1), (5000, None, None, None), (5001, "é" * 101, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int")
    got = packing.best_fit(docs, capacity=50, per_source=2, shard_chars=3000).collect()
    source = defaultdict(list)
    texts = defaultdict(list)
    for i, t, s, _ in rows:
        source[i].append(s)
        texts[i].append(t or "")
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.stop))
        bins[r.shard, r.bin].append(r)
    for i, ts in texts.items():
        want = sorted(p for t in ts for p in ([(a, min(a + 50, len(t))) for a in range(0, len(t), 50)] or [(0, 0)]))
        assert sorted(pieces[i]) == want
    shard = defaultdict(list)
    for r in got:
        shard[r.shard].append(r)
    most = {k: packing.limits([r.stop - r.start for r in rs], [source[r.doc_id][0] for r in rs], 50, 2) for k, rs in shard.items()}
    for rs in bins.values():
        assert sum(r.stop - r.start for r in rs) <= 50
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert all(n <= most[rs[0].shard][s] for s, n in Counter(source[r.doc_id][0] for r in rs if len(source[r.doc_id]) == 1 and source[r.doc_id][0]).items())
        assert sum(1000 <= r.doc_id < 1060 for r in rs) <= 1
    assert packing.best_fit(docs.limit(0)).count() == 0


def filled(got, capacity):
    bins = {(r.shard, r.bin) for r in got}
    return sum(r.stop - r.start for r in got) / (capacity * len(bins))


def test_one_source_fills_its_bins(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 100))), "only") for i in range(1500)]
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=2000).collect()
    assert len(got) == 1500 and filled(got, 2000) > 0.95


def test_shards_follow_pieces_too(spark):
    """A table of empty texts, all of one id, is dealt over many shards."""
    rows = spark.range(3000).selectExpr("1L as doc_id", "case when id % 2 = 0 then '' end as text", "'s' as source")
    got = packing.best_fit(rows, shard_pieces=200).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 3000 and len(sizes) == 15 and max(sizes.values()) < 400
    assert packing.best_fit(rows).select("shard").distinct().count() == 1


def test_order_of_equal_pieces(spark):
    """Equal lengths go by source, cluster, document and piece, whatever the partitions."""
    rows = [(i, f"{i % 7:05}", "ab"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(tuple(r) for r in packing.best_fit(d, capacity=40).collect()) for d in (df.repartition(1), df.repartition(7)))
    assert one == two
