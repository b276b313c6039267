import random
import re

import numpy as np
import pytest

from veilstat.llm import ngram_join as nj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and 100 * same >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def made(seed, n):
    """Documents of many sizes with copies, edits of a few to many words, shared passages and chains of edits."""
    rng = random.Random(seed)
    words = lambda k: [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(k)]
    passage = words(30)
    docs = []
    while len(docs) < n:
        base = words(rng.choice([0, 1, 2, 3, 5, 6, 7, 8, 10, 14, 20, 26, 40, 67, 68, 90, 160, 300, 700]))
        if rng.random() < 0.3:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        docs.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            own = list(rng.choice(docs[-3:]))
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                at = rng.randint(0, len(own))
                own[at : at + rng.randint(0, 1)] = words(rng.randint(0, 2))
            docs.append(own)
    texts = [" ".join(d) for d in docs]
    return [(i * 3 % 1009 + 7, t.upper() if i % 11 == 0 else t.replace(" ", "\n\t", 2)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = made(seed, 420)
    got = nj.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_large_buckets(spark):
    """A group of near copies around one text whose members do not all link with its smallest id."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(70)]
    rows = [(1, " ".join(base[:52] + [f"x{i}" for i in range(10)]))]
    for i in range(2, 90):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"y{rng.randint(0, 30)}"
        if i % 9 == 0:
            own = own[: rng.randint(50, 70)]
        rows.append((i, " ".join(own)))
    got = nj.link(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (5, "A  B"), (None, "a b"), (None, "z z z z z z"), (6, "x " * 5000), (7, "x " * 40), (8, "q" * 200_000), (8, "other words of the same id here"), (9, "other words of the same id here")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, component_id string")
    got = nj.link(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert nj.link(df.limit(0)).count() == 0
    kept = nj.stage(spark, df.select("doc_id", "text"), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, None), (2, ""), (3, " \n"), (4, "a b"), (None, "a b"), (None, "z z z z z z"), (6, "x " * 5000), (8, "q" * 200_000), (8, "other words of the same id here")], key=str)


def test_texts_of_one_id_that_both_lead(spark):
    def fp(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return int(nj.prints(*nj.shingle_sets(data, np.array([0, len(data)])))[0][0])

    texts = {side: " ".join(f"w{side}_{i}" for i in range(60)) for side in "xyz"}
    docs = [(1, t) for t in texts.values()] + [(i, texts[side] + f" more{i}") for i, side in ((10, "x"), (11, "x"), (20, "y"), (21, "y"), (30, "z"))]
    pairs = [(1, fp(texts[side]), i, fp(texts[side] + f" more{i}")) for i, side in ((10, "x"), (11, "x"), (20, "y"), (21, "y"), (30, "z"))]
    pairs.append((1, fp(texts["x"]), 30, pairs[-1][3]))  # no link
    got = nj.verify(spark.createDataFrame(pairs[:-1], "a long, fa long, b long, fb long"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, i) for i in (10, 11, 20, 21, 30)]
    got = nj.verify(spark.createDataFrame(pairs[-1:], "a long, fa long, b long, fb long"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.count() == 0


def test_budget_of_differences():
    for n in range(1, 400):
        for k in range(1, n + 1):
            if 4 * k >= 3 * n:  # k of n kept is the extreme of containment
                smaller, band = k, nj.band_of(k)
                assert n == k or (band in nj.bands_for(n) and band in nj.bands_for(smaller))
                if n != k:
                    assert nj.allowed(n, band) >= n - k and nj.allowed(smaller, band) >= n - k


def test_runs_of_rows_hash_alike():
    texts = [t for _, t in made(5, 60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    tokens, bounds = nj.shingle_sets(data, offsets)
    for i, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        alone, _ = nj.shingle_sets(own, np.array([0, len(own)]))
        assert alone.tolist() == tokens[bounds[i] : bounds[i + 1]].tolist()
        assert len(alone) == len(shingles(t))


def thue_morse(steps):
    word = "a"
    for _ in range(steps):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_share_hashes_modulo_powers_of_two(spark):
    """A Thue-Morse word and its complement agree under every polynomial modulo 2^64."""
    one = thue_morse(11)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, f"x {one} y z u v"), (4, f"x {two} y z u v"), (5, one)]
    got = nj.link(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_words_across_blocks():
    """The hash of a word does not depend on where blocks of bytes end."""
    size = nj.BLOCK_BYTES
    word = "".join(random.Random(3).choice("abcdefg") for _ in range(3 * size + 17))
    hashes = lambda text: nj.word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0].tolist()
    for pad in (0, 1, size - 1, size, size + 1, 2 * size - 5):
        text = "q" * pad + " " + word + " tail"
        got = hashes(text)
        assert got[-2:] == hashes(word + " tail") and len(got) == 2 + (pad > 0)
    rows = ["k" * (size - 3), "abcdef", "g" * size, "", "hi there"]  # rows that start where others end
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    words, at = nj.word_hashes(data, offsets)
    for r, lo, hi in zip(rows, at[:-1], at[1:], strict=True):
        assert words[lo:hi].tolist() == hashes(r)


def test_sets_whose_coarse_segments_do_not_suffice(spark):
    """With a tenth of the segments many sets go the longer way; the links are the same."""
    rng = random.Random(4)
    passages = [[f"p{k}_{i}" for i in range(40)] for k in range(4)]
    rows = []
    for i in range(300):
        own = [w for p in rng.sample(passages, 3) for w in p]
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"y{rng.randint(0, 9)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nj.link(df, coarse=0.1).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    sets = nj.shingle_sets(data, np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]))
    frequent = np.unique(sets[0])
    assert len(nj.signatures(*sets, frequent, 0.1)[2]) > 0 and len(nj.signatures(*sets, frequent)[2]) == 0


def test_repeated_shingles_across_very_long_texts(spark):
    base = " ".join(f"v{i % 5000}" for i in range(300_000))
    rows = [(1, base), (2, base + " end"), (3, " ".join(f"u{i}" for i in range(200_000)))]
    got = nj.link(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 3)]


def test_components_of_few_edges_take_few_tasks(spark):
    """However many partitions a session's shuffles have; a path, a star, a triangle and both directions of one edge."""
    from veilstat.llm._components import components

    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 301), (301, 300), (7, 7)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    tracker, group = spark.sparkContext.statusTracker(), "components of few edges"
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup(group, group)
        got = components(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in keep.items():
            spark.conf.set(k, v)
    labels = [(k, 0) for k in range(41)] + [(100 + k, 100) for k in range(30)] + [(200, 200), (201, 200), (202, 200), (300, 300), (301, 300)]
    assert sorted(tuple(r) for r in got) == labels
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert 0 < tasks < 1000, tasks


def test_many_parts_without_broadcasts(spark, monkeypatch):
    """Edges and candidates of more rows than one partition holds, and labels joined by equi-joins."""
    monkeypatch.setattr("veilstat.llm._spark.PART_ROWS", 16)
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0)
    rows = made(3, 200)
    got = nj.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
