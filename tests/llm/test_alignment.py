import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from veilstat.llm import alignment

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def own():
    return alignment.aligner(None, None)


def ends(sizes):
    return np.cumsum(sizes).tolist()


def plain(own, text):
    """(A ids, B ids, groups, links) of a whole text by both libraries and sets of ends; None if a side's bytes are not the text's."""
    if not text:
        return None
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    want = (" " + text).encode()
    if b"".join(own.a_bytes[i] for i in a) != want or b"".join(own.b_bytes[i] for i in b) != want:
        return None
    end_a, end_b = ends([len(own.a_bytes[i]) for i in a]), ends([len(own.b_bytes[i]) for i in b])
    cuts, groups, at_a, at_b = sorted(set(end_a) & set(end_b)), [], 0, 0
    links = []
    for c in cuts:
        to_a, to_b = end_a.index(c) + 1, end_b.index(c) + 1
        groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
        links.append((a[to_a - 1], b[to_b - 1]))
        at_a, at_b = to_a, to_b
    return a, b, groups, links


def digests(own, rows):
    """What `statistics` gives for (doc_id, text) rows."""
    done = [(i, plain(own, t)) for i, t in rows]
    count = Counter(link for _, p in done if p for link in p[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, p in done:
        if p is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = p
            out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = ["", " ", "  ", "a", "x  y \n\n z\t q <s> </s> <|endoftext|> <unk> <0x41> ", "日本 語 é naïve café's ", "a▁b", " lead", "trail ", "\n", "don't  stop now \x1c x", "a" * 900 + " b   c", "🙂 🙂🙂 ok", "½ ﬁ Å Å", "  x 　 y"]


def test_owners_and_overlaps():
    a, b = alignment.owners(np.array([2, 1, 3])), alignment.owners(np.array([1, 2, 3]))
    assert a.tolist() == [0, 0, 1, 2, 2, 2]
    left, right, cut = alignment.overlaps(a, b)
    assert list(zip(left.tolist(), right.tolist(), cut.tolist(), strict=True)) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, True)]
    assert [len(c) for c in alignment.overlaps(a[:0], b[:0])] == [0, 0, 0]


def test_texts_are_cut_without_a_trace(own):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["the", "ing", " ", "  ", "\n", ".", "é", "1", "'s", "\t", "日", "Z", "▁", "-"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text, (groups, links, na, nb) in zip(texts, own.texts(texts), strict=True):
        p = plain(own, text)
        if p is None:
            assert (groups, links, na, nb) == ("", b"", 0, 0), text
        else:
            assert (groups, na, nb) == (";".join(p[2]), len(p[0]), len(p[1])), text
            assert np.frombuffer(links, "<u8").tolist() == [x * own.b_count + y for x, y in p[3]], text


def test_cache_is_bounded(own, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_FIELDS", 50)
    texts = [f"word{i} other{i % 7}" for i in range(400)]
    got = [r for lo in range(0, 400, 40) for r in own.texts(texts[lo : lo + 40])]
    assert len(own.young) <= 50 + 80 and [g[0] for g in got] == [";".join(plain(own, t)[2]) for t in texts]
    assert all(len(f) <= alignment.CACHE_CHARS for f in own.young)


@pytest.mark.parametrize("heavy", [1 << 20, 40, 0])
def test_statistics(spark, own, heavy):
    """Counts of pairs through the broadcast and through the join: the same rows, all texts, repeated rows, null ids."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9000 + i, t) for i, t in enumerate(ODD)] + [(None, "one two"), (9001, None), docs[0], docs[0]]
    df = spark.createDataFrame([(*r, "x") for r in docs], SCHEMA + ", links string").repartition(3)
    got = sorted((tuple(r) for r in alignment.statistics(df, heavy=heavy).collect()), key=str)
    assert got == digests(own, docs)


def test_kept_columns_and_empty_tables(spark, own):
    df = spark.createDataFrame([(1, "a small text"), (2, None)], SCHEMA)
    got = {r.doc_id: r for r in alignment.align(df).collect()}
    assert got[1].groups == ";".join(plain(own, "a small text")[2]) and got[1].n_links == len(got[1].links) // 8 and got[2].groups == "" and got[2].groups_sha256 == ""
    empty = alignment.statistics(spark.createDataFrame([], T._parse_datatype_string(SCHEMA)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_most_texts_of_the_documents_have_tokens(spark):
    row = alignment.query(spark, "/root/testdata/sf0.001").selectExpr("count(*)", "count_if(n_a > 0)", "count_if(n_groups <= least(n_a, n_b))", "count_if(n_best <= n_links)").first()
    assert row[0] == row[2] == row[3] and row[1] >= 0.95 * row[0]
