import hashlib
import random
import struct

import pytest
from public_tokenizers import path
from pyspark.sql import types as T
from tokenizers import Tokenizer

from veilstat.llm import bpe

FILE = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def same(own, library, text):
    ids, decoded = own.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text[:80]
    assert decoded == library.decode(want, skip_special_tokens=False)


def test_texts(own, library):
    for t in ["", " ", "Hello  World's été 123", "<|endoftext|>x<|startoftext|> y", "ΑΣ İx ﬁ é \x1c a\x85b\xa0c", "日本語 don't 'RE we'll", "a" * 5000, "ab" * 4000 + "'s", "!?" * 3000]:
        same(own, library, t)


def test_every_plain_code_point(own, library):
    for c in map(chr, range(0x2100)):
        if not bpe.OTHER.match(c):
            same(own, library, f"a{c}b {c} {c}{c}'{c}")


def test_random_texts_with_small_leaves(own, library, monkeypatch):
    rng = random.Random(3)
    scan = own.scan_plain
    for _ in range(300):
        text = "".join(rng.choice("abcethr'' \n12,.É") for _ in range(rng.randint(0, 400))).lower()
        assert bpe.tree_words(scan, text, 0, len(text), leaf=rng.randint(1, 30)) == scan(text, 0, len(text))


def test_random_long_words(own):
    rng = random.Random(4)
    for _ in range(200):
        w = "".join(rng.choice(["th", "e", "er", "in", "g", "a", "q", "zz", "on"]) for _ in range(rng.randint(30, 300)))
        symbols = [*w[:-1], w[-1] + "</w>"]
        assert own.merge_tree(symbols, leaf=rng.randint(2, 20)) == own.merge(symbols)


def test_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", None), (3, "a b", None), (None, "c", "y")]
    got = bpe.encode_decode(spark.createDataFrame(rows, schema)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert all(r.ids_sha256 == r.decoded_sha256 == empty for r in got if r.doc_id in (1, 2))
    assert bpe.encode_decode(spark.createDataFrame([], schema)).count() == 0


def test_long_texts_by_pieces(spark, library):
    """Pieces encoded as rows of their own, joined: the library's ids, for every copy of a row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    made = [(9001, "x<|endoftext|>" + "Hello world's été 12! " * 60 + "<|endoftext|>"), (9001, "ΑΣ ﬁ 日本 " * 90), (9002, "q" * 3000), (9002, "q" * 3000), (None, "one two " * 100)]
    docs = docs.union(spark.createDataFrame(made, "doc_id long, text string")).repartition(4)
    got = bpe.encode_decode(docs, long_chars=200, piece_chars=64).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in got)


def test_words_of_the_documents_go_through_the_tree(spark, own, monkeypatch):
    """Words beyond a leaf are common in the documents, so halves are merged and joined there."""
    words = {w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for w in own.plain_words(r.text or "")}
    long = [w for w in words if len(w.encode()) > bpe.LEAF_SYMBOLS]
    assert len(long) > 100
    for w in long:
        shown = "".join(own.shown[b] for b in w.encode())
        assert own.merge_tree([*shown[:-1], shown[-1] + own.suffix]) == [t.value for t in own.library.model.tokenize(shown)]
