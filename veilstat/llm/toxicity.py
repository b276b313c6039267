"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

Features (whole text): hits of a lexicon per word (also their log, kinds, summed and largest weight), hits near a
second-person word, shares of capitals, runs of capitals, exclamation and question marks, other punctuation,
letters broken by signs or digits (obfuscation), tripled characters, and the log of the word count.

The lexicon is learned from labels: words and word beginnings whose log odds of a toxic document are high. Labels
come from at most TRAIN_ROWS labelled documents outside the held-out fold (smallest hash of the id, one row an id). Documents that
are near copies of each other (same smallest hash of five words in a row) count once. They are dealt by that hash into three parts:
one for the lexicon, one for the trees, one for the isotonic fit, so that no part sees what it is measured on.

Nulls and empty texts are scored like any text without words. Without labels of both kinds every score is the
smoothed share of toxic labels. A null id is not held out and not learned from. Repeated rows stay; columns of the
result's names in the input are replaced; an empty table gives an empty result. Texts are read in slices of whole rows
of SLICE_BYTES; a longer text costs about thirty bytes of memory a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstat.llm._arrow import byte_view, row_sums, slices
from veilstat.llm._boost import Boosted, fit_boosted, isotonic
from veilstat.llm._spark import checkpointed, fold_of, held_out, one_row_an_id, shared, small_batches, with_text_columns
from veilstat.sources.tables import table

TRAIN_ROWS = 12_000
LEXICON = 400
NEAR_BYTES = 48
SLICE_BYTES = 1 << 19
LEAST_ODDS = 1.5
ADDED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = [
    "you", "your", "yours", "yourself", "u", "ya", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tus", "usted", "ustedes", "vosotros",
]

_plain = np.full(256, 32, np.uint8)
_plain[97:123] = _plain[65:91] = np.arange(97, 123)
_plain[48:58] = np.arange(48, 58)
_plain[128:] = np.arange(128, 256)
PLAIN = bytes(_plain)
_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_capital = np.zeros(256, bool)
_capital[65:91] = True
_sign = np.zeros(256, bool)
_sign[[ord(c) for c in "*@$#0123456789"]] = True
_punctuation = np.array([chr(i) in "\"#$%&'()*+-/:;<=>@[\\]^_`{|}~" for i in range(256)])


def terms_of(words: set[bytes]) -> set[bytes]:
    """Whole words as ` word ` and beginnings of 4 to 7 bytes as ` begin`, of words of 3 bytes or more."""
    out = set()
    for w in words:
        if 3 <= len(w) <= 40:
            out.add(b" " + w + b" ")
            out.update(b" " + w[:k] for k in range(4, min(len(w), 8)))
    return out


@dataclass
class Lexicon:
    weights: dict[bytes, float]

    def automaton(self):
        a = ahocorasick.Automaton()
        for i, (term, weight) in enumerate(sorted(self.weights.items())):
            a.add_word(term.decode("latin-1"), (i, weight))
        for w in SECOND_PERSON:
            key = f" {w.encode().decode('latin-1')} "
            if key not in a:
                a.add_word(key, (-1, 0.0))
        a.make_automaton()
        return a


def _shift_and(*parts: np.ndarray) -> np.ndarray:
    """True where all parts hold at consecutive bytes; position of the first."""
    n, k = len(parts[0]), len(parts)
    out = np.zeros(n, bool)
    if n >= k:
        out[: n - k + 1] = np.logical_and.reduce([p[i : n - k + 1 + i] for i, p in enumerate(parts)])
    return out


def features(data: np.ndarray, offsets: np.ndarray, automaton) -> np.ndarray:
    """The feature matrix of a run of rows."""
    rows, length = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    plain = data.tobytes().translate(PLAIN)
    text = np.frombuffer(plain, np.uint8)
    space = text == 32
    start = ~space
    start[1:] &= space[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = ~space[first]
    words = row_sums(start, offsets)
    hits, kinds, weight, most, near = (np.zeros(rows) for _ in range(5))
    string, bounds = plain.decode("latin-1"), offsets.tolist()
    for i in range(rows):
        found, second, best, total = [], [], 0.0, 0.0
        for end, (term, w) in automaton.iter(f" {string[bounds[i] : bounds[i + 1]]} "):
            if term < 0:
                second.append(end)
            else:
                found.append((end, term))
                total += w
                best = max(best, w)
        if found:
            hits[i], kinds[i], weight[i], most[i] = len(found), len({t for _, t in found}), total, best
            if second:
                s = np.array(second)
                at = np.array([e for e, _ in found])
                k = np.searchsorted(s, at)
                gap = np.minimum(np.abs(s[np.minimum(k, len(s) - 1)] - at), np.abs(s[np.maximum(k - 1, 0)] - at))
                near[i] = (gap <= NEAR_BYTES).sum()
    letter, capital, sign = _letter[data], _capital[data], _sign[data]
    same = np.zeros(len(data), bool)
    same[:-1] = letter[:-1] & (text[1:] == text[:-1])
    share = lambda mask: row_sums(mask, offsets) / length
    per_word = np.maximum(words, 1)
    return np.stack(
        [
            hits / per_word, np.log1p(hits), kinds, weight / per_word, most, near / per_word, np.log1p(near),
            share(capital), share(_shift_and(capital, capital, capital)), share(data == 33), share(data == 63), share(_punctuation[data]),
            share(_shift_and(letter, sign, letter)), share(_shift_and(same, same)), np.log1p(words),
        ],
        1,
    )


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    xs: np.ndarray
    ys: np.ndarray
    rate: float
    _automaton = None

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.rate)
        if self._automaton is None:
            self._automaton = self.lexicon.automaton()
        margin = self.trees.margin(features(data, offsets, self._automaton))
        raw = 1 / (1 + np.exp(-margin))
        # A thousandth of the raw score keeps the order within the steps of the isotonic fit.
        return (0.999 * np.interp(margin, self.xs, self.ys) + 0.001 * raw) if len(self.xs) else raw


def copy_key(words: list[bytes]) -> int:
    """The smallest hash of five words in a row, which near copies share and other texts do not."""
    return min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4))))


def _copy_keys(batches):
    """(doc_id, copy key) of each row."""
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        keys = [copy_key(data[a:b].tobytes().translate(PLAIN).split()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64())], names=["doc_id", "key"])


def _term_counts(batches):
    """(term, toxic, n): documents that hold a term, summed over a batch."""
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        toxic = batch.column(0).to_pylist()
        counts: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        for t, a, b in zip(toxic, offsets[:-1], offsets[1:], strict=True):
            c = counts[t]
            for term in terms_of(set(data[a:b].tobytes().translate(PLAIN).split())):
                c[term] = c.get(term, 0) + 1
        for t in (0, 1):
            terms = list(counts[t])
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([t] * len(part), pa.int32()), pa.array([counts[t][x] for x in part], pa.int64())], names=["term", "toxic", "n"])


def learn_lexicon(part: DataFrame, n_toxic: int, n_clean: int, size: int = LEXICON) -> Lexicon:
    """At most `size` terms by (toxic documents x log odds); a term under a chosen beginning adds nothing and is left out."""
    counts = part.select("toxic", "text").mapInArrow(_term_counts, "term binary, toxic int, n long")
    table_ = counts.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    least = max(3, n_toxic // 200)
    good = table_.filter((F.col("t") >= least) & (odds >= LEAST_ODDS)).select("term", "t", odds.alias("odds"))
    rows = good.orderBy((F.col("t") * F.col("odds")).desc(), F.length("term"), "term").limit(8 * size).collect()
    chosen: dict[bytes, float] = {}
    for r in rows:
        term = bytes(r["term"])
        if len(chosen) < size and not any(term[:k] in chosen for k in range(5, len(term))):
            chosen[term] = float(r["odds"])
    return Lexicon(chosen)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Model from the labelled documents outside the held-out fold; a document labelled twice counts with its larger label."""
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    ids = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = checkpointed(one_row_an_id(texts, ids, ["text"]).join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text"))  # at most train_rows rows
    keys = sample.select("doc_id", "text").mapInArrow(_copy_keys, "doc_id long, key long").join(F.broadcast(ids), "doc_id").collect()
    seen: dict[int, tuple[int, int]] = {}
    for r in sorted(keys, key=lambda r: r["doc_id"]):
        seen.setdefault(r["key"], (r["doc_id"], r["toxic"]))
    n = np.array([[sum(1 for k, (_, t) in seen.items() if k % 10 in part and t == y) for y in (0, 1)] for part in (range(5), range(5, 8), range(8, 10))])
    rate = float((n[:, 1].sum() + 0.5) / (n.sum() + 1))
    if (n[:2] == 0).any():
        return Model(Lexicon({}), None, np.array([]), np.array([]), rate)
    part_of = {doc: 0 if k % 10 < 5 else 1 if k % 10 < 8 else 2 for k, (doc, _) in seen.items()}
    spark = docs.sparkSession
    parts = spark.createDataFrame(sorted(part_of.items()), "doc_id long, part int")
    dealt = sample.join(F.broadcast(parts), "doc_id")
    lexicon = learn_lexicon(dealt.filter("part = 0"), int(n[0, 1]), int(n[0, 0]))

    def rows(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            data, offsets = byte_view(batch.column(3))
            for lo, hi in slices(offsets, SLICE_BYTES):
                own = offsets[lo : hi + 1]
                x = features(data[own[0] : own[-1]], own - own[0], automaton)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "toxic", "part", "x"])

    got = dealt.filter("part > 0").select("doc_id", "toxic", "part", "text").mapInArrow(rows, "doc_id long, toxic int, part int, x array<double>").collect()
    got.sort(key=lambda r: r["doc_id"])
    x, y, part = (np.array([r[c] for r in got]) for c in ("x", "toxic", "part"))
    trees = fit_boosted(x[part == 1], y[part == 1])
    margin = trees.margin(x[part == 2]) if (part == 2).any() else np.array([])
    xs, ys = isotonic(margin, y[part == 2]) if len(set(y[part == 2].tolist())) == 2 else (np.array([]), np.array([]))
    return Model(lexicon, trees, xs, ys, rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted."""
    held = shared(docs.sparkSession, model)

    def compute(data, offsets):
        s = np.clip(held.value.score(data, offsets), 0.0, 1.0)
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return with_text_columns(docs, "text", ADDED, compute, SLICE_BYTES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted toxic."""
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).filter("predicted = 0").select(*docs.columns)
