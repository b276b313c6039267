"""Language identification by averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are its byte n-grams (2 to 4) after ASCII lower-casing, non-letters of ASCII as spaces. Each hashes
to a row of an embedding table; the mean of the rows goes through a linear softmax. After training, table and
softmax fold into one table of per-language logits, so prediction is one gather a subword over the whole text.

Training: at most TRAIN_ROWS labelled documents (smallest hash of the id, one row an id) outside the held-out fold. A
fifth of them (by a hash of the text) calibrates. The temperature fits the confidence to their labels. The threshold of
rejection is set against errors: texts identified wrongly, and the same texts with their letters shuffled, which are of
no language. It is the lowest that rejects all of these it can, up to MARGIN of the confidence that all but
REJECT_SHARE of the rightly identified texts reach.

Null texts, and texts without a letter: `und`, score 0, rejected. No usable labels: all `und`. Of equally likely
languages the first by name. A null id is not held out and not learned from. Repeated rows stay; columns of the
result's names in the input are replaced; an empty table gives an empty result. Texts are read in slices of whole rows
of SLICE_BYTES; a longer text costs about a hundred bytes of memory a byte.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstat.llm._arrow import byte_view, row_sums, slices
from veilstat.llm._spark import fold_of, held_out, one_row_an_id, shared, small_batches, with_text_columns
from veilstat.sources.tables import table

BUCKETS, DIM = 1 << 13, 16
TRAIN_ROWS = 2000
EPOCHS, STEPS, BATCH, RATE = 12, 1000, 32, 1.0
REJECT_SHARE, MARGIN = 0.001, 0.9
SLICE_BYTES = 1 << 19
ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

_letters = np.full(256, 32, np.uint8)
_letters[97:123] = _letters[65:91] = np.arange(97, 123)
_letters[128:] = np.arange(128, 256)


def subwords(data: np.ndarray):
    """For n = 2, 3, 4: (n, the bucket of the n-gram that starts at each byte)."""
    c = _letters[data].astype(np.uint32)
    gram = c
    for n in (2, 3, 4):
        if len(c) < n:
            return
        gram = gram[:-1] * np.uint32(0x01000193) + c[n - 1 :]
        yield n, (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)


def within(offsets: np.ndarray, n: int) -> np.ndarray:
    """Offsets whose ranges, in an array of the n-grams of all rows, are those that start in a row; others cross rows."""
    return np.maximum(offsets[1:] - (n - 1), offsets[:-1])


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        if not self.langs:
            return ["und"] * rows, np.zeros(rows), np.ones(rows, bool)
        total, count = np.zeros((rows, len(self.langs))), np.zeros(rows)
        for n, bucket in subwords(data):
            ends = within(offsets, n)
            values = self.logits[bucket]
            bounds = np.minimum(np.stack([offsets[:-1], ends], 1).ravel(), len(bucket))
            sums = row_sums(values, np.append(bounds, bounds[-1] if len(bounds) else 0))[::2]
            total += sums
            count += bounds[1::2] - bounds[::2]
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best, score = p.argmax(1), p.max(1)
        kind = np.zeros(len(data), np.uint8)
        kind[_letters[data] != 32] = 1
        some = row_sums(kind, offsets) > 0
        ascii_letter = row_sums((_letters[data] != 32) & (data < 128), offsets) > 0
        for i in np.flatnonzero(some & ~ascii_letter):  # only bytes of other scripts: ask for a letter among them
            some[i] = any(ch.isalpha() for ch in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        langs = [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
        score = np.where(some, score, 0.0)
        return langs, score, ~some | (score < self.threshold)


def shuffled(text: bytes, seed: int) -> bytes:
    """The text with its characters in another order, spaces in place."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4").copy()
    moved = np.flatnonzero((points != 32) & ((points < 9) | (points > 13)))
    points[moved] = points[np.random.default_rng(seed).permutation(moved)]
    return points.tobytes().decode("utf-32-le").encode()


def _counted(data: np.ndarray) -> tuple[bytes, bytes]:
    """Buckets and counts of a text's subwords: at most BUCKETS entries."""
    c = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(data), SLICE_BYTES):
        for _, bucket in subwords(data[lo : lo + SLICE_BYTES]):
            c += np.bincount(bucket, minlength=BUCKETS)
    full = np.flatnonzero(c)
    return full.astype("<u2").tobytes(), c[full].astype("<f4").tobytes()


SAMPLE = "lang string, held boolean, noise boolean, buckets binary, counts binary"


def _samples(batches):
    """Rows of SAMPLE for each training row, and for each that calibrates also one of its shuffled text."""
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        out: list[tuple] = []
        for lang, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            seed = zlib.crc32(data[a:b])
            out.append((lang, seed % 5 == 0, False, *_counted(data[a:b])))
            if seed % 5 == 0:
                out.append((lang, True, True, *_counted(np.frombuffer(shuffled(data[a:b].tobytes(), seed), np.uint8))))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "held", "noise", "buckets", "counts"])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Model of docs' non-null languages outside the held-out fold; ids first, so that only chosen texts are read.

    The driver gets at most 1.2 * train_rows rows of at most BUCKETS counts.
    """
    small_batches(docs.sparkSession)
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 0)
    ids = docs.filter(usable).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = one_row_an_id(docs.filter(usable), ids, ["lang", "text"])
    return trained(chosen.select("lang", "text").mapInArrow(_samples, SAMPLE).toArrow())  # as Arrow: no rows as objects, in either process of the driver


def trained(rows: pa.Table) -> Model:
    """Model of rows of SAMPLE, in whatever order they come; only the rows of a step are dense."""
    columns = [rows.column(c).to_pylist() for c in ("noise", "lang", "buckets", "counts", "held")]
    got = sorted(zip(*columns, strict=True), key=lambda r: r[:4])
    langs = sorted({r[1] for r in got})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)

    def dense(own: np.ndarray) -> np.ndarray:
        x = np.zeros((len(own), BUCKETS), np.float32)
        for k, i in enumerate(own):
            c = np.frombuffer(got[i][3], "<f4")
            x[k, np.frombuffer(got[i][2], "<u2")] = c / max(c.sum(), 1)
        return x

    y = np.array([langs.index(r[1]) for r in got])
    noise, calibrates = (np.array([r[k] for r in got]) for k in (0, 4))
    held, wild = np.flatnonzero(calibrates & ~noise), np.flatnonzero(noise)
    train = np.flatnonzero(~calibrates) if not calibrates.all() else held  # a few rows may all calibrate
    rng = np.random.default_rng(7)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    each = max(1, -(-len(train) // BATCH))
    epochs = max(EPOCHS, -(-STEPS // each))
    steps, step = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            x = dense(own)
            h = x @ embed
            z = h @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            rate = RATE * (1 - step / steps)
            back = p @ weight.T
            weight -= rate * h.T @ p / len(own)
            bias -= 0.1 * rate * p.mean(0)
            seen = x > 0  # as in subword models, a row's update goes to each of its subwords in full
            embed -= rate * (seen.T.astype(np.float32) @ back) / len(own)
            step += 1
    logits = embed @ weight
    z = dense(held) @ logits + bias if len(held) else np.zeros((0, len(langs)))

    def loss(t: float) -> float:
        s = z / t - (z / t).max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), y[held]])) if len(held) else 0.0

    temperature = min((0.5 * 1.25**k for k in range(16)), key=loss) if len(held) else 1.0
    sure = lambda own: np.exp(own / temperature - np.logaddexp.reduce(own / temperature, 1, keepdims=True)).max(1)
    right = z.argmax(1) == y[held]
    return Model(langs, logits.astype(np.float32), bias.astype(np.float64), float(temperature), rejection(sure(z[right]), np.concatenate([sure(z[~right]), sure(dense(wild) @ logits + bias)])))


def rejection(right: np.ndarray, wrong: np.ndarray) -> float:
    """The lowest confidence to accept, from the confidences of texts identified rightly and of those to reject."""
    if not len(right):
        return 0.0
    top = MARGIN * float(np.quantile(right, REJECT_SHARE))
    below = wrong[wrong < top]
    return float(np.nextafter(below.max(), 1)) if len(below) else 0.0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    held = shared(docs.sparkSession, model)

    def compute(data, offsets):
        langs, score, rejected = held.value.predict(data, offsets)
        return [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return with_text_columns(docs, "text", ADDED, compute, SLICE_BYTES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose language is rejected."""
    return identify(docs, fit(docs)).filter(~F.col("rejected")).select(*docs.columns)
