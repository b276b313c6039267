"""Alignment of two tokenizers on the same bytes, by byte-owner arrays.

For a run of texts, np.repeat writes each token's index over its bytes, once for A and once for B. Where the pair of owners
of consecutive bytes changes, a new overlap begins; where both owners change at once, both tokenizations end there: a cut.
Cuts part the tokens into groups, and the A and the B token that end at a cut are linked.

A is a byte-level BPE that sees blank + text, B a piece model with byte fallback that adds the blank itself. Neither has
an entry that goes on over a blank after a visible character (checked when the files are read), and A's pre-tokens end before a
blank. So a text is cut at blanks after a visible character, its fields are encoded on their own, each field once as long as
it stays in a worker's bounded cache, and the cuts of the text are those of its fields. A field costs its own length
in memory; a text without blanks is one field.

How often a pair of ids is linked is counted over all texts. The `heavy` most frequent pairs at most go to all tasks as
sorted arrays and meet the texts there; all others meet them by an equi-join, in which none is frequent.

Texts that are null, empty, or whose bytes a tokenizer does not give back (a text that holds U+2581) have no tokens: zeros, and
an empty `groups_sha256`. Special tokens' strings are plain text. Repeated rows stay and count as often as they come; null ids
stay. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilstat.llm._spark import checkpointed, shared, small_batches
from veilstat.llm.bpe import byte_symbols
from veilstat.sources.tables import table

HEAVY = 1 << 20
CACHE_FIELDS, CACHE_CHARS = 200_000, 64
FIELD = re.compile(r"(?<=[!-~\w]) (?!\Z)")  # a blank after a character that no tokenizer takes for white space, with more after it
INNER = re.compile(r"[!-~\w] ")
BLANK = "▁"
Field = tuple[str, bytes, int, int]


@dataclass
class Side:
    """Tokens of a run of fields: ids, bytes of each token, tokens of each field."""

    ids: list[int]
    sizes: np.ndarray
    counts: np.ndarray

    def lengths(self) -> np.ndarray:
        """Bytes of each field."""
        ends = np.append(0, self.sizes.cumsum())[np.append(0, self.counts.cumsum())]
        return np.diff(ends)


def side(ids: list[list[int]], size: np.ndarray) -> Side:
    flat = list(chain.from_iterable(ids))
    return Side(flat, size[flat], np.array([*map(len, ids)], np.int64))


def owners(sizes: np.ndarray) -> np.ndarray:
    """The token of every byte."""
    return np.repeat(np.arange(len(sizes)), sizes)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, whether both end there) of each overlap, from the owners of the same bytes."""
    if not len(a):
        return a, b, np.zeros(0, bool)
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    ends = np.append(np.flatnonzero(new_a | new_b), len(a) - 1)
    return a[ends], b[ends], np.append(new_a & new_b, True)[ends]


class Aligner:
    """Both tokenizers and their tables; one a worker process."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        raw = {c: n for n, c in enumerate(byte_symbols())}
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        entries = {i: t.encode() if i in special else bytes(raw[c] for c in t) for t, i in self.a.get_vocab().items()}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        piece = self.b.id_to_piece
        self.b_count = self.b.get_piece_size()
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece(i).replace(BLANK, " ").encode() for i in range(self.b_count)]
        if any(INNER.search(t.decode(errors="ignore")) for t in (*[t for i, t in enumerate(self.a_bytes) if i not in special], *self.b_bytes)):
            raise ValueError("an entry goes on over a blank, so texts cannot be cut at blanks")
        self.a_size, self.b_size = np.array([*map(len, self.a_bytes)]), np.array([*map(len, self.b_bytes)])
        # Texts of each id with the mark after it: within a side, between the sides, after a group.
        self.a_next, self.a_last = (np.array([f"{i}{m}" for i in range(len(self.a_bytes))], object) for m in ",|")
        self.b_next, self.b_last = (np.array([f"{i}{m}" for i in range(self.b_count)], object) for m in ",;")
        self.young: dict[str, Field | None] = {}
        self.old: dict[str, Field | None] = {}

    def encoded(self, fields: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch([" " + f for f in fields], add_special_tokens=False)], self.b.encode(fields, num_threads=1)

    def whole(self, fields: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> list[bool]:
        """Whether both sides give back the bytes of each field."""
        wanted = [b" " + f.encode() for f in fields]
        return [b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]) == w for a, b, w in zip(a_ids, b_ids, wanted, strict=True)]

    def aligned(self, fields: list[str]) -> list[Field | None]:
        """(groups, links packed as A id * B's vocabulary + B id, A tokens, B tokens) of each field, None where a side's bytes are not the field's."""
        if not fields:
            return []
        a_ids, b_ids = self.encoded(fields)
        a, b = side(a_ids, self.a_size), side(b_ids, self.b_size)
        # All fields at once: the same bytes, and as many of them in each field on both sides.
        text = b"".join([b" " + f.encode() for f in fields])
        same = text == b"".join([self.a_bytes[i] for i in a.ids]) == b"".join([self.b_bytes[i] for i in b.ids])
        if not same or not np.array_equal(a.lengths(), b.lengths()) or not np.array_equal(a.lengths(), [len(f.encode()) + 1 for f in fields]):
            good = self.whole(fields, a_ids, b_ids)
            if not all(good):
                done = iter(self.aligned([f for f, ok in zip(fields, good, strict=True) if ok]))
                return [next(done) if ok else None for ok in good]
        at_a, at_b, cut = overlaps(owners(a.sizes), owners(b.sizes))
        last_a, last_b = at_a[cut], at_b[cut]  # the linked tokens; fields end at cuts too
        # Each group's A tokens, then its B tokens, as one string of marked ids.
        ids_a, ids_b = np.array(a.ids), np.array(b.ids)
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        before_a, before_b = n_b.cumsum() - n_b, n_a.cumsum()
        marked = np.empty(len(ids_a) + len(ids_b), object)
        mark_a, mark_b = self.a_next[ids_a], self.b_next[ids_b]
        mark_a[last_a], mark_b[last_b] = self.a_last[ids_a[last_a]], self.b_last[ids_b[last_b]]
        marked[np.arange(len(ids_a)) + np.repeat(before_a, n_a)] = mark_a
        marked[np.arange(len(ids_b)) + np.repeat(before_b, n_b)] = mark_b
        links = (ids_a[last_a] * self.b_count + ids_b[last_b]).astype("<u8").tobytes()
        ends_a = a.counts.cumsum()
        ends = (8 * (np.searchsorted(last_a, ends_a - 1) + 1)).tolist()
        texts, pieces = (ends_a + b.counts.cumsum()).tolist(), marked.tolist()
        return [("".join(pieces[p:q]), links[r:z], na, nb) for p, q, r, z, na, nb in zip([0, *texts], texts, [0, *ends], ends, a.counts.tolist(), b.counts.tolist())]  # noqa: B905

    def texts(self, texts: list[str | None]) -> Iterator[Field]:
        """(groups, links in order, A tokens, B tokens) of each text."""
        fields = [FIELD.split(t) if t else [] for t in texts]
        if len(self.young) > CACHE_FIELDS:  # the fields of the last while stay, older ones go
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for f in dict.fromkeys(chain.from_iterable(fields)):
            if f not in young:
                if f in old:
                    young[f] = old[f]
                else:
                    new.append(f)
        young.update(zip(new, self.aligned(new), strict=True))
        for own in fields:
            found = [young[f] for f in own]
            if not found or None in found:
                yield "", b"", 0, 0
                continue
            groups, links, na, nb = zip(*found, strict=True)
            yield "".join(groups)[:-1], b"".join(links), sum(na), sum(nb)
        for f in new:
            if len(f) > CACHE_CHARS:
                del young[f]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str | None, b_path: str | None) -> Aligner:
    """The worker's aligner of two files; by default the public byte-level BPE and the public piece model."""
    import public_tokenizers

    key = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """ALIGNED, and with `keep` the string `groups`, of every row.

    `links` are the sorted keys (A id * B's vocabulary + B id) of the row's links, packed as little-endian 64-bit numbers; `n_links` is their number.
    """
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in ALIGNED.split(", ")] + ["groups"] * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            rows = []
            for groups, links, na, nb in own.texts(batch.column(1).to_pylist()):
                rows.append((na, nb, len(links) // 8, len(links) // 8, hashlib.sha256(groups.encode()).hexdigest() if na else "", np.sort(np.frombuffer(links, "<u8")).tobytes(), groups))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 6 + keep]], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ALIGNED + (", groups string" if keep else ""))


def pair_counts(aligned: DataFrame, b_count: int, flush: int = 1 << 22) -> DataFrame:
    """(pair, n, best): how often each pair of ids is linked, and whether no pair of its B id is linked more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def emptied() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held) if held else np.zeros(0, "<u8"), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for links in batch.column(0):
                own = np.frombuffer(links.as_buffer(), "<u8")
                held.append(own)
                size += len(own)
                if size >= flush:
                    yield emptied()
                    held, size = [], 0
        yield emptied()

    counts = aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)
    best = counts.groupBy((F.col("pair") % b_count).alias("_b")).agg(F.max("n").alias("_most"))  # a row an entry of B
    return counts.join(F.broadcast(best), F.col("pair") % b_count == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def least_of_heavy(counts: DataFrame, limit: int) -> int | None:
    """The smallest count, a power of two, from which on at most `limit` pairs are counted; None if all pairs are so few."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("rows")).orderBy(F.desc("k")).collect()  # at most 63 rows
    total = 0
    for r in sizes:
        total += r.rows
        if total > limit:
            return 2 ** (r.k + 1)
    return None


def with_counts(aligned: DataFrame, counts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """aligned with n_best (links whose pair is its B entry's most frequent) and count_sum (sum of the links' counts); `links` goes.

    `aligned` and `counts` are read more than once: checkpoints, or projections of such.
    """
    spark = aligned.sparkSession
    least = least_of_heavy(counts, heavy)
    frequent = (counts if least is None else counts.filter(F.col("n") >= least)).toPandas().sort_values("pair")
    known = shared(spark, (frequent["pair"].to_numpy(np.uint64), frequent["n"].to_numpy(np.int64), frequent["best"].to_numpy(bool)))
    rows = aligned.withColumn("_row", F.monotonically_increasing_id())
    at, out = rows.columns.index("links"), [c for c in rows.columns if c != "links"]

    def found(links: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of a row, how often each is linked in it, and their places among the frequent ones, -1 if none."""
        pairs, times = np.unique(np.frombuffer(links.as_buffer(), "<u8"), return_counts=True)
        keys = known.value[0]
        place = np.searchsorted(keys, pairs)
        hit = place < len(keys)
        hit[hit] = keys[place[hit]] == pairs[hit]
        return pairs, times, np.where(hit, place, -1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = known.value
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), np.int64)
            for k, links in enumerate(batch.column(at)):
                _, times, place = found(links)
                times, place = times[place >= 0], place[place >= 0]
                sums[:, k] = times[best[place]].sum(), (times * n[place]).sum()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], *map(pa.array, sums)], names=[*out, "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for links, row in zip(batch.column(0), batch.column(1), strict=True):
                pairs, times, place = found(links)
                pairs, times = pairs[place < 0], times[place < 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row.as_py()), pa.int64()), pa.array(pairs.astype(np.int64)), pa.array(times.astype(np.int64))], names=["_row", "pair", "times"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "links")
    done = rows.mapInArrow(summed, f"{fields}, n_best long, count_sum long")
    if least is None:
        return done.drop("_row")
    rare = rows.select("links", "_row").mapInArrow(rest, "_row long, pair long, times long").join(counts.filter(F.col("n") < least), "pair")
    added = rare.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    joined = done.join(added, "_row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return joined.drop("_row", "_best", "_sum")


def statistics(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    aligned = checkpointed(align(docs, a_path, b_path, id_col, text_col, keep=False))
    counts = checkpointed(pair_counts(aligned, aligner(a_path, b_path).b_count))
    return with_counts(aligned, counts, heavy).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return statistics(table(spark, sf_dir, "documents"))
