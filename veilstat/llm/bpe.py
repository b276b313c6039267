"""BPE encoding and decoding by tree concatenation.

A text is encoded as a tree of halves. Words (the vocabulary's pre-tokens) of each half are found on their own; at a
join, a window of the last words of the left half and the first words of the right half is scanned again and grows
until its first word is the left half's and its last word the right half's. From there on both scans are in the
same state, so the joined words are those of one scan of the whole. A long word without a split goes through the
same tree one level down: halves are merged on their own, and windows of tokens around the join are merged again
until the outer token on either side agrees. BPE encodings are those token strings whose adjacent pairs are all
encodings of their own text, so agreement of one token on each side makes the join exact.

Texts of more than LONG_CHARS characters are halved down to PIECE_CHARS, and the pieces are rows of their own: other
tasks encode them at the same time, and one task a text joins them, encoding only the words of the windows. Shorter
texts are encoded where they are read, by the same tree.

Decoding joins the token strings by one space, as a tokenizer file without a decoder asks for.

Nulls and empty texts: no tokens, hashes of the empty string. Special tokens in a text are kept as such. Repeated
rows stay, extra columns are ignored, an empty table gives an empty result. A long text costs its words and tokens in
the task that joins it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilstat.llm._spark import small_batches
from veilstat.sources.tables import table

LEAF_CHARS, LEAF_SYMBOLS, WINDOW_CHARS = 4096, 16, 24
LONG_CHARS, PIECE_CHARS = 32_768, 8192
CACHE_WORDS = 300_000
BLANK = " \t\n\x0b\x0c\r"
# Code points whose lower case, normal form and class do not depend on a Unicode version or on their neighbours.
PLAIN = r"\t\n\x0b\x0c\r -~\xa1-\xac\xae-įĲ-ňŊ-ž–—‘’“”…€"
OTHER = re.compile(f"[^{PLAIN}]")

Scan = Callable[[str, int, int], list[str]]


def tree_words(scan: Scan, text: str, lo: int, hi: int, leaf: int = LEAF_CHARS) -> list[str]:
    """The words of text[lo:hi], by halves."""
    if hi - lo <= leaf:
        return scan(text, lo, hi)
    mid = (lo + hi) // 2
    return join_words(scan, text, tree_words(scan, text, lo, mid, leaf), tree_words(scan, text, mid, hi, leaf), lo, mid, hi)


def join_words(scan: Scan, text: str, left: list[str], right: list[str], lo: int, mid: int, hi: int) -> list[str]:
    """One scan's words of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
    reach, a, b, k, j = WINDOW_CHARS, mid, mid, 0, 0
    while True:
        while k < len(left) and mid - a < reach:
            k += 1
            while text[a - 1] in BLANK:
                a -= 1
            a -= len(left[-k])
        while j < len(right) and b - mid < reach:
            while text[b] in BLANK:
                b += 1
            b += len(right[j])
            j += 1
        whole_left, whole_right = k == len(left), j == len(right)
        window = scan(text, lo if whole_left else a, hi if whole_right else b)
        agree_left = whole_left or (window and window[0] == left[-k])
        agree_right = whole_right or (window and window[-1] == right[j - 1])
        if agree_left and agree_right and (len(window) > 1 or whole_left or whole_right):
            return left[: len(left) - k] + window + right[j:]
        reach *= 2


class Codec:
    """Encoder and decoder of one tokenizer file; one a worker process, with a bounded cache of words."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern).findall
        self.shown = byte_symbols()
        self.raw = {c: b for b, c in enumerate(self.shown)}
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.tokens = {i: t for t, i in (*self.vocab.items(), *self.special.items())}

    def scan_plain(self, text: str, lo: int, hi: int) -> list[str]:
        return self.find(text, lo, hi)

    def scan_other(self, text: str, lo: int, hi: int) -> list[str]:
        """For texts with any other code point: the file's own pre-tokenizer, its symbols as characters again."""
        return [bytes(self.raw[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text[lo:hi])]

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE of a symbol string: the lowest-ranked pair first, leftmost among equals."""
        n = len(symbols)
        if n <= LEAF_SYMBOLS:
            return self.merge_few(symbols)
        part, nxt, prv, alive = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or part[i] != a or part[j] != b:
                continue
            part[i], alive[j] = a + b, False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] < n and (r := self.ranks.get((part[x], part[nxt[x]]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[nxt[x]]))
        return [p for p, ok in zip(part, alive, strict=True) if ok]

    def merge_few(self, symbols: list[str]) -> list[str]:
        """The same for few symbols, looking at all pairs each time."""
        part, rank, none = list(symbols), self.ranks.get, len(self.ranks)
        while len(part) > 1:
            ranks = [rank(pair, none) for pair in zip(part, part[1:])]  # noqa: B905
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
        return part

    def symbols(self, token: str) -> list[str]:
        """The base symbols of a token."""
        if self.suffix and token.endswith(self.suffix):
            own = list(token[: -len(self.suffix)])
            return [*own[:-1], own[-1] + self.suffix]
        return list(token)

    def merge_tree(self, symbols: list[str], leaf: int = LEAF_SYMBOLS) -> list[str]:
        """BPE of a long symbol string by halves."""
        if len(symbols) <= leaf:
            return self.merge(symbols)
        mid = len(symbols) // 2
        left, right = self.merge_tree(symbols[:mid], leaf), self.merge_tree(symbols[mid:], leaf)
        k = 2
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            window = self.merge([s for t in (*left[len(left) - a :], *right[:b]) for s in self.symbols(t)])
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[: len(left) - a] + window + right[b:]
            k *= 2

    def word(self, w: str) -> tuple[bytes, str]:
        """Ids, packed little-endian, and token strings of a word."""
        data = w.encode()
        shown = "".join([self.shown[b] for b in data])
        tokens = [t.value for t in self.library.model.tokenize(shown)] if len(data) <= LEAF_SYMBOLS else self.merge_tree([*shown[:-1], shown[-1] + self.suffix])
        ids = [self.vocab[t] for t in tokens]
        found = struct.pack(f"<{len(ids)}I", *ids), " ".join(tokens)
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[w] = found
        return found

    def prepared(self, text: str) -> tuple[bool, str]:
        """Whether a text holds plain code points only, and the text in normal form."""
        return (False, self.library.normalizer.normalize_str(text)) if OTHER.search(text) else (True, text.lower())

    def scan(self, plain: bool) -> Scan:
        return self.scan_plain if plain else self.scan_other

    def plain_words(self, text: str) -> list[str]:
        plain, text = self.prepared(text)
        return tree_words(self.scan(plain), text, 0, len(text))

    def segments(self, text: str) -> Iterator[tuple[str, str]]:
        """(text, special token after it or the empty string) from left to right."""
        at = 0
        for m in self.split_special.finditer(text) if "<" in text else ():
            yield text[at : m.start()], m[0]
            at = m.end()
        yield text[at:], ""

    def encode(self, text: str) -> tuple[bytes, str]:
        """Packed ids and the decoded text."""
        parts: list[tuple[bytes, str]] = []
        for own, special in self.segments(text):
            parts += self._words(self.plain_words(own))
            if special:
                parts.append((struct.pack("<I", self.special[special]), special))
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def tokens_of(self, ids: bytes) -> str:
        return " ".join([self.tokens[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)])

    def _words(self, words: list[str]) -> list[tuple[bytes, str]]:
        get = self.cache.get
        return [get(w) or self.word(w) for w in words]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next free from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_codecs: dict[str, Codec] = {}


def codec(path: str | None) -> Codec:
    """The worker's codec for a file; by default the public word-level BPE of the installed tokenizer package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]


def finished(doc_ids: list, done: list[tuple[bytes, str]], keep: bool) -> list[pa.Array]:
    """The columns of encoded texts."""
    rows = [(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded) for i, (ids, decoded) in zip(doc_ids, done, strict=True)]
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return [pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)][: 6 if keep else 4]


def halves(lo: int, hi: int, size: int) -> list[tuple[int, int]]:
    """The range, halved until no part is larger than size."""
    if hi - lo <= size:
        return [(lo, hi)]
    mid = (lo + hi) // 2
    return halves(lo, mid, size) + halves(mid, hi, size)


CUT = "doc_id long, key string, segment int, piece int, plain boolean, special string, text string"


def _cut(path: str | None, size: int):
    """The pieces (CUT) of each (doc_id, text) row: the segments between special tokens in normal form, halved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                key, rows = hashlib.sha256(text.encode()).hexdigest(), []
                for n, (segment, special) in enumerate(own.segments(text)):
                    plain, segment = own.prepared(segment)
                    rows += [(i, key, n, p, plain, special, segment[a:b]) for p, (a, b) in enumerate(halves(0, len(segment), size))]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CUT.split(", ")])

    return run


WORDS = CUT + ", lengths binary, counts binary, ids binary"


def words_in(text: str, lengths: bytes) -> list[str]:
    """The words of a piece, of these lengths, with blanks between them."""
    out, at = [], 0
    for n in np.frombuffer(lengths, "<u2").tolist():
        while text[at] in BLANK:
            at += 1
        out.append(text[at : at + n])
        at += n
    return out


def _encoded(path: str | None):
    """Pieces with the lengths of their words, the numbers of the words' ids, and the ids; all packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = []
            for plain, text in zip(batch.column(4).to_pylist(), batch.column(6).to_pylist(), strict=True):
                words = tree_words(own.scan(plain), text, 0, len(text))
                ids = [d[0] for d in own._words(words)]
                out.append((np.array([len(w) for w in words], "<u2").tobytes(), np.array([len(i) for i in ids], "<u4").tobytes(), b"".join(ids)))
            made = [pa.array(c, pa.binary()) for c in list(zip(*out, strict=True)) or [()] * 3]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "lengths", "counts", "ids"])

    return run


def _joined(path: str | None, size: int, keep: bool):
    """One text from its pieces, as many rows as the pieces come in copies."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own = codec(path)
        segments: dict[int, dict[int, dict]] = {}
        copies = 0
        for r in rows.to_pylist():
            copies += r["segment"] == r["piece"] == 0
            segments.setdefault(r["segment"], {})[r["piece"]] = r
        parts: list[bytes] = []
        for _, pieces in sorted(segments.items()):
            ordered = [pieces[p] for p in sorted(pieces)]
            text, known, words = "".join(r["text"] for r in ordered), {}, []
            for r in ordered:
                words.append(words_in(r["text"], r["lengths"]))
                ends = np.frombuffer(r["counts"], "<u4").cumsum().tolist()
                known.update((w, r["ids"][a:b]) for w, a, b in zip(words[-1], [0, *ends], ends))  # noqa: B905
            scan, left = own.scan(ordered[0]["plain"]), iter(words)

            def joined(lo: int, hi: int, text=text, scan=scan, left=left) -> list[str]:
                if hi - lo <= size:
                    return next(left)
                mid = (lo + hi) // 2
                one = joined(lo, mid)
                return join_words(scan, text, one, joined(mid, hi), lo, mid, hi)

            parts += [known.get(w) or own.word(w)[0] for w in joined(0, len(text))]
            if special := ordered[0]["special"]:
                parts.append(struct.pack("<I", own.special[special]))
        ids = b"".join(parts)
        done = ids, own.tokens_of(ids)
        return pa.Table.from_arrays(finished([key[0].as_py()] * copies, [done] * copies, keep), names=NAMES[: 6 if keep else 4])

    return run


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, long_chars: int = LONG_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, digests, and with `keep` the packed ids and the decoded text."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            done = [own.encode(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(finished(batch.column(0).to_pylist(), done, keep), names=NAMES[: 6 if keep else 4])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    pieces = rows.filter(is_long).mapInArrow(_cut(path, piece_chars), CUT).repartition("key", "segment", "piece").mapInArrow(_encoded(path), WORDS)
    return rows.filter(~is_long).mapInArrow(run, schema).union(pieces.groupBy("doc_id", "key").applyInArrow(_joined(path, piece_chars, keep), schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding; only pieces of long texts are shuffled."""
    return encode_decode(table(spark, sf_dir, "documents"), keep=False)
