"""Exact Jaccard join of documents on word 5-grams by a universe-partition pigeonhole.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. J >= 3/4 means |x ^ y| <= (|x| + |y|) / 7.
Documents are put in size bands [4^b, 4^(b+1)); a pair meets in the band of its smaller set. In a band the universe of
shingles is hashed into segments (single shingles under 64), and differences are spread over them: a non-empty segment
that differs costs at least one of the H allowed differences. Which segments a set pays for depends on their cost:
- Segments with a shingle that is not frequent are cheap. A set with more than H of them indexes the subsets of the
  H + 1 first in one order for all documents; two such linked sets share one of these, as at most H come before it.
- A set with fewer cheap segments (near copies, texts made of common passages) indexes all of them, which meets every
  partner of the first kind. To meet its like it also indexes a partition coarse enough to hold rarer combinations:
  every subset, and every subset of two or more shingles with each one left out, so that a segment without a match
  costs two differences. It checks that these pay for H + 1; a set for which they do not (chances under 1e-10) meets
  all others by its single shingles instead. Under 64 shingles frequent ones simply come last in the order.

Sets are indexed once per distinct set, so exact copies never pair up. Index entries travel as packed arrays. A bucket
within another of the same smallest member adds nothing and is left out. Each bucket's hub is its member that lies in
most buckets (the least edited of near copies). Candidates whose counts of shingles in CELLS fixed cells of the universe
differ by more than the allowed differences are none (each unit in a cell is a difference of the sets); the others
are verified on the texts:
1. every set with its most central hub;
2. the pairs of two-member buckets that still lie in different components;
3. the larger buckets whose members still do, all around one component together, in square tiles of bounded text: a tile counts
   the shingles that sets of different components share by postings and returns a spanning set of links, never pairs.
Links within a component are implied and not tested; no candidate in different components stays untested.

A text is read in blocks, so a long one costs about its shingles' 8 bytes each, a few times over.

A document without words (null, empty) has the empty set and links with nothing. Rows with a null id get a null
component. Repeated rows are copies. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstat.llm._arrow import byte_view, row_sums, slices
from veilstat.llm._components import components
from veilstat.llm._spark import checkpointed, parts_for, shared, small_batches, with_text_columns
from veilstat.sources.tables import table

WORDS = 5
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 1 << 16
WINDOW_TOKENS = 2_000_000
FREQUENT, FREQUENT_ROWS = 16, 1 << 20  # frequent: counted so often, and among so many most frequent
CELLS = 128
FLUSH = 1_000_000
GROUP_ENTRIES = 2_000_000
BROADCAST_ROWS = 300_000
MEMBERS = 256
KEPT = 64
TILE_MEMBERS, TILE_TOKENS, SALTS = 1024, 1_000_000, 32

_rng = np.random.default_rng(20240229)
PRIME = 2**31 - 1
BASES = [int(b) for b in _rng.integers(2**16, PRIME, 2)]
_place = _rng.integers(2**62, 2**63, WORDS).astype(np.uint64) | np.uint64(1)
_seeds = _rng.integers(2**62, 2**63, 8).astype(np.uint64)
_code = np.arange(1, 257, dtype=np.uint64)  # of each byte: capitals as small letters, 0 for blanks
_code[65:91] = _code[97:123]
_code[[9, 10, 11, 12, 13, 32]] = 0


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of the base modulo PRIME."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
        done += step
    return out


_power = [_powers(b, BLOCK_BYTES) for b in BASES]
_inverse = [_powers(pow(b, -1, PRIME), BLOCK_BYTES) for b in BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of a run of rows, and the offsets of the rows in them.

    A word is a polynomial of its bytes, modulo a prime, at two points: different words of L bytes share a hash for at
    most L^2 of the PRIME^2 pairs of points. Bytes are read in blocks; the parts of a word in several blocks are joined.
    """
    firsts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    starts: list[np.ndarray] = []
    values: list[tuple[np.ndarray, np.ndarray]] = []
    length, inside = 0, False  # bytes so far of the word that the last block ended in
    for lo in range(0, len(data), BLOCK_BYTES):
        code = _code[data[lo : lo + BLOCK_BYTES]]
        solid = code > 0
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        own = firsts[np.searchsorted(firsts, lo) : np.searchsorted(firsts, lo + len(code))] - lo
        start[own] = solid[own]
        at = np.flatnonzero(start)
        if len(at):
            parts = [np.add.reduceat(code * power[: len(code)], at) % np.uint64(PRIME) * inverse[at] % np.uint64(PRIME) for power, inverse in zip(_power, _inverse, strict=True)]
            going = inside and solid[0] and not (len(own) and own[0] == 0)
            if going:
                end = int(at[1]) if len(at) > 1 else len(code)
                gap = np.flatnonzero(~solid[:end])
                for value, part, base in zip(values[-1], parts, BASES, strict=True):
                    value[-1] = (int(value[-1]) + pow(base, length, PRIME) * int(part[0])) % PRIME
                length += int(gap[0]) if len(gap) else end
                at, parts = at[1:], [p[1:] for p in parts]
            if len(at):
                starts.append(at + lo)
                values.append(tuple(parts))
                length = len(code) - int(at[-1])
        inside = bool(solid[-1])
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    one, two = (np.concatenate([v[k] for v in values]) for k in (0, 1))
    return mix(one | two << np.uint64(31)), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the offsets of the rows in them."""
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    sizes = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(bounds[-1]), np.uint64)
    if len(words) >= WORDS:
        joined = words[: len(words) - WORDS + 1] * _place[0]
        for k in range(1, WORDS):
            joined = joined + words[k : len(words) - WORDS + 1 + k] * _place[k]
        joined = mix(joined)
    keep = np.ones(len(out), bool)
    for i, (w, c, lo, hi) in enumerate(zip(at[:-1].tolist(), count.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if c >= WORDS:
            own = np.sort(joined[w : w + c - WORDS + 1])
            out[lo:hi] = own
            keep[lo + 1 : hi] = own[1:] != own[:-1]
        elif c:
            out[lo] = mix((words[w : w + c] * _place[:c]).sum(dtype=np.uint64, keepdims=True) + _seeds[1 + c % 4])[0]
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[bounds] if len(keep) else np.zeros(len(offsets), np.int64)


def prints(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each row's set; 0 for empty sets."""
    return tuple(row_sums(mix(tokens ^ s), bounds).view(np.int64) for s in (_seeds[5], _seeds[6]))


def cells(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Shingles of each row in each of CELLS cells of the universe, up to 255."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    cell = (mix(tokens ^ _seeds[1]) >> np.uint64(32)).astype(np.int64) % CELLS
    count = np.minimum(np.bincount(row * CELLS + cell, minlength=n * CELLS), 255).astype(np.uint8)
    return [x.tobytes() for x in count.reshape(n, CELLS)]


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, fa, ka, b, fb, two, na, nb, cells of a, cells of b): the pairs whose cells allow a link."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for k in (8, 9))
        size = batch.column(6).to_numpy() + batch.column(7).to_numpy()
        yield pa.RecordBatch.from_arrays(batch.columns[:6], names=["a", "fa", "ka", "b", "fb", "two"]).filter(pa.array(7 * np.abs(x - y).sum(1) <= size))


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, fa, ka, b, fb, two) that size and cells allow to be links."""
    one = lambda s: classes.select(F.col("fp1").alias("f" + s), F.col("rep").alias(s), F.col("n").alias("n" + s), F.col("cells").alias("c" + s))
    both = pairs.join(one("a"), ["a", "fa"]).join(one("b"), ["b", "fb"])
    return both.select("a", "fa", "ka", "b", "fb", "two", "na", "nb", "ca", "cb").mapInArrow(_plausible, "a long, fa long, ka long, b long, fb long, two boolean")


def band_of(n: int) -> int:
    return (n.bit_length() - 1) // 2


def allowed(n: int, band: int) -> int:
    """The most differences of a set of n with a partner, if the smaller of the two lies in the band."""
    low, high = 4**band, 4 ** (band + 1)
    most = (n + min(n, high - 1)) // 7
    return max(most, (n + 4 * n // 3) // 7) if low <= n < high else most


def bands_for(n: int) -> list[int]:
    """The bands in which a set of n can be the smaller or the larger of a linked pair of different sets."""
    if n < 3:
        return []
    own = band_of(n)
    return [own, own - 1] if own and -(-3 * n // 4) < 4**own else [own]


def segments_of(band: int) -> int:
    """Segments of a band; 0: each shingle is one."""
    return 0 if band < 3 else 4 * 4**band if band == 3 else 2 * 4**band


def coarse_band(n: int) -> int:
    """Bands of the coarse partition grow by a third, from 64."""
    c = int(math.log(n / 64, 4 / 3))
    while coarse_edge(c + 1) <= n:
        c += 1
    while coarse_edge(c) > n:
        c -= 1
    return c


def coarse_edge(c: int) -> int:
    return -(-64 * 4**c // 3**c)


def coarse_allowed(n: int, c: int) -> int:
    """The most differences of a set of n with a partner, if the smaller of the two lies in coarse band c."""
    low, high = coarse_edge(c), coarse_edge(c + 1)
    most = (n + min(n, high - 1)) // 7
    return max(most, (n + 4 * n // 3) // 7) if low <= n < high else most


def coarse_segments(c: int) -> int:
    top = coarse_edge(c + 2) - 1
    return 6 + math.ceil(0.62 * ((top + coarse_edge(c + 1)) // 7 + 2))


def grouped(row: np.ndarray, t: np.ndarray, m: int, salt: int):
    """Of the shingles t of rows, dealt into m segments a row: (order, first of each segment, its row, its number, its sum, the parts)."""
    segment = ((mix(t ^ _seeds[2] ^ np.uint64(salt)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    key = row * m + segment.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, part = key[order], mix(t[order] ^ _seeds[3])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    owner, place = np.divmod(key[first], m)
    return order, first, owner, place.astype(np.uint64), np.add.reduceat(part, first), part


def tag_of(kind: int, band: int) -> np.uint64:
    return np.uint64((1000 * kind + band + 1) * int(_seeds[7]) % 2**64)


def signatures(tokens: np.ndarray, bounds: np.ndarray, frequent: np.ndarray, coarse: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) of every index entry of the rows' sets, and the rows whose coarse segments pay too little.

    `coarse`: share of the usual number of coarse segments.
    """
    sizes = np.diff(bounds)
    by_band: dict[int, list[int]] = {}
    for i, n in enumerate(sizes.tolist()):
        for b in bands_for(n):
            by_band.setdefault(b, []).append(i)
    rows_out: list[np.ndarray] = []
    out: list[np.ndarray] = []
    dear: set[int] = set()
    stuck: set[int] = set()

    def of(chosen: np.ndarray):
        n = sizes[chosen]
        ends = np.cumsum(n)
        return np.repeat(np.arange(len(chosen)), n), tokens[np.repeat(bounds[chosen] - (ends - n), n) + np.arange(ends[-1])]

    for band, members in by_band.items():
        own = np.array(members)
        row, t = of(own)
        need = np.array([allowed(int(k), band) + 1 for k in sizes[own]])
        common = np.zeros(len(t), bool)
        if len(frequent):
            common = frequent[np.minimum(np.searchsorted(frequent, t), len(frequent) - 1)] == t
        m, tag = segments_of(band), tag_of(0, band)
        if m == 0:
            sig, owner, heavy = mix(t + tag), row, common
        else:
            order, first, owner, place, total, _ = grouped(row, t, m, 0)
            sig, heavy = mix(total + place * _seeds[4] + tag), np.logical_and.reduceat(common[order], first)
        count = np.bincount(owner, minlength=len(own))
        cheap = np.bincount(owner[~heavy], minlength=len(own))
        rank = (sig >> np.uint64(1)) | (heavy.astype(np.uint64) << np.uint64(63))
        at = np.concatenate([[0], np.cumsum(count)])
        taken = np.where(cheap >= need, need, cheap if m else np.minimum(need, count))
        for i, k in enumerate(taken.tolist()):
            own_rank = rank[at[i] : at[i + 1]]
            best = np.argpartition(own_rank, k - 1)[:k] if 0 < k < len(own_rank) else np.arange(k)
            out.append(sig[at[i] : at[i + 1]][best])
        rows_out.append(np.repeat(own, taken))
        if m:
            dear.update(own[cheap < need].tolist())
    by_coarse: dict[int, list[int]] = {}
    for i in sorted(dear):
        c = coarse_band(int(sizes[i])) if sizes[i] >= 64 else -1
        for b in (c, c - 1):
            if b >= 0 and (b == c or -(-3 * int(sizes[i]) // 4) < coarse_edge(c)):
                by_coarse.setdefault(b, []).append(i)
    for c, members in by_coarse.items():
        own = np.array(members)
        row, t = of(own)
        m, tag = max(1, int(coarse * coarse_segments(c))), tag_of(1, c)
        _, first, owner, place, total, part = grouped(row, t, m, c + 1)
        width = np.diff(np.append(first, len(t)))
        need = np.array([coarse_allowed(int(k), c) + 1 for k in sizes[own]])
        stuck.update(own[np.bincount(owner, np.minimum(width, 2), len(own)) < need].tolist())
        base = place * _seeds[4] + tag
        group = np.repeat(np.arange(len(first)), width)
        less = width[group] > 1
        rows_out += [own[owner], own[owner[group[less]]]]
        out += [mix(total + base), mix(total[group[less]] - part[less] + base[group[less]])]
    left = np.array(sorted(stuck), np.int64)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), left
    return np.concatenate(rows_out), np.concatenate(out), left


SET_FIELDS = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType())])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, fp1, fp2) rows, and (token, count) rows of the shingles that are frequent in a window."""
    seen: set[int] = set()
    window: list[np.ndarray] = []

    def frequent() -> pa.RecordBatch:
        tokens, count = np.unique(np.concatenate(window), return_counts=True)
        much = count > 1
        n = int(much.sum())
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(n, pa.binary()), pa.array(tokens[much].view(np.int64)), pa.array(count[much], pa.int64())], names=names)

    names = ["doc_id", "n_shingles", "fp1", "fp2", "cells", "token", "count"]
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        for lo, hi in slices(offsets, SLICE_BYTES):
            own = offsets[lo : hi + 1]
            tokens, bounds = shingle_sets(data[own[0] : own[-1]], own - own[0])
            one, two = prints(tokens, bounds)
            none = pa.nulls(hi - lo, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), pa.array(one), pa.array(two), pa.array(cells(tokens, bounds), pa.binary()), none, none], names=names)
            for i, f in enumerate(one.tolist()):
                if f not in seen:
                    seen.add(f)
                    window.append(tokens[bounds[i] : bounds[i + 1]])
            if sum(map(len, window)) >= WINDOW_TOKENS:
                yield frequent()
                window = []
    if window:
        yield frequent()


def _index_pass(frequent, groups: int, coarse: float):
    """Packed index entries of each distinct set of a partition: (group, signatures, fingerprints); group -1 holds the sets to be compared by single shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        stuck: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            s, f = np.concatenate(sigs), np.concatenate(owners)
            sigs.clear()
            owners.clear()
            group = ((s >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            order = np.argsort(group, kind="stable")
            s, f, group = s[order], f[order], group[order]
            kept, first = np.unique(group, return_index=True)
            last = np.append(first[1:], len(s))
            return pa.RecordBatch.from_arrays(
                [pa.array(kept.astype(np.int64)), *(pa.array([x[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()) for x in (s, f))], names=["g", "sigs", "owners"]
            )

        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            for lo, hi in slices(offsets, SLICE_BYTES):
                own = offsets[lo : hi + 1]
                tokens, bounds = shingle_sets(data[own[0] : own[-1]], own - own[0])
                one, _ = prints(tokens, bounds)
                fresh = [i for i, f in enumerate(one.tolist()) if f not in seen and not seen.add(f)]
                if not fresh:
                    continue
                picked = np.concatenate([tokens[bounds[i] : bounds[i + 1]] for i in fresh])
                own_bounds = np.concatenate([[0], np.cumsum([bounds[i + 1] - bounds[i] for i in fresh])])
                row, sig, left = signatures(picked, own_bounds, frequent.value, coarse)
                sigs.append(sig)
                owners.append(one[fresh][row])
                if len(left):
                    stuck.append(one[fresh][left])
            if sum(map(len, sigs)) >= FLUSH:
                yield flush()
        if sum(map(len, sigs)):
            yield flush()
        if stuck:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), pa.array([np.concatenate(stuck).tobytes()], pa.binary())], names=["g", "sigs", "owners"])

    return run


def _buckets(key: tuple, block: pa.Table) -> pa.Table:
    """The distinct buckets of two or more sets of one group of signatures, members ascending; in group -1, each set on its own."""
    if key[0].as_py() < 0:
        alone = np.unique(np.frombuffer(b"".join(block["owners"].to_pylist()), np.int64))
        return pa.table({"members": pa.array([[x] for x in alone.tolist()], pa.list_(pa.int64()))})
    join = lambda name, kind: np.frombuffer(b"".join(block[name].to_pylist()), kind)
    sig, owner = join("sigs", np.uint64), join("owners", np.int64)
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
    sig, owner = sig[fresh], owner[fresh]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    much = size > 1
    first, size = first[much], size[much]
    if not len(first):
        return pa.table({"members": pa.array([], pa.list_(pa.int64()))})
    inside = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    members = owner[inside]
    key = mix(row_sums(mix(members.view(np.uint64) ^ _seeds[5]), np.concatenate([[0], np.cumsum(size)])) + size.astype(np.uint64))
    _, pick = np.unique(key, return_index=True)
    lists = [owner[first[i] : first[i] + size[i]] for i in pick]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.table({"members": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))})


def _maximal(key: tuple, block: pa.Table) -> pa.Table:
    """Buckets of one smallest member that lie in no other of the KEPT largest: a bucket within another has no pair of its own."""
    lists = sorted({tuple(x) for x in block["members"].to_pylist()}, key=lambda x: (-len(x), x))
    kept: list[tuple[int, ...]] = []
    large: list[set[int]] = []
    for x in lists:
        if len(x) == 1 or not any(s.issuperset(x) for s in large):
            kept.append(x)
            if len(large) < KEPT:
                large.append(set(x))
    return pa.table({"hub": pa.array([key[0].as_py()] * len(kept), pa.int64()), "no": pa.array(range(len(kept)), pa.int32()), "members": pa.array([list(x) for x in kept], pa.list_(pa.int64()))})


def _verified(names: list[str]):
    """(a, b) for the members of a group linked with its leader; rows come by group, the leader first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, None
        for batch in batches:
            a, b = [], []
            data, offsets = byte_view(batch.column(names.index("text")))
            lead, lead_fp, salt, doc, want = (batch.column(names.index(c)).to_pylist() for c in ("lead", "lead_fp", "salt", "doc_id", "fp1"))
            for lo, hi in slices(offsets, SLICE_BYTES):
                own = offsets[lo : hi + 1]
                tokens, bounds = shingle_sets(data[own[0] : own[-1]], own - own[0])
                one, _ = prints(tokens, bounds)
                for i in range(lo, hi):
                    x = tokens[bounds[i - lo] : bounds[i - lo + 1]]
                    if one[i - lo] != want[i]:
                        continue  # another text of the same id
                    if lead[i] == doc[i] and lead_fp[i] == want[i]:
                        group, leader = (lead[i], lead_fp[i], salt[i]), x
                    elif group == (lead[i], lead_fp[i], salt[i]):
                        same = len(np.intersect1d(leader, x, assume_unique=True))
                        if 4 * same >= 3 * (len(leader) + len(x) - same):
                            a.append(lead[i])
                            b.append(doc[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of checkpointed pairs (a, fa, b, fb) that are links; each text travels once per leader and at most MEMBERS share one copy of it.

    Where rows of docs are repeated, links are too.
    """
    count = pairs.count()
    parts, few = parts_for(2 * count), 2 * count <= BROADCAST_ROWS  # a pair has a member, and at most a leader of its own
    pairs = pairs.coalesce(parts)
    counts = pairs.groupBy("a", "fa").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    group = [F.col("a").alias("lead"), F.col("fa").alias("lead_fp")]  # an id can come with several texts that lead
    members = pairs.join(counts, ["a", "fa"]).select(F.col("b").alias("doc_id"), F.col("fb").alias("fp1"), *group, F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    leaders = counts.select(F.col("a").alias("doc_id"), F.col("fa").alias("fp1"), *group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    wanted = checkpointed(members.union(leaders).coalesce(parts))
    routed = docs.join(F.broadcast(wanted) if few else wanted, "doc_id")
    names = ["lead", "lead_fp", "salt", "doc_id", "fp1", "text"]
    routed = routed.select(*names, ((F.col("lead") != F.col("doc_id")) | (F.col("lead_fp") != F.col("fp1"))).alias("_after"))
    return routed.repartition("lead", "lead_fp", "salt").sortWithinPartitions("lead", "lead_fp", "salt", "_after").select(*names).mapInArrow(_verified(names), "a long, b long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp1, n, token) of every shingle of (doc_id, text) rows."""
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in slices(offsets, SLICE_BYTES):
            own = offsets[lo : hi + 1]
            tokens, bounds = shingle_sets(data[own[0] : own[-1]], own - own[0])
            n = np.diff(bounds)
            each = [np.repeat(x, n) for x in (ids[lo:hi], prints(tokens, bounds)[0], n)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in each), pa.array(tokens.view(np.int64))], names=["doc_id", "fp1", "n", "token"])


def by_single_shingles(docs: DataFrame, classes: DataFrame, stuck: DataFrame) -> DataFrame:
    """The links (a, b) of the sets `stuck` (fp1) with any other, by the shingles they share."""
    rows = docs.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_tokens, "doc_id long, fp1 long, n long, token long").distinct()
    own = rows.join(stuck, "fp1", "left_semi").select("token", F.col("doc_id").alias("a"), F.col("fp1").alias("fa"), F.col("n").alias("na"))
    met = own.join(rows, "token").filter(F.col("fa") != F.col("fp1")).groupBy("a", "fa", "na", F.col("doc_id").alias("b"), "fp1", "n").agg(F.count("*").alias("c"))
    return met.filter("4 * c >= 3 * (na + n - c) and a <> b").select("a", "b").distinct()


def tiled(members: DataFrame) -> DataFrame:
    """Rows (main, rep, fp1, n, l) of groups, each in every tile (i, j) that holds its block; a group has as many blocks as bound a tile."""
    size = members.groupBy("main").agg(F.greatest(F.ceil(F.count("*") / TILE_MEMBERS), F.ceil(F.sum("n") / TILE_TOKENS)).cast("int").alias("blocks"))
    # A large group is dealt over SALTS keys on its way to its number of blocks.
    size = size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("fp1", "rep"), F.lit(SALTS)).cast("int"))
    placed = salted.join(size, ["main", "salt"]).drop("salt").withColumn("block", F.pmod(F.xxhash64("rep", "fp1"), F.col("blocks")).cast("int"))
    other = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o", "blocks")


def _screen(block: pa.Table) -> pa.Table:
    """The members of a tile that size and cells allow to be linked with a member of another component."""
    n, label, main = block["n"].to_numpy(), block["l"].to_numpy(), block["main"].to_numpy()
    x = np.frombuffer(b"".join(block["cells"].to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
    alive = np.zeros(len(n), bool)
    for k in np.flatnonzero(label != main):
        hit = (7 * np.abs(x - x[k]).sum(1) <= n + n[k]) & (label != label[k])
        if hit.any():
            alive |= hit
            alive[k] = True
    return block.select(["main", "i", "j", "rep", "fp1", "l"]).filter(pa.array(alive))


def _tile(block: pa.Table) -> pa.Table:
    """A spanning set of the links between members of different components in a tile, by counting shared shingles."""
    column = block["text"].combine_chunks()
    data, offsets = byte_view(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
    parts: list[np.ndarray] = []
    one: list[np.ndarray] = []
    for lo, hi in slices(offsets, SLICE_BYTES):
        own = offsets[lo : hi + 1]
        tokens, bounds = shingle_sets(data[own[0] : own[-1]], own - own[0])
        one.append(prints(tokens, bounds)[0])
        parts += [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    right = np.concatenate(one) == block["fp1"].to_numpy()  # other texts of the same id take no part
    parts = [p for p, ok in zip(parts, right, strict=True) if ok]
    rep, label, main = (block[c].to_numpy()[right] for c in ("rep", "l", "main"))
    parent = {int(v): int(v) for v in label}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    a: list[int] = []
    b: list[int] = []
    if parts:
        size = np.array([len(p) for p in parts])
        tokens, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for k in np.flatnonzero(label != main):
            lo, hi = np.searchsorted(tokens, parts[k], "left"), np.searchsorted(tokens, parts[k], "right")
            width = hi - lo
            inside = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            shared = np.bincount(owner[inside], minlength=len(parts))
            for m in np.flatnonzero(4 * shared >= 3 * (size + size[k] - shared)):
                x, y = root(int(label[k])), root(int(label[m]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(int(rep[k]))
                    b.append(int(rep[m]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _labels(edges: DataFrame) -> DataFrame:
    """The components' (node, label), checkpointed; broadcast where they are few."""
    labels = checkpointed(components(edges))
    return F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels


def link(docs: DataFrame, coarse: float = 1.0) -> DataFrame:
    """doc_id, n_shingles, fp1 and component_id of every row of docs (doc_id, text).

    `coarse`: share of the usual number of coarse segments; sets for which they do not suffice take a longer way.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = checkpointed(docs.mapInArrow(_first_pass, "doc_id long, n_shingles long, fp1 long, fp2 long, cells binary, token long, count long"))
    sets = first.filter("token is null").select("doc_id", "n_shingles", "fp1", "fp2")
    classes = checkpointed(
        first.filter("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("cells").alias("cells"), F.count("*").alias("rows"))
    )
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = checkpointed(first.filter("token is not null").groupBy("token").agg(F.sum("count").alias("c")).filter(F.col("c") >= FREQUENT))
    least, rows = FREQUENT, 0
    for r in sorted(counted.groupBy((F.floor(F.log2("c") * 8)).alias("e")).agg(F.count("*").alias("k"), F.min("c").alias("c")).collect(), key=lambda r: -r["e"]):  # at most 512 rows
        rows += r["k"]
        if rows > FREQUENT_ROWS:
            break
        least = r["c"]
    else:
        least = FREQUENT
    frequent = np.sort(counted.filter(F.col("c") >= least).select("token").toArrow()["token"].to_numpy().view(np.uint64))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * GROUP_ENTRIES)))
    entries = docs.select("text").mapInArrow(_index_pass(shared(spark, frequent), groups, coarse), "g long, sigs binary, owners binary")
    found = entries.groupBy("g").applyInArrow(_buckets, "members array<long>")
    maximal = found.groupBy(F.col("members")[0].alias("hub")).applyInArrow(_maximal, "hub long, no int, members array<long>")
    buckets = checkpointed(maximal.withColumn("key", F.xxhash64("hub", "no", "members")))
    stuck = buckets.filter(F.size("members") == 1).select(F.col("members")[0].alias("fp1")).distinct()
    longer = None if stuck.isEmpty() else by_single_shingles(docs, classes, stuck)
    # Members as class representatives. Two classes with one fp1 both stand for it; verification tells them apart.
    who = classes.filter("rep is not null").select("fp1", "rep", "n")
    held = checkpointed(buckets.filter(F.size("members") > 1).select("key", F.size("members").alias("size"), F.explode("members").alias("fp1")).join(who, "fp1").select("key", "size", "fp1", "rep", "n"))
    # One order of all candidates, the most central first; of a pair, `a` comes first and leads in verification.
    often = held.groupBy("rep", "fp1").agg(F.count("*").alias("_k"))
    held = checkpointed(held.join(often, ["rep", "fp1"]).select("key", "size", F.struct((-F.col("_k")).alias("k"), "rep", "fp1").alias("o"), "n"))
    close = lambda a, b: 4 * F.least(a, b) >= 3 * F.greatest(a, b)
    hubs = held.groupBy("key").agg(F.min(F.struct("o", "n")).alias("h")).select("key", F.col("h.o").alias("oa"), F.col("h.n").alias("na"))
    star = hubs.join(held.select("key", "size", F.col("o").alias("ob"), F.col("n").alias("nb")), "key").filter((F.col("oa") < F.col("ob")) & close(F.col("na"), F.col("nb")))
    star = star.select(*[F.col(f"o{s}.{c}").alias(t + s) for s in "ab" for c, t in (("rep", ""), ("fp1", "f"), ("k", "k"))], (F.col("size") == 2).alias("two"))
    star = star.groupBy("a", "fa", "ka", "b", "fb").agg(F.max("two").alias("two"))
    pool = checkpointed(plausible(star, classes))
    fresh = checkpointed(pool.groupBy("b", "fb").agg(F.min(F.struct("ka", "a", "fa")).alias("m")).select("m.a", "m.fa", "b", "fb"))
    edges = checkpointed(verify(fresh, docs) if longer is None else verify(fresh, docs).union(longer))
    labels = _labels(edges)
    label = lambda df, c, to: df.withColumn("_c", c).join(labels.withColumnRenamed("node", "_c"), "_c", "left").withColumn(to, F.coalesce("label", "_c")).drop("_c", "label")
    rest = label(label(pool.filter("two"), F.col("a"), "la"), F.col("b"), "lb").filter("la <> lb").select("a", "fa", "b", "fb").join(fresh, ["a", "fa", "b", "fb"], "left_anti")
    edges = edges.union(verify(checkpointed(rest), docs))
    placed = label(held.filter("size > 2"), F.col("o.rep"), "l")
    # All open buckets around one component make one group, so near copies that share many buckets meet once.
    counted = placed.groupBy("key", "l").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("c", "l")).alias("m"))
    members = placed.join(counted.filter("k > 1").select("key", F.col("m.l").alias("main")), "key")
    members = checkpointed(members.select("main", "o.rep", "o.fp1", "n", "l").distinct())
    screened = tiled(members).join(classes.select("fp1", "rep", "cells"), ["fp1", "rep"]).groupBy("main", "i", "j").applyInArrow(_screen, "main long, i int, j int, rep long, fp1 long, l long")
    screened = checkpointed(screened)
    few_rows = screened.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(screened) if few_rows else screened, docs["doc_id"] == screened["rep"]).select("main", "i", "j", "rep", "fp1", "l", "text")
    edges = checkpointed(edges.union(texts.groupBy("main", "i", "j").applyInArrow(_tile, "a long, b long")))
    labels = _labels(edges)
    # Singletons keep their own id; only classes of several rows or with links are joined.
    known = classes.join(labels, classes["rep"] == labels["node"], "left").filter("rows > 1 or label is not null").select("fp1", "fp2", F.coalesce("label", "rep").alias("component_id"))
    return sets.join(known, ["fp1", "fp2"], "left").select("doc_id", "n_shingles", "fp1", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component."""
    return link(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each component, that of the smallest id; rows that repeat it go too."""
    linked = checkpointed(link(docs.select("doc_id", "text")).filter("n_shingles > 0 and doc_id is not null"))
    gone = linked.filter("doc_id <> component_id").select("doc_id", "fp1").distinct()
    few = gone.count() <= BROADCAST_ROWS
    again = linked.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    if again.isEmpty():
        return docs.join(F.broadcast(gone.select("doc_id")) if few else gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # Some ids come more than once: tell their texts apart by the fingerprint.
    marked = with_text_columns(docs.select(*docs.columns), "text", T.StructType([T.StructField("_fp1", T.LongType())]), lambda data, offsets: [pa.array(prints(*shingle_sets(data, offsets))[0])])
    kept = marked.join(gone.select(F.col("doc_id").alias("_id"), F.col("fp1").alias("_gone")), (F.col("doc_id") == F.col("_id")) & (F.col("_fp1") == F.col("_gone")), "left_anti")
    twice = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "_fp1"])
    return kept.join(again, "doc_id", "left_anti").unionByName(twice).select(*docs.columns)


# All pairs by an equi-join on shingles: for small tables only.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
