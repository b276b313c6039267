"""Telephony audio columns: each text's bytes as an 8-bit mu-law recording, decoded with numpy across blocks.

The payload (UTF-8, zero-padded to a positive multiple of 64) becomes the data chunk of a mu-law WAVE file, one
byte a sample, so it comes back byte for byte. Features are read from the stored bytes: mu-law and A-law
expansion by lookup tables, the same bytes decoded as 64-byte IMA ADPCM blocks (all blocks of a slice advance one
nibble at a time together), and the mu-law signal resampled from 8 to 16 kHz 16-bit PCM.

The file (`media`) and the resampled PCM (`pcm16k`) are columns of the result, beside their digests.

Nulls and empty texts: payload of 64 zero bytes, n_bytes 0. Equal texts give equal values. Repeated rows and ids
stay repeated rows, extra columns are ignored, an empty table gives an empty result. A long text is measured in windows
of SLICE_BYTES; it costs its file and its PCM, about eight bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.llm._arrow import byte_view, row_sums, slices
from veilstat.llm._spark import small_batches
from veilstat.sources.tables import table

BLOCK = 64
RATE = 8000
SLICE_BYTES = 1 << 18

# Fixed values of the IMA ADPCM format: the quantizer's steps and the index moves by code magnitude.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law byte: inverted bits, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law byte: even bits inverted, sign set for positive, 3-bit exponent, 4-bit mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For state 16 * index + nibble: the change of the predictor, and the next index times 16."""
    index, nibble = np.divmod(np.arange(89 * 16), 16)
    step = np.array(STEPS)[index]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    move = np.clip(index + np.array(MOVES)[nibble & 7], 0, 88)
    return np.where(nibble & 8, -size, size).astype(np.int32), (move * 16).astype(np.int32)


MULAW, ALAW = mulaw_table(), alaw_table()
MULAW_SQUARE, ALAW_SQUARE = MULAW.astype(np.int64) ** 2, ALAW.astype(np.int64) ** 2
CHANGE, NEXT = adpcm_tables()


def wave(payload: bytes) -> bytes:
    """A mono 8 kHz mu-law WAVE file whose data chunk is the payload."""
    form = struct.pack("<4sIHHIIHHH", b"fmt ", 18, 7, 1, RATE, RATE, 1, 8, 0) + struct.pack("<4sII", b"fact", 4, len(payload))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(payload), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + payload


def samples(media: bytes) -> memoryview:
    """The data chunk of a WAVE file, found by walking its chunks."""
    at, view = 12, memoryview(media)
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def adpcm_blocks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Energy and peak of each 64-byte block: 16-bit predictor, step index (clamped), one spare byte, 120 nibbles."""
    blocks = data.reshape(-1, BLOCK)
    level = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    state = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    energy, peak = level.astype(np.int64) ** 2, np.abs(level)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for byte in codes:
        for nibble in (byte & 15, byte >> 4):
            state += nibble
            level += CHANGE[state]
            np.clip(level, -32768, 32767, out=level)
            state = NEXT[state]
            wide = level.astype(np.int64)
            energy += wide * wide
            np.maximum(peak, np.abs(level), out=peak)
    return energy, peak


def resampled(data: np.ndarray, offsets: np.ndarray, after: int | None = None) -> np.ndarray:
    """Mu-law bytes as 16 kHz PCM: each sample, then the mean with its follower in the same row (the last repeats, or meets `after`)."""
    pcm = MULAW[data]
    follower = np.empty_like(pcm)
    follower[:-1] = pcm[1:]
    last = offsets[1:] - 1
    follower[last] = pcm[last]
    if after is not None:
        follower[-1] = MULAW[after]
    out = np.empty(2 * len(pcm), "<i2")
    out[0::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + follower) >> 1
    return out


@dataclass
class Signal:
    """Sums over the samples of each row, and the rows' PCM one after another."""

    energies: list[np.ndarray]  # by mu-law, A-law and ADPCM decoding
    crossings: np.ndarray
    peak: np.ndarray
    pcm: np.ndarray


def signal(stored: np.ndarray, bounds: np.ndarray, before: int | None = None, after: int | None = None) -> Signal:
    """The measures of rows in one array; `before` and `after`: the bytes next to it, if it is a window of one row."""
    flips = np.zeros(len(stored), np.uint8)
    flips[1:] = (stored[1:] ^ stored[:-1]) >> 7
    flips[bounds[:-1]] = 0
    if before is not None:
        flips[0] = (int(stored[0]) ^ before) >> 7
    energy, peak = adpcm_blocks(stored)
    energies = [row_sums(square[stored], bounds) for square in (MULAW_SQUARE, ALAW_SQUARE)] + [row_sums(energy, bounds // BLOCK)]
    return Signal(energies, row_sums(flips, bounds), np.maximum.reduceat(peak, bounds[:-1] // BLOCK), resampled(stored, bounds, after))


def signal_of_one(stored: np.ndarray) -> Signal:
    """The measures of one long row, window by window."""
    total = Signal([np.zeros(1, np.int64) for _ in range(3)], np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(2 * len(stored), "<i2"))
    for lo in range(0, len(stored), SLICE_BYTES):
        hi = min(lo + SLICE_BYTES, len(stored))
        own = signal(stored[lo:hi], np.array([0, hi - lo]), int(stored[lo - 1]) if lo else None, int(stored[hi]) if hi < len(stored) else None)
        total.energies = [a + b for a, b in zip(total.energies, own.energies, strict=True)]
        total.crossings, total.peak = total.crossings + own.crossings, np.maximum(total.peak, own.peak)
        total.pcm[2 * lo : 2 * hi] = own.pcm
    return total


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Consecutive ranges of an array's bytes as a binary column, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(values)]).cast(pa.binary())


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for (doc_id, text) rows; with `keep`, the file and the resampled PCM too."""
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        for lo, hi in slices(offsets, SLICE_BYTES):
            yield _encode(batch.column(0).slice(lo, hi - lo), data, offsets[lo : hi + 1], keep)


def _encode(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, keep: bool) -> pa.RecordBatch:
    n_bytes = np.diff(offsets)
    padded = np.maximum((n_bytes + BLOCK - 1) // BLOCK, 1) * BLOCK
    files = [wave(data[a : a + n].tobytes() + bytes(int(p - n))) for a, n, p in zip(offsets[:-1].tolist(), n_bytes.tolist(), padded.tolist(), strict=True)]
    back = [samples(f) for f in files]
    stored, bounds = np.frombuffer(back[0] if len(back) == 1 else b"".join(back), np.uint8), np.concatenate([[0], np.cumsum(padded)])
    s = signal_of_one(stored) if len(back) == 1 else signal(stored, bounds)
    rms = lambda energy, count: np.sqrt(energy / count).round().astype(int).tolist()
    mulaw, alaw, coded = rms(s.energies[0], padded), rms(s.energies[1], padded), rms(s.energies[2], padded // BLOCK * 121)
    pcm = s.pcm.view(np.uint8)
    crcs = [zlib.crc32(pcm[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    feature = [
        f"mulaw_rms={m};alaw_rms={a};crossings={c};adpcm_rms={d};adpcm_peak={p};pcm16k_samples={2 * n};pcm16k_crc32={x}"
        for m, a, c, d, p, n, x in zip(mulaw, alaw, s.crossings.tolist(), coded, s.peak.tolist(), padded.tolist(), crcs, strict=True)
    ]
    columns = {
        "doc_id": ids.cast(pa.int64()),
        "n_bytes": pa.array(n_bytes, pa.int64()),
        "payload_bytes": pa.array([len(x) for x in back], pa.int64()),
        "payload_sha256": [hashlib.sha256(x).hexdigest() for x in back],
        "tail_crc32": pa.array([zlib.crc32(x[-BLOCK:]) for x in back], pa.int64()),
        "media_bytes": pa.array([len(x) for x in files], pa.int64()),
        "media_sha256": [hashlib.sha256(x).hexdigest() for x in files],
        "feature": feature,
    }
    if keep:
        columns |= {"media": pa.array(files, pa.binary()), "pcm16k": binaries(pcm, 4 * bounds)}
    return pa.RecordBatch.from_pydict(columns)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """One row per input row with the stored file (`media`), its 16 kHz PCM (`pcm16k`) and their digests and features."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: encode(batches, keep), SCHEMA + (", media binary, pcm16k binary" if keep else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's recording and its resampled PCM, with their digests; no shuffle, one pass."""
    return media_columns(table(spark, sf_dir, "documents"))
