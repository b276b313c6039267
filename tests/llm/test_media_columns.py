import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from veilstat.llm import media_columns as mc


def test_tables_follow_the_companding_laws():
    assert mc.MULAW[0xFF] == 0 and mc.MULAW[0x7F] == 0 and mc.MULAW[0x00] == -32124 and mc.MULAW[0x80] == 32124
    assert mc.ALAW[0xD5] == 8 and mc.ALAW[0x55] == -8 and mc.ALAW[0xAA] == 32256 and mc.ALAW[0x2A] == -32256
    assert len(set(mc.ALAW.tolist())) == 256 and len(set(mc.MULAW.tolist())) == 255


def adpcm(block):
    """One block, one nibble at a time."""
    level = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    energy, peak = level * level, abs(level)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = mc.STEPS[index]
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            level = max(-32768, min(32767, level + (-change if code & 8 else change)))
            index = max(0, min(88, index + mc.MOVES[code & 7]))
            energy += level * level
            peak = max(peak, abs(level))
    return energy, peak


def test_blocks_decode_as_one_by_one():
    data = np.random.default_rng(1).integers(0, 256, 64 * 20).astype(np.uint8)
    data[:64] = 0
    energy, peak = mc.adpcm_blocks(data)
    want = [adpcm(bytes(data[i : i + 64])) for i in range(0, len(data), 64)]
    assert [(int(e), int(p)) for e, p in zip(energy, peak)] == want


def test_resampling_stays_in_the_row():
    pcm = mc.resampled(np.array([0x00, 0x80, 0xFF, 0x00], np.uint8), np.array([0, 2, 4]))
    assert pcm.tolist() == [-32124, 0, 32124, 32124, 0, -16062, -32124, -32124]


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "añ" * 100, "x"), (3, "añ" * 100, "x"), (4, "b" * 64, "x"), (5, "c" * 300_000, "x"), (None, "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = mc.media_columns(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = {1: b"", 2: b"", 3: ("añ" * 100).encode(), 4: b"b" * 64, 5: b"c" * 300_000, None: b"d"}[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert bytes(mc.samples(bytes(r.media))) == payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert len(r.pcm16k) == 4 * len(payload)
    assert len({r.feature for r in got if r.doc_id in (1, 2)}) == 1
    assert mc.media_columns(docs.limit(0)).count() == 0


def test_long_rows_in_windows(monkeypatch):
    """A long row measured in windows gives what one pass gives."""
    rng = np.random.default_rng(3)
    stored = rng.integers(0, 256, 64 * 257).astype(np.uint8)
    whole = mc.signal(stored, np.array([0, len(stored)]))
    for size in (64, 640, 64 * 100, 1 << 20):
        monkeypatch.setattr(mc, "SLICE_BYTES", size)
        parts = mc.signal_of_one(stored)
        assert [int(e[0]) for e in parts.energies] == [int(e[0]) for e in whole.energies]
        assert (int(parts.crossings[0]), int(parts.peak[0])) == (int(whole.crossings[0]), int(whole.peak[0]))
        assert parts.pcm.tobytes() == whole.pcm.tobytes()


def test_memory_of_a_long_text():
    text = np.random.default_rng(4).integers(32, 127, 8 << 20).astype(np.uint8)
    tracemalloc.start()
    mc._encode(pa.array([1]), text, np.array([0, len(text)]), True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)


def test_the_query_stores_the_pcm(spark):
    got = mc.query(spark, "/root/testdata/sf0.001").collect()
    assert got and all(hashlib.sha256(r.media).hexdigest() == r.media_sha256 and f"pcm16k_crc32={zlib.crc32(r.pcm16k)}" in r.feature and len(r.pcm16k) == 4 * r.payload_bytes for r in got)
