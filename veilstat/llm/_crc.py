"""CRC-32 as linear maps: states extended by numpy, and the same checksum as SQL text."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320  # fixed value: the reflected polynomial of CRC-32
UNITS = np.uint32(1) << np.arange(32, dtype=np.uint32)


def _by_bytes(images: np.ndarray) -> np.ndarray:
    """Four tables of 256 from the images of the 32 unit states."""
    number = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        out[bit // 8] ^= np.where(number >> np.uint32(bit % 8) & 1, images[bit], 0).astype(np.uint32)
    return out


def applied(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


def _by_bits(state: np.ndarray, bits: int) -> np.ndarray:
    for _ in range(bits):
        state = state >> np.uint32(1) ^ np.where(state & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return state


def _shifts() -> list[np.ndarray]:
    """Tables that shift a state by 1, 2, 4, ... zero bytes."""
    out = [_by_bytes(_by_bits(UNITS, 8))]
    for _ in range(31):
        out.append(_by_bytes(applied(out[-1], applied(out[-1], UNITS))))
    return out


SHIFTS = _shifts()


def extended(state: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of strings followed by tails of these CRCs and lengths in bytes."""
    out = state.astype(np.uint32)
    for k in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> k & 1)
        out[on] = applied(SHIFTS[k], out[on])
    return out ^ tail


_NIBBLES = np.arange(16, dtype=np.uint32)
_listed = lambda values: f"[{', '.join(map(str, values.tolist()))}]"


def short_sql(text: str) -> str:
    """The unsigned checksum of a short text, half a byte a step."""
    return _of_hex(f"lower(hex(encode({text})))")


def _of_hex(h: str) -> str:
    halves = f"list_transform(range(length({h})), lambda i: CAST('0x' || substr({h}, CAST(i + 2 - 2 * (i % 2) AS INTEGER), 1) AS BIGINT))"
    step = f"xor(a >> 4, {_listed(_by_bits(_NIBBLES, 4))}[(xor(a, n) & 15) + 1])"
    return f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {halves}), lambda a, n: {step}))"


def long_ctes(name: str, texts: str) -> str:
    """CTE `name` (text, crc) of the distinct texts that the query `texts` (text) gives: blocks of 64 bytes on their own,
    the first one shorter, then put together by shifts of 64 bytes."""
    together = "n"
    for k in range(8):
        together = f"xor({together}, {_listed(applied(SHIFTS[6], _NIBBLES << np.uint32(4 * k)))}[((a >> {4 * k}) & 15) + 1])"
    return f"""{name}_hex AS (SELECT text, lower(hex(encode(text))) AS h FROM (SELECT DISTINCT text FROM ({texts}))),
{name}_cut AS (SELECT text, h, unnest(range(0, length(h) // 128 + 1)) AS k, length(h) % 128 AS f FROM {name}_hex),
{name}_part AS (SELECT text, k, CASE WHEN k = 0 THEN substr(h, 1, CAST(f AS INTEGER)) ELSE substr(h, CAST(f + 128 * (k - 1) + 1 AS INTEGER), 128) END AS part FROM {name}_cut),
{name} AS (SELECT text, list_reduce(list({_of_hex('part')} ORDER BY k), lambda a, n: {together}) AS crc FROM {name}_part GROUP BY text)"""
