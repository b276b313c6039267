"""Keyed randomness: every number is a function of a purpose, a seed and the keys of its row.

A redraw of noise would be a second release, so nothing here depends on partitioning or on recomputation:
h = first 12 hexadecimal digits of md5(purpose|seed|keys...), u = (h + 1/2) / 2^48 in (0, 1). The seed is fixed in
tests; a real release needs a secret, fresh one. `KeyedSql` writes the same numbers as SQL text, `uniform_py` in Python.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO48 = float(1 << 48)
Key = Column | str | int | float


def _text(keys: tuple[Key, ...]) -> list[Column]:
    return [(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys]


def digest(purpose: str, *keys: Key) -> Column:
    """32 hexadecimal digits for a purpose and keys; orders rows as a random permutation does."""
    return F.md5(F.concat_ws("|", F.lit(purpose), *_text(keys)))


def uniform(purpose: str, *keys: Key) -> Column:
    return (F.conv(F.substring(digest(purpose, *keys), 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(TWO48)


def laplace(scale: Key, purpose: str, *keys: Key) -> Column:
    """Laplace noise of a scale by the inverse distribution function."""
    u = uniform(purpose, *keys)
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -b * F.signum(u - F.lit(0.5)) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u - F.lit(0.5)))


def gumbel(purpose: str, *keys: Key) -> Column:
    return -F.log(-F.log(uniform(purpose, *keys)))


def normal(purpose: str, *keys: Key) -> Column:
    """A standard normal by Box and Muller from two uniforms."""
    return F.sqrt(F.lit(-2.0) * F.log(uniform(purpose, "r", *keys))) * F.cos(F.lit(2 * math.pi) * uniform(purpose, "a", *keys))


def gamma_int(shape: int, purpose: str, *keys: Key) -> Column:
    """Gamma(shape, 1) for a whole shape: a sum of exponentials."""
    total = F.lit(0.0)
    for i in range(shape):
        total = total - F.log(uniform(purpose, i, *keys))
    return total


def index(size: Key, purpose: str, *keys: Key) -> Column:
    """A uniform index below `size`."""
    n = size if isinstance(size, Column) else F.lit(size)
    return F.floor(uniform(purpose, *keys) * n).cast("bigint")


def uniform_py(purpose: str, *keys) -> float:
    text = "|".join(str(k) for k in (purpose, *keys))
    return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / TWO48


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_STEPS = ((1, 0), (5, 1), (3, 5), (7, 0))  # step i of a round takes the word (a i + b) mod 16
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
DIGITS = 5  # last digits of a number that one array holds
BLOCK = 20_000  # numbers at a time: a step's arrays stay in a core's own cache


@functools.lru_cache(maxsize=32)
def _chars(shift: int, digits: int, lo: int, hi: int) -> list[np.ndarray]:
    """The characters of lo to hi - 1, with this many digits, as the words of a block in which they begin `shift` bytes into a word."""
    j = np.arange(lo, hi, dtype=np.uint32)
    words = [np.zeros_like(j) for _ in range((shift + digits + 3) // 4)]
    for k in range(digits):
        at = shift + k
        words[at // 4] += (j // np.uint32(10 ** (digits - 1 - k)) % np.uint32(10) + np.uint32(48)) << np.uint32(8 * (at % 4))
    return words


def _heads(prefix: bytes, digits: int, lo: int, hi: int) -> np.ndarray:
    """The first 48 bits of the md5 of prefix + j, with this many digits, for lo <= j < hi: the steps of one block of 64 bytes, on arrays."""
    size = len(prefix) + digits
    block = prefix + bytes(digits) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
    words: list = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    first = len(prefix) // 4
    for k, chars in enumerate(_chars(len(prefix) % 4, digits, lo, hi), first):
        words[k] = chars + np.uint32(words[k])
    a, b, c, d = _START
    for i in range(first):  # the words of the prefix alone are the same for all
        f = (a + (((c ^ d) & b) ^ d) + _SINES[i] + words[i]) % 2**32
        turn = _TURNS[0][i % 4]
        a, b, c, d = d, (b + (f << turn | f >> 32 - turn)) % 2**32, b, c
    a, b, c, d = (np.full(hi - lo, v, np.uint32) for v in (a, b, c, d))
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(first, 64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[(_STEPS[kind][0] * i + _STEPS[kind][1]) % 16]
        np.add(f, a, out=f)
        if isinstance(word, int):
            np.add(f, np.uint32((_SINES[i] + word) % 2**32), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, np.uint32(_SINES[i]), out=f)
        turn = _TURNS[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    high = (a + np.uint32(_START[0])).byteswap().astype(np.uint64)
    low = (b + np.uint32(_START[1])).astype(np.uint16).byteswap().astype(np.uint64)
    return (high << np.uint64(16)) | low


def uniforms_np(first: int, last: int, purpose: str, *keys) -> np.ndarray:
    """`uniform` of (keys..., k) for first <= k < last, as one array."""
    text = "|".join(str(k) for k in (purpose, *keys)).encode() + b"|"
    if len(text) + 20 > 55:  # longer than one block of md5
        return np.array([uniform_py(purpose, *keys, k) for k in range(first, last)])
    out, at, whole = np.empty(last - first), first, 10**DIGITS
    while at < last:
        if at < whole:
            digits, prefix, base = len(str(at)), text, 0
            end = min(last, 10**digits, at + BLOCK)
        else:
            digits, prefix, base = DIGITS, text + str(at // whole).encode(), at // whole * whole
            end = min(last, base + whole, at - at % BLOCK + BLOCK)
        out[at - first : end - first] = (_heads(prefix, digits, at - base, end - base) + 0.5) / TWO48
        at = end
    return out


def laplace_py(scale: float, purpose: str, *keys) -> float:
    u = uniform_py(purpose, *keys)
    return -scale * math.copysign(1, u - 0.5) * math.log(1 - 2 * abs(u - 0.5)) if u != 0.5 else 0.0


def normal_py(purpose: str, *keys) -> float:
    return math.sqrt(-2 * math.log(uniform_py(purpose, "r", *keys))) * math.cos(2 * math.pi * uniform_py(purpose, "a", *keys))


class KeyedSql:
    """The same expressions as SQL text; keys are SQL expressions."""

    @staticmethod
    def digest(purpose: str, *keys: str) -> str:
        return f"md5(concat_ws('|', '{purpose}'{''.join(f', CAST({k} AS VARCHAR)' for k in keys)}))"

    @classmethod
    def uniform(cls, purpose: str, *keys: str) -> str:
        return f"((CAST('0x' || substr({cls.digest(purpose, *keys)}, 1, 12) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({1 << 48} AS DOUBLE))"

    @classmethod
    def laplace(cls, scale: str, purpose: str, *keys: str) -> str:
        u = cls.uniform(purpose, *keys)
        return f"(-CAST({scale} AS DOUBLE) * sign({u} - CAST(0.5 AS DOUBLE)) * ln(CAST(1 AS DOUBLE) - CAST(2 AS DOUBLE) * abs({u} - CAST(0.5 AS DOUBLE))))"

    @classmethod
    def gumbel(cls, purpose: str, *keys: str) -> str:
        return f"(-ln(-ln({cls.uniform(purpose, *keys)})))"

    @classmethod
    def normal(cls, purpose: str, *keys: str) -> str:
        return f"(sqrt(CAST(-2 AS DOUBLE) * ln({cls.uniform(purpose, chr(39) + 'r' + chr(39), *keys)})) * cos(CAST({2 * math.pi!r} AS DOUBLE) * {cls.uniform(purpose, chr(39) + 'a' + chr(39), *keys)}))"

    @classmethod
    def index(cls, size: str, purpose: str, *keys: str) -> str:
        return f"CAST(floor({cls.uniform(purpose, *keys)} * {size}) AS BIGINT)"
