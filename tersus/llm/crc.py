"""crc32 of joined strings from the parts' crc32s, for whole arrays.

The crc32 of ``a + b`` is that of ``a`` moved on by as many zero bytes as ``b`` is long, xor that of ``b``. Moving on
is linear in the bits, so one table of 4 * 256 entries does it for each length.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

#: Lengths whose tables are kept together.
SHORT = 64


def _one_byte(crc: np.ndarray) -> np.ndarray:
    for _ in range(8):
        crc = np.where(crc & np.uint32(1), (crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
    return crc


def _table(images: np.ndarray) -> np.ndarray:
    """From the images of the 32 bits: those of every value of each of the four bytes."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, images[8 * b:8 * b + 8], np.uint32(0)), axis=1) for b in range(4)])


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@lru_cache(maxsize=1)
def _short() -> np.ndarray:
    images, out = np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(SHORT):
        out.append(_table(images))
        images = _one_byte(images)
    return np.stack(out)


@lru_cache(maxsize=256)
def _long(length: int) -> np.ndarray:
    images = bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    power = _table(_one_byte(bits))  # moves on by 1, 2, 4 ... bytes
    while length:
        if length & 1:
            images = _moved(images, power)
        power, length = _table(_moved(_moved(bits, power), power)), length >> 1
    return _table(images)


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of each pair's concatenation; ``length``: bytes of the second string."""
    short = _short()
    n = np.minimum(length, SHORT - 1)
    out = (short[n, 0, first & 255] ^ short[n, 1, first >> 8 & 255] ^ short[n, 2, first >> 16 & 255] ^ short[n, 3, first >> 24])
    far = np.flatnonzero(length >= SHORT)
    for value in np.unique(length[far]):
        at = far[length[far] == value]
        out[at] = _moved(first[at], _long(int(value)))
    return out ^ second


def crc32s(strings: list[bytes], before: bytes = b"") -> np.ndarray:
    """crc32 of ``before`` and each string."""
    start = zlib.crc32(before)
    return np.fromiter((zlib.crc32(s, start) for s in strings), np.uint32, len(strings))
