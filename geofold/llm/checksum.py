"""CRC-32 of many strings at once, each put together from the checksums of its parts.

The checksum of A followed by B is that of A, moved on by as many zero bytes as B has, xor that of B. Moving is linear,
so four tables of 256 numbers do it for one length of B.
"""

from __future__ import annotations

from functools import cache
from zlib import crc32

import numpy as np

#: Fixed value: the polynomial, lowest power first.
POLYNOMIAL = 0xEDB88320
#: Up to so many bytes, tables of a length are made byte by byte and remembered.
SHORT = 256


def _after_zero(x: np.ndarray) -> np.ndarray:
    """Registers after one zero byte."""
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return x


def _moved(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & np.uint32(255)] ^ tables[1][(x >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(x >> np.uint32(16)) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]


@cache
def _short(length: int) -> np.ndarray:
    if not length:
        return np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    return _after_zero(_short(length - 1))


def moving(length: int) -> np.ndarray:
    """Tables (4, 256) that move a checksum on by so many bytes."""
    if length <= SHORT:
        return _short(length)
    half = moving(length // 2)
    twice = _moved(half, half)
    return _after_zero(twice) if length % 2 else twice


def appended(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of strings followed by others of these checksums and lengths in bytes."""
    lengths, at = np.unique(length, return_inverse=True)
    if not len(lengths):
        return np.zeros(0, np.uint32)
    tables = np.concatenate([moving(int(x)) for x in lengths])
    at = at * 4
    moved = tables[at, first & np.uint32(255)]
    for k in range(1, 4):
        moved ^= tables[at + k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return moved ^ second


def of_slices(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Checksums of parts of data."""
    return np.fromiter((crc32(data[a:z]) for a, z in zip(start.tolist(), stop.tolist(), strict=True)), np.uint32, len(start))
