"""Words of many texts at once: places, hashes and n-gram keys by numpy, without a Python loop over words.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09 to 0x0D); on UTF-8 that is
the rule of ``JAVA_WORD``. With ``LETTERS``, runs of punctuation are words of their own. A word's hash mixes its length and its bytes, eight at a time; what
a very long word has beyond ``LONG`` bytes enters by XXH64.

Defined cases: null texts are empty; texts without words have none; words of any
length are hashed whole; an empty column has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

#: Words that are hashed at once.
STEP = 1 << 14
#: Bytes of a word that are mixed eight by eight.
LONG = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_POWER = np.uint64(0xD1342543DE82EF95)
#: Keeps the first 0 to 8 bytes of a little-endian number.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Kinds of bytes: 0 parts words, a word has bytes of one kind.
BYTES = np.ones(256, np.uint8)
BYTES[[32, *range(9, 14)]] = 0
#: Letters and digits (of all alphabets) apart from ASCII's punctuation.
LETTERS = BYTES.copy()
LETTERS[[x for x in range(33, 127) if not chr(x).isalnum()]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def fast_order(keys: np.ndarray) -> np.ndarray:
    """An order that sorts 64-bit keys, equal ones as they stand: numbers made of a key's lower bits and its place are sorted, then of its upper bits and that order's place. Sorting numbers is many times faster than sorting places by them."""
    n = len(keys)
    bits = np.uint64(max(1, (n - 1).bit_length()) if n else 1)
    place, mask = np.arange(n, dtype=np.uint64), (np.uint64(1) << bits) - np.uint64(1)
    own = (keys << bits) | place
    own.sort()
    first = (own & mask).astype(np.int64)
    own = (keys[first] >> (np.uint64(64) - bits) << bits) | place
    own.sort()
    return first[(own & mask).astype(np.int64)]


def distinct_sorted(keys: np.ndarray) -> np.ndarray:
    out = np.sort(keys)
    return out[np.r_[True, out[1:] != out[:-1]]] if len(out) else out


def joined_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of what stands before and a word, in this order."""
    return mixed(before * _POWER + word)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, ends of texts with a leading 0) of an Arrow string or binary column; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if kind == pa.large_binary() else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of the texts of a column, in order: maximal runs of bytes of one kind."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, kinds: np.ndarray = BYTES):
        self.data, self.ends = data, ends
        kind = kinds[data]
        first, last = kind > 0, kind > 0
        if len(data):
            cut = kind[1:] != kind[:-1]
            inner = ends[(ends > 0) & (ends < len(data))]
            cut[inner - 1] = True
            first[1:] &= cut
            last[:-1] &= cut
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words before each text, and of all
        self.upto = np.searchsorted(self.start, ends)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.upto)

    def hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word; table: bytes that stand for bytes, such as ``LOWER``."""
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[:-8] = self.data if table is None else table[self.data]
        eights = np.lib.stride_tricks.sliding_window_view(data, 8)
        size = self.stop - self.start
        out = size.astype(np.uint64) * _MIX
        for at in range(0, len(size), STEP):
            start, left, own = self.start[at : at + STEP], size[at : at + STEP], out[at : at + STEP]
            own[:] = mixed(own + (eights[start].view("<u8")[:, 0] & _MASK[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            for passed in range(8, LONG, 8):
                if not len(more):
                    break
                own[more] = joined_key(own[more], eights[start[more] + passed].view("<u8")[:, 0] & _MASK[np.minimum(left[more] - passed, 8)])
                more = more[left[more] > passed + 8]
            for i in more:
                own[i : i + 1] = joined_key(own[i : i + 1], np.array([xxh64_intdigest(data[start[i] : start[i] + left[i]].tobytes())], np.uint64))
        return out


def words_of(column, kinds: np.ndarray = BYTES) -> Words:
    return Words(*flat(column), kinds)
