"""Words and word windows of many texts at once, as 64-bit hashes in numpy arrays.

All functions work on the UTF-8 bytes of an Arrow string column, one bounded
stretch of whole texts after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20

# Bytes that separate words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NON_LETTERS = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_SEED = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_STEP2 = np.uint64(0xA0761D6478BD642F)
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of ``x`` over the result (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _SEED)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def lane(lanes: np.ndarray, start: np.ndarray, size: np.ndarray, j: int) -> np.ndarray:
    """Bytes 8 * j to 8 * j + 8 of the words of ``size`` bytes at ``start``, zero behind their ends."""
    at = np.minimum(start + 8 * j, len(lanes) - 1)
    return lanes[at] & _MASKS[np.clip(size - 8 * j, 0, 8)]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end].

    Every eight bytes are mixed into all bits before the next come, so words of at most eight bytes
    and one size never share a hash, and there is no algebraic relation between longer ones.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * _SEED + _STEP2)
    lanes = lanes_of(data)
    rest = np.flatnonzero(size <= LONG_WORD)
    for j in range(LONG_WORD // 8):
        rest = rest[size[rest] > 8 * j]
        if not len(rest):
            break
        out[rest] = mix((out[rest] ^ lane(lanes, start[rest], size[rest], j)) * _STEP + np.uint64(j))
    for w in np.flatnonzero(size > LONG_WORD).tolist():
        out[w] = xxhash.xxh3_64_intdigest(data[start[w]:end[w]].tobytes(), seed=int(_SEED))
    return out


def _tables(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    word = np.ones(256, bool)
    word[list(separators)] = False
    return fold, word


@dataclass
class Words:
    """The words of consecutive texts: word w is data[start[w]:end[w]], text d has words first[d] to first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> np.ndarray:
        """Hashes of the k words from each position on; positions near a text's end hold words of the next text, see :meth:`inside`."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = self.hash[:n].copy()
        for j in range(1, k):
            out *= _STEP
            out += self.hash[j:n + j]
        return mix(out)

    def second(self, k: int, at: np.ndarray) -> np.ndarray:
        """32 further bits of the windows of k words at ``at``, from other factors than :meth:`windows`."""
        out = mix(self.hash[at] ^ _STEP2)
        for j in range(1, k):
            out *= _STEP2
            out += self.hash[at + j]
        return (mix(out) >> np.uint64(32)).astype(np.uint32)

    def inside(self, k: int) -> np.ndarray:
        """Whether the window of k words from a position on lies in one text; as long as :meth:`windows`."""
        n = max(0, len(self.hash) - k + 1)
        last = np.repeat(self.first[1:], self.counts())[:n]
        return np.arange(n) + k <= last

    def text(self, w: int, k: int) -> str:
        """Words w to w + k, one space between."""
        raw = self.data
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.start[w:w + k].tolist(), self.end[w:w + k].tolist())).decode("utf-8")


def raw_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    if column.null_count:  # a null may still own bytes
        sizes = np.diff(at)
        null = np.asarray(column.is_null())
        if sizes[null].any():
            return raw_column(pa.compute.fill_null(column, ""))
    return raw, at - at[0]


def stretches(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words_of(raw: np.ndarray, offsets: np.ndarray, separators: bytes, lower: bool, hashed: bool = True) -> Words:
    """The words of the texts at ``offsets`` in ``raw`` (offsets[0] may lie inside); ``hashed``: with their hashes."""
    fold, is_word = _tables(separators, lower)
    data = raw[offsets[0]:offsets[-1]]
    at = offsets - offsets[0]
    n = len(data)
    if lower:
        data = fold[data]
    inner = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    opens, closes = inner.copy(), inner.copy()
    opens[1:] &= ~inner[:-1] | edge[1:n]
    closes[:-1] &= ~inner[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, start, end, np.searchsorted(start, at), word_hashes(data, start, end) if hashed else np.empty(0, np.uint64))



def beginnings(words: Words, k: int) -> np.ndarray:
    """Hashes of the words' first k bytes (of shorter words: of the bytes there are), other than any word hash of those bytes."""
    acc = np.full(len(words.start), np.uint64(k), np.uint64)
    for j in range(k):
        at = words.start + j
        acc = acc * _STEP + np.where(at < words.end, _BYTES[words.data[np.minimum(at, len(words.data) - 1)]], np.uint64(0))
    return mix(acc)


def pack_bits(rows: list[tuple[int, int]], bits: int) -> np.ndarray:
    out = np.zeros(max(1, bits // 64), np.uint64)
    for word, value in rows:
        out[word] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)
    return out


def in_bits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash is in the bit table (false positives are possible)."""
    slot = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
