"""Static range asymmetric numeral system over a table of frequencies, many lanes at once.

A block of ids is dealt to ``lanes`` interleaved coders: id i belongs to lane i % lanes. Coders
of one block share a stream of 32-bit words; their states have 64 bits. All coders of all
blocks of a group take their steps together as numpy vectors, and each block can be decoded alone.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
WORD = np.uint64(32)
TABLE_MAGIC = b"LOOMFRQ1"


def scale_bits(symbols: int) -> int:
    """Precision of the frequencies: at least 20 bits, and eight places a symbol."""
    return max(20, (8 * symbols - 1).bit_length())


def quantised(counts: np.ndarray, bits: int) -> np.ndarray:
    """Whole frequencies that add up to 2 ** bits, at least 1 for each symbol that occurs, in proportion to ``counts``."""
    total = float(counts.sum())
    if total == 0:
        return np.zeros(len(counts), np.int64)
    out = np.maximum(np.floor(counts * ((1 << bits) / total)).astype(np.int64), counts > 0)
    over = int(out.sum()) - (1 << bits)
    while over > 0:  # rare symbols were raised to 1: the others give in proportion
        room = np.maximum(out - 1, 0)
        cut = room * over // room.sum()
        if not cut.any():
            cut[np.argsort(-room, kind="stable")[:over]] = 1
        out -= cut
        over -= int(cut.sum())
    out[np.argmax(out)] -= over
    return out


class Coder:
    """Codes blocks of ids by one table of frequencies."""

    def __init__(self, frequencies: np.ndarray, bits: int, lanes: int = 32):
        self.bits, self.lanes = bits, lanes
        self.table = frequencies.astype("<u4")
        self.freq = frequencies.astype(np.uint64)
        self.below = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self._symbols: np.ndarray | None = None

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(struct.pack("<II", len(self.table), self.bits) + self.table.tobytes()).digest()

    def to_bytes(self) -> bytes:
        """The table as a file: magic, number of symbols, bits, frequencies, digest."""
        return TABLE_MAGIC + struct.pack("<II", len(self.table), self.bits) + self.table.tobytes() + self.digest

    @classmethod
    def from_bytes(cls, raw: bytes, lanes: int = 32) -> Coder:
        if raw[:8] != TABLE_MAGIC:
            raise ValueError("no frequency table")
        n, bits = struct.unpack_from("<II", raw, 8)
        out = cls(np.frombuffer(raw, "<u4", n, 16), bits, lanes)
        if raw[16 + 4 * n:] != out.digest:
            raise ValueError("frequency table damaged")
        return out

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """The payloads of blocks of one size, the rows of ``ids``: states of all lanes, then words."""
        blocks, n = ids.shape
        lanes, k = self.lanes, np.uint64(self.bits)
        steps = -(-n // lanes)
        state = np.full((blocks, lanes), LOW)
        words = np.zeros((blocks, steps, lanes), np.uint32)
        sent = np.zeros((blocks, steps, lanes), bool)
        for t in range(steps - 1, -1, -1):
            now = ids[:, t * lanes:(t + 1) * lanes]
            m = now.shape[1]
            f, x = self.freq[now], state[:, :m]
            full = x >= f << np.uint64(63 - self.bits)
            sent[:, t, :m] = full
            words[:, t, :m] = x.astype(np.uint32)
            x = np.where(full, x >> WORD, x)
            whole = x // f
            state[:, :m] = (whole << k) + (x - whole * f) + self.below[now]
        return [state[b].astype("<u8").tobytes() + words[b][sent[b]].astype("<u4").tobytes() for b in range(blocks)]

    def decode(self, payloads: list[bytes], n: int) -> np.ndarray:
        """The ids, row by row, of blocks that hold ``n`` ids each."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        blocks, lanes, k = len(payloads), self.lanes, np.uint64(self.bits)
        mask = np.uint64((1 << self.bits) - 1)
        state = np.stack([np.frombuffer(p, "<u8", lanes) for p in payloads]).astype(np.uint64)
        stream = np.concatenate([*(np.frombuffer(p, "<u4", offset=8 * lanes) for p in payloads), np.zeros(lanes, np.uint32)])
        size = np.array([len(p) // 4 - 2 * lanes for p in payloads])
        at = np.cumsum(size) - size
        stop = at + size
        out = np.empty((blocks, n), np.uint32)
        for t in range(-(-n // lanes)):
            m = min(lanes, n - t * lanes)
            x = state[:, :m]
            slot = x & mask
            found = self._symbols[slot]
            out[:, t * lanes:t * lanes + m] = found
            x = self.freq[found] * (x >> k) + slot - self.below[found]
            empty = x < LOW
            turn = np.cumsum(empty, axis=1)
            place = np.minimum(at[:, None] + turn - 1, len(stream) - 1)
            state[:, :m] = np.where(empty, (x << WORD) | stream[place], x)
            at += turn[:, -1]
        if (at != stop).any() or (state != LOW).any():
            raise ValueError("block damaged")
        return out
