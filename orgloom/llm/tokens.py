"""Token ids of whole texts, chunk by chunk.

A text is cut where the tokenizer can't join what stands on both sides, so its ids are those of
its chunks in turn. Short chunks are looked up, many at once, in a table of fixed size that holds their
bytes; only chunks that are not there go to the tokenizer.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from orgloom.llm import words as W

SHORT = 24  # bytes of a chunk that the table can hold


@dataclass
class Chunks:
    """Chunk c is data[start[c]:end[c]]; text d has chunks first[d] to first[d + 1]. ``letter``: whether a byte belongs to a Latin letter."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    letter: np.ndarray


class ChunkTable:
    """Ids of chunks of bytes, remembered in ``slots`` places and about ``room`` ids.

    A place is chosen by hash and compared in full (length and bytes), so no chunk gets another's ids. A new chunk
    replaces what stood in its place; when ``room`` is used up the table starts empty.
    """

    def __init__(self, encode: Callable[[Chunks, np.ndarray], tuple[np.ndarray, np.ndarray]], slots: int = 1 << 19, room: int = 1 << 22):
        self.encode, self.slots, self.room = encode, slots, room
        self._clear()

    def _clear(self) -> None:
        self.size = np.zeros(self.slots, np.uint8)
        self.lanes = [np.zeros(self.slots, np.uint64) for _ in range(SHORT // 8)]
        self.at = np.zeros(self.slots, np.int64)
        self.count = np.zeros(self.slots, np.int32)
        self.pool = np.zeros(self.room, np.uint32)
        self.used = 0

    def _learn(self, chunks: Chunks, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) in the pool of the ids of some chunks, which the tokenizer gives."""
        count, ids = self.encode(chunks, some)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(len(ids), self.room), np.uint32)])
        self.pool[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(count) - count
        self.used += len(ids)
        return at, count

    def ids(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each chunk, all ids in order)."""
        data, start, end = chunks.data, chunks.start, chunks.end
        if self.used > self.room:
            self._clear()
        size = end - start
        own = W.lanes_of(data)
        lanes = [W.lane(own, start, size, 0)]
        hashed = W.mix(lanes[0] ^ (size.astype(np.uint64) << np.uint64(59)))
        for j in range(1, SHORT // 8):
            longer = np.flatnonzero(size > 8 * j)
            one = np.zeros(len(size), np.uint64)
            one[longer] = W.lane(own, start[longer], size[longer], j)
            hashed[longer] = W.mix(hashed[longer] ^ one[longer])
            lanes.append(one)
        slot = (hashed & np.uint64(self.slots - 1)).astype(np.int64)
        known = self.size[slot] == size  # longer chunks are never stored
        for mine, one in zip(self.lanes, lanes):
            known &= mine[slot] == one
        at, count = self.at[slot], self.count[slot]
        short = np.flatnonzero(~known & (size <= SHORT))
        if len(short):
            _, first, which = np.unique(hashed[short], return_index=True, return_inverse=True)
            model = short[first]
            like = model[which]
            equal = size[short] == size[like]
            for one in lanes:
                equal &= one[short] == one[like]
            new_at, new_count = self._learn(chunks, model)
            at[short], count[short] = new_at[which], new_count[which]
            here = slot[model]
            self.size[here], self.at[here], self.count[here] = size[model], new_at, new_count
            for mine, one in zip(self.lanes, lanes):
                mine[here] = one[model]
            rest = short[~equal]
        else:
            rest = short
        other = np.concatenate([np.flatnonzero(size > SHORT), rest])
        keep = self.used
        if len(other):
            texts = [data[a:b].tobytes() for a, b in zip(start[other].tolist(), end[other].tolist())]
            model: dict[bytes, int] = {}
            which = np.array([model.setdefault(t, len(model)) for t in texts])
            unique = other[np.unique(which, return_index=True)[1]]
            new_at, new_count = self._learn(chunks, unique)
            at[other], count[other] = new_at[which], new_count[which]
        begins = np.cumsum(count) - count
        out = self.pool[np.repeat(at - begins, count) + np.arange(int(count.sum()))]
        self.used = keep  # ids of long chunks are not kept
        if len(self.pool) > 2 * self.room:
            self._clear()
        return count, out


# Both splitting rules part letters from marks. Contractions begin with an apostrophe and names of special tokens
# stand between bars, so there is no cut beside these two.
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'|"]] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """Whether a byte belongs to a letter A-Z, a-z or U+00C0 to U+00FF (without the two signs among them)."""
    out = (data | np.uint8(32)) - np.uint8(97) < np.uint8(26)
    if len(data) > 1:
        pair = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        out[:-1] |= pair
        out[1:] |= pair
    return out


def _mark_cuts(data: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Whether a place lies between a Latin letter and a mark."""
    out = np.zeros(len(data), bool)
    mark = _MARK[data]
    out[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    return out


def word_chunks(raw: np.ndarray, at: np.ndarray) -> Chunks:
    """For vocabularies that drop white space, ignore case and never join across white space: runs without blanks."""
    data, at = raw[at[0]:at[-1]], at - at[0]
    n = len(data)
    if b"<|" not in data.tobytes():  # else case may tell a special token from its name
        data = data + ((data - np.uint8(65) < np.uint8(26)).view(np.uint8) << np.uint8(5))
    letter = _letters(data)
    inner = (data != 0x20) & (data != 0x09) & (data != 0x0A) & (data != 0x0D)
    cut = _mark_cuts(data, letter)
    cut[at[:-1][at[:-1] < n]] = True
    opens, closes = inner.copy(), inner.copy()
    opens[1:] &= ~inner[:-1] | cut[1:]
    closes[:-1] &= ~inner[1:] | cut[1:]
    start = np.flatnonzero(opens)
    return Chunks(data, start, np.flatnonzero(closes) + 1, np.searchsorted(start, at), letter)


def spaced_chunks(raw: np.ndarray, at: np.ndarray) -> Chunks:
    """For byte-level vocabularies, whose splitting rule puts no white space behind other characters into one part: chunks of
    white space and what follows it, all bytes kept. A blank opens a chunk only behind a character that is surely no white space of any alphabet."""
    data, at = raw[at[0]:at[-1]], at - at[0]
    n = len(data)
    letter = _letters(data)
    space = (data == 0x20) | (data - np.uint8(9) < np.uint8(5))
    opens = _mark_cuts(data, letter)
    place = np.flatnonzero(space[1:] & ~space[:-1] & (data[:-1] > 0x20)) + 1 if n > 1 else np.empty(0, np.int64)
    last = data[place - 1]
    two = np.where(place > 1, data[place - 2], 0)
    three = np.where(place > 2, data[place - 3], 0)
    blank = ((two == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((three == 0xE1) & (two == 0x9A)) | (
        ((three == 0xE2) | (three == 0xE3)) & ((two == 0x80) | (two == 0x81)))
    opens[place[(last != 0x7F) & ~blank]] = True
    opens[at[:-1][at[:-1] < n]] = True
    start = np.flatnonzero(opens)
    return Chunks(data, start, np.append(start[1:], n) if len(start) else start, np.searchsorted(start, at), letter)


class TextIds:
    """Ids of texts by a tokenizers file with a byte-level vocabulary. ``spaced``: whether it keeps white space."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = spaced_chunks if spaced else word_chunks
        self.spaced = spaced
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token) - (0 if spaced else 4 * token.endswith("</w>"))
        self.table = ChunkTable(self._encode)

    def _encode(self, chunks: Chunks, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each chosen chunk, all their ids in order). Single words are asked for many at a time, as one text with blanks
        between them; others one by one."""
        lead = int(self.spaced)  # the blank belongs to the chunk
        data, start, end = chunks.data, chunks.start[chosen], chunks.end[chosen]
        other = np.concatenate([[0], np.cumsum(~chunks.letter, dtype=np.int32)])
        joint = (other[end] == other[np.minimum(start + lead, end)]) & (end - start > lead)
        if lead:
            joint &= data[start] == 0x20
        found: list[np.ndarray | None] = [None] * len(start)
        alone = np.flatnonzero(~joint).tolist()
        joint = np.flatnonzero(joint)
        count = np.zeros(len(start), np.int64)
        raw = data.tobytes()
        batches = [joint[i:i + 500] for i in range(0, len(joint), 500)]
        texts = [(b"" if lead else b" ").join([raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())]).decode() for some in batches]
        for some, ids in zip(batches, self._many(texts)):
            passed = np.cumsum(self.bytes[ids])
            ends = np.cumsum(end[some] - start[some])
            at = np.searchsorted(passed, ends) + 1
            if len(ids) != at[-1] or (passed[at - 1] != ends).any():  # not as this vocabulary splits
                alone += some.tolist()
                continue
            count[some] = np.diff(at, prepend=0)
            found[int(some[0])] = ids
        # ids of joint chunks stand behind the first chunk of their batch
        order = [*(some for some in batches if found[int(some[0])] is not None)]
        pool = [found[int(some[0])] for some in order]
        if alone:
            for i, ids in zip(alone, self._many([raw[start[i]:end[i]].decode() for i in alone])):
                order.append(np.array([i]))
                pool.append(ids)
                count[i] = len(ids)
        place = np.zeros(len(start), np.int64)
        turn = np.concatenate(order) if order else np.empty(0, np.int64)
        place[turn] = np.cumsum(count[turn]) - count[turn]
        begins = np.cumsum(count) - count
        flat = np.concatenate([*pool, np.empty(0, np.uint32)])
        return count, flat[np.repeat(place - begins, count) + np.arange(int(count.sum()))]

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def batches(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, text after the last, offsets of their ids, ids) of bounded stretches of whole texts; null texts are empty."""
        raw, at = W.raw_column(column)
        for i, j in W.stretches(at):
            chunks = self.cut(raw, at[i:j + 1])
            count, ids = self.table.ids(chunks)
            yield i, j, np.concatenate([[0], np.cumsum(count)])[chunks.first], ids


_OPEN: dict[tuple[str, bool], TextIds] = {}  # of this Python worker; tables of fixed size


def text_ids(path: str, spaced: bool) -> TextIds:
    if (path, spaced) not in _OPEN:
        _OPEN[path, spaced] = TextIds(path, spaced)
    return _OPEN[path, spaced]
