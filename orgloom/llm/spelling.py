"""Grouping of spelling variants by Bloom-guided neighbourhoods.

The vocabulary, all words that occur often enough with their counts, is a table. For every word the words one edit away are
probed as hashes against blocked Bloom filters of the vocabulary, one per word length; a word's hash
is a sum of numbers per (character, place), so the hashes of all edits come from prefix and suffix sums and no
edited word is spelt out unless a filter knows it. Those few are joined with the vocabulary itself, which removes
the filters' false positives. As an inserted character is a deleted one seen from the other side, deletions and replacements reach
every pair.

Filters of at most ``filter_bytes`` together are broadcast. A vocabulary that needs more is probed in several passes: by lengths,
and where one length is too large by ranges of its hashes; each pass has filters within the bound, and no word is left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm import words as W
from orgloom.llm.storage import tidy, written

BITS_PER_WORD, PROBES = 24, 5
FILTER_BYTES = 16 << 20
DAMAGE = 199
_CELLS = 1 << 21  # edits looked up at once


def _crc_table() -> np.ndarray:
    """Byte-wise remainders of CRC-32 (reversed polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _crcs(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word behind a prefix whose CRC-32 is ``state``; words of over 64 bytes are taken one by one."""
    out = state ^ np.uint32(0xFFFFFFFF)
    rest = np.flatnonzero(size <= W.LONG_WORD)
    for j in range(W.LONG_WORD):
        rest = rest[size[rest] > j]
        if not len(rest):
            break
        now = out[rest]
        out[rest] = _CRC[(now ^ data[start[rest] + j]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for w in np.flatnonzero(size > W.LONG_WORD).tolist():
        out[w] = zlib.crc32(data[start[w]:start[w] + size[w]].tobytes(), int(state[w]))
    return out


def _letter_runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z in lower case, start, bytes, code points, text) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF."""
    data, at = raw[at[0]:at[-1]], at - at[0]
    data = np.where((data >= 65) & (data < 91), data + np.uint8(32), data)
    n = len(data)
    lead = data == 0xC3  # leads U+00C0 to U+00FF and nothing else
    inner = ((data >= 97) & (data < 123)) | lead
    inner[1:] |= lead[:-1]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    opens, closes = inner.copy(), inner.copy()
    opens[1:] &= ~inner[:-1] | edge[1:n]
    closes[:-1] &= ~inner[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    two = np.concatenate([[0], np.cumsum(lead)])
    return data, start, end - start, end - start - (two[end] - two[start]), np.searchsorted(at, start, "right") - 1


def _counted(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> dict[str, int]:
    """How often each word occurs; words are told apart by their bytes."""
    hashes = W.word_hashes(data, start, start + size)
    _, model, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    like = model[which]
    lanes = W.lanes_of(data)
    same = size == size[like]
    rest = np.flatnonzero(same)
    for j in range(W.LONG_WORD // 8):
        rest = rest[size[rest] > 8 * j]
        if not len(rest):
            break
        same[rest] &= W.lane(lanes, start[rest], size[rest], j) == W.lane(lanes, start[like[rest]], size[like[rest]], j)
    raw = data.tobytes()
    if not same.all() or (size > W.LONG_WORD).any():  # one hash for two words, or long ones: count the words themselves
        out: dict[str, int] = {}
        for a, s in zip(start.tolist(), size.tolist()):
            word = raw[a:a + s].decode()
            out[word] = out.get(word, 0) + 1
        return out
    return {raw[a:a + s].decode(): k for a, s, k in zip(start[model].tolist(), size[model].tolist(), n.tolist())}


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, damage: int | None = None) -> DataFrame:
    """(word, n) of all words of at least ``least_chars`` code points.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. With ``damage``, a run whose CRC-32 of
    ``<identifier>:<run>`` it divides loses the code point at that number modulo the run's length. Counts are summed per stretch of texts and
    task before they are shuffled, so a frequent word is one row per task. A null identifier damages nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            raw, at = W.raw_column(batch["text"])
            ids = batch["id"].to_pylist()
            for i, j in W.stretches(at):
                for word, n in _stretch_counts(raw, at[i:j + 1], ids[i:j]).items():
                    held[word] = held.get(word, 0) + n
                if len(held) > 100_000:
                    yield _pairs(held)
                    held = {}
        if held:
            yield _pairs(held)

    def _pairs(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def _stretch_counts(raw: np.ndarray, at: np.ndarray, ids: list) -> dict[str, int]:
        data, start, size, chars, text = _letter_runs(raw, at)
        long = np.flatnonzero(chars >= least_chars)
        start, size, chars, text = start[long], size[long], chars[long], text[long]
        changed: list[str] = []
        if damage:
            prefix = np.array([zlib.crc32(f"{i}:".encode()) if i is not None else 0 for i in ids], np.uint32)
            known = np.array([i is not None for i in ids], bool)
            h = _crcs(prefix[text], data, start, size)
            hit = (h % np.uint32(damage) == 0) & known[text]
            for w in np.flatnonzero(hit).tolist():
                word = data[start[w]:start[w] + size[w]].tobytes().decode()
                cut = int(h[w]) % len(word)
                if len(word) > least_chars:
                    changed.append(word[:cut] + word[cut + 1:])
            start, size = start[~hit], size[~hit]
        out = _counted(data, start, size)
        for word in changed:
            out[word] = out.get(word, 0) + 1
        return out

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _numbers(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number per (character, place)."""
    return W.mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + W.mix(places.astype(np.uint64) + np.uint64(1)))


def _cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (W.mix(hashes) >> np.uint64(32)) % np.uint64(cells)


def _mask(hashes: np.ndarray) -> np.ndarray:
    """The bits of a word in its 64-bit cell."""
    h = W.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    out = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        out |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return out


def _codes(words: list[str]) -> np.ndarray:
    """The characters of words of one length, row by row; all of them are below U+0100."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _hashes(codes: np.ndarray) -> np.ndarray:
    return _numbers(codes, np.arange(codes.shape[1])[None, :]).sum(axis=1, dtype=np.uint64)


@dataclass(frozen=True)
class Shard:
    """The filter of the words of one length whose mixed hash modulo ``parts`` is ``part``."""

    length: int
    part: int
    parts: int
    cells: int


def _passes(sizes: dict[int, int], limit: int) -> list[list[Shard]]:
    """Shards for ``sizes`` (length -> words), gathered in passes of at most ``limit`` bytes."""
    out: list[list[Shard]] = [[]]
    room = limit
    for length, n in sorted(sizes.items()):
        cells = -(-n * BITS_PER_WORD // 64)
        parts = -(-cells // max(1, limit // 8))
        for part in range(parts):
            shard = Shard(length, part, parts, -(-cells // parts))
            if out[-1] and 8 * shard.cells > room:
                out.append([])
                room = limit
            out[-1].append(shard)
            room -= 8 * shard.cells
    return out


def _filters(vocabulary: DataFrame, shards: list[Shard]) -> dict[Shard, np.ndarray]:
    """The filled filters; bits are united before and after the shuffle, and one row per cell reaches the driver."""
    by_length: dict[int, list[Shard]] = {}
    for s in shards:
        by_length.setdefault(s.length, []).append(s)
    base = dict(zip(shards, np.cumsum([0, *(s.cells for s in shards)]).tolist()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, bits = [], []
            for length, words in _by_length(batch["word"].to_pylist()):
                h = _hashes(_codes(words))
                for s in by_length.get(length, ()):
                    own = h[_part(h, s.parts) == s.part]
                    cells.append(_cell(own, s.cells).astype(np.int64) + base[s])
                    bits.append(_mask(own))
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(bits).view(np.int64))], ["cell", "bits"])

    lengths = [s for s in by_length]
    rows = vocabulary.filter(F.length("word").isin(lengths)).select("word").mapInArrow(fill, "cell bigint, bits bigint")
    found = rows.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    flat = np.zeros(sum(s.cells for s in shards), np.uint64)
    flat[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return {s: flat[b:b + s.cells] for s, b in base.items()}


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (W.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(20)) % np.uint64(parts)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    yield from groups.items()


def _edits(codes: np.ndarray, alphabet: np.ndarray, filters: dict[int, list[tuple[Shard, np.ndarray]]]) -> Iterator[tuple[int, int, int]]:
    """(word, place, character) of edits that a filter knows; character -1 deletes. ``codes``: words of one length, row by row."""
    n, length = codes.shape
    places = np.arange(length)
    mine = _numbers(codes, places[None, :])
    whole = mine.sum(axis=1, dtype=np.uint64)
    if length - 1 in filters:
        moved = np.zeros((n, length), np.uint64)  # characters one place earlier
        moved[:, 1:] = _numbers(codes[:, 1:], places[None, :-1])
        ahead = np.cumsum(mine, axis=1, dtype=np.uint64) - mine
        behind = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
        hashes = ahead + behind
        last = np.ones((n, length), bool)  # of equal neighbours only the last is deleted
        last[:, :-1] = codes[:, 1:] != codes[:, :-1]
        w, p = np.nonzero(last)
        for k in np.flatnonzero(_known(hashes[w, p], filters[length - 1])).tolist():
            yield int(w[k]), int(p[k]), -1
    if length in filters:
        step = max(1, _CELLS // (n * len(alphabet)))
        for lo in range(0, length, step):
            some = places[lo:lo + step]
            new = _numbers(alphabet[None, :], some[:, None])
            hashes = (whole[:, None] - mine[:, lo:lo + step])[:, :, None] + new[None]
            other = codes[:, lo:lo + step, None] != alphabet[None, None, :]
            w, p, c = np.nonzero(other)
            for k in np.flatnonzero(_known(hashes[other], filters[length])).tolist():
                yield int(w[k]), int(p[k]) + lo, int(alphabet[c[k]])


def _known(hashes: np.ndarray, shards: list[tuple[Shard, np.ndarray]]) -> np.ndarray:
    out = np.zeros(len(hashes), bool)
    for shard, cells in shards:
        own = slice(None) if shard.parts == 1 else np.flatnonzero(_part(hashes, shard.parts) == shard.part)
        h = hashes[own]
        mask = _mask(h)
        out[own] = cells[_cell(h, shard.cells).astype(np.int64)] & mask == mask
    return out


def near_words(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, other, n, other_n): both ways, the pairs of words of ``vocabulary`` (word, n) that one inserted, deleted or replaced code point parts.

    Words must consist of code points below U+0100. No pair is lost or given twice; rows of a word that the vocabulary holds twice count twice.
    """
    spark = vocabulary.sparkSession
    stats = {r.size: r.n for r in vocabulary.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    seen = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # at most 256
    alphabet = np.array(sorted(ord(r.c) for r in seen if r.c), np.uint8)
    found: DataFrame | None = None
    for shards in _passes(stats, filter_bytes) if stats else []:
        filled = spark.sparkContext.broadcast(_filters(vocabulary, shards))

        def probe(batches: Iterator[pa.RecordBatch], filled=filled) -> Iterator[pa.RecordBatch]:
            filters: dict[int, list[tuple[Shard, np.ndarray]]] = {}
            for s, cells in filled.value.items():
                filters.setdefault(s.length, []).append((s, cells))
            for batch in batches:
                counts = dict(zip(batch["word"].to_pylist(), batch["n"].to_pylist()))
                for length, words in _by_length(list(counts)):
                    size = max(1, _CELLS // (length * len(alphabet)))
                    for i in range(0, len(words), size):
                        out: list[tuple[str, int, str]] = []
                        some = words[i:i + size]
                        for w, p, c in _edits(_codes(some), alphabet, filters):
                            word = some[w]
                            out.append((word, counts[word], word[:p] + ("" if c < 0 else chr(c)) + word[p + 1:]))
                        if out:
                            word, n, other = zip(*out)
                            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n, pa.int64()), pa.array(other)], ["word", "n", "candidate"])

        probed = vocabulary.select("word", "n").mapInArrow(tidy(probe), "word string, n bigint, candidate string")
        found = probed if found is None else found.unionByName(probed)
    if found is None:
        found = vocabulary.select("word", "n", F.col("word").alias("candidate")).limit(0)
    known = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = found.join(known, F.col("candidate") == F.col("other")).select("word", "other", "n", "other_n")
    # replacements are found from both sides, deletions from the longer word only
    turned = pairs.filter(F.length("other") < F.length("word")).select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("other_n").alias("n"), F.col("n").alias("other_n"))
    return pairs.unionByName(turned)


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form): the last word when forms are followed, by doubled strides."""
    reach = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(steps):
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("far"))
        reach = written(reach.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "roots")
    return reach


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_count: int = 5, factor: int = 5,
    damage: int | None = None, filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are those of :func:`word_counts` with at least ``least_count`` occurrences over all documents. n_near counts the words that one
    inserted, deleted or replaced code point away occur often enough too. A word's form is the one of them with the largest n (of several the
    smallest in code-point order), if that n is at least ``factor`` times the word's; else form and form_n are null. root
    follows forms from the word to the last one, the word itself without any.

    Null and empty texts have no words, repeated rows count each time, an empty table gives no rows, other columns are ignored.
    """
    counted = word_counts(docs, id_col, text_col, least_chars, damage)
    vocabulary = written(counted.filter(F.col("n") >= least_count), "vocabulary")
    best = F.min_by("other", F.struct(-F.col("other_n"), F.col("other")))
    near = near_words(vocabulary, filter_bytes).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.max("other_n").alias("best_n"), F.first("n").alias("n"))
    taken = F.col("best_n") >= factor * F.col("n")
    judged = written(near.select("word", "n_near", F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")), "near")
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    # a chain's counts grow by the factor with every step
    depth = math.ceil(math.log(max(most, 1), factor)) + 1 if factor > 1 else 64
    roots = _roots(judged.filter("form IS NOT NULL").select("word", "form"), max(1, math.ceil(math.log2(depth))))
    return vocabulary.join(judged, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
