"""Removal of repeated passages by fixed-block anchors.

Every document is cut into blocks of ``block`` words that do not overlap (the
reference blocks). All rolling windows of ``block`` words probe them. As a passage of
2 * block - 1 words contains a whole reference block wherever it starts, a repeated
window of ``window`` >= 2 * block - 1 words has an anchor: its text is probed
by a reference block of the other occurrence. Anchors are then
extended: the windows around them are compared by 96 bits of two independent hashes, and
neighbouring repeated windows merge into maximal repeats.

Hashes travel as packed arrays, one row per stretch of texts and hash range. Repeats
within a stretch are settled before the shuffle, so a passage that a third of
all documents share arrives once per stretch and not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm import words as W
from orgloom.llm.storage import bit_table, tidy, written

STRETCH_BYTES = 4 << 20
LAST = (1 << 63) - 1  # stands for a null identifier: larger than all others

_PACKED = "part int, stretch bigint, hashes binary, checks binary, places binary, ids binary, starts binary, info binary"
_PACKED_NAMES = ["part", "stretch", "hashes", "checks", "places", "ids", "starts", "info"]
_DOC = "id bigint, key bigint, n_words bigint, hits binary, repeats binary"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): the identifier and the text's hash name a document; equal rows are one document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, W.Words]]:
    """(serial number, rows by identifier, their words) of each stretch of texts."""
    context = TaskContext.get()
    serial = (context.partitionId() if context else 0) << 32
    for batch in batches:
        batch = batch.take(np.argsort(batch["id"].to_numpy(), kind="stable"))
        raw, at = W.raw_column(batch["text"])
        for i, j in W.stretches(at, STRETCH_BYTES):
            yield serial, batch.slice(i, j - i), _words(raw, at[i:j + 1])
            serial += 1


def _words(raw: np.ndarray, at: np.ndarray) -> W.Words:
    """As :func:`words_of`, in smaller steps."""
    parts = [W.words_of(raw, at[i:j + 1], W.SPACES, False) for i, j in W.stretches(at)]
    if len(parts) == 1:
        return parts[0]
    shift = np.cumsum([0, *(len(p.data) for p in parts)])
    words = np.cumsum([0, *(len(p.start) for p in parts)])
    return W.Words(
        raw[at[0]:at[-1]], np.concatenate([p.start + s for p, s in zip(parts, shift)]), np.concatenate([p.end + s for p, s in zip(parts, shift)]),
        np.concatenate([[0], *(p.first[1:] + n for p, n in zip(parts, words))]), np.concatenate([p.hash for p in parts]))


def _earlier(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether an entry's hash and check also belong to an entry with smaller (id, start)."""
    if not len(hashes):
        return np.empty(0, bool)
    order = np.lexsort((starts, ids, checks, hashes))
    h, c, i, s = hashes[order], checks[order], ids[order], starts[order]
    opens = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    head = np.maximum.accumulate(np.where(opens, np.arange(len(h)), 0))
    out = np.empty(len(h), bool)
    out[order] = (i != i[head]) | (s != s[head])
    return out


def _earlier_in_order(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """As :func:`_earlier` for entries that come by strictly rising (id, start)."""
    out = np.zeros(len(hashes), bool)
    if len(hashes):
        order = np.argsort(hashes, kind="stable")
        h, c = hashes[order], checks[order]
        same = h[1:] == h[:-1]
        if (c[1:][same] != c[:-1][same]).any():  # one hash, other words
            return _earlier(hashes, checks, np.arange(len(h)), np.zeros(len(h), np.uint32))
        out[order[1:]] = same
    return out


def _cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words from one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:n]) > 0


def _deal(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The entries of each part, in their order."""
    order = np.argsort(part.astype(np.uint16), kind="stable")
    sizes = np.bincount(part)
    ends = np.cumsum(sizes)
    for p in np.flatnonzero(sizes):
        at = order[ends[p] - sizes[p]:ends[p]]
        yield int(p), [c[at] for c in columns]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    cols = list(zip(*rows)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _PACKED_NAMES)


def _info(batch: pa.RecordBatch, words: W.Words, repeats: np.ndarray) -> bytes:
    """A stretch's documents and the windows in them that repeat earlier ones of the stretch."""
    sink = pa.BufferOutputStream()
    owner = np.searchsorted(words.first, repeats, "right") - 1
    cut = np.searchsorted(owner, np.arange(len(batch) + 1))
    inner = (repeats - words.first[owner]).astype(np.uint32) if len(repeats) else np.empty(0, np.uint32)
    table = pa.RecordBatch.from_arrays(
        [batch["id"], batch["key"], pa.array(words.counts()), pa.array([inner[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
        ["id", "key", "n_words", "repeats"])
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _parts(df: DataFrame) -> int:
    """Hash ranges: a power of two, twice the shuffle partitions at least."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(1 << 16, max(64, 1 << (2 * n - 1).bit_length()))


def _packed_stage(rows: DataFrame, judge: Callable[[list[dict]], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """Deal packed rows by part, let ``judge`` choose entries of each part, and gather them by stretch and document.

    Rows with info (part -1) hold a stretch's documents and pass through.
    """

    def judged(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["stretch", "places", "info"])
        out = [(s, p.tobytes(), None) for s, p in judge(table.to_pylist()) if len(p)]
        cols = list(zip(*out)) or [[]] * 3
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["stretch", "places", "info"])

    def by_document(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        info = next(r["info"] for r in rows if r["info"] is not None)
        docs = pa.ipc.open_stream(info).read_all().combine_chunks()
        first = np.concatenate([[0], np.cumsum(docs["n_words"].to_numpy())])
        places = [np.frombuffer(r["places"], np.uint32) for r in rows if r["places"]]
        hits = np.sort(np.concatenate([np.empty(0, np.uint32), *places])).astype(np.int64)
        cut = np.searchsorted(hits, first)
        inner = [(hits[a:b] - f).astype(np.uint32).tobytes() for a, b, f in zip(cut[:-1], cut[1:], first)]
        return pa.table([docs["id"], docs["key"], docs["n_words"], pa.array(inner, pa.binary()), docs["repeats"]],
                        ["id", "key", "n_words", "hits", "repeats"])

    # info rows have a part of their own per stretch, so they are dealt evenly
    spread = rows.withColumn("part", F.when(F.col("info").isNotNull(), -1 - F.pmod(F.xxhash64("stretch"), F.lit(1 << 30)).cast("int")).otherwise(F.col("part")))
    chosen = spread.groupBy("part").applyInArrow(judged, "stretch bigint, places binary, info binary")
    return chosen.groupBy("stretch").applyInArrow(by_document, _DOC)


def _united(docs: DataFrame) -> DataFrame:
    """One row per document in which something was found; rows that repeat a document add to its lists."""
    return docs.filter("length(hits) + length(repeats) > 0").groupBy("id", "key").agg(
        F.collect_list("hits").alias("hits"), F.collect_list("repeats").alias("repeats"))


def anchors(keyed: DataFrame, window: int, block: int) -> DataFrame:
    """Per document: the places of its rolling blocks that equal a reference block of another place
    (or are such a block), and the windows already known to repeat an earlier one of their stretch."""
    parts = _parts(keyed)
    shift = np.uint64(64 - parts.bit_length() + 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for serial, batch, words in _stretches(batches):
            whole = np.flatnonzero(words.inside(window))
            again = _earlier_or_same(words, batch, whole, window)
            open_ = whole[~again]
            # a block is needed where it lies in a window that is still open
            need = _cover(open_, window - block + 1, len(words.hash))
            place = np.flatnonzero(need)
            hashes = words.windows(block)[place] if len(place) else np.empty(0, np.uint64)
            owner = np.searchsorted(words.first, place, "right") - 1
            reference = ((place - words.first[owner]) % block == 0) if len(place) else np.empty(0, bool)
            short = ((hashes.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | reference.astype(np.uint32))
            out = [(-1, serial, None, None, None, None, None, _info(batch, words, whole[again]))]
            for p, (h, at) in _deal((hashes >> shift).astype(np.int64), short, place):
                out.append((p, serial, h.tobytes(), None, _steps(at), None, None, None))
            yield _rows(out)

    def judge(rows: list[dict]) -> Iterator[tuple[int, np.ndarray]]:
        hashes = [np.frombuffer(r["hashes"], np.uint32) for r in rows]
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        h = every[order]
        opens = np.flatnonzero(np.concatenate([[True], (h[1:] >> 1) != (h[:-1] >> 1)]))
        size = np.diff(np.concatenate([opens, [len(h)]]))
        good = (size > 1) & (np.bitwise_or.reduceat(h & 1, opens) == 1)
        hit = np.empty(len(h), bool)
        hit[order] = np.repeat(good, size)
        end = 0
        for r, own in zip(rows, hashes):
            yield r["stretch"], _places(r["places"])[hit[end:end + len(own)]].astype(np.uint32)
            end += len(own)

    return _united(_packed_stage(keyed.mapInArrow(tidy(probe), _PACKED), judge))


def _earlier_or_same(words: W.Words, batch: pa.RecordBatch, whole: np.ndarray, window: int) -> np.ndarray:
    if not len(whole):
        return np.empty(0, bool)
    hashes, checks = words.windows(window)[whole], words.second(window, whole)
    ids = batch["id"].to_numpy()
    if len(ids) < 2 or (ids[1:] > ids[:-1]).all():
        return _earlier_in_order(hashes, checks)
    owner = np.searchsorted(words.first, whole, "right") - 1
    return _earlier(hashes, checks, ids[owner], whole - words.first[owner])


def _steps(place: np.ndarray) -> bytes:
    """Rising places as 16-bit steps, or as they are where a step is larger."""
    step = np.diff(place, prepend=0)
    return b"s" + step.astype(np.uint16).tobytes() if step.max(initial=0) < 1 << 16 else b"p" + place.astype(np.uint32).tobytes()


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint16, offset=1).astype(np.int64)) if packed[:1] == b"s" else np.frombuffer(packed, np.uint32, offset=1)


def _with_found(keyed: DataFrame, found: DataFrame, filter_bits: int, keep_others: bool) -> DataFrame:
    """Documents with what was found in them. The text of others is not shuffled: they are
    dropped, or already counted and digested."""
    tagged = found.withColumn("slot", F.xxhash64("id", "key"))
    bits = W.pack_bits(bit_table(tagged, "slot", filter_bits), filter_bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = W.in_bits(bits, batch["slot"].to_numpy().view(np.uint64))
            if not keep_others:
                batch, near = batch.filter(pa.array(near)), near[near]
            counts = np.zeros(len(batch), np.int64)
            digest: list[str | None] = [None] * len(batch)
            for n in np.flatnonzero(~near):
                words = batch["text"][n].as_py().encode().split()
                counts[n], digest[n] = len(words), hashlib.sha256(b" ".join(words)).hexdigest()
            text = pa.compute.if_else(pa.array(near), batch["text"], pa.scalar(None, batch["text"].type))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], text, pa.array(counts), pa.array(digest, pa.string())],
                                             ["id", "key", "text", "n", "digest"])

    picked = keyed.withColumn("slot", F.xxhash64("id", "key")).mapInArrow(tidy(pick), "id bigint, key bigint, text string, n bigint, digest string")
    return picked.join(found, ["id", "key"], "left" if keep_others else "inner")


def repeated_windows(keyed: DataFrame, found: DataFrame, window: int, block: int, filter_bits: int) -> DataFrame:
    """Per document: the windows around its anchors that repeat an earlier window (hits)."""
    rows = _with_found(keyed, found.filter(F.exists("hits", lambda h: F.length(h) > 0)).select("id", "key", "hits"), filter_bits, False).select("id", "key", "text", "hits")
    parts = _parts(keyed)
    shift = np.uint64(64 - parts.bit_length() + 1)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for serial, batch, words in _stretches(batches):
            places = [np.frombuffer(b, np.uint32) + f for own, f in zip(batch["hits"].to_pylist(), words.first) for b in own]
            hits = np.concatenate(places) if places else np.empty(0, np.int64)
            # windows from window - block words before an anchor to the anchor itself
            near = _cover(np.maximum(hits - (window - block), 0), window - block + 1, len(words.hash))
            whole = np.flatnonzero(words.inside(window) & near[:max(0, len(words.hash) - window + 1)])
            again = _earlier_or_same(words, batch, whole, window)
            open_ = whole[~again]
            hashes = words.windows(window)[open_] if len(open_) else np.empty(0, np.uint64)
            owner = np.searchsorted(words.first, open_, "right") - 1
            ids = batch["id"].to_numpy()[owner] if len(open_) else np.empty(0, np.int64)
            out = [(-1, serial, None, None, None, None, None, _info(batch, words, whole[again]))]
            checks = words.second(window, open_) if len(open_) else np.empty(0, np.uint32)
            for p, (h, c, at, i, s) in _deal((hashes >> shift).astype(np.int64), hashes, checks, open_, ids, open_ - words.first[owner]):
                out.append((p, serial, h.tobytes(), c.tobytes(), at.astype(np.uint32).tobytes(), i.tobytes(), s.astype(np.uint32).tobytes(), None))
            yield _rows(out)

    def judge(rows: list[dict]) -> Iterator[tuple[int, np.ndarray]]:
        column = lambda c, t: [np.frombuffer(r[c], t) for r in rows]
        hashes, places = column("hashes", np.uint64), column("places", np.uint32)
        again = _earlier(np.concatenate(hashes), np.concatenate(column("checks", np.uint32)), np.concatenate(column("ids", np.int64)), np.concatenate(column("starts", np.uint32)))
        end = 0
        for r, own in zip(rows, places):
            yield r["stretch"], own[again[end:end + len(own)]]
            end += len(own)

    return _united(_packed_stage(rows.mapInArrow(tidy(extend), _PACKED), judge))


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, block: int = 10, filter_bits: int = 1 << 24,
) -> DataFrame:
    """One row per document row: ``id_col``, n_words, n_removed, kept_sha256, kept (the kept words, null where none is removed), removed spans.

    Words are separated by ASCII white space and not changed. A word goes when it
    lies in a window of ``window`` words whose words also start earlier: in a document
    with a smaller identifier, or earlier in the same document. Windows are judged on
    the input. removed holds merged (start, end) word ranges.

    A null text has no words. Identifiers are integers; a null one counts as larger than all
    others. Rows that share identifier and text are one document: none of them repeats
    the other, and each is returned. Empty tables give no rows, other columns are ignored.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must be able to hold a whole reference block: window >= 2 * block - 1")
    keyed = _keyed(docs, id_col, text_col)
    first = written(anchors(keyed, window, block), "anchors")
    second = repeated_windows(keyed, first, window, block, filter_bits)
    both = first.select("id", "key", "repeats").unionByName(second.select("id", "key", F.concat("repeats", "hits").alias("repeats")))
    told = both.select("id", "key", F.filter("repeats", lambda r: F.length(r) > 0).alias("repeats")).filter(F.size("repeats") > 0)
    found = written(told.groupBy("id", "key").agg(F.flatten(F.collect_list("repeats")).alias("repeats")), "repeats")
    rows = _with_found(keyed, found, filter_bits, True)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = batch["n"].to_numpy().copy(), batch["digest"].to_pylist()
            removed, kept, spans = np.zeros(len(batch), np.int64), [None] * len(batch), [[] for _ in range(len(batch))]
            for n in np.flatnonzero(np.asarray(batch["text"].is_valid())):
                words = batch["text"][n].as_py().encode().split()
                counts[n] = len(words)
                starts = batch["repeats"][n].as_py()
                if starts:
                    gone = _cover(np.unique(np.concatenate([np.frombuffer(s, np.uint32) for s in starts])).astype(np.int64), window, len(words))
                    removed[n] = gone.sum()
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans[n] = [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(words)
                digests[n] = hashlib.sha256(joined).hexdigest()
                kept[n] = joined.decode() if removed[n] else None
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(counts), pa.array(removed), pa.array(digests, pa.string()), pa.array(kept, pa.string()), pa.array(spans, span)],
                ["id", "n_words", "n_removed", "kept_sha256", "kept", "removed"])

    out = rows.mapInArrow(tidy(cut), "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string, removed array<struct<start:bigint,end:bigint>>")
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept", "removed")
