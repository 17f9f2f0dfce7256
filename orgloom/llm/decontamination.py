"""Benchmark decontamination by winnowing.

In every stretch of ``span`` words the smallest hash of its ``gram``-word grams is a
fingerprint, so two texts that share ``span`` words in a row share a fingerprint. The
fingerprints of documents are joined with those of the benchmark items; each hit is extended to
the windows around it, whose words are then compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm import words as W
from orgloom.llm.storage import bit_table, tidy, written


def fingerprints(words: W.Words, span: int, gram: int) -> np.ndarray:
    """Positions of the fingerprint grams: of each inside window of ``span`` words the last smallest gram."""
    grams, ok = words.windows(gram), words.inside(span)
    n = len(ok)
    if not n:
        return np.empty(0, np.int64)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, span - gram + 1):
        other = grams[j:n + j]
        smaller = other <= best
        best[smaller] = other[smaller]
        place[smaller] = np.flatnonzero(smaller) + j
    chosen = np.zeros(len(grams), bool)
    chosen[place[ok]] = True
    return np.flatnonzero(chosen)


def _item_windows(items: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """(item, size, window, prints) of every window; an item of fewer words is one window. prints: its fingerprint hashes, or its own hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = W.raw_column(batch["text"])
            ids = batch["item"].to_pylist()
            for i, j in W.stretches(at):
                words = W.words_of(raw, at[i:j + 1], W.NON_ALNUM, True)
                prints = fingerprints(words, span, gram)
                grams = words.windows(gram).view(np.int64)
                out: list[tuple] = []
                for d in range(j - i):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    if 0 < b - a < span:
                        own = words.windows(b - a).view(np.int64)[a]
                        out.append((ids[i + d], b - a, words.text(a, b - a), [int(own)]))
                    for w in range(a, b - span + 1):
                        lo, hi = np.searchsorted(prints, [w, w + span - gram + 1])
                        out.append((ids[i + d], span, words.text(w, span), grams[prints[lo:hi]].tolist()))
                cols = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()),
                     pa.array(cols[3], pa.list_(pa.int64()))], ["item", "size", "window", "prints"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(cut), "item string, size int, window string, prints array<bigint>")


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", span: int = 10, gram: int = 5, filter_bits: int = 1 << 23,
) -> DataFrame:
    """One row per document row: ``id_col``, n_words, n_hit, items, spans, text_key (a hash of the text).

    Words are runs of a-z, 0-9 and non-ASCII characters after A-Z is lower-cased.
    Every window of ``span`` consecutive item words counts (an item of fewer words,
    but not none, is one window), wherever it occurs in a document. n_hit is the
    number of document words inside any occurrence, items the sorted identifiers of
    the items that occur, spans the merged (start, end) word ranges.

    A fixed table of ``filter_bits`` bits of the items' fingerprints keeps most
    documents' fingerprints from the join; it only saves work.

    A null text has no words and no windows; null item identifiers count as '';
    null document identifiers stay; repeated rows are judged one by one and
    repeated items count once; empty tables give n_hit 0, or no rows; other columns are ignored.
    """
    windows = written(_item_windows(items, item_col, item_text_col, span, gram), "windows")
    prints = windows.select("size", F.explode("prints").alias("print"))
    long_bits = W.pack_bits(bit_table(prints.filter(F.col("size") == span), "print", filter_bits), filter_bits)
    short = prints.filter(F.col("size") < span)
    sizes = [r.size for r in short.select("size").distinct().collect()]  # fewer than span
    short_bits = {s: W.pack_bits(bit_table(short.filter(F.col("size") == s), "print", filter_bits), filter_bits) for s in sizes}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 40
        for batch in batches:
            raw, at = W.raw_column(batch["text"])
            for i, j in W.stretches(at):
                words = W.words_of(raw, at[i:j + 1], W.NON_ALNUM, True)
                prints = fingerprints(words, span, gram)
                grams = words.windows(gram)
                prints = prints[W.in_bits(long_bits, grams[prints])]
                ok = np.flatnonzero(words.inside(span))
                near = np.unique((prints[:, None] - np.arange(span - gram + 1)).ravel())
                found = [(int(w), span) for w in near[np.isin(near, ok)]]
                for size, bits in short_bits.items():
                    hashes = words.windows(size)
                    found += [(int(w), size) for w in np.flatnonzero(words.inside(size) & W.in_bits(bits, hashes))]
                found.sort()
                owner = np.searchsorted(words.first, [w for w, _ in found], "right") - 1
                tries: list[list[dict]] = [[] for _ in range(j - i)]
                for (w, size), d in zip(found, owner):
                    tries[d].append({"start": w - int(words.first[d]), "size": size, "window": words.text(w, size)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(serial, serial + j - i)), batch["id"].slice(i, j - i), batch["key"].slice(i, j - i), pa.array(words.counts()),
                     pa.array(tries, pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("window", pa.string())])))],
                    ["row", "id", "key", "n_words", "tries"])
                serial += j - i

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    probed = rows.mapInArrow(tidy(probe), f"row bigint, id {kind}, key bigint, n_words bigint, tries array<struct<start:int,size:int,window:string>>")
    tried = probed.select("row", "id", "key", "n_words", F.explode_outer("tries").alias("t")).select("row", "id", "key", "n_words", "t.*")
    known = windows.groupBy("window").agg(F.collect_set("item").alias("found"))
    hit = tried.join(known, "window", "left").groupBy("row", "id", "key", "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("found").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("end"))))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("items"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    # occurrences of the full window size overlap in runs; a run's words are one span
    merged = F.aggregate(
        "at", F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")),
        lambda s, o: F.when(o["start"] <= s["end"], F.struct(s["done"], s["start"], F.greatest(s["end"], o["end"]).alias("end"))).otherwise(
            F.struct(F.when(s["end"] > 0, F.array_append(s["done"], F.struct(s["start"], s["end"]))).otherwise(s["done"]).alias("done"),
                     o["start"].alias("start"), o["end"].alias("end"))),
        lambda s: F.when(s["end"] > 0, F.array_append(s["done"], F.struct(s["start"], s["end"]))).otherwise(s["done"]),
    )
    return hit.select(F.col("id").alias(id_col), "n_words", merged.alias("spans"), "items", F.col("key").alias("text_key")).select(
        id_col, "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"), "items", "spans", "text_key")
