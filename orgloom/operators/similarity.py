"""Similar records by banded minhash signatures: candidates that share a band, sifted block against block by small sketches, then compared by their words.

Records with the same word set are one class from the start, so copies are never compared. A class has ``bands`` keys, each made of ``rows``
minima of hashed words; classes that share a key meet. A pair of similarity s is met with probability 1 - (1 - s^rows)^bands: with 20 bands of 3
rows over 0.999999 at 0.8 and 0.93 at 0.5. A key that many classes share is cut into blocks; two blocks meet in one task, each pair in the first
band that it shares.

What meets in every shared band is a sketch of fixed size: keys, number of words and a table of BITS bits, one flipped by each word. Words in one
set only are at least as many as the bits that differ, so a pair that the sketches reject is surely not similar. Only classes of a pair that
is left bring their words, to the task of that pair's band; the verdict is taken on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from orgloom.session import stored

BLOCK = 256  # classes a side in one comparison
COLUMNS = 4096  # words compared at a time
BITS = 1024  # of a sketch
SETS = 1024  # sketched at a time


def word_set(text: Column) -> Column:
    """The distinct lower-cased words between white space, sorted."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sketches(bands: int, rows: int):
    """UDF: hashed words of a class, one or more -> its band keys and bits."""

    @arrow_udf("struct<keys: array<int>, bits: binary>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sets in batches:
            sizes = np.diff(sets.offsets.to_numpy())
            flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(sizes).astype(np.int64)
            first = ends - sizes
            out = np.empty((len(sizes), bands), np.uint32)
            for band in range(bands if len(sizes) else 0):
                key = np.full(len(sizes), band, np.uint64)
                for row in range(rows):
                    seed = np.uint64((band * rows + row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                    key = _mix(key ^ np.minimum.reduceat(_mix(flat ^ seed), first))
                out[:, band] = key >> np.uint64(32)
            bits = []
            for lo in range(0, len(sizes), SETS):
                hi = min(lo + SETS, len(sizes))
                place = (flat[first[lo]:ends[hi - 1]] % np.uint64(BITS)).astype(np.int64)
                place += np.repeat(np.arange(hi - lo), sizes[lo:hi]) * BITS
                flipped = np.bincount(place, minlength=(hi - lo) * BITS).reshape(hi - lo, BITS) & 1
                bits += [row.tobytes() for row in np.packbits(flipped.astype(np.uint8), axis=1)]
            offsets = np.arange(len(sizes) + 1, dtype=np.int32) * bands
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(offsets, pa.array(out.view(np.int32).ravel())), pa.array(bits, pa.binary())], ["keys", "bits"])

    return sketch


def _met(key: tuple, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the two sides of a task, and which of their pairs it decides: of different blocks or in order, and met in no earlier band."""
    slot, i, j = (k.as_py() for k in key)
    ids, own = table["class_id"].to_numpy(), table["own"].to_numpy()
    keys = np.stack(table["keys"].to_numpy())
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    kept = ids[left][:, None] < ids[right][None, :] if i == j else np.ones((len(left), len(right)), bool)
    for band in range(slot >> 32):
        kept &= keys[left, band][:, None] != keys[right, band][None, :]
    return left, right, kept


def _sift(threshold: float):
    """Classes of one task that are in a pair which may be similar by its sketches."""

    def sift(key: tuple, table: pa.Table) -> pa.Table:
        left, right, kept = _met(key, table)
        size = table["n"].to_numpy()
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(size), -1)
        n, m = size[left][:, None], size[right][None, :]
        differ = np.zeros(kept.shape, np.int64)
        for word in range(bits.shape[1]):
            differ += np.bitwise_count(bits[left, word][:, None] ^ bits[right, word][None, :])
        # with d words in one set only, the similarity is (n + m - d) / (n + m + d); d is |n - m| at least
        differ = np.maximum(differ, np.abs(n - m))
        kept &= (n + m - differ) >= threshold * (n + m + differ) - 1e-9 * (n + m)
        x, y = np.nonzero(kept)
        places = np.unique(np.concatenate([left[x], right[y]]))
        same = lambda k, kind: pa.array(np.full(len(places), k.as_py()), kind)
        found = table.select(["class_id", "own", "keys"]).take(pa.array(places))
        return pa.table([same(key[0], pa.int64()), same(key[1], pa.int32()), same(key[2], pa.int32()), *found.columns], ["slot", "i", "j", "class_id", "own", "keys"])

    return sift


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Words in common of each left and right set (places in ``sets``)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    words, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(words)) > 1
    column, owner = (np.cumsum(often) - 1)[column[often[column]]], owner[often[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(often.sum()), COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[i:j], column[i:j] - lo] = 1
        common += np.rint(grid[left] @ grid[right].T).astype(np.int64)
    return common


def _judged(threshold: float, listed: bool):
    """Pairs of one task by their words: the pairs themselves, or for each class the number of records that it is linked with there."""

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        left, right, kept = _met(key, table)
        ids, copies = table["class_id"].to_numpy(), table["copies"].to_numpy()
        number: dict[str, int] = {}
        sets = [np.array([number.setdefault(w, len(number)) for w in words.split(" ")], np.int64) for words in table["words"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        common = _shared(sets, left, right)
        similarity = common / (sizes[left][:, None] + sizes[right][None, :] - common)
        kept &= similarity >= threshold
        x, y = np.nonzero(kept)
        if not listed:
            n = np.bincount(left[x], copies[right[y]], len(ids)) + np.bincount(right[y], copies[left[x]], len(ids))
            some = np.flatnonzero(n)
            return pa.table({"class_id": ids[some], "n": n[some].astype(np.int64)})
        similarity, x, y = similarity[x, y], left[x], right[y]
        x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        return pa.table({"a": ids[x], "b": ids[y], "similarity": similarity, "copies_a": copies[x], "copies_b": copies[y]})

    return judge


def word_classes(records: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, class_id, copies), one row per record: class_id is the smallest identifier with the same words, copies their number.

    A record without words or without an identifier is a class of its own, with copies 1.
    """
    return _classes(_words(records, id_col, text_col))


def _words(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per record: id, words (joined by single spaces), digest (NULL without words or identifier)."""
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.array_join(word_set(F.col(text_col)), " ").alias("words"))
    return rows.withColumn("digest", F.when((F.col("words") != "") & F.col("id").isNotNull(), F.unhex(F.sha2("words", 256))))


def _classes(rows: DataFrame) -> DataFrame:
    rows = rows.select("id", "digest")
    filled = rows.filter("digest IS NOT NULL")
    classes = filled.groupBy("digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return filled.join(classes, "digest").select("id", "class_id", "copies").unionByName(
        rows.filter("digest IS NULL").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies")))


def similar_pairs(records: DataFrame, threshold: float = 0.8, id_col: str = "id", text_col: str = "text", bands: int = 20, rows: int = 3) -> DataFrame:
    """(a, b, similarity, copies_a, copies_b) of classes a < b (see :func:`word_classes`) whose word sets have a Jaccard similarity of ``threshold`` or more.

    Identifiers are unique integers; null ones and records without words are in no pair. Other columns are ignored.
    """
    return _compared(_sets(_words(records, id_col, text_col)), threshold, bands, rows, listed=True)


def _sets(rows: DataFrame) -> DataFrame:
    """One row per class: class_id, copies, words."""
    grouped = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"))
    return stored(grouped.select("class_id", "copies", "words"), "word-sets")


def _compared(sets: DataFrame, threshold: float, bands: int, rows: int, listed: bool) -> DataFrame:
    """Similar pairs of classes, or (class_id, n) rows whose sum is the number of records linked with the class."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    hashed = sets.select("class_id", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("hashes"))
    sketched = hashed.select("class_id", F.size("hashes").alias("n"), _sketches(bands, rows)(F.col("hashes")).alias("s"))
    signed = stored(sketched.select("class_id", "n", "s.keys", "s.bits"), "signatures")
    # one number for band and key
    buckets = signed.select("class_id", F.posexplode("keys").alias("band", "key")).select(
        "class_id", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))).alias("slot"))
    sizes = buckets.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = buckets.join(sizes, "slot").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "class_id", "slot", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    task = ["slot", "i", "j"]
    likely = stored(met.join(signed, "class_id").groupBy(task).applyInArrow(
        _sift(threshold), "slot bigint, i int, j int, class_id bigint, own int, keys array<int>"), "likely")
    columns = "a bigint, b bigint, similarity double, copies_a bigint, copies_b bigint" if listed else "class_id bigint, n bigint"
    return likely.join(sets, "class_id").groupBy(task).applyInArrow(_judged(threshold, listed), columns)


def similar_records(records: DataFrame, threshold: float = 0.8, id_col: str = "id", text_col: str = "text", bands: int = 20, rows: int = 3) -> DataFrame:
    """One row per record: ``id_col``, class_id, n_links.

    class_id is the smallest identifier with the same words; n_links counts the other records of similarity ``threshold`` or more, copies
    included. A record without words is a class of its own without links; so is one without an identifier.
    """
    words = stored(_words(records, id_col, text_col), "words")
    links = _compared(_sets(words), threshold, bands, rows, listed=False)
    others = links.groupBy("class_id").agg(F.sum("n").alias("others"))
    out = _classes(words).join(others, "class_id", "left")
    return out.select(F.col("id").alias(id_col), "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
