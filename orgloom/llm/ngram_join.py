"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its word shingles. All sets are sorted in one global order,
rare shingles first by two frequency sketches of fixed size: one of shingles, which shows the
frequent ones above its noise, and one of words, whose product tells the rare ones apart, however many shingles share a counter. For two sets that are
similar enough, the first |x| - ceil(t|x|) + l shingles of each share at least l, for any l. Each
document lengthens its prefix (a larger l) where the sketch estimates that this
saves more verifications than it costs in postings; a pair is a candidate when its prefixes
share as many shingles as the smaller of the two l, and as many as their sizes ask for (see :func:`enough`).

Documents with the same set are one node from the start. Shingles in few prefixes
yield candidate pairs directly, and connected candidates form a group. Shingles in
many prefixes do not: all nodes of such shingles join the group of the shingle's first node.
Within a group the full sets are compared block against block, and only a
spanning set of the links found leaves a task, with the number of links of each node. So no link is lost, and no group's pairs
are ever listed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgloom.llm import words as W
from orgloom.llm.components import components
from orgloom.llm.storage import bit_table, tidy, written

SKETCH_BITS, WORD_BITS = 22, 20  # counters of shingles and of words
SKETCH_PARTS = 64  # of either
OCTAVE = 4  # levels of rarity for a factor of two
RAREST = -6 * OCTAVE  # shingles expected less often than 2 ** -6 times count as equally rare
LONGEST = 4  # largest number of shared prefix shingles asked for
VERIFY_COST = 8.0  # of a candidate, in postings
PAIRED = 64  # a shingle in more prefixes is not turned into pairs
BLOCK = 512  # nodes compared with as many others in one task
BLOCK_SHINGLES = 1 << 20  # about as many in a block at most


def _sets_of(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, W.Words]]:
    """(i, j, shingles, owner, first word, number of words, words) for stretches of texts: the distinct shingle hashes of texts i to j, by text."""
    raw, at = W.raw_column(texts)
    for i, j in W.stretches(at):
        words = W.words_of(raw, at[i:j + 1], W.SPACES, True)
        counts = words.counts()
        owner = np.repeat(np.arange(j - i), counts)
        inside = words.inside(k)
        parts, owners, places, sizes = [words.windows(k)[inside]], [owner[:len(inside)][inside]], [np.flatnonzero(inside)], [np.full(inside.sum(), k)]
        for n in range(1, k):  # fewer words: the whole sequence is the shingle
            few = np.flatnonzero(counts == n)
            if len(few):
                parts.append(words.windows(n)[words.first[few]])
                owners.append(few)
                places.append(words.first[few])
                sizes.append(np.full(len(few), n))
        tokens, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        order = order[fresh]
        yield i, j, tokens[fresh], owner[fresh], np.concatenate(places)[order], np.concatenate(sizes)[order], words


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, shingles, owner) for stretches of texts: the distinct shingle hashes of texts i to j, by text."""
    for found in _sets_of(texts, k):
        yield found[:4]


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by owner (sorted), wrapping."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    at = np.searchsorted(owner, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def _node_hashes(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One number per set, whatever the order of its shingles."""
    return W.mix(_sums(W.mix(tokens ^ np.uint64(0xA5A5)), owner, n)).view(np.int64)


def _cells(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in ``table``, whose size is a power of two."""
    return (hashes >> np.uint64(65 - len(table).bit_length())).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """32-bit counters, compressed by byte places, as most are small."""
    return zlib.compress(counts.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _described(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (id, key, n, node) and of partial sketches (cell, counts): parts of the shingles' sketch, then of the words'."""
    names = ["id", "key", "n", "node", "cell", "counts"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, often = np.zeros(1 << SKETCH_BITS, np.uint32), np.zeros(1 << WORD_BITS, np.uint32)
        for batch in batches:
            for i, j, tokens, owner, _, _, words in _sets_of(batch["text"], k):
                np.add.at(sketch, _cells(tokens, sketch), np.uint32(1))
                np.add.at(often, _cells(words.hash, often), np.uint32(1))
                node = _node_hashes(tokens, owner, j - i)
                counts = np.bincount(owner, minlength=j - i)
                none = pa.nulls(j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(i, j - i), batch["key"].slice(i, j - i), pa.array(counts), pa.array(node), none.cast(pa.int32()),
                     none.cast(pa.binary())], names)
        parts = [*np.split(sketch, SKETCH_PARTS), *np.split(often, SKETCH_PARTS)]
        cells = [p for p, part in enumerate(parts) if part.any()]
        if cells:
            none = pa.nulls(len(cells), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(cells, pa.int32()), pa.array([_packed(parts[p]) for p in cells], pa.binary())], names)

    return docs.mapInArrow(tidy(describe), "id bigint, key bigint, n bigint, node bigint, cell int, counts binary")


def _sketches(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The summed sketches of shingles and of words: a fixed number of counters."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(_unpacked(b.as_py()).astype(np.float64) for b in table["counts"])
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    rows = described.filter("cell IS NOT NULL").select("cell", "counts").groupBy("cell").applyInArrow(add, "cell int, counts binary").collect()
    out = [np.zeros((SKETCH_PARTS, (1 << bits) // SKETCH_PARTS), np.float32) for bits in (SKETCH_BITS, WORD_BITS)]
    for r in rows:
        out[r.cell // SKETCH_PARTS][r.cell % SKETCH_PARTS] = np.frombuffer(r.counts, np.float32)
    return out[0].ravel(), out[1].ravel()


def levels(sketch: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(of shingles, of words, base) by counter: levels of rarity, OCTAVE of them for a factor of two.

    A shingle's level is the larger of its own counter's, where that stands out of the noise of other shingles, and of base and its words' levels
    together, which is how often words so frequent would meet by chance. All are whole numbers, made once, so every task sorts alike.
    """
    floor = max(1.0, float(np.median(sketch)))
    above = sketch - np.float32(floor)
    own = np.where(above > max(1.0, 4 * floor ** 0.5), np.round(OCTAVE * np.log2(np.maximum(above, np.float32(1)))), -128).astype(np.int8)
    total, floor = max(1.0, float(often.sum(dtype=np.float64))), float(np.median(often))
    share = np.maximum(often - np.float32(floor), max(1.0, floor ** 0.5)) / np.float32(total)
    return own, np.round(OCTAVE * np.log2(share)).astype(np.int16), round(OCTAVE * float(np.log2(total)))


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection of a set of n with any set that is similar enough."""
    return -(-percent * n // 100)


def _at_least(rate: np.ndarray, least: int) -> np.ndarray:
    """Probability that a Poisson variable of that rate is ``least`` or more."""
    term, below = np.exp(-rate), np.zeros_like(rate)
    for i in range(least):
        below += term
        term = term * rate / (i + 1)
    return np.where(rate < 0.05, term * (1 + rate / (least + 1)), 1 - below)  # term: exactly ``least``


def _level(tokens: np.ndarray, place: np.ndarray, size: np.ndarray, words: W.Words, rarity: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Levels of the shingles of ``size`` words at ``place``."""
    own, of_words, base = rarity
    total = np.concatenate([[0], np.cumsum(of_words[_cells(words.hash, of_words)], dtype=np.int64)])
    return np.maximum(np.maximum(base + total[place + size] - total[place], own[_cells(tokens, own)]), RAREST)


def prefixes(tokens: np.ndarray, owner: np.ndarray, n: int, level: np.ndarray, documents: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen, l, order): tokens sorted rare first within each owner by ``order``, which of them are in the prefix, and l by owner."""
    order = np.lexsort((tokens, level, owner))
    others, owner = np.exp2(level[order] / OCTAVE), owner[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    size = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(others)])
    spare = size - _needed(size, percent)
    best, chosen = np.full(n, np.inf), np.ones(n, np.int64)
    for least in range(1, LONGEST + 1):
        length = np.minimum(spare + least, size)
        met = total[first[:-1] + length] - total[first[:-1]]
        cost = length + met + VERIFY_COST * documents * _at_least(met / max(1, documents), least)
        better = (cost < best) & (least <= _needed(size, percent))
        best[better], chosen[better] = cost[better], least
    place = np.arange(len(owner)) - first[owner]
    return place < np.minimum(spare + chosen, size)[owner], chosen, order


def enough(percent: int) -> Column:
    """How many shingles of their prefixes two similar sets (n, need and n2, need2) share at least.

    The prefix that ends first in the global order, x's, shares nothing with the rest of y, so what x and y have in common lies in both prefixes or
    in the rest of x, which has as many shingles as x needs in common with any set, less l. The larger set gives the lower number, or the smaller need.
    """
    common = f"({percent} * (n + n2) + {99 + percent}) div {100 + percent}"
    return F.expr(f"greatest(least(need, need2), {common} - greatest(({percent} * n + 99) div 100 - need, ({percent} * n2 + 99) div 100 - need2))")


def _postings(docs: DataFrame, k: int, percent: int, rarity: tuple[np.ndarray, np.ndarray, int], documents: int) -> DataFrame:
    """(node, n, need, shingles): each node's prefix. Sets so small that only equal ones are similar have none."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tokens, owner, place, length, words in _sets_of(batch["text"], k):
                node = _node_hashes(tokens, owner, j - i)
                size = np.bincount(owner, minlength=j - i)
                inside, need, order = prefixes(tokens, owner, j - i, _level(tokens, place, length, words, rarity), documents, percent)
                tokens, owner = tokens[order][inside], owner[order][inside]
                at = np.searchsorted(owner, np.arange(j - i + 1))
                large = np.flatnonzero(100 * size >= percent * (size + 1))
                large = large[np.unique(node[large], return_index=True)[1]]
                lists = [tokens[at[d]:at[d + 1]].view(np.int64) for d in large]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[large]), pa.array(size[large]), pa.array(need[large].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    ["node", "n", "need", "shingles"])

    rows = docs.select("text").mapInArrow(tidy(choose), "node bigint, n bigint, need int, shingles array<bigint>")
    return rows.groupBy("node").agg(F.first("n").alias("n"), F.first("need").alias("need"), F.first("shingles").alias("shingles"))


def _common(tokens: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each of ``left`` shares with each of ``right`` (of ``n`` owners; a token once per owner)."""
    common = np.zeros((len(left), len(right)), np.float64)
    if not len(tokens):
        return common.astype(np.int64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    opens = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    often = np.diff(np.append(opens, len(tokens)))
    # shingles with the same owners are one column, weighted
    pattern = np.add.reduceat(W.mix(owner.astype(np.uint64) + np.uint64(1)), opens)
    shared = np.flatnonzero(often > 1)
    _, sample, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    for lo in range(0, len(sample), 4096):
        rows = shared[sample[lo:lo + 4096]]
        grid = np.zeros((n, len(rows)), np.float32)
        column = np.repeat(np.arange(len(rows)), often[rows])
        places = np.concatenate([np.arange(opens[r], opens[r] + often[r]) for r in rows])
        grid[owner[places], column] = 1
        common += (grid[left] * weight[lo:lo + 4096].astype(np.float32)) @ grid[right].T
    return np.rint(common).astype(np.int64)


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``left`` are similar enough to which of ``right`` (places in ``sets``)."""
    size = np.array([len(s) for s in sets], np.int64)
    common = _common(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets), left, right)
    return 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)


def _spanning(similar: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of ``n`` nodes: each node but one of a connected piece, with that one."""
    label = np.arange(n)
    while True:
        a = np.where(similar, label[right][None, :], n).min(1, initial=n)
        new = label.copy()
        new[left] = np.minimum(new[left], a)
        b = np.where(similar, new[left][:, None], n).min(0, initial=n)
        np.minimum.at(new, right, b)
        if (new == label).all():
            break
        label = new
    return [(i, int(r)) for i, r in enumerate(label) if i != r]


def _met_before(names: pa.ChunkedArray, kind: int, name: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of ``left`` and ``right`` share a group before (``kind``, ``name``); ``names`` lists the groups of each node."""
    lists = names.combine_chunks()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    held = lists.flatten()
    kinds, own = held.field("kind").to_numpy().astype(np.int64), held.field("name").to_numpy()
    before = (kinds < kind) | ((kinds == kind) & (own < name))
    _, number = np.unique(np.stack([kinds[before], own[before]]), axis=1, return_inverse=True)
    return _common(number.ravel().astype(np.uint64), owner[before], len(lists), left, right) > 0


def _links(groups: DataFrame, sets: DataFrame, percent: int, counted: bool) -> DataFrame:
    """Spanning links (a, b) within the groups (grp, node, n) and, if ``counted``, rows (a, null, n): n documents of other sets linked with node a.

    ``sets`` then holds copies too. A pair that meets in several groups counts in the first of them only, so the sum of n over the rows of a node is exact.
    """
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = groups.groupBy("grp").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    placed = groups.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp", "node", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        nodes, own = table["node"].to_numpy(), table["own"].to_numpy()
        held = [np.frombuffer(s.as_py(), np.uint64) for s in table["shingles"]]
        if len(held) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        similar = _similar(held, left, right, percent)
        found = _spanning(similar, len(held), left, right)
        a, b, n = [int(nodes[x]) for x, _ in found], [int(nodes[y]) for _, y in found], [None] * len(found)
        if counted:
            group = key[0].as_py()
            fresh = similar & (left[:, None] != right[None, :]) & ~_met_before(table["names"], group["kind"], group["name"], left, right)
            copies = table["copies"].to_numpy()
            total = np.zeros(len(held), np.int64)
            total[left] += fresh @ copies[right]
            if i != j:
                total[right] += copies[left] @ fresh
            some = np.flatnonzero(total)
            a, b, n = a + nodes[some].tolist(), b + [None] * len(some), n + total[some].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    if counted:
        sets = sets.join(groups.groupBy("node").agg(F.collect_set("grp").alias("names")), "node")
    return met.join(sets, "node").groupBy("grp", "i", "j").applyInArrow(compare, "a bigint, b bigint, n bigint")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, filter_bits: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, key): the whole sets, packed."""
    bits = W.pack_bits(bit_table(wanted, "key", filter_bits), filter_bits)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(W.in_bits(bits, batch["key"].to_numpy().view(np.uint64))))
            for i, j, tokens, owner in shingle_sets(batch["text"], k):
                node = _node_hashes(tokens, owner, j - i)
                at = np.searchsorted(owner, np.arange(j - i + 1))
                some = np.unique(node, return_index=True)[1]
                packed = [tokens[at[d]:at[d + 1]].tobytes() for d in some]
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(packed, pa.binary())], ["node", "shingles"])

    found = docs.select("key", "text").mapInArrow(tidy(collect), "node bigint, shingles binary")
    return found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, filter_bits: int = 1 << 24, count_links: bool = False) -> DataFrame:
    """One row per document row: ``id_col``, n_shingles, component_id, set_id, text_key and, with ``count_links``, n_links.

    A-Z is lower-cased, words are separated by ASCII white space, the set holds the
    distinct shingles of ``k`` words (with fewer words, the whole sequence). Two documents
    link when 100 * |intersection| >= ``percent`` * |union|. component_id is the smallest
    identifier that links reach, the own one included; set_id is equal for equal sets. n_links is the number
of other rows that a row links with, copies included, whatever group they met in.

    A null, empty or blank text has an empty set, which links with nothing, not even
    another empty one. Identifiers are integers; a null one is reached last (component_id is null
    only where no member has one). Rows that repeat an identifier are compared row by row and each returned; an empty
    table gives no rows; other columns are ignored. Texts are taken whole. Shingles and sets
    are told apart by 64-bit hashes. text_key is the hash of the text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    described = written(_described(rows, k), "sets")
    nodes = described.filter("cell IS NULL")
    whole = nodes.filter("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.min("id").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    rarity, documents = levels(*_sketches(described)), nodes.count()

    prefix = written(_postings(rows, k, percent, rarity, documents), "prefixes")
    postings = prefix.select("node", "n", "need", F.explode("shingles").alias("shingle"))
    often = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = written(postings.join(often, "shingle"), "postings")
    few = shared.filter(F.col("often") <= PAIRED)
    other = few.select("shingle", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("need").alias("need2"))
    met = few.join(other, "shingle").filter(
        (F.col("node") < F.col("node2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")))
    candidates = met.withColumn("enough", enough(percent)).groupBy("node", "node2").agg(F.count(F.lit(1)).alias("met"), F.first("enough").alias("enough"))
    edges = candidates.filter("met >= enough").select(F.col("node").alias("a"), F.col("node2").alias("b"))
    # two kinds of groups; their names must not meet
    paired = components(edges).select(F.struct(F.lit(0).alias("kind"), F.col("root").alias("name")).alias("grp"), "node")
    many = shared.filter(F.col("often") > PAIRED).select("shingle", "node")
    dense = many.join(many.groupBy("shingle").agg(F.min("node").alias("head")), "shingle").select(
        F.struct(F.lit(1).alias("kind"), F.col("head").alias("name")).alias("grp"), "node").distinct()
    groups = written(paired.unionByName(dense).join(whole.select("node", "n"), "node"), "groups")
    sets = _sets(rows, groups.select("node").distinct().join(whole, "node").select("node", "key"), k, filter_bits)
    if count_links:
        links = written(_links(groups, sets.join(whole.select("node", "copies"), "node"), percent, True), "links")
        others = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
        whole = whole.join(others, "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
        linked = components(links.filter("b IS NOT NULL").select("a", "b"))
    else:
        linked = components(_links(groups, sets, percent, False).select("a", "b"))

    rooted = whole.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    counts = ["n_links"] if count_links else []
    found = rooted.join(least, "root").select("node", "component_id", *counts)
    return nodes.join(found.withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & (F.col("n") > 0), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("node").alias("set_id"), F.col("key").alias("text_key"),
        *[F.coalesce(x, F.lit(0)).alias(x) for x in counts])
