"""Packing of tokenised documents into sequences of bounded length.

How pieces are placed depends only on how many there are of each length, and there
are no more lengths than tokens in a sequence. So the plan is made from that small
histogram: large lengths are split into groups of equal cardinality and rounded up to
their group's largest, few-size configurations are chosen for the rounded sizes, the
actual pieces are substituted, and the small ones go best-fit into the gaps. The plan says
for each length which ranks go to which sequences; Spark numbers the pieces of each
length and looks their places up.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgloom.llm.storage import tidy, written
from orgloom.llm.tokens import text_ids

Runs = list[tuple[int, int, int]]  # (length, first rank, number of pieces)

def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, part, serial): every document's ids and ``end_id``, cut only where longer than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = text_ids(vocabulary, spaced=False)
        context = TaskContext.get()
        part, serial = context.partitionId() if context else 0, 0
        for batch in batches:
            for i, j, at, ids in tokens.batches(batch["text"]):
                # one end id behind each text
                at = at + np.arange(j - i + 1)
                raw = np.full(int(at[-1]), end_id, "<u4")
                inner = np.ones(len(raw), bool)
                inner[at[1:] - 1] = False
                raw[inner] = ids
                count = -(-np.diff(at) // capacity)
                n = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
                lo = at[n] + piece * capacity
                hi = np.minimum(lo + capacity, at[n + 1])
                view = memoryview(raw).cast("B")
                cuts = [view[4 * x:4 * y] for x, y in zip(lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(pa.array(n + i)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(hi - lo),
                     pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array([bytes(c) for c in cuts] if keep_ids else [None] * len(n), pa.binary()),
                     pa.array(np.full(len(n), part), pa.int32()), pa.array(np.arange(serial, serial + len(n)))],
                    ["id", "piece", "start", "length", "ids_crc32", "ids", "part", "serial"])
                serial += len(n)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(cut), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part int, serial bigint")


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Uses of each size (descending) in one sequence: the largest size left, and what fills it best."""
    first = next(i for i, n in enumerate(left) if n)
    uses = [0] * len(sizes)
    uses[first] = 1
    room = capacity - sizes[first]
    whole = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i in range(first, len(sizes)):
        before = reach
        n = min(left[i] - (i == first), room // sizes[i])
        shift = 1
        while n > 0:  # binary parts of the count
            k = min(shift, n)
            reach |= (reach << (k * sizes[i])) & whole
            n -= k
            shift *= 2
        steps.append((i, before))
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    for i, before in reversed(steps):
        while not before >> fill & 1:
            uses[i] += 1
            fill -= sizes[i]
    return uses


def _take(runs: Runs, n: int) -> Runs:
    """Remove n pieces from the front of ``runs``."""
    out: Runs = []
    while n:
        length, rank, have = runs[0]
        k = min(n, have)
        out.append((length, rank, k))
        n -= k
        if k == have:
            runs.pop(0)
        else:
            runs[0] = (length, rank + k, have - k)
    return out


def packing_plan(histogram: dict[int, int], capacity: int, groups: int = 256) -> np.ndarray:
    """The plan with the fewest sequences among those with small lengths up to an eighth, a quarter or half of the capacity."""
    plans = [_plan(histogram, capacity, groups, capacity // part) for part in (8, 4, 2)]
    return min(plans, key=lambda p: (p[:, 3] + p[:, 2]).max(initial=0))


def _plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset): pieces ``first rank + i`` of that
    length go to ``first sequence + i`` at ``offset``. Lengths up to ``small`` are filled in last."""
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number)
    sequences = 0
    large: Runs = [(n, 0, c) for n, c in sorted(histogram.items(), reverse=True) if n > small]
    total = sum(c for _, _, c in large)
    # groups of equal cardinality, each as large as its largest
    queues: dict[int, Runs] = {}
    step = -(-total // groups) if total else 1
    while total > 0:
        run = _take(large, min(step, total))
        total -= sum(c for _, _, c in run)
        queues.setdefault(run[0][0], []).extend(run)
    sizes = sorted(queues, reverse=True)
    left = [sum(c for _, _, c in queues[s]) for s in sizes]
    while any(left):
        uses = _configuration(sizes, left, capacity)
        times = min(n // u for n, u in zip(left, uses) if u)
        slots = [_take(queues[sizes[i]], times) for i, u in enumerate(uses) for _ in range(u)]
        left = [n - times * u for n, u in zip(left, uses)]
        # sequences with the same lengths in all slots form one stretch
        at = 0
        while at < times:
            n = min(s[0][2] for s in slots)
            offset = 0
            for s in slots:
                (length, rank, _), = _take(s, n)
                plan.append((length, rank, n, sequences + at, offset))
                offset += length
            gaps.setdefault(capacity - offset, []).append((sequences + at, n))
            at += n
        sequences += times
    rooms = sorted(gaps)
    for length in sorted((n for n in histogram if n <= small), reverse=True):
        rank, count = 0, histogram[length]
        while count:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                fresh = -(-count // (capacity // length))
                bisect.insort(rooms, capacity)
                gaps[capacity] = [(sequences, fresh)]
                sequences += fresh
                continue
            room = rooms[i]
            first, have = gaps[room].pop()
            k = min(count, have)
            plan.append((length, rank, k, first, capacity - room))
            if k < have:
                gaps[room].append((first + k, have - k))
            if not gaps[room]:
                del gaps[room]
                rooms.pop(i)
            if room - length not in gaps:
                gaps[room - length] = []
                bisect.insort(rooms, room - length)
            gaps[room - length].append((first, k))
            rank, count = rank + k, count - k
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False, groups: int = 256,
) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's ids (by the tokenizers file ``vocabulary``) and ``end_id`` form one
    piece, or pieces of ``capacity`` where there are more. Pieces fill sequences of
    at most ``capacity`` without gaps between them. ids_crc32 is taken over the
    ids as little-endian 32-bit numbers; ``keep_ids`` adds those bytes.

    A null text is empty and gives one piece with ``end_id`` alone; null and repeated identifiers
    stay as they are, row by row; an empty table gives no rows; other columns are ignored.
    """
    pieces = written(tokenised_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = packing_plan(histogram, capacity, groups)
    before = counted.select(
        "part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    turn = F.row_number().over(Window.partitionBy("part", "length").orderBy("serial")) - 1
    ranked = pieces.withColumn("turn", turn).join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("turn"))
    keys = (plan[:, 0] << 45) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = plan[np.searchsorted(keys, (length << 45) + rank, "right") - 1]
            named = {n: batch[n] for n in ("id", "piece", "start", "length", "ids_crc32")}
            named |= {"sequence_id": pa.array(row[:, 3] + rank - row[:, 1]), "offset": pa.array(row[:, 4])}
            named |= {"ids": batch["ids"]} if keep_ids else {}
            yield pa.RecordBatch.from_pydict(named)

    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    columns = ["id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if keep_ids else [])]
    return ranked.select(*columns).mapInArrow(tidy(place), schema + (", ids binary" if keep_ids else "")).withColumnRenamed("id", id_col)
