"""Written intermediate tables in the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgloom.session import checkpoint_root


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` below the folder named by ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: later steps reread files that every executor sees, so a
    lost executor costs the reading of some files and not the work before them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bit_table(df: DataFrame, hash_col: str, bits: int) -> list[tuple[int, int]]:
    """A table of ``bits`` bits (a power of two) with the slots of all hashes set, as (64-bit word, value) pairs.

    Its size is fixed by ``bits``, however many rows there are; with many rows it only
    lets more others pass. Bits are gathered before the shuffle.
    """
    slot = F.col(hash_col).bitwiseAND(F.lit(bits - 1))
    word = F.shiftright(slot, 6).alias("word")
    one = F.expr(f"shiftleft(1L, cast({hash_col} & 63 AS int))")
    rows = df.filter(F.col(hash_col).isNotNull()).groupBy(word).agg(F.bit_or(one).alias("value")).collect()
    return [(r.word, r.value) for r in rows]


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 1 << 23) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (doc_id, text_key, kept) keep, with the columns of ``docs``.

    Rows are named by identifier and text hash. A table of ``bits`` bits, of fixed size, tells
    which rows surely stay; only the others, about as many as are dropped, are shuffled
    with their texts. Of rows with one name as many stay as there are verdicts to keep; rows without a verdict stay.
    """
    named = verdicts.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("kept").cast("long").alias("kept"))
    doubtful = written(named.groupBy("id", "key").agg(F.sum("kept").alias("stay"), F.count(F.lit(1)).alias("n")).filter("stay < n"), "verdicts")
    slot = F.xxhash64("id", "key").bitwiseAND(F.lit(bits - 1))
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    table = doubtful.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(
        F.bit_or("bit").alias("value"))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"))
    # at most bits / 64 rows
    marked = rows.withColumn("word", word).join(F.broadcast(table), "word", "left")
    sure = F.coalesce(F.call_function("shiftright", F.col("value"), bit).bitwiseAND(F.lit(1)) == 0, F.lit(True))
    turn = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0)))
    asked = doubtful.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "stay")
    doubted = marked.filter(~sure).withColumn("turn", turn).join(
        asked, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left").filter("stay IS NULL OR turn <= stay")
    return marked.filter(sure).select("row.*").unionByName(doubted.select("row.*"))


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow; its freed memory goes back to the system at the end of a task, as Python workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass

    return run
