"""Labelled rows for fitting: the held-out rule and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_REST = 2


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its identifier as text, modulo 4, is 2. A null identifier is."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == HELD_OUT_REST, F.lit(True))


def fitting_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label, turn): one row per identifier that may be learnt from. Null labels and identifiers are left out; of several labels the largest counts.
    turn is a hash of the identifier that orders and splits rows."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    rows = rows.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    return rows.withColumn("turn", F.xxhash64(F.lit("turn"), "id"))
