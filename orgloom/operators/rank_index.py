"""Pages by number of a stored order: any page costs what the first one costs.

The rows are dealt to ranges of the order by sampled splitters and written sorted, one folder per range; the exact number of rows
before each range stands beside them. A page lies in one range or a few neighbouring ones, and only their files are read. Splitters decide how
even the ranges are, never which rows a page has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

Order = Sequence[tuple[str, bool]]


def _sorted_by(order: Order) -> list[Column]:
    """Nulls come first in either direction."""
    return [F.desc_nulls_first(c) if descending else F.asc_nulls_first(c) for c, descending in order]


def create_rank_index(df: DataFrame, folder: str, order: Order, rows_per_range: int = 200_000) -> None:
    """Store ``df`` in an order of (column, descending), whose columns are together unique. An index is replaced by writing it to another folder.

    A group of rows with equal leading columns is split like any other, as ranges are cut by all columns of the order.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows_per_range))
    data = f"{folder}/rows-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(parts, *_sorted_by(order)).withColumn("__part", F.spark_partition_id())
    ranged.sortWithinPartitions("__part", *_sorted_by(order)).write.partitionBy("__part").parquet(data)
    stored = StructType([*df.schema.fields, StructField("__part", IntegerType())])
    counts = spark.read.schema(stored).parquet(data).groupBy("__part").agg(F.count("*").alias("n"))
    # one row per range
    before = (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before")
    plain = ",".join(f"{c} {'desc' if d else 'asc'}" for c, d in order)
    told = counts.select("__part", "n", before, F.lit(data.rsplit("/", 1)[1]).alias("rows"), F.lit(plain).alias("order"), F.lit(df.schema.json()).alias("schema"))
    told.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranges")


def ranked_page(spark: SparkSession, folder: str, number: int, size: int) -> DataFrame:
    """Page ``number``, from 1, of ``size`` rows, in order; empty behind the last one."""
    if number < 1 or size < 1:
        raise ValueError("pages are numbered from 1 and hold at least one row")
    first = (number - 1) * size
    ranges = spark.read.parquet(f"{folder}/ranges")
    hit = ranges.filter((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).orderBy("__part").collect()  # of one page
    if not hit:
        some = ranges.select("schema").first()
        return spark.createDataFrame([], _schema(some.schema)) if some else spark.createDataFrame([], "empty int")
    order = [tuple(x.rsplit(" ", 1)) for x in hit[0].order.split(",")]
    rows = spark.read.schema(_schema(hit[0].schema)).parquet(*[f"{folder}/{r.rows}/__part={r['__part']}" for r in hit])
    return rows.orderBy(*_sorted_by([(c, d == "desc") for c, d in order])).offset(first - hit[0].before).limit(size)


def _schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


def ranked_total(spark: SparkSession, folder: str) -> int:
    """Rows of the index."""
    return spark.read.parquet(f"{folder}/ranges").select(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
