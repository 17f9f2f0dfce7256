"""A stored trigram index: substring search that reads what a term's trigrams point to, not the table.

A folder holds versions, each with its rows and its postings::

    rows/version=0/bucket=7      rows by a hash of their identifier; later versions hold changed rows and, marked, deleted ones
    grams/version=0/slot=3       (gram, bucket, n, ids): per trigram and bucket the identifiers, sorted; dealt to slots by a hash of the trigram
    manifest/n=5                 the versions that count, first the base; the newest manifest is the truth

A posting is a block of one bucket, so a trigram of every row is many bounded blocks. Postings only propose rows: the condition itself is
evaluated on them. Writers add files and then a manifest, so readers see a change as a whole or not at all, and a failed write changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 3


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    store, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []


def _manifest(spark: SparkSession, folder: str) -> dict:
    numbers = [int(e[2:]) for e in _entries(spark, f"{folder}/manifest") if e.startswith("n=") and "_SUCCESS" in _entries(spark, f"{folder}/manifest/{e}")]
    if not numbers:
        raise ValueError(f"no index in {folder}")
    return {"n": max(numbers), **spark.read.json(f"{folder}/manifest/n={max(numbers)}").first().asDict(recursive=True)}


def _publish(spark: SparkSession, folder: str, n: int, told: dict) -> None:
    names = ("versions", "id", "columns", "buckets", "slots", "schema")
    row = spark.createDataFrame([tuple(told[k] for k in names)], "versions array<string>, id string, columns array<string>, buckets int, slots int, schema string")
    row.coalesce(1).write.json(f"{folder}/manifest/n={n}")


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    places = F.when(F.length(low) >= N, F.sequence(F.lit(1), F.length(low) - (N - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(N))))


def _write(rows: DataFrame, folder: str, told: dict, version: str) -> None:
    """One version: ``rows`` hold the index's columns and __deleted."""
    bucket = F.pmod(F.xxhash64(told["id"]), F.lit(told["buckets"])).cast("int")
    stored = rows.withColumn("bucket", bucket)
    stored.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/rows/version={version}")
    back = rows.sparkSession.read.schema(stored.schema).parquet(f"{folder}/rows/version={version}").filter(~F.col("__deleted"))
    every = reduce(lambda a, b: F.array_union(a, b), [grams(F.col(c)) for c in told["columns"]])
    exploded = back.select(F.col(told["id"]).alias("id"), "bucket", F.explode(every).alias("gram"))
    postings = exploded.groupBy("gram", "bucket").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    slot = F.pmod(F.xxhash64("gram"), F.lit(told["slots"])).cast("int")
    postings.select("gram", "bucket", F.size("ids").cast("long").alias("n"), "ids", slot.alias("slot")).repartition("slot").sortWithinPartitions(
        "slot", "gram", "bucket").write.partitionBy("slot").parquet(f"{folder}/grams/version={version}")


def create_index(rows: DataFrame, folder: str, id_col: str, columns: Sequence[str], buckets: int = 64, slots: int = 64) -> None:
    """Index ``columns`` of ``rows``, whose identifiers are unique and not null. Choose ``buckets`` so that one bucket's rows are a file or a few."""
    spark = rows.sparkSession
    told = {"versions": [uuid.uuid4().hex], "id": id_col, "columns": list(columns), "buckets": buckets, "slots": slots, "schema": rows.schema.json()}
    _write(rows.withColumn("__deleted", F.lit(False)), folder, told, told["versions"][0])
    _publish(spark, folder, 0, told)


def update_index(spark: SparkSession, folder: str, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
    """Add a version with new or changed rows, and the identifiers in the first column of ``deleted``. A row both changed and deleted is deleted."""
    told = _manifest(spark, folder)
    n = told.pop("n")
    schema = _schema(told)
    parts = []
    if changed is not None:
        kept = changed.select(*schema.names)
        if deleted is not None:
            kept = kept.join(deleted.select(F.col(deleted.columns[0]).alias(told["id"])).distinct(), told["id"], "left_anti")
        parts.append(kept.select(*schema.names, F.lit(False).alias("__deleted")))
    if deleted is not None:
        kind = schema[told["id"]].dataType
        gone = deleted.select(F.col(deleted.columns[0]).cast(kind).alias(told["id"])).distinct()
        parts.append(gone.select(*[F.col(f.name) if f.name == told["id"] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], F.lit(True).alias("__deleted")))
    if not parts:
        return
    version = uuid.uuid4().hex
    _write(reduce(DataFrame.unionByName, parts), folder, told, version)
    _publish(spark, folder, n + 1, {**told, "versions": [*told["versions"], version]})


def compact_index(spark: SparkSession, folder: str) -> None:
    """Make one base of all versions; files of earlier ones stay for readers that still use them."""
    told = _manifest(spark, folder)
    n = told.pop("n")
    version = uuid.uuid4().hex
    _write(current_rows(spark, folder).withColumn("__deleted", F.lit(False)), folder, told, version)
    _publish(spark, folder, n + 1, {**told, "versions": [version]})


def _schema(told: dict):
    import json

    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(told["schema"]))


def _rows(spark: SparkSession, folder: str, told: dict, buckets: Sequence[int] | None, first: int = 0) -> DataFrame:
    """Rows of the versions from number ``first`` on with __version (its number) and bucket; only files of ``buckets``."""
    out = None
    schema = _schema(told).add("__deleted", "boolean").add("bucket", "integer")
    for number, version in list(enumerate(told["versions"]))[first:]:
        base = f"{folder}/rows/version={version}"
        have = {e for e in _entries(spark, base) if e.startswith("bucket=")}
        wanted = sorted(have if buckets is None else have & {f"bucket={b}" for b in buckets})
        if wanted:
            part = spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{w}" for w in wanted]).withColumn("__version", F.lit(number))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema.add("__version", "integer"))


def _newest(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Without rows that a later version replaced, and without deleted ones."""
    later = changes.select(F.col(key).alias("__key"), F.col("__version").alias("__later"))
    return rows.join(later, (F.col(key) == F.col("__key")) & (F.col("__version") < F.col("__later")), "left_anti").filter(~F.col("__deleted"))


def current_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table as it is now."""
    told = _manifest(spark, folder)
    every = _rows(spark, folder, told, None)
    return _newest(every, _rows(spark, folder, told, None, 1), told["id"]).select(*_schema(told).names)


def _parts(term: str, wildcards: bool) -> list[str]:
    """Literal stretches of a term."""
    if not wildcards:
        return [term]
    return [p for p in term.replace("_", "%").replace("\\", "%").split("%") if p]


def search(spark: SparkSession, folder: str, term: str, columns: Sequence[str] | None = None, wildcards: bool = True, most: int = 4) -> DataFrame:
    """Current rows of which one of ``columns`` (default: all indexed ones) holds ``term``.

    ``wildcards``: in any case, '%' and '_' act as in LIKE (the rows of ``ilike('%term%')``); else exactly as written. Postings of
    the term's ``most`` rarest trigrams are intersected, shortest first, bucket by bucket; then only files of buckets with
    candidates are read and the condition is evaluated. A term without three literal characters in a row reads the whole table.
    """
    told = _manifest(spark, folder)
    key, names = told["id"], list(columns or told["columns"])
    unknown = set(names) - set(told["columns"])
    if unknown:
        raise ValueError(f"not indexed: {sorted(unknown)}")
    holds = reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{term}%") if wildcards else F.col(c).contains(term) for c in names])
    found = candidates(spark, folder, told, term, wildcards, most)
    if found is None:
        return current_rows(spark, folder).filter(holds)
    buckets = [r.bucket for r in found.select("bucket").distinct().collect()]  # at most the number of buckets
    rows = _rows(spark, folder, told, buckets)
    asked = found.select(F.col("id").alias("__asked"), F.col("version").alias("__at"))
    proposed = rows.join(asked, (F.col(key) == F.col("__asked")) & (F.col("__version") == F.col("__at")), "left_semi").filter(holds)
    return _newest(proposed, _rows(spark, folder, told, buckets, 1), key).select(*_schema(told).names)


def candidates(spark: SparkSession, folder: str, told: dict, term: str, wildcards: bool, most: int) -> DataFrame | None:
    """(version, bucket, id) of rows that hold the term's rarest trigrams; None where it has none."""
    # Spark's lower, as for the texts
    low = [spark.range(1).select(F.lower(F.lit(p))).first()[0] for p in _parts(term, wildcards)]
    wanted = sorted({p[i:i + N] for p in low for i in range(len(p) - N + 1)})
    if not wanted:
        return None
    postings = None
    slots = sorted({r.s for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(F.pmod(F.xxhash64("g"), F.lit(told["slots"])).alias("s")).collect()})
    for number, version in enumerate(told["versions"]):
        base = f"{folder}/grams/version={version}"
        have = set(_entries(spark, base))
        paths = [f"{base}/slot={s}" for s in slots if f"slot={s}" in have]
        if paths:
            part = spark.read.parquet(*paths).filter(F.col("gram").isin(wanted)).withColumn("version", F.lit(number))
            postings = part if postings is None else postings.unionByName(part)
    if postings is None:
        return spark.createDataFrame([], f"version int, bucket int, id {_schema(told)[told['id']].dataType.simpleString()}")
    totals = {r.gram: r.n for r in postings.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # one row per trigram of the term
    rarest = sorted(wanted, key=lambda g: totals.get(g, 0))[:most]
    blocks = postings.filter(F.col("gram").isin(rarest)).groupBy("version", "bucket").agg(F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("b"))
    lists = F.transform("b", lambda x: x["ids"])
    both = F.aggregate(F.slice(lists, F.lit(2), F.size(lists)), lists[0], lambda a, x: F.array_intersect(a, x))
    return blocks.filter(F.size("b") == len(rarest)).select("version", "bucket", F.explode(both).alias("id"))
