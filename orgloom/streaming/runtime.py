"""Sources and the restartable table sink shared by the streaming jobs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from orgloom.operators.ranking import first_per_key
from orgloom.session import checkpoint_root
from orgloom.sources.tables import VIEWS


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, whether it is a folder of files or one file."""
    schema = spark.read.parquet(path).schema
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path)
    if status.isFile():
        folder, name = path.rsplit("/", 1)
        return file_stream(spark, folder, schema, name, files_per_batch)
    return file_stream(spark, path, schema, None, files_per_batch)


def stream_view(events: DataFrame, name: str) -> DataFrame:
    """A derived view (metrics, health, results) over an event stream."""
    sql = VIEWS[name].replace("FROM events", "FROM {events}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    return events.sparkSession.sql(sql, events=events)


def new_root(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def run(stream: DataFrame, root: str, mode: str, each: Callable[[DataFrame, int], None]) -> object:
    """Process what is available batch by batch; progress lives in ``root``/progress."""
    handle = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True).foreachBatch(each).start())
    handle.awaitTermination()
    return handle


def start_table(spark: SparkSession, folder: str, schema: StructType | str) -> None:
    """An empty batch -1, so that readers find a table before anything arrives."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/batch_id=-1")


def run_to_table(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Write every batch to its own partition of ``root``/out.

    A batch that is retried after a failure overwrites its partition, so the
    table holds each batch once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    start_table(stream.sparkSession, f"{root}/out", stream.schema)
    run(stream, root, mode, write)
    return stream.sparkSession.read.schema(StructType(stream.schema.fields).add("batch_id", "long")).parquet(f"{root}/out")


def latest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest version of each row of an update-mode table."""
    return first_per_key(table, keys, [F.desc("batch_id")]).drop("batch_id")


def last_batch(table: DataFrame) -> DataFrame:
    """The newest complete-mode result."""
    newest = table.select(F.max("batch_id")).scalar()
    return table.filter(F.col("batch_id") == newest).drop("batch_id")


def _entries(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []


def batches(spark: SparkSession, folder: str) -> list[int]:
    """The batches of a table that are written whole."""
    names = [e for e in _entries(spark, folder) if e.startswith("batch_id=")]
    return sorted(int(e[9:]) for e in names if "_SUCCESS" in _entries(spark, f"{folder}/{e}"))


class Runs:
    """The batches of ``root``/out, merged level by level as they come.

    ``fan_out`` runs of one level become one of the next; a batch is a run of level 0. Which runs count is told by the newest manifest in
    ``root``/manifest, written after the files it names, so a reader sees a merge as a whole or not at all, and a merge that
    failed or is repeated changes nothing. Readers find fewer than ``fan_out`` runs of each level: their number grows with the logarithm of the
    batches. Files of merged runs stay for readers that still use them.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, fan_out: int):
        if fan_out < 2:
            raise ValueError("fan_out must be at least 2")
        self.spark, self.root, self.schema, self.fan_out = spark, root, schema, fan_out

    def _newest(self) -> tuple[int, list[dict]]:
        folder = f"{self.root}/manifest"
        numbers = [int(e[2:]) for e in _entries(self.spark, folder) if e.startswith("n=") and "_SUCCESS" in _entries(self.spark, f"{folder}/{e}")]
        if not numbers:
            return -1, []
        return max(numbers), json.loads(self.spark.read.text(f"{folder}/n={max(numbers)}", wholetext=True).first().value)

    def runs(self) -> list[dict]:
        """level, first and last batch, and folder of each run, oldest first."""
        merged = self._newest()[1]
        last = max((r["last"] for r in merged), default=-2)
        fresh = [{"level": 0, "first": b, "last": b, "path": f"out/batch_id={b}"} for b in batches(self.spark, f"{self.root}/out") if b > last]
        return sorted([*merged, *fresh], key=lambda r: r["first"])

    def merge(self, merged: Callable[[DataFrame], DataFrame], upto: int) -> None:
        """Merge while a level holds ``fan_out`` runs of batches up to ``upto``. ``merged`` unites rows of any runs, whatever was united before."""
        while True:
            number, _ = self._newest()
            every = [r for r in self.runs() if r["last"] <= upto]
            levels: dict[int, list[dict]] = {}
            for r in every:
                levels.setdefault(r["level"], []).append(r)
            full = next((some for _, some in sorted(levels.items()) if len(some) >= self.fan_out), None)
            if full is None:
                return
            path = f"runs/{uuid.uuid4().hex}"
            merged(self._rows(full)).write.parquet(f"{self.root}/{path}")
            new = {"level": full[0]["level"] + 1, "first": full[0]["first"], "last": full[-1]["last"], "path": path}
            told = [r for r in every if r["level"] > 0 and r not in full] + [new]
            # batches between merged runs stay runs of their own
            told += [r for r in every if r["level"] == 0 and r not in full and r["last"] < new["last"]]
            line = self.spark.createDataFrame([(json.dumps(sorted(told, key=lambda r: r["first"])),)], "value string")
            line.coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/n={number + 1}")

    def _rows(self, runs: Sequence[dict]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{r['path']}" for r in runs])

    def read(self) -> DataFrame:
        """The rows of all runs."""
        runs = self.runs()
        return self._rows(runs) if runs else self.spark.createDataFrame([], self.schema)
