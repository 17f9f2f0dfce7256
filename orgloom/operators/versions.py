"""A table in versions: updates rewrite the buckets that hold changed keys, and stored aggregate views follow by signed changes.

A folder holds::

    rows/version=3/bucket=7     the rows of a bucket as version 3 wrote them
    views/coverage/version=3    what version 3 changed in a view: additive counts of the new rows less those of the old ones
    manifest/n=5.json           which version holds each bucket, which runs make up each view, and the last batch that went in

Writers add files and then one manifest, so a reader sees a change of rows and views as a whole or not at all; a failed write leaves the old
version, and its files count nowhere. A batch that comes again changes nothing. Two writers can't both publish the same number where the store
renames atomically without overwriting (HDFS); elsewhere let one writer at a time in. Files of replaced buckets stay for readers that still use them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from orgloom.operators.text_index import _entries, _fs

Change = Callable[[DataFrame, DataFrame], DataFrame]
MERGED_RUNS = 16  # runs of a view before they are summed into one


class View:
    """Additive counts by ``keys``: ``counts`` maps names to boolean or numeric columns that are summed over the rows that pass ``where``."""

    def __init__(self, keys: Sequence[str], counts: Mapping[str, Column], where: Column | None = None):
        self.keys, self.counts, self.where = list(keys), dict(counts), where

    def _values(self, rows: DataFrame, sign: int) -> DataFrame:
        kept = rows if self.where is None else rows.filter(self.where)
        return kept.select(*self.keys, *[(F.coalesce(v.cast("long"), F.lit(0)) * sign).alias(n) for n, v in self.counts.items()], F.lit(sign).cast("long").alias("n_rows"))

    def summed(self, values: DataFrame) -> DataFrame:
        names = [*self.counts, "n_rows"]
        sums = values.groupBy(*self.keys).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
        return sums.filter(reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names])) if self.keys else sums

    def of(self, rows: DataFrame) -> DataFrame:
        """The view counted anew."""
        return self.summed(self._values(rows, 1))

    def change(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return self.summed(self._values(old, -1).unionByName(self._values(new, 1)))


class VersionedTable:
    """Rows with a unique ``key`` in ``folder``; see the module for its layout."""

    def __init__(self, spark: SparkSession, folder: str, views: Mapping[str, View] | None = None):
        self.spark, self.folder, self.views = spark, folder.rstrip("/"), dict(views or {})

    # -- manifests

    def _newest(self) -> dict | None:
        numbers = [int(e[2:-5]) for e in _entries(self.spark, f"{self.folder}/manifest") if e.startswith("n=") and e.endswith(".json")]
        if not numbers:
            return None
        text = self.spark.read.text(f"{self.folder}/manifest/n={max(numbers)}.json", wholetext=True).first().value
        return {"n": max(numbers), **json.loads(text)}

    def _told(self) -> dict:
        told = self._newest()
        if told is None:
            raise ValueError(f"no table in {self.folder}")
        return told

    def _publish(self, n: int, told: dict) -> None:
        store, goal = _fs(self.spark, f"{self.folder}/manifest/n={n}.json")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        draft = path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        store.mkdirs(goal.getParent())
        out = store.create(draft, False)
        out.write(bytearray(json.dumps({k: v for k, v in told.items() if k != "n"}).encode()))
        out.close()
        if store.exists(goal) or not store.rename(draft, goal):
            raise RuntimeError(f"another writer has published change {n} of {self.folder}; read the table again and repeat the change")

    # -- rows

    def _bucket(self, told: dict) -> Column:
        return F.pmod(F.xxhash64(told["key"]), F.lit(told["buckets"])).cast("int")

    def _write(self, rows: DataFrame, told: dict, version: str) -> list[int]:
        """Writes whole buckets; returns those that hold rows."""
        path = f"{self.folder}/rows/version={version}"
        rows.withColumn("__bucket", self._bucket(told)).repartition("__bucket").write.partitionBy("__bucket").parquet(path)
        return [int(e.split("=")[1]) for e in _entries(self.spark, path) if e.startswith("__bucket=")]

    def _read(self, told: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(told["schema"])
        wanted = told["rows"] if buckets is None else {str(b): told["rows"][str(b)] for b in buckets if str(b) in told["rows"]}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/rows/version={v}/__bucket={b}" for b, v in sorted(wanted.items(), key=lambda x: int(x[0]))]
        return self.spark.read.schema(schema).parquet(*paths)

    def _view_path(self, name: str, run: str) -> str:
        return f"{self.folder}/views/{name}/version={run}"

    def create(self, rows: DataFrame, key: str, buckets: int) -> None:
        """The first version. ``buckets`` grows with the table (some 100 MB each); ``key`` is unique and not null."""
        if buckets < 1:
            raise ValueError("buckets must be at least 1")
        if self._newest() is not None:
            raise ValueError(f"a table is in {self.folder} already")
        version = uuid.uuid4().hex
        told = {"key": key, "buckets": buckets, "schema": json.loads(rows.schema.json()), "batch": None}
        told["rows"] = {str(b): version for b in self._write(rows, told, version)}
        told["views"] = {}
        for name, view in self.views.items():
            view.of(self._read(told)).write.parquet(self._view_path(name, version))
            told["views"][name] = [version]
        self._publish(0, told)

    def read(self) -> DataFrame:
        """The rows as of the newest manifest."""
        return self._read(self._told())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows with one of the ``keys`` (a column named like the key), from their buckets only."""
        told = self._told()
        wanted = keys.select(told["key"]).distinct()
        return self._read(told, self._touched(wanted, told)).join(wanted, told["key"], "left_semi")

    def _touched(self, keys: DataFrame, told: dict) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(told).alias("b")).distinct().collect())  # at most the number of buckets

    def update(self, changes: DataFrame, change: Change, batch: int | None = None) -> dict:
        """New rows of the keys in ``changes`` by ``change(rows, changes)``; returns buckets and rows rewritten.

        ``changes`` holds the key, not null. ``change`` gets the stored rows of these keys (not of others) and the changes, and returns the rows that
        stand for them: a key left out goes, a new key comes. The upserts and patches of ``operators.updates`` fit as they are.
        ``batch`` numbers the change, as a stream does; a number up to the last one that is in does nothing.
        """
        told = self._told()
        if batch is not None and told["batch"] is not None and batch <= told["batch"]:
            return {"buckets": 0, "rows": 0}
        key, version = told["key"], uuid.uuid4().hex
        changes = self._kept(changes, version, "changes")
        keys = changes.select(key).distinct()
        buckets = self._touched(keys, told)
        if not buckets:
            return {"buckets": 0, "rows": 0}
        stored = self._read(told, buckets)
        old = self._kept(stored.join(keys, key, "left_semi"), version, "old")
        new = self._kept(change(old, changes).select(*stored.columns), version, "new")
        self._check(new, keys, key)
        whole = stored.join(keys, key, "left_anti").unionByName(new)
        written = self._write(whole, told, version)
        rows = {b: v for b, v in told["rows"].items() if int(b) not in buckets} | {str(b): version for b in written}
        views = {}
        for name, runs in told["views"].items():
            if name not in self.views:
                raise ValueError(f"view {name} is stored but its definition was not given")
            view = self.views[name]
            view.change(old, new).write.parquet(self._view_path(name, version))
            views[name] = [*runs, version]
            if len(views[name]) > MERGED_RUNS:
                one = uuid.uuid4().hex
                view.summed(self._runs(name, views[name])).write.parquet(self._view_path(name, one))
                views[name] = [one]
        self._publish(told["n"] + 1, told | {"rows": rows, "views": views, "batch": told["batch"] if batch is None else batch})
        return {"buckets": len(buckets), "rows": new.count()}

    def _check(self, new: DataFrame, keys: DataFrame, key: str) -> None:
        wrong = new.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(keys.withColumn("__known", F.lit(True)), key, "left")
        if not wrong.filter(f"n > 1 OR __known IS NULL OR `{key}` IS NULL").isEmpty():
            raise ValueError("a change must return each of its keys at most once, and no other key")

    def _kept(self, rows: DataFrame, version: str, name: str) -> DataFrame:
        """Rows written once, so that files and views come from the same evaluation."""
        path = f"{self.folder}/changes/{version}/{name}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # -- views

    def _runs(self, name: str, runs: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*[self._view_path(name, r) for r in runs])

    def view(self, name: str) -> DataFrame:
        """The counts of a view as of the newest manifest; groups without rows are left out."""
        told = self._told()
        if name not in told["views"] or name not in self.views:
            raise ValueError(f"no view {name}")
        return self.views[name].summed(self._runs(name, told["views"][name]))
