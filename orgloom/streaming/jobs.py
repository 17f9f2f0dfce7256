"""The streaming jobs. Each takes a stream and gives a stream (or a table)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from orgloom.functions import fixed_values as V
from orgloom.functions import scoring as S
from orgloom.functions.blank import percent
from orgloom.operators import alerts as AL
from orgloom.operators.ranking import first_per_key

from .runtime import Runs, batches, run, start_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watermarked(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Event time must be an instant: zone-free times are read in the session zone (UTC)."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def _plain(instant: str) -> Column:
    return F.col(instant).cast("timestamp_ntz")


def progress_deltas(results: DataFrame, root: str, delay: str = "1 hour", fan_out: int = 8) -> DataFrame:
    """Append each batch's newest completed result per organization to a delta table, whose batches are merged in runs of ``fan_out``.

    Repeated event ids within the watermark are dropped. The organization table
    itself is not rewritten per batch: readers lay the newest delta over it.
    """
    done = watermarked(results, "ts", delay).dropDuplicatesWithinWatermark(["event_id"]).filter("status = 'COMPLETED'")

    def write(batch: DataFrame, batch_id: int) -> None:
        # one aggregate, so that the batch and its deduplication state are evaluated once
        row = F.struct("ts", "event_id", *[f for f in batch.columns if f not in ("ts", "event_id")])
        newest = batch.withColumn("ts", _plain("ts")).groupBy("organization_id").agg(F.max_by(row, F.struct("ts", "event_id")).alias("r"), F.count("*").alias("processed"))
        newest.select(*[F.col("r")[f].alias(f) for f in batch.columns], "processed").write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    schema = StructType(results.schema.fields).add("processed", "long")
    start_table(results.sparkSession, f"{root}/out", schema)
    runs = Runs(results.sparkSession, root, schema, fan_out)

    def merged(some: DataFrame) -> DataFrame:
        row = F.struct(*[f for f in schema.names if f != "processed"])
        newest = some.groupBy("organization_id").agg(F.max_by(row, F.struct("ts", "event_id")).alias("r"), F.sum("processed").alias("processed"))
        return newest.select(*[F.col("r")[f].alias(f) for f in schema.names if f != "processed"], "processed")

    def write_and_merge(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        runs.merge(merged, batch_id)

    run(done, root, "append", write_and_merge)
    return runs.read()


def current_organizations(orgs: DataFrame, deltas: DataFrame) -> DataFrame:
    """The stored rows with the newest delta laid over them."""
    newest = first_per_key(deltas, ["organization_id"], [F.desc("ts"), F.desc("event_id")]).select(
        F.col("organization_id").alias("id"), F.col("phone").alias("new_phone"), F.col("ts").alias("found_at"))
    total = deltas.groupBy(F.col("organization_id").alias("id")).agg(F.sum("processed").alias("processed_count"))
    return orgs.join(newest, "id", "left").join(total, "id", "left").select(
        "id", "name", F.coalesce("new_phone", "phone").alias("phone"), (F.col("ai_crawled") | F.col("found_at").isNotNull()).alias("ai_crawled"),
        F.coalesce("found_at", "last_crawled_at").alias("last_crawled_at"), F.coalesce("processed_count", F.lit(0)).alias("processed_count"))


def job_progress(results: DataFrame) -> DataFrame:
    g = results.groupBy("job_id").agg(
        F.count("*").alias("total_count"), F.count_if(F.col("status") == "COMPLETED").alias("processed_count"),
        F.count_if(F.col("status") == "FAILED").alias("failed_count"), F.count_if(F.col("status") == "PROCESSING").alias("open_count"))
    return g.select("job_id", "total_count", "processed_count", "failed_count",
                    percent(F.col("processed_count"), F.col("total_count"), 6).alias("progress_percentage"), (F.col("open_count") > 0).alias("is_running"))


def hourly_trend(metrics: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Closed hours only: success rate, mean duration and count."""
    return watermarked(metrics, "start_time", delay).groupBy(F.window("start_time", "1 hour")).agg(
        F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"), F.round(F.avg("duration"), 9).alias("avg_duration"),
        F.count("*").alias("task_count")).select(_plain("window.start").alias("hour"), "success_rate", "avg_duration", "task_count")


def recent_window(health: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Sliding means over 60 minutes every 5 minutes."""
    return watermarked(health, "ts", delay).groupBy(F.window("ts", "60 minutes", "5 minutes")).agg(
        F.round(F.avg("cpu_usage"), 9).alias("avg_cpu"), F.round(F.avg("memory_usage"), 9).alias("avg_memory"),
        F.round(F.avg("response_time"), 9).alias("avg_response"), F.count("*").alias("samples")
    ).select(_plain("window.start").alias("window_start"), "avg_cpu", "avg_memory", "avg_response", "samples")


def health_status(health: DataFrame) -> DataFrame:
    return health.select("event_id", "ts", S.health_status().alias("overall_status"))


def alert_batches(health: DataFrame, root: str, rules: Sequence[tuple[str, str, str, int]] = V.ALERT_RULES) -> DataFrame:
    """Alerts with cooldown, batch by batch.

    Each batch is solved in parallel time slices; only the last fire per rule
    (one row each) is carried to the next batch, beside the alerts on disk.
    """
    spark, fired = health.sparkSession, "rule string, severity string, us long"
    start_table(spark, f"{root}/out", fired)
    start_table(spark, f"{root}/last", AL.CARRIED)

    def write(batch: DataFrame, batch_id: int) -> None:
        carried = spark.read.schema(AL.CARRIED).parquet(f"{root}/last/batch_id={batch_id - 1}")
        out = f"{root}/out/batch_id={batch_id}"
        AL.alert_log(batch, rules, carried=carried).write.mode("overwrite").parquet(out)
        last = spark.read.schema(fired).parquet(out).select("rule", F.col("us").alias("last_us"))
        last.unionByName(carried).groupBy("rule").agg(F.max("last_us").alias("last_us")).write.mode("overwrite").parquet(f"{root}/last/batch_id={batch_id}")

    run(health, root, "append", write)
    return spark.read.schema(f"{fired}, batch_id long").parquet(f"{root}/out")


class Cooldown(StatefulProcessor):
    """Remembers per rule when it last fired (event time, microseconds)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last_fired", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        # only samples that met the rule arrive here; of each its time is held, eight bytes, as chunks come in no order of time
        times, rule, severity, cooldown = [], None, None, 0
        for hits in rows:
            if len(hits):
                rule, severity, cooldown = hits["rule"].iloc[0], hits["severity"].iloc[0], int(hits["cooldown_us"].iloc[0])
                times.append(hits["us"].to_numpy())
        times = np.unique(np.concatenate(times)) if times else np.empty(0, np.int64)
        last, fired = self._last.get()[0] if self._last.exists() else None, []
        while True:
            i = 0 if last is None else int(times.searchsorted(last + cooldown, side="left"))
            if i >= len(times):
                break
            last = int(times[i])
            fired.append(last)
        if fired:
            self._last.update((last,))
            yield pd.DataFrame({"rule": rule, "severity": severity, "us": fired})

    def close(self) -> None:
        pass


def alert_cooldown(health: DataFrame, rules: Sequence[tuple[str, str, str, int]] = V.ALERT_RULES) -> DataFrame:
    """Alerts as samples arrive, for low rates; needs the RocksDB state store.

    State is one time per rule, and a rule's samples of a batch meet in one task;
    ``alert_batches`` spreads them. Samples that meet no rule never reach Python.
    """
    hit = F.array_compact(F.array(*[
        F.when(F.expr(cond), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(minutes * 60 * AL.US).cast("long").alias("cooldown_us")))
        for name, cond, severity, minutes in rules]))
    hits = health.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.inline(hit))
    return hits.groupBy("rule").transformWithStateInPandas(
        statefulProcessor=Cooldown(), outputStructType="rule string, severity string, us long", outputMode="Append", timeMode="None")


def agent_stats(metrics: DataFrame) -> DataFrame:
    """Running counts and means per agent."""
    return metrics.groupBy("agent_name").agg(
        F.count("*").alias("total_tasks"), F.count_if("success").alias("successful_tasks"), F.count_if(~F.col("success")).alias("failed_tasks"),
        F.round(F.coalesce(F.avg(F.when(F.col("duration") > 0, F.col("duration"))), F.lit(0.0)), 6).alias("average_duration"),
        F.round(F.coalesce(F.avg(F.when(F.col("confidence_score") > 0, F.col("confidence_score"))), F.lit(0.0)), 6).alias("average_confidence"))


def rate_window(metrics: DataFrame, limit: int, delay: str = "5 minutes") -> DataFrame:
    """Requests per agent and minute against a limit."""
    return watermarked(metrics, "start_time", delay).groupBy(F.window("start_time", "1 minute"), "agent_name").agg(
        F.count("*").alias("requests")).select(_plain("window.start").alias("minute"), "agent_name", "requests", (F.col("requests") >= limit).alias("limited"))


def rate_limit_batches(calls: DataFrame, root: str, key: str = "agent_name", time: str = "start_time", seconds: int = 60) -> DataFrame:
    """(key, us, calls, batch_id) per rate window and batch; :func:`orgloom.operators.alerts.rate_limited` adds them up.

    Carried from batch to batch: the start of each caller's newest window. A call older than the window that was newest when
    its batch began belongs to no window and goes to ``root``/late.
    """
    spark, schema = calls.sparkSession, f"{key} string, us long, calls long"
    start_table(spark, f"{root}/out", schema)
    start_table(spark, f"{root}/last", AL.CARRIED)

    def write(batch: DataFrame, batch_id: int) -> None:
        carried = spark.read.schema(AL.CARRIED).parquet(f"{root}/last/batch_id={batch_id - 1}")
        told = batch.withColumn("__us", F.unix_micros(F.col(time).cast("timestamp"))).join(carried.select(F.col("rule").alias(key), "last_us"), key, "left")
        late = F.coalesce(F.col("__us") < F.col("last_us"), F.lit(False))
        told.filter(late).select(*batch.columns).write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
        fresh = told.filter(~late).select(*batch.columns)
        opened = f"{root}/starts/batch_id={batch_id}"
        AL.rate_limit_starts(fresh, key, time, seconds, carried).write.mode("overwrite").parquet(opened)
        starts = spark.read.schema("rule string, us long").parquet(opened).unionByName(carried.select("rule", F.col("last_us").alias("us")))
        AL.rate_limit_windows(fresh, starts, key, time, seconds).write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")
        starts.groupBy("rule").agg(F.max("us").alias("last_us")).write.mode("overwrite").parquet(f"{root}/last/batch_id={batch_id}")

    run(calls, root, "append", write)
    return spark.read.schema(f"{schema}, batch_id long").parquet(f"{root}/out")


_RUN = "job_id {}, first_us long, last_us long, total_count long, processed_count long, failed_count long, open_count long"


def job_runs(results: DataFrame, root: str, idle: int = 24 * 3600, delay: int = 3600) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Finished runs, open runs and late results of jobs; what is held does not grow with the jobs ever seen.

    A job's results with no gap of more than ``idle`` seconds are one run. A run is finished, and written once, when it ended more than
    ``idle`` before the watermark (the newest time seen, less ``delay`` seconds). Only open runs are carried to the next batch. A result that is so
    old that its run may be finished (more than ``idle`` before the watermark when its batch began) goes to the side table.

    Results are counted per (job, stretch of ``idle``) before the shuffle, so a job with a third of all results is a row per stretch and task.
    """
    spark, us, gap = results.sparkSession, AL.US, idle * AL.US
    held = _RUN.format(results.schema["job_id"].dataType.simpleString())
    start_table(spark, f"{root}/finished", held)
    start_table(spark, f"{root}/open", held)
    start_table(spark, f"{root}/seen", "top long")

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = spark.read.schema("top long, batch_id long").parquet(f"{root}/seen").filter(F.col("batch_id") < batch_id).select(F.max("top")).scalar()
        rows = batch.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
        late = F.coalesce(F.col("us") + gap < seen - delay * us, F.lit(False))
        rows.filter(late).select(*batch.columns).write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
        fresh = rows.filter(~late)
        status = lambda s: F.count_if(F.col("status") == s)
        counted = fresh.groupBy("job_id", F.floor(F.col("us") / gap).alias("stretch")).agg(
            F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("total_count"), status("COMPLETED").alias("processed_count"),
            status("FAILED").alias("failed_count"), status("PROCESSING").alias("open_count")).drop("stretch")
        before = spark.read.schema(held).parquet(f"{root}/open/batch_id={batch_id - 1}")
        by_job = Window.partitionBy("job_id").orderBy("first_us", "last_us")
        end = F.max("last_us").over(by_job.rowsBetween(Window.unboundedPreceding, -1))
        parts = counted.unionByName(before).withColumn("new", F.coalesce((F.col("first_us") > end + gap).cast("int"), F.lit(0)))
        totals = ("total_count", "processed_count", "failed_count", "open_count")
        runs = parts.withColumn("run", F.sum("new").over(by_job)).groupBy("job_id", "run").agg(
            F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *(F.sum(c).alias(c) for c in totals)).drop("run")
        rows.agg(F.max("us").alias("top")).write.mode("overwrite").parquet(f"{root}/seen/batch_id={batch_id}")
        top = spark.read.schema("top long, batch_id long").parquet(f"{root}/seen").filter(F.col("batch_id") <= batch_id).select(F.max("top")).scalar()
        done = F.coalesce(F.col("last_us") + gap < F.lit(top) - delay * us, F.lit(False))
        runs.withColumn("done", done).write.mode("overwrite").partitionBy("done").parquet(f"{root}/runs/batch_id={batch_id}")
        both = spark.read.schema(f"{held}, done boolean").parquet(f"{root}/runs/batch_id={batch_id}")
        both.filter("done").drop("done").write.mode("overwrite").parquet(f"{root}/finished/batch_id={batch_id}")
        both.filter("NOT done").drop("done").write.mode("overwrite").parquet(f"{root}/open/batch_id={batch_id}")

    schema = results.schema
    start_table(spark, f"{root}/late", schema)
    run(results, root, "append", write)
    read = lambda name, s: spark.read.schema(s).parquet(f"{root}/{name}")
    opened = read("open", f"{held}, batch_id long")
    newest = opened.select(F.max("batch_id")).scalar()
    # the last batch may hold no open run
    last = max((int(b) for b in batches(spark, f"{root}/open")), default=newest)
    return (read("finished", f"{held}, batch_id long"), opened.filter(F.col("batch_id") == last), read("late", StructType(schema.fields).add("batch_id", "long")))


def run_report(runs: DataFrame) -> DataFrame:
    """Runs with times and progress."""
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return runs.select("job_id", at("first_us").alias("first_ts"), at("last_us").alias("last_ts"), "total_count", "processed_count", "failed_count",
                       percent(F.col("processed_count"), F.col("total_count"), 6).alias("progress_percentage"), (F.col("open_count") > 0).alias("is_running"))


def recent_results(results: DataFrame, root: str, k: int = 20) -> DataFrame:
    """The newest k rows, kept as a bounded table that every batch replaces."""
    spark = results.sparkSession
    columns = StructType(results.schema.fields)

    def write(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(columns).parquet(f"{root}/out/batch_id={batch_id - 1}")
        batch.unionByName(before).orderBy(F.desc("ts"), F.desc("event_id")).limit(k).write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    start_table(spark, f"{root}/out", columns)
    run(results, root, "append", write)
    return spark.read.schema(StructType(columns.fields).add("batch_id", "long")).parquet(f"{root}/out")


def retry_outcome(results: DataFrame, gap: str = "6 hours", delay: str = "1 hour", max_retries: int = 3) -> DataFrame:
    """Attempts close together form one task run: attempts, success if any succeeded, limit kept."""
    runs = watermarked(results, "ts", delay).groupBy(F.session_window("ts", gap), "organization_id").agg(
        F.count("*").alias("attempts"), F.max((F.col("status") == "COMPLETED").cast("int")).alias("ok"))
    return runs.select(_plain("session_window.start").alias("first_attempt"), "organization_id", "attempts",
                       (F.col("ok") == 1).alias("succeeded"), (F.col("attempts") <= max_retries + 1).alias("within_limit"))


def split_late(events: DataFrame, root: str, delay: str = "INTERVAL 1 HOUR") -> tuple[DataFrame, DataFrame]:
    """On-time and late rows as two tables.

    A row is late when it is older than the greatest time of earlier batches minus
    the delay. That time is read back from the per-batch maxima on disk, so a
    restarted or repeated batch splits the same way.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = spark.read.schema("top timestamp_ntz, batch_id long").parquet(f"{root}/seen").filter(F.col("batch_id") < batch_id)
        bound = seen.select(F.max("top") - F.expr(delay)).scalar()
        late = F.coalesce(F.col("ts") < bound, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{root}/out/batch_id={batch_id}")
        batch.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(f"{root}/seen/batch_id={batch_id}")

    start_table(spark, f"{root}/seen", "top timestamp_ntz")
    run(events, root, "append", write)
    schema = StructType(events.schema.fields).add("batch_id", "long").add("late", "boolean")
    table = spark.read.schema(schema).parquet(f"{root}/out")
    return table.filter(~F.col("late")), table.filter("late")
