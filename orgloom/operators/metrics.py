"""Crawl metrics, trends, bottlenecks and health summaries (batch)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orgloom.functions import scoring as S
from orgloom.session import stored


def _mean(c: str) -> Column:
    """Mean of the positive values, 0 without any."""
    return F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))


def running_mean(df: DataFrame, key: str, value: str, order: Sequence[str], time: str, bucket: str = "1 hour") -> DataFrame:
    """The order-dependent running mean a(n) = (a(n-1)*(n-1) + v) / n over positive v.

    Row numbers and the tail products are taken inside (key, time bucket) groups
    and carried across buckets through one row per bucket, so a key that holds
    most of the rows is spread over many tasks.
    """
    t = df.select(key, F.window(time, bucket)["start"].alias("b"), *order, F.col(value).alias("v"))
    sizes = t.groupBy(key, "b").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(key, "b").orderBy(*order)
    numbered = t.withColumn("rn", F.row_number().over(inside)).join(offsets, [key, "b"]).withColumn(
        "m", (F.col("rn") + F.col("offset")).cast("double")).filter("v > 0")
    shrink = F.when(F.col("m") > 1, F.log((F.col("m") - 1) / F.col("m"))).otherwise(F.lit(0.0))
    later = Window.partitionBy(key, "b").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.withColumn("l", shrink).withColumn(
        "w", F.col("v") / F.col("m") * F.exp(F.coalesce(F.sum("l").over(later), F.lit(0.0)))
    ).groupBy(key, "b").agg(F.sum("w").alias("w"), F.sum("l").alias("l"))
    later_buckets = Window.partitionBy(key).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("x", F.col("w") * F.exp(F.coalesce(F.sum("l").over(later_buckets), F.lit(0.0)))).groupBy(key).agg(
        F.round(F.sum("x"), 6).alias("running_mean"))


def agent_stats(metrics: DataFrame) -> DataFrame:
    """Per agent: counts, durations, plain and running mean confidence, rates, last activity."""
    g = metrics.groupBy("agent_name").agg(
        F.count("*").alias("total_tasks"), F.count_if("success").alias("successful_tasks"), F.count_if(~F.col("success")).alias("failed_tasks"),
        F.round(F.sum(F.when(F.col("duration") > 0, F.col("duration")).otherwise(0.0)), 6).alias("total_duration"),
        F.round(_mean("duration"), 6).alias("average_duration"), F.round(_mean("confidence_score"), 6).alias("average_confidence"),
        F.max("start_time").alias("last_activity"))
    ordered = running_mean(metrics, "agent_name", "confidence_score", ["start_time", "event_id"], "start_time")
    return g.join(ordered.withColumnRenamed("running_mean", "running_confidence"), "agent_name", "left").select(
        "*", F.round(F.col("successful_tasks") / F.col("total_tasks"), 6).alias("success_rate"),
        F.round(F.col("failed_tasks") / F.col("total_tasks"), 6).alias("failure_rate")
    ).fillna({"running_confidence": 0.0})


def exact_medians(df: DataFrame, key: str, values: Sequence[str], cells: int = 4096) -> DataFrame:
    """Exact medians of the positive values per key without sorting a group in one task.

    1. a quantile sketch brackets the middle; 2. rows are counted into ``cells`` cells
    inside the bracket (plus one below and one above) before they are shuffled, which
    shows the cells that hold the middle ranks; 3. only the values of those cells are
    counted and ranked. The sketch decides how little is ranked, never the result.
    """
    g = [key, "what"]
    long = df.select(key, F.inline(F.array(*[F.struct(F.lit(v).alias("what"), F.col(v).alias("v")) for v in values]))).filter("v > 0")
    span = long.groupBy(*g).agg(F.count("*").alias("total"), F.percentile_approx("v", [0.4995, 0.5005], 10000).alias("b")).select(
        *g, "total", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))
    span = stored(span, "brackets")  # two steps must see one sketch
    v, width = F.col("v"), (F.col("hi") - F.col("lo")) / cells
    cell = (F.when(v < F.col("lo"), 0).when(v > F.col("hi"), cells + 1)
            .when(width > 0, 1 + F.least(F.floor((v - F.col("lo")) / width), F.lit(cells - 1))).otherwise(1).cast("int"))
    placed = long.join(span, g).withColumn("cell", cell)
    per_cell = placed.groupBy(*g, "cell", "total").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*g).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    first, second = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)

    def holds(rank: Column) -> Column:
        return (F.col("before") < rank) & (rank <= F.col("end"))

    middle = per_cell.withColumn("end", F.sum("n").over(upto)).withColumn("before", F.col("end") - F.col("n")).filter(
        holds(first) | holds(second)).select(*g, "cell", F.col("before").alias("base"))
    middle = stored(middle, "cells")
    inside = Window.partitionBy(*g, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    chosen = placed.join(middle, [*g, "cell"]).groupBy(*g, "cell", "base", "total", "v").agg(F.count("*").alias("n"))
    ranked = chosen.withColumn("end", F.col("base") + F.sum("n").over(inside)).withColumn("before", F.col("end") - F.col("n"))
    both = ranked.groupBy(*g).agg(
        ((F.max(F.when(holds(first), F.col("v"))) + F.max(F.when(holds(second), F.col("v")))) / 2).alias("m"))
    # one row per key and column is left
    return both.groupBy(key).agg(*[F.max(F.when(F.col("what") == v, F.col("m"))).alias(v) for v in values])


def task_type_stats(metrics: DataFrame) -> DataFrame:
    g = metrics.groupBy("task_type").agg(
        F.count("*").alias("total_tasks"), F.count_if("success").alias("successful_tasks"), F.count_if(~F.col("success")).alias("failed_tasks"),
        F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"), F.round(_mean("duration"), 6).alias("average_duration"),
        F.coalesce(F.min(F.when(F.col("duration") > 0, F.col("duration"))), F.lit(0.0)).alias("min_duration"),
        F.coalesce(F.max(F.when(F.col("duration") > 0, F.col("duration"))), F.lit(0.0)).alias("max_duration"),
        F.round(_mean("confidence_score"), 6).alias("average_confidence"))
    med = exact_medians(metrics, "task_type", ["duration", "confidence_score"])
    return g.join(med, "task_type", "left").select(
        *g.columns, F.round(F.coalesce("duration", F.lit(0.0)), 6).alias("median_duration"),
        F.round(F.coalesce("confidence_score", F.lit(0.0)), 6).alias("median_confidence"))


def system_overview(metrics: DataFrame, as_of: Column) -> DataFrame:
    """Headline numbers; each number of different values is an aggregate of its own, so no row is repeated."""
    unique = {f: metrics.select(F.col(c).alias("v")).distinct().select(F.count("v")).scalar() for f, c in (("active_agents", "agent_name"), ("unique_task_types", "task_type"))}
    counts = metrics.agg(
        F.count("*").alias("total_tasks"), F.count_if("success").alias("successful_tasks"), F.count_if(~F.col("success")).alias("failed_tasks"),
        F.round(F.avg(F.col("success").cast("int")), 6).alias("overall_success_rate"),
        F.count_if(F.col("start_time") >= as_of - F.expr("INTERVAL 60 MINUTES")).alias("recent_tasks_count"),
        F.round(_mean("duration"), 6).alias("average_duration"), F.round(_mean("confidence_score"), 6).alias("average_confidence"))
    return counts.select("*", *[v.alias(f) for f, v in unique.items()])


def hourly_trend(metrics: DataFrame, as_of: Column | None = None, hours: int | None = None) -> DataFrame:
    """Per hour: success rate, mean duration (zeros included) and count."""
    rows = metrics if hours is None else metrics.filter(F.col("start_time") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    return rows.groupBy(F.date_trunc("hour", "start_time").cast("timestamp_ntz").alias("hour")).agg(
        F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"), F.round(F.avg("duration"), 9).alias("avg_duration"),
        F.count("*").alias("task_count"))


def trend_analysis(trend: DataFrame) -> DataFrame:
    """Mean, extremes and direction over the hourly rows (first against last hour)."""
    g = trend.agg(
        F.count("*").alias("hours"), F.round(F.avg("avg_duration"), 6).alias("duration_average"), F.max("avg_duration").alias("duration_max"),
        F.min("avg_duration").alias("duration_min"), F.min_by("avg_duration", "hour").alias("d0"), F.max_by("avg_duration", "hour").alias("d1"),
        F.round(F.avg("success_rate"), 6).alias("success_average"), F.min_by("success_rate", "hour").alias("s0"), F.max_by("success_rate", "hour").alias("s1"))
    many = F.col("hours") > 1
    return g.select(
        "duration_average", "duration_max", "duration_min", F.when(many & (F.col("d1") > F.col("d0")), "increasing").otherwise("stable").alias("duration_trend"),
        "success_average", F.col("s1").alias("success_current"), F.when(many & (F.col("s1") > F.col("s0")), "improving").otherwise("stable").alias("success_trend"))


def current_sample(health: DataFrame) -> DataFrame:
    """Newest health sample as one row."""
    names = [c for c in health.columns if c not in ("ts", "event_id")]
    return health.agg(F.max(F.struct("ts", "event_id", *names)).alias("c")).select("c.*")


def bottlenecks(trend: DataFrame, health: DataFrame, model_confidence: float = 0.5) -> DataFrame:
    """Rules that fired, each with the shared priority score."""
    t = trend.agg(F.avg("avg_duration").alias("d"), F.avg("success_rate").alias("s"))
    now = current_sample(health)

    def rule(kind: str, fired: Column, high: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.coalesce(fired, F.lit(False)).alias("fired"), F.when(high, "high").otherwise("medium").alias("severity"))

    speed = t.select(F.inline(F.array(
        rule("response_time", F.col("d") > 5.0, F.col("d") > 10), rule("success_rate", F.col("s") < 0.9, F.col("s") < 0.7))))
    load = now.select(F.inline(F.array(
        rule("cpu_usage", F.col("cpu_usage") > 80, F.lit(True)), rule("memory_usage", F.col("memory_usage") > 80, F.lit(True)))))
    hit = speed.unionByName(load).filter("fired").drop("fired")
    every = Window.partitionBy(F.lit(0))  # four rows at most
    share = F.avg((F.col("severity") == "high").cast("int")).over(every)
    return hit.withColumn("priority_score", F.round(share * 0.7 + model_confidence * 0.3, 6))


def health_summary(health: DataFrame, as_of: Column) -> DataFrame:
    """Newest sample and its status, last-hour means and time since the first sample."""
    last_hour = F.col("ts") >= as_of - F.expr("INTERVAL 60 MINUTES")
    names = ["cpu_usage", "memory_usage", "disk_usage", "error_count", "response_time", "active_agents"]
    g = health.agg(
        F.max(F.struct("ts", "event_id", *names)).alias("c"), F.min("ts").alias("first_ts"),
        *[F.round(F.coalesce(F.avg(F.when(last_hour, F.col(c))), F.lit(0.0)), 6).alias(a)
          for c, a in (("cpu_usage", "avg_cpu_1h"), ("memory_usage", "avg_memory_1h"), ("response_time", "avg_response_time_1h"))],
        F.count_if(F.col("error_count") <= 10).alias("ok"), F.count("*").alias("n"))
    flat = g.select("c.*", "first_ts", "avg_cpu_1h", "avg_memory_1h", "avg_response_time_1h", "ok", "n")
    return flat.select(
        S.health_status().alias("current_status"), F.col("cpu_usage").alias("current_cpu"), F.col("memory_usage").alias("current_memory"),
        F.col("disk_usage").alias("current_disk"), "active_agents", "error_count", "avg_cpu_1h", "avg_memory_1h", "avg_response_time_1h",
        F.round(F.col("ok") * 100.0 / F.col("n"), 6).alias("success_rate"),
        F.timestamp_diff("MINUTE", F.col("first_ts"), as_of).alias("uptime_minutes"))


def top_agents(stats: DataFrame, n: int = 5) -> DataFrame:
    return stats.orderBy(F.desc("success_rate"), F.desc("average_confidence"), "agent_name").limit(n)
