"""Streaming jobs run over the event table until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from orgloom.operators import alerts as AL
from orgloom.sources import tables as T
from orgloom.streaming import jobs as J
from orgloom.streaming import runtime as RT

from . import sqlparts as q
from .coverage import JOB_SQL
from .metrics import ALERTS, _POS, _RATE
from .registry import query

c = F.col


def events(spark, d):
    """The event table as a stream."""
    return RT.table_stream(spark, f"{d}/events.parquet")


def over(spark, d, name: str):
    return RT.stream_view(events(spark, d), name)


@query("stream_progress_upsert", """
WITH done AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY ts DESC, event_id DESC) AS rn FROM results WHERE status = 'COMPLETED'),
n AS (SELECT organization_id, count(*) AS processed_count FROM done GROUP BY organization_id)
SELECT o.id, o.name, coalesce(r.phone, o.phone) AS phone, o.ai_crawled OR r.ts IS NOT NULL AS ai_crawled, coalesce(r.ts, o.last_crawled_at) AS last_crawled_at,
  coalesce(n.processed_count, 0) AS processed_count FROM org o LEFT JOIN done r ON r.organization_id = o.id AND r.rn = 1 LEFT JOIN n ON n.organization_id = o.id""", uses=("org", "results"))
def stream_progress_upsert(spark, d):
    deltas = J.progress_deltas(over(spark, d, "results"), RT.new_root(spark, "progress"))
    return J.current_organizations(T.organizations(spark, d), deltas)


@query("stream_job_progress", JOB_SQL, uses=("results",))
def stream_job_progress(spark, d):
    table = RT.run_to_table(J.job_progress(over(spark, d, "results")), RT.new_root(spark, "jobs"), "update")
    return RT.latest(table, ["job_id"])


@query("stream_hourly_trend", f"""
WITH t AS (SELECT date_trunc('hour', start_time) AS hour, {_RATE} AS success_rate, round(avg(duration), 9) AS avg_duration, count(*) AS task_count FROM metrics GROUP BY 1)
SELECT * FROM t WHERE hour + INTERVAL 1 HOUR <= (SELECT max(start_time) FROM metrics) - INTERVAL 1 HOUR""", uses=("metrics",))
def stream_hourly_trend(spark, d):
    return RT.run_to_table(J.hourly_trend(over(spark, d, "metrics")), RT.new_root(spark, "trend")).drop("batch_id")


@query("stream_recent_window", """
WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * i) AS window_start, cpu_usage, memory_usage, response_time FROM health, range(12) r(i))
SELECT window_start, round(avg(cpu_usage), 9) AS avg_cpu, round(avg(memory_usage), 9) AS avg_memory, round(avg(response_time), 9) AS avg_response, count(*) AS samples FROM w GROUP BY 1""", uses=("health",))
def stream_recent_window(spark, d):
    table = RT.run_to_table(J.recent_window(over(spark, d, "health")), RT.new_root(spark, "recent"), "update")
    return RT.latest(table, ["window_start"])


@query("stream_health_status", """
SELECT event_id, ts, CASE WHEN cpu_usage > 95 OR memory_usage > 95 OR disk_usage > 95 THEN 'critical'
  WHEN cpu_usage > 80 OR memory_usage > 80 OR disk_usage > 80 OR error_count > 10 OR response_time > 5 THEN 'warning' ELSE 'healthy' END AS overall_status FROM health""", uses=("health",))
def stream_health_status(spark, d):
    return RT.run_to_table(J.health_status(over(spark, d, "health")), RT.new_root(spark, "status")).drop("batch_id")


@query("stream_alert_cooldown", ALERTS, uses=("health",))
def stream_alert_cooldown(spark, d):
    from orgloom.operators.alerts import fired_at

    return fired_at(J.alert_batches(over(spark, d, "health"), RT.new_root(spark, "alerts")))


@query("stream_alert_cooldown_stateful", ALERTS, uses=("health",))
def stream_alert_cooldown_stateful(spark, d):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, J.ROCKSDB)
    try:
        table = RT.run_to_table(J.alert_cooldown(over(spark, d, "health")), RT.new_root(spark, "alerts"))
    finally:
        spark.conf.set(provider, before)
    return table.select("rule", "severity", F.timestamp_micros("us").cast("timestamp_ntz").alias("fired_at"))


@query("stream_resource_alerts", """
SELECT event_id, ts, 'memory_warning' AS type, memory_usage AS value FROM health WHERE memory_usage > 85
UNION ALL SELECT event_id, ts, 'cpu_warning', cpu_usage FROM health WHERE cpu_usage > 80""", uses=("health",))
def stream_resource_alerts(spark, d):
    from orgloom.operators.alerts import resource_alerts

    return RT.run_to_table(resource_alerts(over(spark, d, "health")), RT.new_root(spark, "resource")).drop("batch_id")


@query("stream_agent_stats", f"""
SELECT agent_name, count(*) AS total_tasks, {q.count('success')} AS successful_tasks, {q.count('NOT success')} AS failed_tasks,
  round({_POS.format(c='duration')}, 6) AS average_duration, round({_POS.format(c='confidence_score')}, 6) AS average_confidence FROM metrics GROUP BY agent_name""", uses=("metrics",))
def stream_agent_stats(spark, d):
    return RT.last_batch(RT.run_to_table(J.agent_stats(over(spark, d, "metrics")), RT.new_root(spark, "agents"), "complete"))


_CALLS = """starts AS (SELECT agent_name, min(start_time) AS s FROM metrics GROUP BY 1
  UNION ALL SELECT x.agent_name, min(m.start_time) FROM starts x JOIN metrics m ON m.agent_name = x.agent_name AND m.start_time > x.s + INTERVAL 60 SECOND GROUP BY x.agent_name, x.s)"""


@query("stream_rate_window", f"""
WITH RECURSIVE {_CALLS}, n AS (SELECT agent_name, s AS window_start, count(*) AS calls FROM starts JOIN metrics USING (agent_name) WHERE start_time BETWEEN s AND s + INTERVAL 60 SECOND GROUP BY 1, 2)
SELECT *, least(calls, 2) AS allowed, greatest(calls - 2, 0) AS refused, calls >= 2 AS limited FROM n""", uses=("metrics",))
def stream_rate_window(spark, d):
    windows = J.rate_limit_batches(over(spark, d, "metrics"), RT.new_root(spark, "rate"))
    return AL.rate_limited(windows, "agent_name", 2)


@query("stream_job_runs", """
WITH o AS (SELECT *, max(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM results),
r AS (SELECT *, sum(CASE WHEN ts > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
a AS (SELECT job_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS total_count, count(*) FILTER (status = 'COMPLETED') AS processed_count, count(*) FILTER (status = 'FAILED') AS failed_count,
  count(*) FILTER (status = 'PROCESSING') AS open_count FROM r GROUP BY job_id, run)
SELECT job_id, first_ts, last_ts, total_count, processed_count, failed_count, """ + q.pct("processed_count", "total_count", 6) + """ AS progress_percentage, open_count > 0 AS is_running,
  last_ts + INTERVAL 6 HOUR < (SELECT max(ts) FROM results) - INTERVAL 1 HOUR AS finished FROM a""", uses=("results",))
def stream_job_runs(spark, d):
    finished, opened, _ = J.job_runs(over(spark, d, "results"), RT.new_root(spark, "runs"), idle=6 * 3600)
    named = lambda runs, done: J.run_report(runs).withColumn("finished", F.lit(done))
    return named(finished, True).unionByName(named(opened, False))


@query("stream_rate_minutes", """
SELECT date_trunc('minute', start_time) AS minute, agent_name, count(*) AS requests, count(*) >= 2 AS limited FROM metrics GROUP BY 1, 2""", uses=("metrics",))
def stream_rate_minutes(spark, d):
    table = RT.run_to_table(J.rate_window(over(spark, d, "metrics"), limit=2), RT.new_root(spark, "rate"), "update")
    return RT.latest(table, ["minute", "agent_name"])


@query("stream_recent_results", "SELECT * FROM results ORDER BY ts DESC, event_id DESC LIMIT 20", uses=("results",))
def stream_recent_results(spark, d):
    return RT.last_batch(J.recent_results(over(spark, d, "results"), RT.new_root(spark, "newest"), 20))


@query("stream_retry_outcome", """
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new_run FROM results WINDOW w AS (PARTITION BY organization_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new_run) OVER (PARTITION BY organization_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
a AS (SELECT organization_id, run, min(ts) AS first_attempt, max(ts) AS last_attempt, count(*) AS attempts, bool_or(status = 'COMPLETED') AS succeeded FROM s GROUP BY 1, 2)
SELECT first_attempt, organization_id, attempts, succeeded, attempts <= 4 AS within_limit FROM a
WHERE last_attempt + INTERVAL 6 HOUR <= (SELECT max(ts) FROM results) - INTERVAL 1 HOUR""", uses=("results",))
def stream_retry_outcome(spark, d):
    return RT.run_to_table(J.retry_outcome(over(spark, d, "results")), RT.new_root(spark, "retry")).drop("batch_id")


@query("stream_late_data", """
SELECT false AS late, count(*) AS n, min(event_id) AS first_event FROM events
UNION ALL SELECT true, count(*), min(event_id) + 1000000000 FROM events""", uses=())
def stream_late_data(spark, d):
    # every event arrives once in time and once more, forty days too old, in a later file
    e = T.given(spark, d, "events")
    folder = RT.new_root(spark, "arrivals")
    e.write.parquet(folder)
    again = e.withColumn("event_id", c("event_id") + 1000000000).withColumn("ts", c("ts") - F.expr("INTERVAL 40 DAYS"))
    root = RT.new_root(spark, "late")
    J.split_late(RT.file_stream(spark, folder, e.schema), root)
    again.write.mode("append").parquet(folder)
    on_time, late = J.split_late(RT.file_stream(spark, folder, e.schema), root)
    return on_time.unionByName(late).groupBy("late").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
