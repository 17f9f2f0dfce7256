"""Crawl metrics, trends, health and alerts (batch)."""

from __future__ import annotations

from orgloom.functions import fixed_values as V
from orgloom.operators import alerts as AL
from orgloom.operators import metrics as M
from orgloom.sources import tables as T

from . import sqlparts as q
from .queues import EVENTS_AS_OF, as_of_events
from .registry import query

_POS = "coalesce(avg({c}) FILTER (WHERE {c} > 0), 0.0E0)"
_RATE = "round(avg(CASE WHEN success THEN 1 ELSE 0 END), 6)"
_AGENT = f"""
n AS (SELECT agent_name, confidence_score AS c, row_number() OVER (PARTITION BY agent_name ORDER BY start_time, event_id) AS m FROM metrics),
p AS (SELECT * FROM n WHERE c > 0),
l AS (SELECT *, coalesce(sum(CASE WHEN m > 1 THEN ln((m - 1) / CAST(m AS DOUBLE)) ELSE 0.0E0 END) OVER (PARTITION BY agent_name ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0E0) AS tail FROM p),
rm AS (SELECT agent_name, round(sum(c / m * exp(tail)), 6) AS running_confidence FROM l GROUP BY agent_name),
st AS (SELECT agent_name, count(*) AS total_tasks, {q.count('success')} AS successful_tasks, {q.count('NOT success')} AS failed_tasks,
  round(sum(CASE WHEN duration > 0 THEN duration ELSE 0.0E0 END), 6) AS total_duration, round({_POS.format(c='duration')}, 6) AS average_duration,
  round({_POS.format(c='confidence_score')}, 6) AS average_confidence, max(start_time) AS last_activity FROM metrics GROUP BY agent_name),
ag AS (SELECT st.*, coalesce(rm.running_confidence, 0.0E0) AS running_confidence, round(successful_tasks / CAST(total_tasks AS DOUBLE), 6) AS success_rate,
  round(failed_tasks / CAST(total_tasks AS DOUBLE), 6) AS failure_rate FROM st LEFT JOIN rm ON rm.agent_name = st.agent_name)"""


@query("agent_stats", f"WITH {_AGENT} SELECT * FROM ag", uses=("metrics",))
def agent_stats(spark, d):
    return M.agent_stats(T.view(spark, d, "metrics"))


@query("top_agents", f"WITH {_AGENT} SELECT * FROM ag ORDER BY success_rate DESC, average_confidence DESC, agent_name LIMIT 3", uses=("metrics",))
def top_agents(spark, d):
    return M.top_agents(M.agent_stats(T.view(spark, d, "metrics")), 3)


@query("task_type_stats", f"""
SELECT task_type, count(*) AS total_tasks, {q.count('success')} AS successful_tasks, {q.count('NOT success')} AS failed_tasks, {_RATE} AS success_rate,
  round({_POS.format(c='duration')}, 6) AS average_duration, coalesce(min(duration) FILTER (WHERE duration > 0), 0.0E0) AS min_duration,
  coalesce(max(duration) FILTER (WHERE duration > 0), 0.0E0) AS max_duration, round({_POS.format(c='confidence_score')}, 6) AS average_confidence,
  round(coalesce(median(duration) FILTER (WHERE duration > 0), 0.0E0), 6) AS median_duration,
  round(coalesce(median(confidence_score) FILTER (WHERE confidence_score > 0), 0.0E0), 6) AS median_confidence FROM metrics GROUP BY task_type""", uses=("metrics",))
def task_type_stats(spark, d):
    return M.task_type_stats(T.view(spark, d, "metrics"))


@query("system_overview", f"""
SELECT count(*) AS total_tasks, {q.count('success')} AS successful_tasks, {q.count('NOT success')} AS failed_tasks, {_RATE} AS overall_success_rate,
  {q.count(f'start_time >= {EVENTS_AS_OF} - INTERVAL 60 MINUTE')} AS recent_tasks_count, round({_POS.format(c='duration')}, 6) AS average_duration,
  round({_POS.format(c='confidence_score')}, 6) AS average_confidence, count(DISTINCT agent_name) AS active_agents, count(DISTINCT task_type) AS unique_task_types FROM metrics""", uses=("metrics",))
def system_overview(spark, d):
    return M.system_overview(T.view(spark, d, "metrics"), as_of_events())


TREND = f"SELECT date_trunc('hour', start_time) AS hour, {_RATE} AS success_rate, round(avg(duration), 9) AS avg_duration, count(*) AS task_count FROM metrics"


@query("hourly_trend", f"{TREND} GROUP BY 1", uses=("metrics",))
def hourly_trend(spark, d):
    return M.hourly_trend(T.view(spark, d, "metrics"))


@query("hourly_trend_last_day", f"{TREND} WHERE start_time >= {EVENTS_AS_OF} - INTERVAL 24 HOUR GROUP BY 1", uses=("metrics",))
def hourly_trend_last_day(spark, d):
    return M.hourly_trend(T.view(spark, d, "metrics"), as_of_events(), 24)


@query("trend_analysis", f"""
WITH t AS ({TREND} GROUP BY 1) SELECT round(avg(avg_duration), 6) AS duration_average, max(avg_duration) AS duration_max, min(avg_duration) AS duration_min,
  CASE WHEN count(*) > 1 AND arg_max(avg_duration, hour) > arg_min(avg_duration, hour) THEN 'increasing' ELSE 'stable' END AS duration_trend,
  round(avg(success_rate), 6) AS success_average, arg_max(success_rate, hour) AS success_current,
  CASE WHEN count(*) > 1 AND arg_max(success_rate, hour) > arg_min(success_rate, hour) THEN 'improving' ELSE 'stable' END AS success_trend FROM t""", uses=("metrics",))
def trend_analysis(spark, d):
    return M.trend_analysis(M.hourly_trend(T.view(spark, d, "metrics")))


@query("bottlenecks", f"""
WITH t AS ({TREND} GROUP BY 1), a AS (SELECT avg(avg_duration) AS d, avg(success_rate) AS s FROM t), c AS (SELECT * FROM health ORDER BY ts DESC, event_id DESC LIMIT 1),
r AS (SELECT 'response_time' AS type, CASE WHEN d > 10 THEN 'high' ELSE 'medium' END AS severity FROM a WHERE d > 5
  UNION ALL SELECT 'success_rate', CASE WHEN s < 0.7 THEN 'high' ELSE 'medium' END FROM a WHERE s < 0.9
  UNION ALL SELECT 'cpu_usage', 'high' FROM c WHERE cpu_usage > 80 UNION ALL SELECT 'memory_usage', 'high' FROM c WHERE memory_usage > 80)
SELECT type, severity, round(avg(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) OVER () * 0.7E0 + 0.5E0 * 0.3E0, 6) AS priority_score FROM r""", uses=("metrics", "health"))
def bottlenecks(spark, d):
    return M.bottlenecks(M.hourly_trend(T.view(spark, d, "metrics")), T.view(spark, d, "health"))


_HOUR = f"ts >= {EVENTS_AS_OF} - INTERVAL 60 MINUTE"


@query("health_summary", f"""
WITH c AS (SELECT * FROM health ORDER BY ts DESC, event_id DESC LIMIT 1),
a AS (SELECT {', '.join(f"round(coalesce(avg({x}) FILTER (WHERE {_HOUR}), 0.0E0), 6) AS {n}" for x, n in (('cpu_usage', 'avg_cpu_1h'), ('memory_usage', 'avg_memory_1h'), ('response_time', 'avg_response_time_1h')))},
  round({q.count('error_count <= 10')} * 100.0E0 / count(*), 6) AS success_rate, min(ts) AS first_ts FROM health)
SELECT CASE WHEN cpu_usage > 95 OR memory_usage > 95 OR disk_usage > 95 THEN 'critical' WHEN cpu_usage > 80 OR memory_usage > 80 OR disk_usage > 80 OR error_count > 10 OR response_time > 5 THEN 'warning' ELSE 'healthy' END AS current_status,
  cpu_usage AS current_cpu, memory_usage AS current_memory, disk_usage AS current_disk, active_agents, error_count, avg_cpu_1h, avg_memory_1h, avg_response_time_1h, success_rate,
  CAST(floor(date_diff('microsecond', first_ts, {EVENTS_AS_OF}) / 60000000.0E0) AS BIGINT) AS uptime_minutes FROM c, a""", uses=("health",))
def health_summary(spark, d):
    return M.health_summary(T.view(spark, d, "health"), as_of_events())


_RULES = " UNION ALL ".join(
    f"SELECT DISTINCT '{n}' AS rule, '{s}' AS severity, {m} AS cd, ts FROM health WHERE {cond}" for n, cond, s, m in V.ALERT_RULES)
# each trigger points at the first one after its cooldown; the fires are the chain from the first trigger
ALERTS = f"""
WITH RECURSIVE hits AS ({_RULES}),
nx AS (SELECT a.rule, a.severity, a.ts, min(b.ts) AS nxt FROM hits a LEFT JOIN hits b ON b.rule = a.rule AND b.ts >= a.ts + to_minutes(a.cd) GROUP BY a.rule, a.severity, a.ts),
chain AS (SELECT rule, severity, min(ts) AS ts FROM nx GROUP BY rule, severity
  UNION ALL SELECT c.rule, c.severity, n.nxt FROM chain c JOIN nx n ON n.rule = c.rule AND n.ts = c.ts WHERE n.nxt IS NOT NULL)
SELECT rule, severity, ts AS fired_at FROM chain"""


@query("alert_log", ALERTS, uses=("health",))
def alert_log(spark, d):
    return AL.fired_at(AL.alert_log(T.view(spark, d, "health")))


@query("resource_alerts", """
SELECT event_id, ts, 'memory_warning' AS type, memory_usage AS value FROM health WHERE memory_usage > 85
UNION ALL SELECT event_id, ts, 'cpu_warning', cpu_usage FROM health WHERE cpu_usage > 80""", uses=("health",))
def resource_alerts(spark, d):
    return AL.resource_alerts(T.view(spark, d, "health"))
