"""Streams fed day by day end where the batch jobs end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orgloom.operators import alerts as AL
from orgloom.operators import coverage as C
from orgloom.sources import tables as T
from orgloom.streaming import jobs as J
from orgloom.streaming import runtime as RT


@pytest.fixture(scope="module")
def days(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("days"))
    events = T.given(spark, small, "events")
    for start, end in ((1, 8), (8, 15), (15, 32)):
        lo, hi = dt.datetime(2024, 1, start), dt.datetime(2024, 1, 1) + dt.timedelta(days=end - 1)
        events.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, small, days, name):
    return RT.stream_view(RT.file_stream(spark, days, T.given(spark, small, "events").schema, files_per_batch=1), name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_job_progress(spark, small, days):
    table = RT.run_to_table(J.job_progress(stream(spark, small, days, "results")), RT.new_root(spark, "t"), "update")
    assert table.select("batch_id").distinct().count() == 3
    batch = C.job_progress(T.view(spark, small, "results"))
    assert rows(RT.latest(table, ["job_id"]).select(*batch.columns)) == rows(batch)


def test_alerts_over_batches(spark, small, days):
    want = {(r.rule, r.us) for r in AL.alert_log(T.view(spark, small, "health")).collect()}
    got = J.alert_batches(stream(spark, small, days, "health"), RT.new_root(spark, "t"))
    assert {(r.rule, r.us) for r in got.collect()} == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    state = RT.run_to_table(J.alert_cooldown(stream(spark, small, days, "health")), RT.new_root(spark, "t"))
    assert {(r.rule, r.us) for r in state.collect()} == want


def test_progress_deltas_and_recent(spark, small, days):
    deltas = J.progress_deltas(stream(spark, small, days, "results"), RT.new_root(spark, "t"))
    now = J.current_organizations(T.organizations(spark, small), deltas)
    done = T.view(spark, small, "results").filter("status = 'COMPLETED'")
    assert now.agg(F.sum("processed_count")).first()[0] == done.count()
    top = RT.last_batch(J.recent_results(stream(spark, small, days, "results"), RT.new_root(spark, "t"), 7))
    want = T.view(spark, small, "results").orderBy(F.desc("ts"), F.desc("event_id")).limit(7)
    assert rows(top.select(*want.columns)) == rows(want)


def test_restart_continues(spark, small, tmp_path):
    folder, root = str(tmp_path / "in"), RT.new_root(spark, "t")
    events = T.given(spark, small, "events")
    events.filter("event_id % 2 = 0").write.parquet(folder)
    run = lambda: J.alert_batches(RT.stream_view(RT.file_stream(spark, folder, events.schema), "health"), root)
    run()
    first = T.view(spark, small, "health").filter("event_id % 2 = 0")
    assert {(r.rule, r.us) for r in run().collect()} == {(r.rule, r.us) for r in AL.alert_log(first).collect()}


def test_late_rows_are_kept_apart(spark, small, tmp_path):
    folder, root = str(tmp_path / "in"), RT.new_root(spark, "t")
    events = T.given(spark, small, "events")
    events.write.parquet(folder)
    J.split_late(RT.file_stream(spark, folder, events.schema), root)
    events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 2 DAYS")).write.mode("append").parquet(folder)
    on_time, late = J.split_late(RT.file_stream(spark, folder, events.schema), root)
    top = events.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    assert late.count() == events.filter(F.col("ts") - F.expr("INTERVAL 2 DAYS") < top).count()
    assert on_time.count() + late.count() == 2 * events.count()


def test_delta_runs_stay_few(spark, tmp_path):
    """Reading after many batches opens few runs; merges that are repeated or left unfinished change nothing."""
    schema = "organization_id int, event_id long, ts timestamp_ntz, phone string, status string"
    folder, root = str(tmp_path / "in"), RT.new_root(spark, "t")
    start, want, counts = dt.datetime(2024, 1, 1), {}, []
    for b in range(14):
        rows = [(k % 7, 100 * b + k, start + dt.timedelta(minutes=10 * b + (k * 13) % 9), f"p{b}-{k}", "COMPLETED" if k % 5 else "FAILED") for k in range(12)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for o, e, t, p, s in rows:
            if s == "COMPLETED":
                best, n = want.get(o, (None, 0))
                want[o] = (max(best, (t, e, p)) if best else (t, e, p), n + 1)
        deltas = J.progress_deltas(RT.file_stream(spark, folder, spark.read.parquet(folder).schema), root, fan_out=3)
        if b % 4 == 1 or b == 13:
            runs = RT.Runs(spark, root, deltas.schema, 3)
            counts.append(len(runs.runs()))
            newest = {r.organization_id: ((r.ts, r.event_id, r.phone), r.n) for r in deltas.groupBy("organization_id").agg(
                F.max_by(F.struct("ts", "event_id", "phone"), F.struct("ts", "event_id")).alias("m"), F.sum("processed").alias("n")).select("organization_id", "m.*", "n").collect()}
            assert newest == want
    assert max(counts) <= 6 and len(RT.batches(spark, f"{root}/out")) >= 15
    assert len({f.rsplit("/", 2)[1] for f in deltas.inputFiles()}) <= 6
    before = rows_of(deltas)
    runs.merge(lambda df: df, 13)  # nothing is left to merge
    spark.createDataFrame([("[]",)], "value string").write.text(f"{root}/left")  # no manifest
    assert rows_of(runs.read()) == before


def rows_of(df):
    return sorted(map(str, df.collect()))


def fed(spark, folder, root, rows, schema, job):
    """The job's result after each batch of rows."""
    for some in rows:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
        yield job(RT.file_stream(spark, folder, spark.read.parquet(folder).schema), root)


def test_finished_jobs_leave_the_state(spark, tmp_path):
    schema = "job_id int, event_id long, ts timestamp_ntz, status string"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    given = [
        [(1, 1, at(0), "PROCESSING"), (1, 2, at(1), "COMPLETED"), (2, 3, at(1), "FAILED"), (3, 4, at(0), "COMPLETED"), (3, 5, at(9), "COMPLETED")],
        [(2, 6, at(2), "COMPLETED"), (4, 7, at(20), "COMPLETED")],
        [(1, 8, at(2), "COMPLETED"), (4, 9, at(24), "PROCESSING"), (1, 10, at(40), "COMPLETED")],
        [(9, 11, at(90), "COMPLETED")]]
    held = []
    for finished, opened, late in fed(spark, str(tmp_path / "in"), RT.new_root(spark, "t"), given, schema, lambda s, r: J.job_runs(s, r, idle=6 * 3600)):
        told = lambda df: sorted((r.job_id, r.first_us // 3_600_000_000 - 24 * 19723, r.last_us // 3_600_000_000 - 24 * 19723, r.total_count, r.processed_count, r.failed_count) for r in df.collect())
        held.append((told(finished), told(opened), sorted(r.event_id for r in late.collect())))
    # the watermark is at 8 hours: of runs that ended before 2 nothing more can come
    assert held[0] == ([(1, 0, 1, 2, 1, 0), (2, 1, 1, 1, 0, 1), (3, 0, 0, 1, 1, 0)], [(3, 9, 9, 1, 1, 0)], [])
    finished, opened, late = held[-1]
    assert opened == [(9, 90, 90, 1, 1, 0)] and late == [8]
    assert len(finished) == len(set(f[:2] for f in finished))  # each run once
    assert sum(f[3] for f in finished) + len(late) + sum(o[3] for o in opened) == 11
    assert (1, 40, 40, 1, 1, 0) in finished and (4, 20, 24, 2, 1, 0) in finished


def test_rate_windows_start_with_calls(spark, tmp_path):
    """Against the counter kept call by call."""
    import random

    rnd, schema, limit = random.Random(4), "agent_name string, start_time timestamp_ntz", 3
    t, calls = 0.0, []
    for _ in range(150):
        t += rnd.choice([0, 0.5, 3, 20, 29.5, 60, 61, 300])
        calls.append((rnd.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)))
    want, open_ = {}, {}
    for agent, at in calls:
        if agent not in open_ or at - open_[agent] > dt.timedelta(seconds=60):
            open_[agent] = at
        key = (agent, open_[agent])
        allowed, refused = want.get(key, (0, 0))
        want[key] = (allowed + 1, refused) if allowed < limit else (allowed, refused + 1)
    given = [calls[:60], calls[60:61], calls[61:]]
    for windows in fed(spark, str(tmp_path / "in"), RT.new_root(spark, "t"), given, schema, J.rate_limit_batches):
        pass
    got = AL.rate_limited(windows, "agent_name", limit).collect()
    assert {(r.agent_name, r.window_start): (r.allowed, r.refused) for r in got} == want
    assert all(r.limited == (r.allowed == limit) and r.calls == r.allowed + r.refused for r in got)
