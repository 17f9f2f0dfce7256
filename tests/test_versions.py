"""A versioned table equals a rewritten one after any updates; its views equal a recount; small updates write few files."""

import random

import pytest
from pyspark.sql import functions as F

from orgloom.operators import coverage as C
from orgloom.operators import updates as U
from orgloom.operators import versions as V
from orgloom.operators import views as VW
from orgloom.sources import tables as T

SCHEMA = "id long, grp string, n int, is_on boolean"


def view():
    return V.View(["grp"], {"on": F.col("is_on"), "sum": F.col("n")}, F.col("n") >= 0)


def laid_over(old, changes):
    """Changes with gone = true delete, others replace or insert."""
    return changes.filter("NOT gone").drop("gone")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_updates_deletes_and_replays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "MERGED_RUNS", 3)
    rng = random.Random(3)
    row = lambda i: (i, rng.choice(["a", "b", None]), rng.choice([None, -1, 0, 5]), rng.choice([True, False, None]))
    model = {i: row(i) for i in range(60)}
    table = V.VersionedTable(spark, str(tmp_path / "t"), {"v": view()})
    table.create(spark.createDataFrame(list(model.values()), SCHEMA), "id", 5)
    for batch in range(4):
        ids = rng.sample(range(80), 12)
        changes = [(*row(i), rng.random() < 0.4) for i in ids]
        df = spark.createDataFrame(changes, SCHEMA + ", gone boolean")
        table.update(df, laid_over, batch)
        for r in changes:
            model.pop(r[0], None)
            if not r[4]:
                model[r[0]] = r[:4]
        assert table.update(df, laid_over, batch) == {"buckets": 0, "rows": 0}
        if batch == 3:
            assert rows(table.read()) == sorted(model.values(), key=repr)
            again = view().of(spark.createDataFrame(list(model.values()), SCHEMA))
            assert rows(table.view("v")) == rows(again)
    assert len(table._told()["views"]["v"]) <= 4
    assert rows(table.lookup(spark.createDataFrame([(3,), (3,), (999,)], "id long"))) == ([model[3]] if 3 in model else [])


def test_few_buckets_are_rewritten_and_a_failed_write_leaves_the_old_version(spark, tmp_path):
    table = V.VersionedTable(spark, str(tmp_path / "t"), {"v": view()})
    table.create(spark.range(5000).select("id", F.lit("a").alias("grp"), F.lit(1).alias("n"), F.lit(True).alias("is_on")), "id", 64)
    before = set(table.read().inputFiles())
    few = spark.createDataFrame([(7, "b", 2, False, False), (8, "b", 2, False, False)], SCHEMA + ", gone boolean")
    assert table.update(few, laid_over)["buckets"] <= 2
    after = set(table.read().inputFiles())
    assert len(before) == 64 and len(after - before) <= 2
    assert len(table.lookup(few.select("id")).inputFiles()) <= 2

    def broken(old, changes):
        return laid_over(old, changes).withColumn("n", F.raise_error(F.lit("no")).cast("int"))

    def doubled(old, changes):
        return laid_over(old, changes).unionByName(laid_over(old, changes))

    def strangers(old, changes):
        return laid_over(old, changes).withColumn("id", F.col("id") + 100_000)

    counts = rows(table.view("v"))
    for wrong in (broken, doubled, strangers):
        with pytest.raises(Exception):
            table.update(few, wrong)
        assert set(table.read().inputFiles()) == after and rows(table.view("v")) == counts == [("a", 4998, 4998, 4998), ("b", 0, 4, 2)]


def test_only_one_of_two_writers_publishes(spark, tmp_path):
    table = V.VersionedTable(spark, str(tmp_path / "t"))
    table.create(spark.createDataFrame([(1, "a", 1, True)], SCHEMA), "id", 2)

    def meanwhile(old, changes):
        V.VersionedTable(spark, str(tmp_path / "t")).update(spark.createDataFrame([(1, "first", 1, True, False)], SCHEMA + ", gone boolean"), laid_over)
        return laid_over(old, changes)

    with pytest.raises(RuntimeError):
        table.update(spark.createDataFrame([(1, "second", 1, True, False)], SCHEMA + ", gone boolean"), meanwhile)
    assert rows(table.read()) == [(1, "first", 1, True)]


def test_empty_tables(spark, tmp_path):
    table = V.VersionedTable(spark, str(tmp_path / "t"), {"v": view()})
    with pytest.raises(ValueError):
        table.read()
    table.create(spark.createDataFrame([], SCHEMA), "id", 4)
    assert table.read().count() == 0 and table.view("v").count() == 0
    none = spark.createDataFrame([], SCHEMA + ", gone boolean")
    assert table.update(none, laid_over) == {"buckets": 0, "rows": 0}
    table.update(spark.createDataFrame([(1, "a", 1, True, False)], SCHEMA + ", gone boolean"), laid_over)
    assert rows(table.read()) == [(1, "a", 1, True)]
    table.update(spark.createDataFrame([(1, "a", 1, True, True)], SCHEMA + ", gone boolean"), laid_over)
    assert table.read().count() == 0 and table.view("v").count() == 0


def test_reports_of_views_equal_recounts(spark, small, tmp_path):
    orgs, found = T.organizations(spark, small), T.view(spark, small, "found")
    table = V.VersionedTable(spark, str(tmp_path / "t"), {"report": VW.report_view(), "status": VW.status_view()})
    table.create(orgs, "id", 8)
    table.update(found, U.upsert_overwrite)
    table.update(found.filter("id % 4 = 0").select("id"), U.soft_delete)
    counts, active = table.view("report"), table.read().filter("is_active")
    assert rows(VW.contact_coverage(counts)) == rows(C.contact_coverage(active))
    assert rows(VW.category_coverage(counts)) == rows(C.category_coverage(active))
    assert rows(VW.quality_report(counts)) == rows(C.quality_report(active))
