"""Plans and results when one key holds a third of the rows."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orgloom.operators import matching as M
from orgloom.operators import ranking as R
from orgloom.plans import registry
from orgloom.sources import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    return spark.range(0, 60000, 1, 8).select("id", key.alias("name"), F.col("id").alias("seq"))


def test_first_per_key_reduces_before_the_shuffle(hot):
    df = R.first_per_key(hot, ["name"], [F.asc("seq")])
    text = plan(df)
    limits = [m.start() for m in re.finditer("WindowGroupLimit", text)]
    assert len(limits) == 2 and text.index("Exchange hashpartitioning") < limits[1]
    assert df.count() == 40001 and df.filter("name = 'hot'").first().seq == 0


def test_top_per_key_on_a_hot_key(hot):
    df = R.top_per_key(hot, ["name"], [F.desc("seq")], 3)
    assert "WindowGroupLimit" in plan(df)
    assert sorted(r.seq for r in df.filter("name = 'hot'").collect()) == [59991, 59994, 59997]


def test_pages_after_a_row(spark):
    rows = [(i, None if i % 7 == 0 else i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, rank int")
    order, last, seen = [("rank", True), ("id", False)], None, []
    while part := R.page_after(df, order, last, 9).collect():
        seen += [r.id for r in part]
        last = (part[-1].rank, part[-1].id)
    assert seen == [i for i, _ in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))]


def test_distinct_counts_repeat_no_row(spark, small):
    for name in ("dataset_basic_stats", "system_overview"):
        assert "Expand" not in plan(entry.queries()[name](spark, small))


def test_merge_does_not_multiply_a_hot_name(spark, hot):
    second = hot.select("name", "seq", F.col("id").cast("string").alias("phone"))
    out = M.merge_with_validation(hot.select("id", "name", F.lit("").alias("phone")), second, ["phone"])
    assert out.count() == hot.count()
    assert out.filter("name = 'hot'").select("phone").distinct().collect()[0][0] == "0"


def test_scans_read_only_what_is_used(spark, small):
    text = plan(entry.queries()["category_coverage"](spark, small))
    assert "orders.parquet" not in text and "lineitem.parquet" not in text
    assert all("c_comment" not in s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", text))
    text = plan(R.search_filter(T.organizations(spark, small), equals={"category": "BUILDING"}))
    assert "EqualTo(c_mktsegment,BUILDING)" in text


def test_no_cross_joins_or_row_functions(spark, small):
    for name, fn in registry.load()[0].items():
        text = plan(fn(spark, small))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in text, f"{name}: {bad}"


@pytest.mark.parametrize("name", ["texts", "htmls", "replies"])
def test_texts_of_customers_are_made_by_many_tasks(spark, small, name):
    # the customers fill one file split; what is made of them must not stay in its task
    rows = T.view(spark, small, name).filter("id >= 1000000000")
    tasks = rows.groupBy(F.spark_partition_id()).count().count()
    assert tasks > 1 and rows.count() == spark.read.parquet(f"{small}/customer.parquet").count()
    assert "REPARTITION_BY_NUM" in plan(rows) and "orders.parquet" not in plan(rows)
