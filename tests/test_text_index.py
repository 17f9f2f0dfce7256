"""The trigram index gives the rows of a scan, through updates, and reads less for rarer terms."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from orgloom.operators import text_index as X
from orgloom.sources import tables as T

COLUMNS = ["name", "address", "email"]


def scan(df, term, wildcards=True, columns=COLUMNS):
    test = lambda c: F.col(c).ilike(f"%{term}%") if wildcards else F.col(c).contains(term)
    return {r.id for r in df.filter(reduce(lambda a, b: a | b, map(test, columns))).collect()}


@pytest.fixture(scope="module")
def orgs(spark, small):
    return T.organizations(spark, small).select("id", *COLUMNS, "is_active")


@pytest.fixture
def index(spark, orgs, tmp_path):
    folder = str(tmp_path / "index")
    X.create_index(orgs, folder, "id", COLUMNS, buckets=8, slots=8)
    return folder


TERMS = ["Customer#000000001", "중앙로 1", "구", "00_01", "no such text", "중구%1", ".KR", "\\"]


def test_same_rows_as_a_scan(spark, orgs, index):
    rnd = random.Random(1)
    texts = [t for r in orgs.limit(20).collect() for t in (r.name, r.address, r.email) if t]
    cut = [t[i:i + rnd.randrange(3, 9)] for t in texts for i in [rnd.randrange(max(1, len(t) - 3))]][:4]
    for term in [*TERMS, *cut]:
        if term != "\\":
            got = [r.id for r in X.search(spark, index, term).collect()]
            assert len(got) == len(set(got)) and set(got) == scan(orgs, term), term
        assert {r.id for r in X.search(spark, index, term, wildcards=False).collect()} == scan(orgs, term, False), term
    assert {r.id for r in X.search(spark, index, "중앙로", ["address"]).collect()} == scan(orgs, "중앙로", columns=["address"])
    with pytest.raises(ValueError, match="not indexed"):
        X.search(spark, index, "중앙로", ["is_active"])


def test_updates_deletes_and_compaction(spark, orgs, index):
    table = {r.id: r for r in orgs.collect()}
    rnd = random.Random(2)
    schema = orgs.schema
    for step in range(3):
        ids = rnd.sample(sorted(table), 12)
        changed = [(i, f"새 이름 {step} {i}", table[i].address, None, True) for i in ids[:6]] + [(10_000 + step, "전혀 다른 곳", "부산 중앙로 9", "x@y.kr", None)]
        gone = [*ids[6:], ids[0], 999_999]  # one is changed too, one was never there
        if step == 1:
            changed = []
        X.update_index(spark, index, spark.createDataFrame(changed, schema) if changed else None, spark.createDataFrame([(i,) for i in gone], "id int"))
        for row in changed:
            table[row[0]] = schema_row(schema, row)
        for i in gone:
            table.pop(i, None)
        now = spark.createDataFrame([tuple(r) for r in table.values()], schema)
        assert {tuple(r) for r in X.current_rows(spark, index).collect()} == {tuple(r) for r in table.values()}
        for term in ("새 이름", "중앙로", "x@y"):
            assert {r.id for r in X.search(spark, index, term).collect()} == scan(now, term), (step, term)
        if step == 0:
            X.compact_index(spark, index)
            assert len(X._manifest(spark, index)["versions"]) == 1


def schema_row(schema, row):
    from pyspark.sql import Row

    return Row(**dict(zip(schema.names, row)))


def files(df):
    return sum("/rows/" in f for f in df.inputFiles())


def test_rare_terms_read_fewer_files(spark, orgs, index):
    rare, common = X.search(spark, index, "Customer#000000149"), X.search(spark, index, "Customer#")
    assert rare.count() == 1 and files(rare) == 1 < files(common) == 8
    assert X.search(spark, index, "no such text").count() == 0 and files(X.search(spark, index, "no such text")) == 0
    for df in (rare, common):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unfinished_writes_are_not_seen(spark, orgs, index):
    before = {tuple(r) for r in X.current_rows(spark, index).collect()}
    told = X._manifest(spark, index)
    X._write(orgs.limit(3).withColumn("__deleted", F.lit(True)), index, told, "left")  # no manifest follows
    assert {tuple(r) for r in X.current_rows(spark, index).collect()} == before


def test_nothing_and_nulls(spark, tmp_path):
    rows = [(1, None, ""), (2, "ab", "abc"), (3, "ABCD", None)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    X.create_index(df, str(tmp_path / "i"), "id", ["a", "b"], buckets=2, slots=2)
    assert {r.id for r in X.search(spark, str(tmp_path / "i"), "abc").collect()} == {2, 3}
    assert {r.id for r in X.search(spark, str(tmp_path / "i"), "abc", wildcards=False).collect()} == {2}
    X.create_index(df.limit(0), str(tmp_path / "e"), "id", ["a"])
    assert X.search(spark, str(tmp_path / "e"), "abc").count() == 0 and X.current_rows(spark, str(tmp_path / "e")).count() == 0
