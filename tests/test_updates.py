"""Invariants of the update jobs."""

import json

import pytest
from pyspark.sql import functions as F

from orgloom.operators import matching as M
from orgloom.operators import updates as U
from orgloom.sources import tables as T


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_upserts_twice_equal_once(spark, small):
    orgs, found = T.organizations(spark, small), T.view(spark, small, "found")
    for job in (U.upsert_coalesce, U.upsert_overwrite):
        once = job(orgs, found)
        assert same(once, job(once, found)), job.__name__
    once = U.upsert_validated(orgs, found).drop("changes")
    assert same(once, U.upsert_validated(once, found).drop("changes"))


def test_rows_are_kept(spark, small):
    orgs, found = T.organizations(spark, small), T.view(spark, small, "found")
    for job in (U.upsert_coalesce, U.upsert_overwrite, U.upsert_validated, U.fill_blank_only):
        assert job(orgs, found).count() == orgs.count()


def test_merge_json_replaces_broken_text(spark):
    df = spark.createDataFrame([('{"a": "1", "b": "2"}',), ("{broken",), (None,)], "j string")
    got = [json.loads(r[0]) for r in df.select(U.merge_json(F.col("j"), F.create_map(F.lit("b"), F.lit("3")))).collect()]
    assert got == [{"a": "1", "b": "3"}, {"b": "3"}, {"b": "3"}]


def test_import_outcomes_add_up(spark, small):
    from orgloom.plans.matching import sheet

    orgs, rows = T.organizations(spark, small), sheet(spark, small)
    out = M.import_rows(orgs, rows).groupBy("outcome").count().collect()
    n = {r.outcome: r["count"] for r in out}
    assert n["updated"] + n.get("unchanged", 0) == orgs.count()
    pairs = rows.select("name", "address").distinct().count()
    assert n["inserted"] == pairs - orgs.filter("address is not null").select("name", "address").distinct().count()


def test_deleting_is_stable(spark, small):
    orgs, found = T.organizations(spark, small), T.view(spark, small, "found")
    gone = U.soft_delete(orgs, found)
    assert U.soft_delete(gone.drop("deleted"), found).filter("deleted").isEmpty()
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    assert U.deletion_activities(gone, at).count() == gone.filter("deleted").count()


def test_contact_pages_phone_known_so_far(spark):
    orgs = spark.createDataFrame([(1, None, None, None)], "id long, phone string, fax string, email string")
    items = spark.createDataFrame([
        (1, 1, 0, "fax", "02-1", "a"), (1, 2, 0, "phone", "02-1", "b"), (1, 3, 0, "fax", "02-9", "c"), (1, 3, 0, "email", "e@x.kr", "c")],
        "id long, page_no int, pos int, kind string, value string, keyword string")
    r = U.merge_contact_pages(orgs, items).first()
    # page 1 is read before any phone is known, so its fax is taken although page 2 calls it a phone
    assert (r.phone, r.phone_source, r.fax, r.fax_source, r.email) == ("02-1", "contact_page_b", "02-1", "contact_page_a", "e@x.kr")


def test_canonical_json_matches_sorted_dump(spark):
    rows = [("x\"y\\z\n", 3, "가나"), ("", None, None)]
    df = spark.createDataFrame(rows, "b string, a int, c string")
    want = [json.dumps({"a": a, "b": b, "c": c}, sort_keys=True, ensure_ascii=False) for b, a, c in rows]
    assert [r[0] for r in df.select(M.canonical_json(["b", "a", "c"])).collect()] == want


@pytest.mark.parametrize("stored, want", [
    ('{"a":{"b":1},"k":[1,2],"x":5,"y":0.0,"s":"5","t":true,"z":null,"q":"a\\"b\\\\"}', {"a": {"b": 1}, "k": [1, 2], "x": 5, "y": 0.0, "s": "5", "t": True, "z": None, "q": 'a"b\\'}),
    ('{"new":[1],"o":{}}', {"o": {}}), ("not json", {}), ("[1]", {}), (None, {}), ("{}", {})])
def test_merged_json_keeps_types(spark, stored, want):
    row = spark.createDataFrame([(stored,)], "j string").select(U.merge_json(F.col("j"), F.create_map(F.lit("new"), F.lit("v\n"))).alias("j")).first()
    assert json.loads(row.j) == want | {"new": "v\n"}
