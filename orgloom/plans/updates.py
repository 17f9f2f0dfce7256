"""New table versions after crawl results, patches, deletions and inserts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orgloom.functions import fixed_values as V
from orgloom.operators import updates as U
from orgloom.operators import views as VW
from orgloom.operators.versions import VersionedTable
from orgloom.session import checkpoint_root
from orgloom.sources import tables as T

from . import sqlparts as q
from .coverage import _CAT, _QUALITY, ORG_AS_OF, as_of_org
from .registry import query

c = F.col
W = U.WRITTEN
BASE = ("org", "found")
KEPT = ["id", *W, "ai_crawled", "last_crawled_at", "updated_at"]


def _tables(spark, d):
    return T.organizations(spark, d), T.view(spark, d, "found")


def _new(f: str, rule: str) -> str:
    return rule.format(n=f"f.{f}", o=f"o.{f}") + f" AS {f}"


_STAMP = "coalesce(o.ai_crawled OR f.id IS NOT NULL, o.ai_crawled) AS ai_crawled, CASE WHEN f.id IS NOT NULL THEN f.found_at ELSE o.last_crawled_at END AS last_crawled_at"
_AT = "CASE WHEN f.id IS NOT NULL THEN f.found_at ELSE o.updated_at END AS updated_at"
_JOIN = "FROM org o LEFT JOIN found f ON f.id = o.id"


@query("upsert_coalesce", f"SELECT o.id, {', '.join(_new(f, chr(99) + 'oalesce(nullif({n}, {e}), {o})'.replace('{e}', chr(39) * 2)) for f in W)}, {_STAMP}, {_AT} {_JOIN}", uses=BASE)
def upsert_coalesce(spark, d):
    return U.upsert_coalesce(*_tables(spark, d)).select(*KEPT)


@query("upsert_overwrite", f"SELECT o.id, {', '.join(_new(f, 'CASE WHEN f.id IS NOT NULL THEN {n} ELSE {o} END') for f in W)}, {_STAMP}, o.updated_at {_JOIN}", uses=BASE)
def upsert_overwrite(spark, d):
    return U.upsert_overwrite(*_tables(spark, d)).select(*KEPT)


_PREFIX = "^(02|" + "|".join(p for p in V.SAVE_PREFIXES if len(p) == 3) + ")"


def _save_ok(f: str) -> str:
    n = f"f.{f}"
    if f in ("phone", "fax"):
        dg = q.digits(n)
        return f"(length({dg}) BETWEEN 9 AND 11 AND regexp_matches({dg}, '{_PREFIX}'))"
    if f == "email":
        return f"regexp_matches(trim({n}), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$')"
    return f"(starts_with(trim({n}), 'http://') OR starts_with(trim({n}), 'https://'))"


def _take(f: str) -> str:
    return f"coalesce(NOT {q.blank('f.' + f)} AND {_save_ok(f)}, false)"


@query("upsert_validated", f"""
SELECT o.id, {', '.join(f'CASE WHEN {_take(f)} THEN trim(f.{f}) ELSE o.{f} END AS {f}' for f in W)}, {_STAMP}, o.updated_at,
  concat_ws(',', {', '.join(f"CASE WHEN {_take(f)} THEN '{f}' END" for f in ("homepage", "phone", "fax", "email"))}) AS changes {_JOIN}""", uses=BASE)
def upsert_validated(spark, d):
    return U.upsert_validated(*_tables(spark, d)).select(*KEPT, F.array_join("changes", ",").alias("changes"))


BY_NAME = f"""
WITH k AS (SELECT lower(trim(name)) AS nk, min(id) AS id FROM org GROUP BY 1),
r AS (SELECT f.*, k.id AS org_id FROM found f LEFT JOIN k ON k.nk = lower(trim(f.name)))
SELECT o.id, o.name, {', '.join(f'coalesce(r.{f}, o.{f}) AS {f}' for f in W)}, o.ai_crawled OR r.org_id IS NOT NULL AS ai_crawled FROM org o LEFT JOIN r ON r.org_id = o.id
UNION ALL SELECT NULL, name, {', '.join(W)}, true FROM r WHERE org_id IS NULL"""


@query("upsert_by_name", BY_NAME, uses=BASE)
def upsert_by_name(spark, d):
    return U.upsert_by_name(*_tables(spark, d))


def _fill(f: str) -> str:
    return f"coalesce({q.missing('o.' + f)} AND {q.filled('f.' + f)}, false)"


@query("fill_blank_only", f"""
SELECT o.id, {', '.join(f'CASE WHEN {_fill(f)} THEN f.{f} ELSE o.{f} END AS {f}' for f in W)},
  concat_ws(',', {', '.join(f"CASE WHEN {_fill(f)} THEN '{f}' END" for f in W)}) AS updated_fields {_JOIN}""", uses=BASE)
def fill_blank_only(spark, d):
    return U.fill_blank_only(*_tables(spark, d)).select("id", *W, F.array_join("updated_fields", ",").alias("updated_fields"))


@query("fill_phone_from_list", f"""
WITH l AS (SELECT id, list_filter([nullif(trim(fax), ''), nullif(trim(phone), ''), '02-555-0199'], lambda x: x IS NOT NULL) AS p FROM found)
SELECT o.id, CASE WHEN {q.blank('o.phone')} AND l.id IS NOT NULL THEN l.p[1] ELSE o.phone END AS phone,
  CASE WHEN {q.blank('o.phone')} AND l.id IS NOT NULL THEN array_to_string(l.p[2:], ',') ELSE '' END AS additional_phones FROM org o LEFT JOIN l ON l.id = o.id""", uses=BASE)
def fill_phone_from_list(spark, d):
    o, f = _tables(spark, d)
    lists = f.select("id", F.array_compact(F.array(F.nullif(F.trim("fax"), F.lit("")), F.nullif(F.trim("phone"), F.lit("")), F.lit("02-555-0199"))).alias("phones"))
    return U.fill_phone_from_list(o, lists).select("id", "phone", F.array_join("additional_phones", ",").alias("additional_phones"))


_RICHER = """json_merge_patch(CASE WHEN json_valid(o.crawling_data) THEN o.crawling_data ELSE '{}' END, '{"seen": {"by": ["a", 1, null], "deep": {"x": 1.5}}, "n": 7, "ok": true}')"""


@query("merge_json_metadata", f"""
WITH j AS (SELECT o.id, f.event_id, json_merge_patch({_RICHER}, json_object('last_enrichment', CAST(f.event_id AS VARCHAR), 'enrichment_source', 'crawler')) AS m
  FROM org o JOIN found f ON f.id = o.id)
SELECT id, len(json_keys(m)) AS n_keys, json_extract_string(m, '$.data_quality_grade') AS grade, json_extract_string(m, '$.validation_score') AS score,
  json_extract_string(m, '$.last_enrichment') AS last_enrichment, json_extract_string(m, '$.enrichment_source') AS enrichment_source,
  json_extract_string(m, '$.seen.by[0]') AS first, json_type(m, '$.seen.by[1]') = 'UBIGINT' AND json_type(m, '$.n') = 'UBIGINT' AS whole,
  json_type(m, '$.seen.by[2]') = 'NULL' AS empty, json_extract_string(m, '$.seen.deep.x') AS x, json_type(m, '$.ok') = 'BOOLEAN' AS truth FROM j""", uses=BASE)
def merge_json_metadata(spark, d):
    o, f = _tables(spark, d)
    added = F.create_map(F.lit("last_enrichment"), c("event_id").cast("string"), F.lit("enrichment_source"), F.lit("crawler"))
    tail = '"seen": {"by": ["a", 1, null], "deep": {"x": 1.5}}, "n": 7, "ok": true}'
    valid = F.try_parse_json("crawling_data").isNotNull()
    body = F.regexp_replace(F.trim("crawling_data"), r"\}$", "")
    richer = F.when(valid & (F.length(F.trim(body)) > 1), F.concat(body, F.lit(", " + tail))).otherwise("{" + tail)
    merged = o.join(f.select("id", "event_id"), "id").select("id", U.merge_json(richer, added).alias("j"))
    v = merged.select("id", "j", F.try_parse_json("j").alias("v"))
    at = lambda path, kind="string": F.try_variant_get("v", path, kind)
    of = lambda path: F.schema_of_variant(at(path, "variant"))
    return v.select(
        "id", F.size(F.json_object_keys("j")).cast("long").alias("n_keys"), at("$.data_quality_grade").alias("grade"), F.get_json_object("j", "$.validation_score").alias("score"),
        at("$.last_enrichment").alias("last_enrichment"), at("$.enrichment_source").alias("enrichment_source"), at("$.seen.by[0]").alias("first"),
        ((of("$.seen.by[1]") == "BIGINT") & (of("$.n") == "BIGINT")).alias("whole"), (of("$.seen.by[2]") == "VOID").alias("empty"),
        at("$.seen.deep.x").alias("x"), (of("$.ok") == "BOOLEAN").alias("truth"))


@query("patch_fields", f"""
SELECT o.id, coalesce(f.phone, o.phone) AS phone, coalesce(f.email, o.email) AS email, o.homepage,
  CASE WHEN f.id IS NOT NULL THEN {ORG_AS_OF} ELSE o.updated_at END AS updated_at {_JOIN}""", uses=BASE)
def patch_fields(spark, d):
    o, f = _tables(spark, d)
    return U.patch_fields(o, f, ["phone", "email"], at=as_of_org()).select("id", "phone", "email", "homepage", "updated_at")


@query("soft_delete", """
SELECT o.id, o.is_active AND f.id IS NULL AS is_active, coalesce(o.is_active AND f.id IS NOT NULL, false) AS deleted FROM org o LEFT JOIN found f ON f.id = o.id""", uses=BASE)
def soft_delete(spark, d):
    return U.soft_delete(*_tables(spark, d)).select("id", "is_active", "deleted")


@query("soft_delete_activities", f"""
SELECT o.id AS organization_id, 'NOTE' AS activity_type, 'deleted' AS subject, {ORG_AS_OF} AS created_at FROM org o JOIN found f ON f.id = o.id WHERE o.is_active""", uses=BASE)
def soft_delete_activities(spark, d):
    notes = U.deletion_activities(U.soft_delete(*_tables(spark, d)), as_of_org())
    return notes.select("organization_id", "activity_type", "subject", "created_at")


@query("insert_activity", f"""
SELECT * FROM activities UNION ALL SELECT NULL, id, 'NOTE', coalesce(email, ''), {ORG_AS_OF}, false FROM found""", uses=("activities", "found"))
def insert_activity(spark, d):
    new = T.view(spark, d, "found").select(c("id").alias("organization_id"), c("email").alias("subject"))
    return U.insert_activities(T.view(spark, d, "activities"), new, as_of_org())


def _got(f: str) -> str:
    return f"{q.blank('o.' + f)} AND NOT {q.blank('f.' + f)}"


@query("enrichment_result", f"""
SELECT o.id, concat_ws(',', {', '.join(f"CASE WHEN {_got(f)} THEN '{f}' END" for f in W)}) AS found,
  concat_ws(',', {', '.join(f"CASE WHEN {q.blank('o.' + f)} AND {q.blank('f.' + f)} THEN '{f}' END" for f in W)}) AS still_missing,
  {' OR '.join('(' + _got(f) + ')' for f in W)} AS success, f.processing_time FROM org o JOIN found f ON f.id = o.id""", uses=BASE)
def enrichment_result(spark, d):
    return U.enrichment_result(*_tables(spark, d)).select(
        "id", F.array_join("found", ",").alias("found"), F.array_join("still_missing", ",").alias("still_missing"), "success", "processing_time")


@query("enrichment_history_row", f"""
SELECT id, CAST(updated_at AS VARCHAR) AS enrichment_date, 'crawler' AS source, concat_ws(',', {', '.join(f"CASE WHEN NOT {q.blank(f)} THEN '{f}' END" for f in W)}) AS found_fields
FROM org WHERE ai_crawled""")
def enrichment_history_row(spark, d):
    fields = F.array_compact(F.array(*[F.when(F.trim(f) != "", F.lit(f)) for f in W]))
    stored = T.organizations(spark, d).filter("ai_crawled").withColumn("crawling_data", F.to_json(F.struct(
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("last_enrichment"), F.lit("crawler").alias("enrichment_source"), fields.alias("found_fields"))))
    return U.enrichment_history_rows(stored)


def _supp(f: str, conf: str) -> str:
    take = f"coalesce(({q.missing('o.' + f)} OR {conf} < 0.7) AND {q.filled('f.' + f)}, false)"
    return (f"CASE WHEN {take} THEN f.{f} ELSE o.{f} END AS {f}, CASE WHEN {take} THEN 'supplement' END AS {f}_source, "
            f"CASE WHEN {take} THEN 0.8E0 ELSE round({conf}, 6) END AS {f}_confidence")


@query("supplement_low_confidence", f"SELECT o.id, {_supp('phone', '((o.id % 10) / 10.0E0)')}, {_supp('fax', '((o.id % 7) / 7.0E0)')} {_JOIN}", uses=BASE)
def supplement_low_confidence(spark, d):
    o, f = _tables(spark, d)
    out = U.supplement_low_confidence(o, f, {"phone": c("id") % 10 / F.lit(10.0), "fax": c("id") % 7 / F.lit(7.0)})
    return out.select("id", *[x + s for x in ("phone", "fax") for s in ("", "_source", "_confidence")])


_ITEMS = """items AS (SELECT user_id AS id, event_id AS page_no, 0 AS pos, 'phone' AS kind, '02-' || CAST(1000 + event_id % 50 AS STRING) || '-5555' AS value, event_type AS keyword FROM events WHERE event_type = 'click'
  UNION ALL SELECT user_id, event_id, 0, 'fax', '02-' || CAST(1000 + event_id % 50 AS STRING) || '-5555', event_type FROM events
  UNION ALL SELECT user_id, event_id, 1, 'fax', '02-' || CAST(2000 + event_id % 50 AS STRING) || '-5555', event_type FROM events
  UNION ALL SELECT user_id, event_id, 0, 'email', 'm' || CAST(event_id AS STRING) || '@page.kr', event_type FROM events WHERE event_type = 'view')"""


def _items(spark, d):
    e = T.given(spark, d, "events").select(c("user_id").alias("id"), c("event_id").alias("page_no"), c("event_type").alias("keyword"))
    num = lambda base: F.concat(F.lit("02-"), (F.lit(base) + c("page_no") % 50).cast("string"), F.lit("-5555"))
    one = lambda df, kind, pos, value: df.select("id", "page_no", F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), value.alias("value"), "keyword")
    return (one(e.filter("keyword = 'click'"), "phone", 0, num(1000)).unionByName(one(e, "fax", 0, num(1000)))
            .unionByName(one(e, "fax", 1, num(2000)))
            .unionByName(one(e.filter("keyword = 'view'"), "email", 0, F.concat(F.lit("m"), c("page_no").cast("string"), F.lit("@page.kr")))))


@query("merge_contact_pages", f"""
WITH {_ITEMS}, s AS (SELECT *, page_no * 10 + pos AS ord FROM items),
p1 AS (SELECT id, arg_min(value, ord) AS v, arg_min(keyword, ord) AS k, min(page_no) AS page_no FROM s WHERE kind = 'phone' GROUP BY id),
e1 AS (SELECT id, arg_min(value, ord) AS v, arg_min(keyword, ord) AS k FROM s WHERE kind = 'email' GROUP BY id),
f1 AS (SELECT s.id, arg_min(s.value, ord) AS v, arg_min(s.keyword, ord) AS k FROM s JOIN org o ON o.id = s.id LEFT JOIN p1 ON p1.id = s.id
  WHERE s.kind = 'fax' AND s.value <> CASE WHEN {q.filled('o.phone')} THEN o.phone WHEN p1.page_no <= s.page_no THEN p1.v ELSE '' END GROUP BY s.id)
SELECT o.id, {', '.join(f"CASE WHEN {q.missing('o.' + f)} AND {t}.v IS NOT NULL THEN {t}.v ELSE o.{f} END AS {f}, CASE WHEN {q.missing('o.' + f)} AND {t}.v IS NOT NULL THEN 'contact_page_' || {t}.k END AS {f}_source" for f, t in (('phone', 'p1'), ('fax', 'f1'), ('email', 'e1')))}
FROM org o LEFT JOIN p1 ON p1.id = o.id LEFT JOIN f1 ON f1.id = o.id LEFT JOIN e1 ON e1.id = o.id""")
def merge_contact_pages(spark, d):
    return U.merge_contact_pages(T.organizations(spark, d), _items(spark, d))


@query("combine_result_metadata", f"""
SELECT o.id, {', '.join(f'coalesce(f.{f}, o.{f}) AS {f}' for f in W)}, CASE WHEN f.id IS NULL THEN 'pending' ELSE 'completed' END AS final_stage,
  coalesce(f.processing_time, 0.0E0) AS processing_time {_JOIN}""", uses=BASE)
def combine_result_metadata(spark, d):
    out = U.combine_result(*_tables(spark, d))
    return out.select("id", *W, F.get_json_object("processing_metadata", "$.final_stage").alias("final_stage"),
                      F.get_json_object("processing_metadata", "$.processing_time").cast("double").alias("processing_time"))


# --- the same changes on a versioned table: results come in batches, some rows are deleted, the last batch comes twice
def _versioned(spark, d) -> VersionedTable:
    orgs, found = _tables(spark, d)
    table = VersionedTable(spark, f"{checkpoint_root(spark)}/organizations-{uuid.uuid4().hex}", {"report": VW.report_view(), "status": VW.status_view()})
    table.create(orgs, "id", 8)
    table.update(found.filter("id % 3 <> 1"), U.upsert_coalesce, 0)
    for _ in range(2):
        table.update(found.filter("id % 3 = 1"), U.upsert_coalesce, 1)
    table.update(found.filter("id % 7 = 2").select("id"), U.soft_delete, 2)
    table.update(found.filter("id % 7 = 3").select("id"), lambda old, _: old.limit(0), 3)
    return table


_CHANGED = f"""changed AS (SELECT o.id, o.category, o.contact_status, o.is_active AND (f.id IS NULL OR f.id % 7 <> 2) AS is_active,
  {', '.join(f"coalesce(nullif(f.{x}, ''), o.{x}) AS {x}" for x in W)}, {_STAMP}, {_AT} {_JOIN} WHERE f.id IS NULL OR f.id % 7 <> 3)"""


def _over_changed(sql: str) -> str:
    return f"WITH {_CHANGED},\n{sql.strip()[5:]}".replace("FROM org WHERE", "FROM changed WHERE")


@query("versioned_updates", f"WITH {_CHANGED} SELECT id, is_active, {', '.join(KEPT[1:])} FROM changed", uses=BASE)
def versioned_updates(spark, d):
    return _versioned(spark, d).read().select("id", "is_active", *KEPT[1:])


@query("view_category_coverage", _over_changed(_CAT + "SELECT * FROM cov"), uses=BASE)
def view_category_coverage(spark, d):
    return VW.category_coverage(_versioned(spark, d).view("report"))


@query("view_quality_report", _over_changed(_QUALITY + "SELECT * FROM rep"), uses=BASE)
def view_quality_report(spark, d):
    return VW.quality_report(_versioned(spark, d).view("report"))


@query("view_dashboard", f"""WITH {_CHANGED} SELECT 'status' AS metric, contact_status AS key, count(*) AS value FROM changed WHERE is_active GROUP BY contact_status
UNION ALL SELECT 'organizations', '', count(*) FROM changed WHERE is_active""", uses=BASE)
def view_dashboard(spark, d):
    return VW.dashboard_organizations(_versioned(spark, d).view("status"))
