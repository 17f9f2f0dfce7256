"""Filters, searches, work queues, rights and picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from orgloom.functions import address as A
from orgloom.functions import fixed_values as V
from orgloom.functions import scoring as S
from orgloom.functions import web as W
from orgloom.functions.blank import is_filled, is_missing
from orgloom.operators import rank_index as RI
from orgloom.operators import ranking as R
from orgloom.operators import text_index as X
from orgloom.sources import tables as T

from . import sqlparts as q
from .coverage import ORG_AS_OF, as_of_org, scratch
from .registry import query

EVENTS_AS_OF = f"TIMESTAMP '{T.AS_OF_EVENTS}'"
KEEP = ["id", "name", "type", "category", "phone", "fax", "email", "homepage", "address", "priority"]
_KEEP = ", ".join(KEEP)


def as_of_events():
    return F.expr(f"TIMESTAMP_NTZ '{T.AS_OF_EVENTS}'")


@query("scan_table", "SELECT * FROM org")
def scan_table(spark, d):
    return T.organizations(spark, d)


@query("active_only", f"SELECT {_KEEP} FROM org WHERE is_active")
def active_only(spark, d):
    return T.active_organizations(spark, d).select(*KEEP)


@query("missing_any_contact", f"SELECT {_KEEP} FROM org WHERE is_active AND {q.any_missing()}")
def missing_any_contact(spark, d):
    return R.missing_any_contact(T.active_organizations(spark, d)).select(*KEEP)


@query("search_all_text_columns", f"""
SELECT {_KEEP} FROM org WHERE {' OR '.join(f"contains({c}, '33')" for c in KEEP[1:])} ORDER BY id LIMIT 10""")
def search_all_text_columns(spark, d):
    return R.search_text_columns(T.organizations(spark, d).select(*KEEP), "33", limit=10)


@query("search_all_text_columns_whole", f"""
SELECT {_KEEP} FROM org WHERE {' OR '.join(f"contains({c}, '33')" for c in KEEP[1:])}""")
def search_all_text_columns_whole(spark, d):
    return R.search_text_columns(T.organizations(spark, d).select(*KEEP), "33")


@query("has_complete_contact", f"""
SELECT id, {q.filled('phone')} AND {q.filled('fax')} AND {q.filled('email')} AS complete,
  {q.filled('phone')} AND {q.filled('email')} AS complete_now FROM org WHERE is_active""")
def has_complete_contact(spark, d):
    return T.active_organizations(spark, d).select(
        "id", (is_filled("phone") & is_filled("fax") & is_filled("email")).alias("complete"),
        (is_filled("phone") & is_filled("email")).alias("complete_now"))


_SEARCH = f"""is_active AND (name ILIKE '%00%' OR address ILIKE '%00%' OR email ILIKE '%00%') AND type = 'CHURCH' AND {q.any_missing()}
  AND created_at >= TIMESTAMP '1994-01-01 00:00:00' AND created_at <= TIMESTAMP '2001-01-01 00:00:00'"""


def _search(spark, d):
    return R.search_filter(
        T.organizations(spark, d), term="00", equals={"type": "CHURCH"}, missing_contacts=True,
        created_after="1994-01-01 00:00:00", created_before="2001-01-01 00:00:00")


@query("search_organizations", f"SELECT {_KEEP}, updated_at FROM org WHERE {_SEARCH} ORDER BY updated_at DESC NULLS FIRST, id LIMIT 20 OFFSET 20")
def search_organizations(spark, d):
    return R.page(_search(spark, d).select(*KEEP, "updated_at"), [F.desc_nulls_first("updated_at"), F.asc("id")], number=2, size=20)


_NOW = """now AS (SELECT id, CASE WHEN id % 10 = 3 THEN '새 이름 ' || id ELSE name END AS name, address, email FROM org WHERE id % 10 <> 7)"""


def _indexed(spark, d):
    """An index of all organizations, then a tenth of them renamed and a tenth deleted."""
    o = T.organizations(spark, d).select("id", "name", "address", "email")
    folder = scratch(spark, "index")
    X.create_index(o, folder, "id", ["name", "address", "email"], buckets=16, slots=16)
    renamed = o.filter("id % 10 = 3").withColumn("name", F.concat(F.lit("새 이름 "), "id"))
    X.update_index(spark, folder, renamed, o.filter("id % 10 = 7").select("id"))
    return folder


@query("search_indexed", f"""
WITH {_NOW} SELECT 'customer#00000001' AS term, * FROM now WHERE name ILIKE '%customer#00000001%' OR address ILIKE '%customer#00000001%' OR email ILIKE '%customer#00000001%'
UNION ALL SELECT '이름 1_3', * FROM now WHERE name ILIKE '%이름 1_3%' OR address ILIKE '%이름 1_3%' OR email ILIKE '%이름 1_3%'
UNION ALL SELECT '로 11', * FROM now WHERE contains(address, '로 11')""")
def search_indexed(spark, d):
    folder = _indexed(spark, d)
    found = [X.search(spark, folder, "customer#00000001"), X.search(spark, folder, "이름 1_3"), X.search(spark, folder, "로 11", ["address"], wildcards=False)]
    named = [f.select(F.lit(t).alias("term"), "*") for t, f in zip(("customer#00000001", "이름 1_3", "로 11"), found)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("pagination_totals", f"""
SELECT 2 AS page, 20 AS per_page, count(*) AS total_count, CAST(ceil(count(*) / 20.0E0) AS BIGINT) AS total_pages FROM org WHERE {_SEARCH}""")
def pagination_totals(spark, d):
    return R.page_totals(_search(spark, d), number=2, size=20)


_RECRAWL = f"""is_active AND (NOT ai_crawled OR last_crawled_at IS NULL OR last_crawled_at < {ORG_AS_OF} - INTERVAL 30 DAY
  OR {q.any_missing(('phone', 'fax', 'homepage', 'email'))})"""


@query("needs_recrawl", f"SELECT id, name, last_crawled_at FROM org WHERE {_RECRAWL}")
def needs_recrawl(spark, d):
    return R.needs_recrawl(T.organizations(spark, d), as_of_org()).select("id", "name", "last_crawled_at")


@query("recrawl_queue", f"""
SELECT id, name, priority, {q.rank('priority', 4)} AS rank, last_crawled_at FROM org WHERE {_RECRAWL} ORDER BY rank, last_crawled_at NULLS FIRST, id""")
def recrawl_queue(spark, d):
    return R.recrawl_queue(T.organizations(spark, d), as_of_org()).select("id", "name", "priority", "rank", "last_crawled_at")


@query("recent_window", f"""
SELECT 'organizations' AS source, id AS key FROM org WHERE updated_at >= {ORG_AS_OF} - INTERVAL 30 DAY
UNION ALL SELECT 'metrics', event_id FROM metrics WHERE start_time >= {EVENTS_AS_OF} - INTERVAL 60 MINUTE
UNION ALL SELECT 'health', event_id FROM health WHERE ts >= {EVENTS_AS_OF} - INTERVAL 24 HOUR""", uses=("org", "metrics", "health"))
def recent_window(spark, d):
    o = R.recent(T.organizations(spark, d), "updated_at", as_of_org(), "30 DAYS").select(F.lit("organizations").alias("source"), F.col("id").alias("key"))
    m = R.recent(T.view(spark, d, "metrics"), "start_time", as_of_events(), "60 MINUTES").select(F.lit("metrics").alias("source"), F.col("event_id").alias("key"))
    h = R.recent(T.view(spark, d, "health"), "ts", as_of_events(), "24 HOURS").select(F.lit("health").alias("source"), F.col("event_id").alias("key"))
    return o.unionByName(m).unionByName(h)


_LEVEL = "CASE role " + " ".join(f"WHEN '{r}' THEN {v['level']}" for r, v in V.ROLES.items()) + " ELSE 0 END"


@query("viewable_users", f"""
SELECT *, {_LEVEL} AS level FROM users WHERE role IN {q.in_list(V.ROLES['팀장']['view'])} ORDER BY level DESC, rank_value DESC, id""", uses=("users",))
def viewable_users(spark, d):
    return R.viewable_users(T.view(spark, d, "users"), 2, "팀장")


@query("viewable_users_lowest_role", f"SELECT *, {_LEVEL} AS level FROM users WHERE id = 4", uses=("users",))
def viewable_users_lowest_role(spark, d):
    return R.viewable_users(T.view(spark, d, "users"), 4, "일반사원")


def _allowed(right: str) -> str:
    return "CASE a.role " + " ".join(
        f"WHEN '{r}' THEN {'b.role IN ' + q.in_list(v[right]) if v[right] else 'false'}" for r, v in V.ROLES.items()) + " ELSE false END"


@query("permission_matrix", f"""
SELECT a.role AS actor_role, b.role AS target_role, a.id = b.id AS same_id, count(*) AS n_pairs,
  bool_or(a.id = b.id OR a.role = '{V.TOP_ROLE}' OR {_allowed('view')}) AS can_view,
  bool_or(a.id = b.id OR a.role = '{V.TOP_ROLE}' OR {_allowed('manage')}) AS can_manage,
  bool_or(a.role = '{V.TOP_ROLE}' OR {_allowed('create')}) AS can_create,
  bool_or(CASE WHEN a.role = '{V.TOP_ROLE}' THEN b.role <> '{V.TOP_ROLE}' ELSE {_allowed('delete')} END) AS can_delete
FROM users a CROSS JOIN users b GROUP BY 1, 2, 3""", uses=("users",))
def permission_matrix(spark, d):
    return R.permission_matrix(T.view(spark, d, "users"))


_HOST = r"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_UNWRAP = "CASE WHEN starts_with(link, '/url?q=') THEN split_part(substr(link, 8), '&', 1) ELSE link END"


@query("homepage_domain_filter", f"""
WITH l AS (SELECT id, CASE WHEN id % 2 = 0 THEN '/url?q=' || homepage || '&sa=U' ELSE homepage END AS link FROM org WHERE {q.filled('homepage')}),
u AS (SELECT id, {_UNWRAP} AS url FROM l)
SELECT id, url FROM u WHERE NOT {q.contains_any(_HOST.format(u='url'), V.SEARCH_EXCLUDED_DOMAINS)}""")
def homepage_domain_filter(spark, d):
    links = T.organizations(spark, d).filter(is_filled("homepage")).select("id", F.when(
        F.col("id") % 2 == 0, F.concat(F.lit("/url?q="), "homepage", F.lit("&sa=U"))).otherwise(F.col("homepage")).alias("link"))
    return links.filter(W.homepage_allowed("link")).select("id", W.unwrap_redirect("link").alias("url"))


@query("homepage_domain_filter_pages", f"""
SELECT page_id, {_HOST.format(u='url')} AS host FROM pages WHERE NOT {q.contains_any(_HOST.format(u='url'), V.EXCLUDED_DOMAINS)}""", uses=())
def homepage_domain_filter_pages(spark, d):
    pages = T.given(spark, d, "pages").select("page_id", "url")
    return pages.filter(W.homepage_allowed("url", V.EXCLUDED_DOMAINS)).select("page_id", W.url_host("url").alias("host"))


_GRADE_VALUE = "CASE {g} WHEN 'A' THEN 1.0E0 WHEN 'B' THEN 0.8E0 WHEN 'C' THEN 0.6E0 WHEN 'D' THEN 0.4E0 WHEN 'E' THEN 0.2E0 ELSE 0.0E0 END"


@query("satisfactory_grade", f"""
WITH g AS (SELECT id, json_extract_string(crawling_data, '$.data_quality_grade') AS grade FROM org)
SELECT id, grade FROM g WHERE grade IS NOT NULL AND {_GRADE_VALUE.format(g='grade')} >= 0.6""")
def satisfactory_grade(spark, d):
    g = T.organizations(spark, d).select("id", S.grade_of_json().alias("grade"))
    return g.filter(F.col("grade").isNotNull() & (S.grade_value(F.col("grade")) >= 0.6))


@query("missing_fax_with_homepage", f"SELECT id, name, homepage FROM org WHERE {q.missing('fax')} AND {q.filled('homepage')}")
def missing_fax_with_homepage(spark, d):
    return T.organizations(spark, d).filter(is_missing("fax") & is_filled("homepage")).select("id", "name", "homepage")


@query("parse_eligibility", """
SELECT id, CASE WHEN homepage LIKE 'http://%' OR homepage LIKE 'https://%' THEN 'parse' ELSE 'no_homepage' END AS status FROM org""")
def parse_eligibility(spark, d):
    h = F.col("homepage")
    ok = F.coalesce(h.startswith("http://") | h.startswith("https://"), F.lit(False))
    return T.organizations(spark, d).select("id", F.when(ok, "parse").otherwise("no_homepage").alias("status"))


@query("recent_results", f"""
SELECT id, name, category, phone, email, updated_at, {q.filled('phone')} AND {q.filled('email')} AS has_complete_contact
FROM org WHERE is_active ORDER BY updated_at DESC NULLS FIRST, id LIMIT 5""")
def recent_results(spark, d):
    return R.recent_results(T.active_organizations(spark, d))


@query("missing_contacts_list", f"""
WITH m AS (SELECT id, name, priority, updated_at, {q.missing_fields()} AS mf FROM org WHERE is_active AND {q.any_missing()}
  ORDER BY {q.missing_count()} DESC, priority ASC NULLS LAST, updated_at DESC NULLS FIRST, id)
SELECT id, name, priority, updated_at, array_to_string(mf, ',') AS missing_fields, CAST(len(mf) AS INTEGER) AS missing_count FROM m""")
def missing_contacts_list(spark, d):
    return R.missing_contacts_list(T.active_organizations(spark, d)).select(
        "id", "name", "priority", "updated_at", F.array_join("missing_fields", ",").alias("missing_fields"), "missing_count")


_CAND = f"""
WITH c AS (SELECT id, name, priority, updated_at, {q.missing_count()} AS missing_count, {q.missing_fields()} AS mf,
  CASE priority WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS rank FROM org WHERE is_active AND {q.any_missing()}),
s AS (SELECT *, CASE priority WHEN 'HIGH' THEN 3.0E0 WHEN 'MEDIUM' THEN 2.0E0 ELSE 1.0E0 END + missing_count * 0.5E0
  + CASE WHEN date_diff('microsecond', updated_at, {ORG_AS_OF}) >= 31 * 86400000000 THEN 1.0E0 ELSE 0.0E0 END AS score FROM c)
SELECT id, name, rank, missing_count, array_to_string(mf, ',') AS missing_fields,
  CASE WHEN score >= 5 THEN 'URGENT' WHEN score >= 3 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS enrichment_priority FROM s
"""


def _candidates(spark, d, limit):
    return R.enrichment_candidates(T.active_organizations(spark, d), as_of_org(), limit=limit).select(
        "id", "name", "rank", "missing_count", F.array_join("missing_fields", ",").alias("missing_fields"), "enrichment_priority")


@query("enrichment_candidates", _CAND)
def enrichment_candidates(spark, d):
    return _candidates(spark, d, None)


@query("enrichment_candidates_page", f"""
SELECT {_KEEP}, updated_at FROM org WHERE is_active AND {q.any_missing()} AND priority = 'HIGH' ORDER BY updated_at DESC NULLS FIRST, id LIMIT 50 OFFSET 50""")
def enrichment_candidates_page(spark, d):
    rows = R.missing_any_contact(T.active_organizations(spark, d)).filter(F.col("priority") == "HIGH")
    return R.page(rows.select(*KEEP, "updated_at"), [F.desc_nulls_first("updated_at"), F.asc("id")], number=2, size=50)


@query("enrichment_candidates_ranked_pages", f"""
WITH c AS (SELECT {_KEEP}, updated_at, row_number() OVER (ORDER BY updated_at DESC NULLS FIRST, id) - 1 AS place FROM org WHERE is_active AND {q.any_missing()})
SELECT CAST(place // 50 + 1 AS INTEGER) AS page, * EXCLUDE (place) FROM c WHERE place // 50 + 1 IN (1, 7) OR place // 50 = (SELECT max(place) FROM c) // 50""")
def enrichment_candidates_ranked_pages(spark, d):
    """The first, the seventh and the last page of all candidates, from a stored rank index."""
    rows = R.missing_any_contact(T.active_organizations(spark, d)).select(*KEEP, "updated_at")
    folder = scratch(spark, "ranks")
    RI.create_rank_index(rows, folder, [("updated_at", True), ("id", False)], rows_per_range=200)
    last = -(-RI.ranked_total(spark, folder) // 50)
    pages = [RI.ranked_page(spark, folder, n, 50).select(F.lit(n).alias("page"), "*") for n in sorted({1, 7, last})]
    return reduce(lambda a, b: a.unionByName(b), pages)


@query("enrichment_requests", f"""
WITH c AS (SELECT id, name, {q.missing_fields()} AS mf FROM org WHERE is_active AND {q.any_missing()}
  ORDER BY CASE priority WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, updated_at DESC NULLS FIRST, id)
SELECT id, name, array_to_string(mf, ',') AS missing_fields FROM c WHERE len(mf) > 0""")
def enrichment_requests(spark, d):
    return R.enrichment_requests(T.active_organizations(spark, d)).select("id", "name", F.array_join("missing_fields", ",").alias("missing_fields"))


# --- homepage candidates: every page offers itself to the organization with its number
@query("best_homepage", f"""
WITH c AS (SELECT page_id % 97 AS org_id, page_id AS seq, url,
  CASE WHEN starts_with(url, 'https://') THEN 0.9E0 WHEN starts_with(url, 'http://') THEN 0.7E0 ELSE 0.0E0 END AS confidence FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY confidence DESC, seq) AS rn FROM c)
SELECT org_id, seq, url, confidence FROM r WHERE rn = 1""")
def best_homepage(spark, d):
    c = T.given(spark, d, "pages").select(
        (F.col("page_id") % 97).alias("org_id"), F.col("page_id").alias("seq"), "url", W.url_confidence("url").alias("confidence"))
    return R.best_homepage(c)


def fits_region_sql(c: str) -> str:
    a = f"({q.area(q.digits(c))})"
    return (f"(CASE WHEN NOT {q.filled(c)} OR NOT {q.filled('address')} THEN true WHEN {a} IS NULL THEN false "
            f"ELSE coalesce({a} = {q.first_contained('address', V.REGION_NAMES, lambda p: p[1])}, true) END)")


PICKS = """picks AS (SELECT id, phone, address, list_filter([fax, phone], lambda x: x IS NOT NULL) AS phones,
  list_filter([phone, fax, '02-555-0199'], lambda x: x IS NOT NULL) AS faxes FROM org)"""


def picks(spark, d):
    return T.organizations(spark, d).select(
        "id", "phone", "address", F.array_compact(F.array("fax", "phone")).alias("phones"),
        F.array_compact(F.array("phone", "fax", F.lit("02-555-0199"))).alias("faxes"))


@query("best_phone", f"""
WITH {PICKS}, e AS (SELECT id, address, unnest(phones) AS x, generate_subscripts(phones, 1) AS pos FROM picks),
f AS (SELECT id, arg_min(x, pos) AS x FROM e WHERE {fits_region_sql('x')} GROUP BY id)
SELECT p.id, coalesce(f.x, p.phones[1]) AS best_phone FROM picks p LEFT JOIN f ON f.id = p.id""")
def best_phone(spark, d):
    return picks(spark, d).select("id", R.best_phone(F.col("phones"), F.col("address")).alias("best_phone"))


@query("best_fax", f"""
WITH {PICKS}, e AS (SELECT id, phone, unnest(faxes) AS x, generate_subscripts(faxes, 1) AS pos FROM picks),
f AS (SELECT id, arg_min(x, pos) AS x FROM e WHERE NOT (x <> '' AND coalesce(phone, '') <> '' AND {q.digits('x')} = coalesce({q.digits('phone')}, '?')) GROUP BY id)
SELECT p.id, f.x AS best_fax FROM picks p LEFT JOIN f ON f.id = p.id""")
def best_fax(spark, d):
    return picks(spark, d).select("id", R.best_fax(F.col("faxes"), F.col("phone")).alias("best_fax"))


@query("first_valid_fax", f"""
WITH {PICKS}, e AS (SELECT id, phone, address, unnest(faxes) AS fax, generate_subscripts(faxes, 1) AS pos FROM picks),
n0 AS (SELECT *, {q.normalize_groups('fax')} AS fn, {q.normalize_groups('phone')} AS pn FROM e),
n1 AS (SELECT *, {q.digits('fn')} AS fd, {q.digits('pn')} AS pd FROM n0),
f AS (SELECT id, arg_min(fax, pos) AS x FROM n1 WHERE coalesce((CASE WHEN NOT {q.filled('fax')} THEN false ELSE {q.valid_prefix('fn')}
  AND (CASE WHEN {q.filled('phone')} THEN fn <> pn AND ({q.area_len('fd')}) = ({q.area_len('pd')}) AND NOT {q.too_similar('fd', 'pd')} ELSE true END)
  AND {q.fits_address('fn', 'address')} END), false) GROUP BY id)
SELECT p.id, f.x AS fax FROM picks p LEFT JOIN f ON f.id = p.id""")
def first_valid_fax(spark, d):
    return picks(spark, d).select("id", R.first_valid_fax(F.col("faxes"), F.col("phone"), F.col("address")).alias("fax"))


_SHORT = q.first_contained("address", V.REGION_CODES, other="''")


@query("search_query_plan", f"""
WITH s AS (SELECT id, name, phone, {_SHORT} AS region FROM org WHERE {q.filled('name')} AND {q.filled('address')})
SELECT id, name || ' 전화번호' AS query, 'phone' AS kind, 1 AS priority FROM s WHERE {q.filled('phone')}
UNION ALL SELECT id, name || ' 팩스번호', 'fax', 2 FROM s UNION ALL SELECT id, region || ' ' || name || ' 전화번호', 'phone', 3 FROM s WHERE region <> ''
UNION ALL SELECT id, name || ' 홈페이지', 'homepage', 4 FROM s UNION ALL SELECT id, name || ' 이메일', 'email', 5 FROM s""")
def search_query_plan(spark, d):
    return R.search_query_plan(T.organizations(spark, d))


def region_city_sql(city: bool) -> str:
    tails = {"시군": r"\s+(\S+시|\S+군)", "구": r"\s+(\S+구)", "시": r"\s+(\S+시)", "": ""}
    parts = []
    for names, kind in V.REGION_CITY_RULES:
        p = f"({names}){tails[kind]}"
        value = f"regexp_extract(address, '{p}', 1)" + (f" || ' ' || regexp_extract(address, '{p}', 2)" if city and kind else "")
        parts.append(f"WHEN regexp_matches(address, '{p}') THEN {value}")
    return "CASE " + " ".join(parts) + " ELSE '' END"


def region_of_phone_sql() -> str:
    name = q.area_name(f"({q.area_len(q.digits('phone'))})", "''")
    return (f"(CASE WHEN NOT {q.filled('phone')} THEN CASE WHEN {q.filled('address')} THEN {region_city_sql(False)} ELSE '' END "
            f"WHEN {name} IN ('핸드폰', '인터넷전화', '') AND {q.filled('address')} THEN {region_city_sql(False)} ELSE {name} END)")


@query("scenario_plan", f"""
WITH s AS (SELECT *, CASE WHEN {q.filled('address')} THEN 2 WHEN NOT {q.blank('phone')} THEN 3 ELSE 1 END AS scenario FROM org)
SELECT id, scenario, CASE scenario WHEN 2 THEN {region_city_sql(True)} WHEN 3 THEN {region_of_phone_sql()} ELSE '' END AS region FROM s""")
def scenario_plan(spark, d):
    return R.scenario_plan(T.organizations(spark, d))


@query("bounded_history", """
SELECT * FROM (SELECT 'metrics' AS source, event_id, start_time AS at FROM metrics ORDER BY start_time DESC, event_id DESC LIMIT 10000)
UNION ALL SELECT * FROM (SELECT 'health', event_id, ts FROM health ORDER BY ts DESC, event_id DESC LIMIT 100)""", uses=("metrics", "health"))
def bounded_history(spark, d):
    m = R.newest(T.view(spark, d, "metrics").select(F.lit("metrics").alias("source"), "event_id", F.col("start_time").alias("at")), 10000, [F.desc("at"), F.desc("event_id")])
    h = R.newest(T.view(spark, d, "health").select(F.lit("health").alias("source"), "event_id", F.col("ts").alias("at")), 100, [F.desc("at"), F.desc("event_id")])
    return m.unionByName(h)
