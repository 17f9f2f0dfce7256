"""Joins, deduplication, set operations and comparisons of result sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from orgloom.functions import scoring as S
from orgloom.functions.blank import is_filled
from orgloom.operators import matching as M
from orgloom.operators import similarity as SM
from orgloom.sources import tables as T

from . import sqlparts as q
from .coverage import NESTED, nested_contacts
from .registry import query
from .rules import RELATION, points, _PTS

c = F.col

# a second file of the same organizations: other spelling, later copies, other numbers
_SECOND = """second AS (SELECT upper(name) AS name, fax AS phone, phone AS fax, email, id AS seq FROM org
  UNION ALL SELECT name || ' ', '02-700-0000', '02-700-0001', 'later@copy.kr', id + 1000000 FROM org)"""


def second_file(spark, d):
    o = T.organizations(spark, d)
    a = o.select(F.upper("name").alias("name"), c("fax").alias("phone"), c("phone").alias("fax"), "email", c("id").alias("seq"))
    b = o.select(F.concat("name", F.lit(" ")).alias("name"), F.lit("02-700-0000").alias("phone"), F.lit("02-700-0001").alias("fax"),
                 F.lit("later@copy.kr").alias("email"), (c("id") + 1000000).alias("seq"))
    return a.unionByName(b)


@query("merge_with_validation", f"""
WITH {_SECOND}, s1 AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY seq) AS rn FROM second),
s2 AS (SELECT lower(trim(name)) AS k, phone, fax, email FROM s1 WHERE rn = 1)
SELECT o.id, o.name, CASE WHEN {q.blank('o.phone')} AND s.k IS NOT NULL THEN s.phone ELSE o.phone END AS phone,
  CASE WHEN {q.blank('o.fax')} AND s.k IS NOT NULL THEN s.fax ELSE o.fax END AS fax,
  CASE WHEN {q.blank('o.email')} AND s.k IS NOT NULL THEN s.email ELSE o.email END AS email,
  CASE WHEN s.k IS NOT NULL THEN 'matched' ELSE 'primary_only' END AS merge_status
FROM org o LEFT JOIN s2 s ON s.k = lower(trim(o.name))""")
def merge_with_validation(spark, d):
    o = T.organizations(spark, d).select("id", "name", "phone", "fax", "email")
    return M.merge_with_validation(o, second_file(spark, d), ["phone", "fax", "email"])


@query("activities_of_org", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY created_at DESC, id DESC) AS rank FROM activities)
SELECT r.organization_id, r.id, r.activity_type, r.subject, r.created_at, r.is_completed, CAST(r.rank AS INTEGER) AS rank, o.name AS organization_name
FROM r JOIN org o ON o.id = r.organization_id WHERE rank <= 10""", uses=("org", "activities"))
def activities_of_org(spark, d):
    return M.activities_of_org(T.view(spark, d, "activities"), T.organizations(spark, d), 10)


@query("result_to_org_by_name", """
SELECT f.id AS result_id, f.event_id, f.name, f.phone, k.id AS org_id, CASE WHEN k.id IS NULL THEN 'insert' ELSE 'update' END AS action
FROM found f LEFT JOIN (SELECT lower(trim(name)) AS nk, min(id) AS id FROM org GROUP BY 1) k ON k.nk = lower(trim(f.name))""", uses=("org", "found"))
def result_to_org_by_name(spark, d):
    return M.results_to_orgs(T.view(spark, d, "found"), T.organizations(spark, d)).select(
        c("id").alias("result_id"), "event_id", "name", "phone", "org_id", "action")


# sheet rows: each organization twice (later row partly blank) plus one new pair per organization
_SHEET = """sheet AS (SELECT name, address, fax AS phone, '' AS fax, homepage, id * 10 AS seq FROM org
  UNION ALL SELECT name, address, '', phone, NULL, id * 10 + 1 FROM org
  UNION ALL SELECT name || ' 2', '서울 강남구 ' || CAST(id AS VARCHAR), phone, fax, homepage, id * 10 + 2 FROM org)"""


def sheet(spark, d):
    o = T.organizations(spark, d)
    none = F.lit(None).cast("string")
    return (
        o.select("name", "address", c("fax").alias("phone"), F.lit("").alias("fax"), "homepage", (c("id") * 10).alias("seq"))
        .unionByName(o.select("name", "address", F.lit("").alias("phone"), c("phone").alias("fax"), none.alias("homepage"), (c("id") * 10 + 1).alias("seq")))
        .unionByName(o.select(F.concat("name", F.lit(" 2")).alias("name"), F.concat(F.lit("서울 강남구 "), c("id").cast("string")).alias("address"),
                              "phone", "fax", "homepage", (c("id") * 10 + 2).alias("seq"))))


_LAST = "arg_max({f}, seq) FILTER (WHERE {f} IS NOT NULL AND {f} <> '') AS new_{f}"


@query("import_rows_name_address", f"""
WITH {_SHEET}, folded AS (SELECT name, address, {', '.join(_LAST.format(f=f) for f in ('phone', 'fax', 'homepage'))} FROM sheet GROUP BY name, address),
target AS (SELECT name, address, min(id) AS target_id FROM org WHERE name IS NOT NULL AND address IS NOT NULL GROUP BY name, address),
m AS (SELECT f.*, t.target_id FROM folded f LEFT JOIN target t ON t.name = f.name AND t.address = f.address)
SELECT o.id, o.name, o.address, coalesce(m.new_phone, o.phone) AS phone, coalesce(m.new_fax, o.fax) AS fax, coalesce(m.new_homepage, o.homepage) AS homepage,
  CASE WHEN m.target_id IS NULL THEN 'unchanged' ELSE 'updated' END AS outcome FROM org o LEFT JOIN m ON m.target_id = o.id
UNION ALL SELECT NULL, name, address, new_phone, new_fax, new_homepage, 'inserted' FROM m WHERE target_id IS NULL""")
def import_rows_name_address(spark, d):
    return M.import_rows(T.organizations(spark, d), sheet(spark, d))


_PAIR = """CASE WHEN trim(coalesce(address, '')) <> '' THEN 'a' ELSE 'p' END AS branch, trim(coalesce(name, '')) AS kname,
  CASE WHEN trim(coalesce(address, '')) <> '' THEN trim(address) ELSE trim(coalesce(phone, '')) END AS kvalue"""
_STORED = """stored AS (SELECT 'a' AS branch, name, address AS value FROM org WHERE is_active UNION ALL SELECT 'p', name, phone FROM org WHERE is_active)"""
_NOT_STORED = "NOT EXISTS (SELECT 1 FROM stored s WHERE s.branch = i.branch AND s.name = i.kname AND s.value = i.kvalue)"


@query("dedupe_against_existing", f"""
WITH {_SHEET}, {_STORED}, i AS (SELECT *, {_PAIR} FROM sheet)
SELECT name, address, phone, fax, homepage, seq FROM i WHERE {_NOT_STORED}""")
def dedupe_against_existing(spark, d):
    return M.dedupe_against_existing(sheet(spark, d), T.active_organizations(spark, d))


@query("dedupe_against_existing_name", f"""
WITH {_SHEET} SELECT name, address, phone, fax, homepage, seq FROM sheet i WHERE NOT EXISTS (SELECT 1 FROM org o WHERE o.is_active AND o.name = i.name)""")
def dedupe_against_existing_name(spark, d):
    return M.dedupe_by_name(sheet(spark, d), T.active_organizations(spark, d))


@query("dedupe_incoming", f"""
WITH {_SHEET}, {_STORED}, k AS (SELECT *, {_PAIR} FROM sheet WHERE trim(name) <> ''),
i AS (SELECT *, row_number() OVER (PARTITION BY branch, kname, kvalue ORDER BY seq) AS rn FROM k)
SELECT name, address, phone, fax, homepage, seq FROM i WHERE rn = 1 AND {_NOT_STORED}""")
def dedupe_incoming(spark, d):
    return M.dedupe_incoming(sheet(spark, d), T.active_organizations(spark, d))


@query("extraction_results_back", f"""
SELECT o.id, CASE WHEN {q.blank('f.fax')} THEN o.fax ELSE trim(f.fax) END AS fax, CASE WHEN {q.blank('f.phone')} THEN o.phone ELSE trim(f.phone) END AS phone
FROM org o LEFT JOIN found f ON f.id = o.id""", uses=("org", "found"))
def extraction_results_back(spark, d):
    o = T.organizations(spark, d).select("id", "fax", "phone")
    return M.write_back(o, T.view(spark, d, "found"), ["fax", "phone"])


# two result sets for the same organizations
_GRADED = (f"CASE WHEN {_PTS} >= 90 THEN 'A' WHEN {_PTS} >= 70 THEN 'B' WHEN {_PTS} >= 50 THEN 'C' WHEN {_PTS} >= 30 THEN 'D' WHEN {_PTS} >= 10 THEN 'E' ELSE 'F' END")
_RUNS = f"""ra AS (SELECT id, phone, fax, email, homepage, {_GRADED} AS grade, (id % 10) / 10.0E0 AS confidence, (id % 13) / 2.0E0 AS processing_time, 'ai' AS source FROM org WHERE is_active),
rb AS (SELECT id, fax AS phone, phone AS fax, lower(email) AS email, '' AS homepage, {q.grade()} AS grade, (id % 7) / 7.0E0 AS confidence, (id % 5) / 2.0E0 AS processing_time, 'legacy' AS source FROM org WHERE ai_crawled OR {q.filled('email')})"""


def runs(spark, d):
    i = c("id")
    a = T.active_organizations(spark, d).select(
        "id", "phone", "fax", "email", "homepage", S.grade_by_points(points()).alias("grade"), (i % 10 / F.lit(10.0)).alias("confidence"),
        (i % 13 / F.lit(2.0)).alias("processing_time"), F.lit("ai").alias("source"))
    b = T.organizations(spark, d).filter(c("ai_crawled") | is_filled("email")).select(
        "id", c("fax").alias("phone"), c("phone").alias("fax"), F.lower("email").alias("email"), F.lit("").alias("homepage"),
        S.grade_by_fields().alias("grade"), (i % 7 / F.lit(7.0)).alias("confidence"), (i % 5 / F.lit(2.0)).alias("processing_time"), F.lit("legacy").alias("source"))
    return a, b


def _pick_sql(f: str) -> str:
    return (f"CASE WHEN base_a THEN coalesce(nullif(a{f}, ''), nullif(b{f}, '')) ELSE coalesce(nullif(b{f}, ''), nullif(a{f}, '')) END AS {f}")


@query("hybrid_pick", f"""
WITH {_RUNS}, j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.grade < b.grade, b.id IS NULL) AS base_a,
  {', '.join(f'a.{f} AS a{f}, b.{f} AS b{f}' for f in M.PICKED + ('grade', 'confidence', 'processing_time', 'source'))} FROM ra a FULL JOIN rb b ON a.id = b.id)
SELECT id, {', '.join(_pick_sql(f) for f in M.PICKED)}, CASE WHEN base_a THEN agrade ELSE bgrade END AS grade, greatest(aconfidence, bconfidence) AS confidence,
  coalesce(aprocessing_time, 0) + coalesce(bprocessing_time, 0) AS processing_time,
  CASE WHEN base_a THEN concat_ws(',', asource, bsource) ELSE concat_ws(',', bsource, asource) END AS sources FROM j""")
def hybrid_pick(spark, d):
    return M.hybrid_pick(*runs(spark, d))


def _fall_sql(f: str) -> str:
    return f"CASE WHEN coalesce(a.confidence > 0.7, false) THEN a.{f} WHEN b.id IS NOT NULL THEN b.{f} ELSE o.{f} END AS {f}"


@query("fallback_pick", f"""
WITH {_RUNS} SELECT o.id, {', '.join(_fall_sql(f) for f in M.PICKED)},
  CASE WHEN coalesce(a.confidence > 0.7, false) THEN a.grade WHEN b.id IS NOT NULL THEN b.grade ELSE 'F' END AS grade,
  CASE WHEN coalesce(a.confidence > 0.7, false) THEN a.source WHEN b.id IS NOT NULL THEN b.source ELSE 'minimal' END AS source
FROM org o LEFT JOIN ra a ON a.id = o.id LEFT JOIN rb b ON b.id = o.id WHERE {q.filled('o.name')} AND {q.filled('o.address')}""")
def fallback_pick(spark, d):
    return M.fallback_pick(T.organizations(spark, d), *runs(spark, d))


def _share_sql(s: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {q.filled(s + '.' + f)} THEN 1 ELSE 0 END" for f in M.PICKED) + ")"


@query("compare_runs", f"""
WITH {_RUNS} SELECT a.id, CASE WHEN a.processing_time < b.processing_time THEN 'AI' ELSE 'Legacy' END AS speed_winner,
  CASE WHEN a.grade < b.grade THEN 'AI' ELSE 'Legacy' END AS quality_winner, CASE WHEN {_share_sql('a')} > {_share_sql('b')} THEN 'AI' ELSE 'Legacy' END AS completeness_winner,
  CASE WHEN a.confidence > b.confidence THEN 'AI' ELSE 'Legacy' END AS confidence_winner FROM ra a JOIN rb b ON a.id = b.id""")
def compare_runs(spark, d):
    return M.compare_runs(*runs(spark, d))


@query("compare_original_extracted", f"""
WITH x AS (SELECT id, phone, address, [fax, '02-555-0199'] AS phones, CASE WHEN id % 2 = 0 AND address IS NOT NULL THEN ['우편 ' || address || ' 3층'] ELSE CAST([] AS VARCHAR[]) END AS addresses,
  (id % 10) / 10.0E0 AS quality_score FROM org),
n AS (SELECT id, concat_ws(',', CASE WHEN {q.filled('phone')} AND NOT coalesce(list_contains(phones, phone), false) THEN 'phone_mismatch' END,
  CASE WHEN {q.filled('address')} AND NOT (len(addresses) > 0 AND contains(addresses[1], address)) THEN 'address_unconfirmed' END) AS notes, quality_score FROM x)
SELECT id, notes, round(CASE WHEN notes <> '' THEN quality_score * 0.9E0 ELSE quality_score END, 6) AS quality_score FROM n""")
def compare_original_extracted(spark, d):
    o = T.organizations(spark, d)
    no = F.array().cast("array<string>")
    extracted = o.select("id", F.array(F.coalesce("fax", F.lit("")), F.lit("02-555-0199")).alias("phones"),
                         F.when((c("id") % 2 == 0) & c("address").isNotNull(), F.array(F.concat(F.lit("우편 "), "address", F.lit(" 3층")))).otherwise(no).alias("addresses"),
                         (c("id") % 10 / F.lit(10.0)).alias("quality_score"))
    return M.compare_original(o, extracted).select("id", F.array_join("notes", ",").alias("notes"), "quality_score")


_PAIRS = """pl AS (SELECT id, list_filter([phone, fax], lambda x: x IS NOT NULL) AS ps, list_filter([fax, phone, '02-555-0199'], lambda x: x IS NOT NULL) AS fs FROM org),
pe AS (SELECT id, unnest(ps) AS a, generate_subscripts(ps, 1) AS i, fs FROM pl), fe AS (SELECT id, a, i, unnest(fs) AS b, generate_subscripts(fs, 1) AS j FROM pe),
fd AS (SELECT *, regexp_replace(a, '[^0-9]', '', 'g') AS da, regexp_replace(b, '[^0-9]', '', 'g') AS db FROM fe)"""


@query("best_phone_fax_pair", f"""
WITH {_PAIRS}, r AS (SELECT *, {RELATION.format(a='a', b='b', da='da', db='db')} AS relation FROM fd),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE relation WHEN 'exact_match' THEN 0 WHEN 'similar_pattern' THEN 1 ELSE 2 END,
  CASE relation WHEN 'similar_pattern' THEN -(i * 1000 + j) ELSE i * 1000 + j END) AS rn FROM r)
SELECT o.id, k.a AS phone, k.b AS fax, coalesce(k.relation, 'no_match') AS relation FROM org o LEFT JOIN k ON k.id = o.id AND k.rn = 1""")
def best_phone_fax_pair(spark, d):
    return T.organizations(spark, d).select("id", M.best_pair(
        F.array_compact(F.array("phone", "fax")), F.array_compact(F.array("fax", "phone", F.lit("02-555-0199")))).alias("p")).select("id", "p.*")


@query("page_batch_status", f"""
WITH p AS (SELECT page_id AS id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n FROM pages)
SELECT o.id, p.id IS NOT NULL AS homepage_parsed, CASE WHEN NOT coalesce({q.filled('homepage')} AND starts_with(homepage, 'http'), false) THEN 'no_homepage'
  WHEN p.id IS NULL THEN 'error' WHEN p.n < 100 THEN 'failed' ELSE 'success' END AS parsing_status FROM org o LEFT JOIN p ON p.id = o.id""")
def page_batch_status(spark, d):
    pages = T.given(spark, d, "pages").select(c("page_id").alias("id"), F.regexp_replace("html", "<[^>]*>", "").alias("text"))
    return M.page_batch_status(T.organizations(spark, d), pages)


# --- set operations -------------------------------------------------------------
@query("combine_datasets", """
WITH u AS (SELECT 0 AS source_no, c_name AS name, c_mktsegment AS category, c_custkey AS seq FROM customer
  UNION ALL SELECT 1, lower(s_name), NULL, s_suppkey FROM supplier UNION ALL SELECT 2, upper(c_name) || ' ', 'copy', c_custkey FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY source_no, seq) AS rn FROM u WHERE trim(coalesce(name, '')) <> '')
SELECT name, category, seq, source_no FROM r WHERE rn = 1""", uses=())
def combine_datasets(spark, d):
    cu, su = T.given(spark, d, "customer"), T.given(spark, d, "supplier")
    return M.combine_datasets([
        cu.select(c("c_name").alias("name"), c("c_mktsegment").alias("category"), c("c_custkey").alias("seq")),
        su.select(F.lower("s_name").alias("name"), c("s_suppkey").alias("seq")),
        cu.select(F.concat(F.upper("c_name"), F.lit(" ")).alias("name"), F.lit("copy").alias("category"), c("c_custkey").alias("seq"))])


@query("dedupe_urls", """
WITH r AS (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM r WHERE url <> '') SELECT page_id, url FROM k WHERE rn = 1""", uses=())
def dedupe_urls(spark, d):
    bare = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return M.dedupe_urls(T.given(spark, d, "pages").select("page_id", bare.alias("url")))


@query("merge_contact_lists", f"""
WITH {NESTED} SELECT DISTINCT category, 'phone' AS kind, unnest(phones) AS value FROM nested
UNION ALL SELECT DISTINCT category, 'fax', unnest(faxes) FROM nested UNION ALL SELECT DISTINCT category, 'email', unnest(emails) FROM nested""")
def merge_contact_lists(spark, d):
    items = M.contact_items(nested_contacts(spark, d), ["category"], {"phone": "phones", "fax": "faxes", "email": "emails"})
    return M.merge_contact_items(items, ["category"])


@query("contact_items", f"""
WITH {NESTED} SELECT id, 'phone' AS kind, CAST(generate_subscripts(phones, 1) AS INTEGER) AS pos, unnest(phones) AS value FROM nested
UNION ALL SELECT id, 'fax', CAST(generate_subscripts(faxes, 1) AS INTEGER), unnest(faxes) FROM nested
UNION ALL SELECT id, 'email', CAST(generate_subscripts(emails, 1) AS INTEGER), unnest(emails) FROM nested""")
def contact_items(spark, d):
    return M.contact_items(nested_contacts(spark, d), ["id"], {"phone": "phones", "fax": "faxes", "email": "emails"})


@query("content_hash", "SELECT md5(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1", uses=())
def content_hash(spark, d):
    return M.content_groups(T.given(spark, d, "documents"), "doc_id")


@query("content_hash_record", """
SELECT doc_id, md5('{"lang": "' || lang || '", "n_chars": ' || CAST(n_chars AS VARCHAR) || ', "source": "' || source || '"}') AS record_hash FROM documents""", uses=())
def content_hash_record(spark, d):
    return T.given(spark, d, "documents").select("doc_id", F.md5(M.canonical_json(["source", "lang", "n_chars"])).alias("record_hash"))


@query("record_similarity", r"""
WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS tok FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.tok, b.tok))) > 0
  THEN CAST(len(list_intersect(a.tok, b.tok)) AS DOUBLE) / len(list_distinct(list_concat(a.tok, b.tok))) ELSE 0.0E0 END, 6) AS similarity
FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""", uses=())
def record_similarity(spark, d):
    return M.neighbour_similarity(T.given(spark, d, "conversations"))


@query("record_similarity_links", r"""
WITH r AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x{85}\x{A0}\p{Z}]+'), lambda x: x <> ''))) AS tok FROM documents),
k AS (SELECT tok, len(tok) AS n, min(doc_id) AS class_id, count(*) AS copies FROM r WHERE len(tok) > 0 GROUP BY tok),
p AS (SELECT class_id, n, copies, unnest(tok) AS t FROM k),
m AS (SELECT a.class_id AS a, any_value(b.copies) AS copies FROM p a JOIN p b ON a.t = b.t AND a.class_id <> b.class_id AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n
      GROUP BY a.class_id, b.class_id HAVING 10 * count(*) >= 8 * (any_value(a.n) + any_value(b.n) - count(*))),
o AS (SELECT a, sum(copies) AS others FROM m GROUP BY a)
SELECT r.doc_id, coalesce(k.class_id, r.doc_id) AS class_id, CAST(coalesce(k.copies - 1, 0) + coalesce(o.others, 0) AS BIGINT) AS n_links
FROM r LEFT JOIN k ON k.tok = r.tok LEFT JOIN o ON o.a = k.class_id""", uses=())
def record_similarity_links(spark, d):
    return SM.similar_records(T.given(spark, d, "documents"), 0.8, "doc_id")


@query("org_name_blocking", """
WITH n AS (SELECT id, trim(name) AS t FROM (SELECT id, name FROM org UNION ALL SELECT id + 1000000, upper(name) || ' 지역아동센터 ' FROM org))
SELECT lower(CASE WHEN contains(t, '지역아동센터') OR ends_with(t, '센터') THEN t ELSE t || ' 지역아동센터' END) AS block, count(*) AS members, min(id) AS first_id FROM n GROUP BY 1""")
def org_name_blocking(spark, d):
    o = T.organizations(spark, d).select("id", "name")
    return M.org_name_groups(o.unionByName(o.select((c("id") + 1000000).alias("id"), F.concat(F.upper("name"), F.lit(" 지역아동센터 ")).alias("name"))))
