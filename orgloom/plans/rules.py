"""Standardization and validation rules over whole tables.

Every query is one scan and one projection of built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from orgloom.functions import address as A
from orgloom.functions import fixed_values as V
from orgloom.functions import phone as P
from orgloom.functions import scoring as S
from orgloom.functions import web as W
from orgloom.functions.blank import clean_value, first_nonblank, is_blank, is_filled
from orgloom.operators import dictionary as D
from orgloom.operators import validation as VD
from orgloom.sources import tables as T

from . import sqlparts as q
from .coverage import FAXED, NESTED
from .queues import fits_region_sql, region_city_sql, region_of_phone_sql
from .registry import query

c = F.col


def over_org(name: str, sql_columns: str, columns, ctes: str = "", source: str = "org") -> None:
    """Register a projection of the organization table keyed by id."""

    @query(name, f"{ctes}SELECT id, {sql_columns} FROM {source}")
    def _(spark, d):
        return T.organizations(spark, d).select("id", *[v.alias(k) for k, v in columns().items()])


def _both(make, sql) -> tuple[str, object]:
    """The same rule on phone and fax."""
    return (f"{sql('phone')} AS phone_value, {sql('fax')} AS fax_value",
            lambda: {"phone_value": make("phone"), "fax_value": make("fax")})


def _page_dash(d: str) -> str:
    seoul, mobile = f"starts_with({d}, '02')", f"substr({d}, 1, 3) IN ('010','011','016','017','018','019','070')"
    part = lambda a, b: f"substr({d}, 1, {a}) || '-' || substr({d}, {a + 1}, {b}) || '-' || substr({d}, {a + b + 1})"
    return (f"CASE WHEN length({d}) BETWEEN 9 AND 11 THEN CASE WHEN {seoul} AND length({d}) = 9 THEN {part(2, 3)} WHEN {seoul} THEN {part(2, 4)} "
            f"WHEN {mobile} THEN {part(3, 4)} WHEN length({d}) = 10 THEN {part(3, 3)} ELSE {part(3, 4)} END END")


over_org("phone_digits", *_both(P.digits, q.digits))
over_org("phone_strip_country", *_both(lambda x: P.strip_country(P.digits(x)), lambda x: q.strip(q.digits(x))))
over_org("phone_area_code", *_both(lambda x: P.area_code(P.digits(x)), lambda x: q.area(q.digits(x))))
over_org("phone_area_code_by_length", *_both(lambda x: P.area_code_by_length(P.digits(x)), lambda x: q.area_len(q.digits(x))))
over_org("phone_format", *_both(P.format_phone, q.format_phone))
over_org("phone_format_any_length", *_both(P.normalize_helper, q.normalize_helper))
over_org("phone_format_page", *_both(lambda x: P.dash_page(P.digits(x)), lambda x: _page_dash(q.digits(x))))
over_org("phone_group_normalize", *_both(P.normalize_groups, q.normalize_groups))
over_org("phone_valid_strict", *_both(P.valid_strict, q.valid_strict))
over_org("phone_valid_length_table", *_both(P.valid_length_table, q.valid_length_table))
over_org("phone_valid_reason", *_both(P.invalid_reason, q.reason))
over_org("phone_valid_prefix", *_both(P.valid_prefix, q.valid_prefix))
over_org("area_lookup", *_both(
    lambda x: P.area_name(P.area_code(P.digits(x))),
    lambda x: q.area_name(f"({q.area(q.digits(x))})", "'알 수 없음'")))


def _model_sql(x):
    return f"CASE WHEN NOT {q.filled(x)} THEN true ELSE regexp_matches(trim({x}), '^[0-9]{{2,3}}-[0-9]{{3,4}}-[0-9]{{4}}$') END"


_AGENT = r"^0[2-9]{1,2}-[0-9]{3,4}-[0-9]{4}$|^01[0-9]-[0-9]{3,4}-[0-9]{4}$|^070-[0-9]{3,4}-[0-9]{4}$"
_CHECKER = r"^0[2-9]{1,2}-[0-9]{3,4}-[0-9]{4}$|^01[0-9]-[0-9]{3,4}-[0-9]{4}$"
_MAP = r"^0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}$|^01[0-9]-[0-9]{3,4}-[0-9]{4}$"
over_org(
    "phone_valid_loose",
    f"{_model_sql('phone')} AS model_ok, coalesce(regexp_matches(regexp_replace(phone, '[.\\s]', '-', 'g'), '{_AGENT}'), false) AS agent_ok, "
    f"coalesce(regexp_matches(phone, '{_CHECKER}'), false) AS checker_ok, coalesce(regexp_matches(phone, '{_MAP}'), false) AS map_ok",
    lambda: {f"{p}_ok": P.valid_loose("phone", p) for p in ("model", "agent", "checker", "map")})


def _confidence_sql(x):
    d = q.digits("(" + q.normalize_helper(x) + ")")
    return (f"CASE WHEN ({q.normalize_helper(x)}) IS NULL THEN 0.0E0 WHEN substr({d}, 1, 3) IN ('010', '011', '016') OR starts_with({d}, '02') THEN 0.9E0 "
            f"WHEN starts_with({d}, '0') THEN 0.8E0 ELSE 0.6E0 END")


over_org("phone_confidence", *_both(P.confidence, _confidence_sql))
over_org("phone_dummy", *_both(P.is_dummy, lambda x: f"coalesce({q.dummy(x)}, true)"))


def _few_sql(x):
    return f"len(list_distinct(string_split({q.digits(x)}, ''))) - CASE WHEN {q.digits(x)} = '' THEN 1 ELSE 0 END <= 2"


over_org("phone_few_digits", *_both(lambda x: P.few_digits(F.coalesce(c(x), F.lit(""))), lambda x: _few_sql(f"coalesce({x}, '')")))
over_org("phone_normalize_validator", *_both(P.normalize_validator, q.normalize_validator))


def _verdict_sql(x):
    n = q.normalize_validator(x)
    again = f"split_part({q.normalize_validator('(' + n + ')')}, '-', 1)"
    return (f"CASE WHEN NOT {q.filled(x)} THEN 'empty' WHEN {q.dummy(x)} THEN 'dummy' WHEN {again} NOT IN {q.in_list(V.AREA_NAMES)} THEN 'area' "
            f"WHEN NOT regexp_matches({n}, '^0[0-9]{{1,2}}-[0-9]{{3,4}}-?[0-9]{{4}}') THEN 'pattern' ELSE 'ok' END")


@query("clean_contact_pair", f"""
WITH v AS (SELECT id, {_verdict_sql('phone')} AS phone_verdict, {_verdict_sql('fax')} AS fax_verdict,
  {q.normalize_validator('phone')} AS pn, {q.normalize_validator('fax')} AS fn FROM org),
w AS (SELECT *, phone_verdict = 'ok' AND fax_verdict = 'ok' AND pn = fn AS is_duplicate FROM v)
SELECT id, CASE WHEN phone_verdict = 'ok' THEN pn ELSE '' END AS phone, CASE WHEN fax_verdict = 'ok' AND NOT is_duplicate THEN fn ELSE '' END AS fax,
  phone_verdict = 'ok' AS phone_valid, fax_verdict = 'ok' AND NOT is_duplicate AS fax_valid, is_duplicate,
  concat_ws(',', CASE WHEN phone_verdict <> 'empty' THEN 'phone:' || phone_verdict END,
    CASE WHEN fax_verdict <> 'empty' THEN 'fax:' || fax_verdict END, CASE WHEN is_duplicate THEN 'fax:removed' END) AS messages FROM w""")
def clean_contact_pair(spark, d):
    return VD.clean_contact_pair(T.organizations(spark, d)).select(
        "id", "phone", "fax", "phone_valid", "fax_valid", "is_duplicate", F.array_join("messages", ",").alias("messages"))


over_org(
    "phone_fax_duplicate",
    f"coalesce({q.filled('phone')} AND {q.filled('fax')} AND {q.digits('phone')} = {q.digits('fax')}, false) AS same_digits, "
    f"coalesce({q.filled('phone')} AND {q.filled('fax')} AND ({q.format_phone('phone')}) = ({q.format_phone('fax')}), false) AS same_number",
    lambda: {"same_digits": P.same_digits("phone", "fax"), "same_number": P.same_number("phone", "fax")})
over_org(
    "phone_area_exchange",
    f"nullif(split_part({q.format_phone('phone')}, '-', 1), '') AS area, nullif(split_part({q.format_phone('phone')}, '-', 2), '') AS exchange",
    lambda: {"area": F.split_part(P.format_phone("phone"), F.lit("-"), F.lit(1)), "exchange": P.exchange(P.format_phone("phone"))})
over_org(
    "fax_same_area",
    f"coalesce(({q.area_len(q.digits('fax'))}) = ({q.area_len(q.digits('phone'))}), false) AS same_area",
    lambda: {"same_area": F.coalesce(P.area_code_by_length(P.digits("fax")) == P.area_code_by_length(P.digits("phone")), F.lit(False))})

_DIG = f"WITH dg AS (SELECT id, phone, fax, {q.digits('phone')} AS pd, {q.digits('fax')} AS fd FROM org) "
over_org("fax_too_similar", f"{q.too_similar('fd', 'pd')} AS too_similar",
         lambda: {"too_similar": P.too_similar(P.digits("fax"), P.digits("phone"))}, _DIG, "dg")
_SIM = (f"CASE WHEN {q.filled('phone')} AND {q.filled('fax')} AND length(pd) = length(fd) AND length(pd) > 0 "
        f"THEN round((length(pd) - {q.hamming('pd', 'fd')}) / CAST(length(pd) AS DOUBLE), 6) ELSE 0.0E0 END")
over_org("phone_similarity_score", f"{_SIM} AS score, {_SIM} >= 0.8 AS similar, "
         f"CASE WHEN {q.blank('phone')} THEN true ELSE length(pd) = length(fd) AND {q.hamming('pd', 'fd')} <= 4 END AS fax_accepted",
         lambda: {"score": F.round(P.similarity("phone", "fax"), 6), "similar": F.round(P.similarity("phone", "fax"), 6) >= 0.8,
                  "fax_accepted": F.when(is_blank("phone"), True).otherwise(
                      (F.length(P.digits("phone")) == F.length(P.digits("fax"))) & (P.differing_positions(P.digits("phone"), P.digits("fax")) <= 4))},
         _DIG, "dg")
RELATION = """CASE WHEN {a} = {b} THEN 'exact_match' WHEN length({da}) = length({db}) AND length({da}) IN (10, 11)
  AND substr({da}, 1, length({da}) - 4) = substr({db}, 1, length({da}) - 4) AND {da} <> {db} THEN 'similar_pattern' ELSE 'different' END"""
over_org("phone_fax_relation", RELATION.format(a="phone", b="fax", da="pd", db="fd") + " AS relation",
         lambda: {"relation": P.relation(c("phone"), c("fax"))}, _DIG, "dg")


@query("fax_valid_strict", f"WITH {FAXED} SELECT id, ok_strict AS valid FROM faxed")
def fax_valid_strict(spark, d):
    return VD.fax_checks(T.organizations(spark, d)).select("id", c("ok_strict").alias("valid"))


@query("fax_valid_relaxed", f"WITH {FAXED} SELECT id, ok_relaxed AS valid FROM faxed")
def fax_valid_relaxed(spark, d):
    return VD.fax_checks(T.organizations(spark, d)).select("id", c("ok_relaxed").alias("valid"))


over_org("region_city_from_address", f"{region_city_sql(True)} AS region_city, {region_city_sql(False)} AS region",
         lambda: {"region_city": F.coalesce(A.region_city("address"), F.lit("")), "region": F.coalesce(A.region_city("address", False), F.lit(""))})
over_org("region_from_phone", f"{region_of_phone_sql()} AS region", lambda: {"region": A.region_of_phone("phone", "address")})
over_org("region_from_address", f"{q.first_contained('address', V.REGION_NAMES)} AS region_key, {q.first_contained('address', V.REGION_CODES, other=chr(39) * 2)} AS region_short",
         lambda: {"region_key": A.region_key("address"), "region_short": A.region_short("address")})
_HEAD = "(CASE WHEN contains(phone, '-') THEN split_part(phone, '-', 1) ELSE substr(phone, 1, 3) END)"
over_org("phone_region_consistency",
         f"{fits_region_sql('phone')} AS exact_ok, {q.fits_address('phone', 'address')} AS neighbour_ok, "
         f"coalesce({_HEAD} = {q.first_contained('address', V.REGION_CODES, lambda p: p[1])}, false) AS strict_ok",
         lambda: {f"{p}_ok": A.phone_fits_region("phone", "address", p) for p in ("exact", "neighbour", "strict")})
over_org("email_domain", f"{q.email_domain('email')} AS domain", lambda: {"domain": W.email_domain("email")})
over_org("email_class", f"{q.email_class('(' + q.email_domain('email') + ')')} AS email_class", lambda: {"email_class": W.email_class(W.email_domain("email"))})
_EM = "coalesce(regexp_matches(trim(email), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$'), false)"
over_org("email_valid", f"NOT {q.filled('email')} OR {_EM} AS anchored_ok, coalesce(contains(email, '@') AND contains(email, '.'), false) AS simple_ok, {_EM} AS strict_ok",
         lambda: {f"{p}_ok": W.email_valid("email", p) for p in ("anchored", "simple", "strict")})
over_org("email_confidence",
         "CASE WHEN email IS NULL OR email = '' OR NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}') THEN 0.0E0 "
         f"WHEN ({q.email_domain('email')}) IN {q.in_list(V.COMMON_DOMAINS)} THEN 0.9E0 ELSE 0.7E0 END AS confidence",
         lambda: {"confidence": W.email_confidence("email")})
_URL = ("CASE WHEN NOT starts_with(u, 'http://') AND NOT starts_with(u, 'https://') AND (starts_with(u, 'www.') OR contains(u, '.')) "
        "THEN 'http://' || u ELSE u END")
over_org("url_normalize", f"{_URL} AS url, CASE WHEN regexp_matches({_URL}, '^https?://[^\\s]+\\.[^\\s]+') THEN {_URL} END AS url_or_null",
         lambda: {"url": W.url_with_scheme("homepage"), "url_or_null": W.url_or_null("homepage")},
         "WITH us AS (SELECT id, coalesce(trim(homepage), '') AS u FROM org) ", "us")
_SOCIAL = "CASE " + " ".join(f"WHEN contains(host, '{dm}') THEN '{lb}' END" if i == len(V.SOCIAL_DOMAINS) - 1 else f"WHEN contains(host, '{dm}') THEN '{lb}'"
                             for i, (dm, lb) in enumerate(V.SOCIAL_DOMAINS))
_HOSTS = r"WITH hs AS (SELECT id, lower(regexp_extract(homepage, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM org) "
over_org("social_platform", f"{_SOCIAL} AS platform", lambda: {"platform": W.social_platform("homepage")}, _HOSTS, "hs")
over_org("address_clean", r"CASE WHEN length(a) >= 10 THEN regexp_replace(a, '[^0-9A-Za-z_가-힣ㄱ-ㅎㅏ-ㅣ\s\-.,()]', '', 'g') END AS cleaned",
         lambda: {"cleaned": A.clean_address("address")},
         r"WITH ad AS (SELECT id, trim(regexp_replace(address, '\s+', ' ', 'g')) AS a FROM org) ", "ad")
over_org("address_plausible",
         f"coalesce({q.contains_any('address', [r for r, _ in V.REGION_CODES])} OR regexp_matches(address, '(로|길)\\s*[0-9]+') "
         "OR regexp_matches(address, '[0-9]+-[0-9]+') OR length(address) > 10, false) AS plausible",
         lambda: {"plausible": A.plausible("address")})
over_org("value_clean", ", ".join(
    f"CASE WHEN trim(coalesce({f}, '')) IN {q.in_list(V.BLANK_WORDS)} THEN '' ELSE trim(coalesce({f}, '')) END AS {f}" for f in ("phone", "fax", "email", "priority")),
    lambda: {f: clean_value(f) for f in ("phone", "fax", "email", "priority")})


def _nonblank_sql(*cols):
    return "coalesce(" + ", ".join(
        f"CASE WHEN trim({x}) <> '' AND lower(trim({x})) NOT IN ('nan', 'none', 'null') THEN trim({x}) END" for x in cols) + ", '')"


over_org("map_columns_first_nonblank", f"{_nonblank_sql('phone', 'fax')} AS phone, {_nonblank_sql('fax', 'phone')} AS fax, {_nonblank_sql('email', 'homepage', 'name')} AS contact",
         lambda: {"phone": first_nonblank("phone", "fax"), "fax": first_nonblank("fax", "phone"), "contact": first_nonblank("email", "homepage", "name")})

# names with Korean keywords: type word put before the generated name
_KNAME = "CASE type WHEN 'CHURCH' THEN '은혜교회 ' WHEN 'ACADEMY' THEN '미래학원 ' WHEN 'PUBLIC' THEN '시청 도서관 ' ELSE 'Central ' END || name"


def korean_name() -> Column:
    word = (F.when(c("type") == "CHURCH", "은혜교회 ").when(c("type") == "ACADEMY", "미래학원 ")
            .when(c("type") == "PUBLIC", "시청 도서관 ").otherwise("Central "))
    return F.concat(word, c("name"))


_KN = f"WITH kn AS (SELECT id, {_KNAME} AS kname, category, name FROM org) "
over_org("small_organization",
         f"{q.contains_any('lower(kname || chr(32) || category)', V.SMALL_ORG_WORDS)} AS small, "
         f"{q.contains_any('lower(kname || chr(32) || category)', V.SMALL_ORG_WORDS_SEARCH)} OR length(kname) <= 10 AS small_for_search",
         lambda: {"small": S.small_organization(korean_name(), c("category")), "small_for_search": S.small_organization(korean_name(), c("category"), "search")},
         _KN, "kn")


def _type_sql(text: str) -> str:
    scores = [("(" + " + ".join(f"CAST(contains({text}, {q.lit(w)}) AS INTEGER)" for w in ws) + ")", n) for n, ws in V.ORG_TYPE_WORDS]
    best = "greatest(" + ", ".join(s for s, _ in scores) + ")"
    return f"CASE WHEN {best} = 0 THEN '{V.OTHER}' " + " ".join(f"WHEN {s} = {best} THEN '{n}'" for s, n in scores) + " END"


over_org("org_type_classify", f"{_type_sql('lower(kname)')} AS org_type", lambda: {"org_type": S.org_type(korean_name())}, _KN, "kn")


@query("org_type_classify_documents", f"SELECT doc_id, {_type_sql('lower(text)')} AS org_type FROM documents", uses=())
def org_type_classify_documents(spark, d):
    return T.given(spark, d, "documents").select("doc_id", S.org_type(c("text")).alias("org_type"))


_CATEGORY = "CASE " + " ".join(f"WHEN {q.contains_any('lower(text)', ws)} THEN '{n}'" for n, ws in V.TEXT_CATEGORY_WORDS) + f" ELSE '{V.OTHER}' END"


@query("text_category", f"SELECT doc_id, {_CATEGORY} AS category FROM documents", uses=())
def text_category(spark, d):
    return T.given(spark, d, "documents").select("doc_id", S.text_category(c("text")).alias("category"))


@query("text_category_dictionary", f"SELECT doc_id, {_CATEGORY} AS category, {_type_sql('lower(text)')} AS org_type FROM documents", uses=())
def text_category_dictionary(spark, d):
    """Both word lists as dictionary tables, each in one pass over the texts."""
    docs = T.given(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    out = D.with_dictionary(docs, "low", D.dictionary_of(spark, V.TEXT_CATEGORY_WORDS), "category_")
    out = D.with_dictionary(out, "low", D.dictionary_of(spark, V.ORG_TYPE_WORDS), "type_")
    return out.select("doc_id", F.coalesce("category_first_label", F.lit(V.OTHER)).alias("category"), F.coalesce("type_best_label", F.lit(V.OTHER)).alias("org_type"))


@query("region_dictionary", f"""
SELECT id, {q.first_contained('address', V.REGION_NAMES)} AS region_key, {q.first_contained('address', V.REGION_CODES, other=chr(39) * 2)} AS region_short FROM org""")
def region_dictionary(spark, d):
    orgs = T.organizations(spark, d).select("id", "address")
    out = D.with_dictionary(orgs, "address", D.dictionary_of(spark, [(n, [n]) for n, _ in V.REGION_NAMES]), "name_")
    out = D.with_dictionary(out, "address", D.dictionary_of(spark, [(n, [n]) for n, _ in V.REGION_CODES]), "code_")
    return out.select("id", F.col("name_first_label").alias("region_key"), F.coalesce("code_first_label", F.lit("")).alias("region_short"))


@query("part_names_in_documents", """
WITH w AS (SELECT word, min(p_partkey) AS place FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE length(word) >= 3 GROUP BY word),
h AS (SELECT d.doc_id, w.word, w.place FROM documents d JOIN w ON contains(lower(d.text), w.word))
SELECT d.doc_id, (SELECT arg_min(word, (place, word)) FROM h WHERE h.doc_id = d.doc_id) AS first_word, (SELECT count(*) FROM h WHERE h.doc_id = d.doc_id) AS n_words FROM documents d""", uses=())
def part_names_in_documents(spark, d):
    """A dictionary made of a table: the words of part names."""
    parts = T.given(spark, d, "part").select(F.col("p_partkey").alias("place"), F.explode(F.split(F.lower("p_name"), " ")).alias("word")).filter(F.length("word") >= 3)
    words = parts.groupBy("word").agg(F.min("place").alias("place")).withColumn("label", F.col("word"))
    docs = T.given(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    return D.with_dictionary(docs, "low", words).select("doc_id", F.col("first_label").alias("first_word"), "n_words")


@query("text_clean", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\s\x{85}\x{A0}\p{Z}]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}\p{Pc}\s.-]', '', 'g')) AS cleaned FROM documents""", uses=())
def text_clean(spark, d):
    return T.given(spark, d, "documents").select("doc_id", VD.clean_text("text").alias("cleaned"))


_N5 = "(" + " + ".join(f"CASE WHEN {q.blank(f)} THEN 0 ELSE 1 END" for f in q.FIELDS) + ")"
over_org("org_completeness", f"CAST(floor({_N5} * 100.0E0 / 5 + 0.5E0) AS INTEGER) AS completeness, "
         f"({' + '.join(f'CASE WHEN {q.filled(f)} THEN 1 ELSE 0 END' for f in ('phone', 'fax', 'email', 'homepage'))}) / 4.0E0 AS contact_share",
         lambda: {"completeness": S.completeness(), "contact_share": S.field_share(["phone", "fax", "email", "homepage"])})
over_org("quality_grade_fields", f"{q.grade()} AS grade, {q.grade('mobile')} AS grade_with_mobile",
         lambda: {"grade": S.grade_by_fields(), "grade_with_mobile": S.grade_by_fields(F.when(c("id") % 2 == 0, c("phone")).otherwise(""))},
         "WITH mb AS (SELECT *, CASE WHEN id % 2 = 0 THEN phone ELSE '' END AS mobile FROM org) ", "mb")
_PTS = (f"(CASE WHEN {q.filled('phone')} THEN 30 ELSE 0 END + CASE WHEN {q.filled('fax')} THEN 20 ELSE 0 END + CASE WHEN {q.filled('homepage')} THEN 25 ELSE 0 END "
        f"+ CASE WHEN {q.filled('email')} THEN 15 ELSE 0 END + CASE WHEN {q.filled('crawling_data')} THEN 10 ELSE 0 END)")


def points() -> Column:
    return S.points(*[is_filled(f) for f in ("phone", "fax", "homepage", "email", "crawling_data")])


over_org("quality_grade_points", f"{_PTS} AS points, CASE WHEN {_PTS} >= 90 THEN 'A' WHEN {_PTS} >= 70 THEN 'B' WHEN {_PTS} >= 50 THEN 'C' "
         f"WHEN {_PTS} >= 30 THEN 'D' WHEN {_PTS} >= 10 THEN 'E' ELSE 'F' END AS grade",
         lambda: {"points": points(), "grade": S.grade_by_points(points())})


# --- list rules ---------------------------------------------------------------
_VALID_LISTS = f"""valid AS (SELECT id,
  len(phones) AS n_phone, len(list_filter(phones, lambda x: regexp_matches(x, '{_CHECKER}'))) AS v_phone,
  len(faxes) AS n_fax, len(list_filter(faxes, lambda x: regexp_matches(x, '{_CHECKER}'))) AS v_fax,
  len(emails) AS n_email, len(list_filter(emails, lambda x: regexp_matches(x, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$'))) AS v_email,
  len(sites) AS n_site, len(list_filter(sites, lambda x: (starts_with(x, 'http://') OR starts_with(x, 'https://') OR starts_with(x, 'www.')) AND contains(x, '.'))) AS v_site,
  phones, faxes, name, address FROM (SELECT n.*, o.address, CASE WHEN o.homepage IS NULL THEN CAST([] AS VARCHAR[]) ELSE [o.homepage] END AS sites
    FROM nested n JOIN org o ON o.id = n.id))"""


def listed(spark, d):
    """Organizations with contact lists, one row each."""
    return T.organizations(spark, d).select(
        "id", "name", "address",
        F.array_compact(F.array("phone", "fax")).alias("phones"), F.array_compact(F.array("fax")).alias("faxes"),
        F.when(is_filled("email"), F.array("email", F.concat(F.lit("info."), c("email")))).otherwise(F.array().cast("array<string>")).alias("emails"),
        F.array_compact(F.array("homepage")).alias("websites"))


def _list_cols(kind: str) -> str:
    rate = f"CASE WHEN n_{kind} > 0 THEN round(CAST(v_{kind} AS DOUBLE) / n_{kind}, 6) ELSE 0.0E0 END"
    return (f"v_{kind} > 0 AS {kind}_valid, CAST(v_{kind} AS INTEGER) AS {kind}_valid_count, CAST(n_{kind} - v_{kind} AS INTEGER) AS {kind}_invalid_count, {rate} AS {kind}_success_rate")


@query("list_validation", f"WITH {NESTED}, {_VALID_LISTS} SELECT id, {', '.join(_list_cols(k) for k in ('phone', 'fax', 'email', 'site'))} FROM valid")
def list_validation(spark, d):
    return VD.list_validation(listed(spark, d))


_AREAS = "list_distinct([split_part(x, '-', 1) for x in {c} if contains(x, '-')])"
_SCORES = f"""sc AS (SELECT id, ((v_phone > 0)::INT + (v_fax > 0)::INT + (v_email > 0)::INT + (v_site > 0)::INT) / 4.0E0 AS format_score,
  ((CASE WHEN {q.filled('name')} AND {q.filled('address')} AND contains(name, '서울') AND NOT contains(address, '서울') THEN 0.8E0 ELSE 1.0E0 END)
   + (CASE WHEN len({_AREAS.format(c='phones')}) > 0 AND len({_AREAS.format(c='faxes')}) > 0
        AND NOT list_has_any({_AREAS.format(c='phones')}, {_AREAS.format(c='faxes')}) THEN 0.7E0 ELSE 1.0E0 END)) / 2 AS consistency_score,
  (({q.filled('name')})::INT + (n_phone > 0)::INT + ({q.filled('address')})::INT) / 3.0E0 * 0.8E0 + ((n_fax > 0)::INT + (n_email > 0)::INT + (n_site > 0)::INT) / 3.0E0 * 0.2E0 AS completeness_score
  FROM valid),
ov AS (SELECT *, format_score * 0.25E0 + consistency_score * 0.2E0 + completeness_score * 0.25E0 + 0.9E0 * 0.2E0 + 0.8E0 * 0.1E0 AS overall FROM sc)"""


@query("validation_scores", f"""
WITH {NESTED}, {_VALID_LISTS}, {_SCORES}
SELECT id, round(format_score, 6) AS format_score, round(consistency_score, 6) AS consistency_score, round(completeness_score, 6) AS completeness_score,
  round(overall, 6) AS overall_score, CASE WHEN round(overall, 6) >= 0.9 THEN 'A' WHEN round(overall, 6) >= 0.8 THEN 'B' WHEN round(overall, 6) >= 0.7 THEN 'C'
  WHEN round(overall, 6) >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM ov""")
def validation_scores(spark, d):
    return VD.validation_scores(listed(spark, d), reliability=F.lit(0.9), model=F.lit(0.8))


@query("extraction_confidence", f"""
WITH {NESTED}, n AS (SELECT id, len(phones) + len(faxes) + len(emails) AS n, (id % 11) / 10.0E0 AS model FROM nested)
SELECT id, round(CASE WHEN n = 0 THEN 0.0E0 ELSE least(1.0E0, (0.6E0 + model + least(0.3E0, n * 0.05E0)) / 2) END, 6) AS confidence FROM n""")
def extraction_confidence(spark, d):
    return listed(spark, d).select("id", F.round(S.extraction_confidence(
        F.size("phones") + F.size("faxes") + F.size("emails"), (c("id") % 11) / F.lit(10.0)), 6).alias("confidence"))


_CONF = {k: f"CAST({s} AS DOUBLE)" for k, s in (("p", _confidence_sql("phone")), ("f", _confidence_sql("fax")))}


@query("overall_confidence", f"""
WITH v AS (SELECT id, {_confidence_sql('phone')} AS p, {_confidence_sql('fax')} AS f,
  CASE WHEN email IS NULL OR NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}') THEN 0.0E0
    WHEN ({q.email_domain('email')}) IN {q.in_list(V.COMMON_DOMAINS)} THEN 0.9E0 ELSE 0.7E0 END AS e, phone, fax, email FROM org),
n AS (SELECT *, (phone IS NOT NULL)::INT + (fax IS NOT NULL)::INT + (email IS NOT NULL)::INT AS n FROM v)
SELECT id, round(CASE WHEN n = 0 THEN 0.0E0 ELSE ((CASE WHEN phone IS NULL THEN 0.0E0 ELSE p END) + (CASE WHEN fax IS NULL THEN 0.0E0 ELSE f END) + e) / n END, 6) AS confidence,
  round((p + f + e) / 3, 6) AS stage_mean FROM n""")
def overall_confidence(spark, d):
    return VD.overall_confidence(T.organizations(spark, d))


@query("confidence_adjust", """
WITH m AS (SELECT id, (id % 10) / 10.0E0 AS phone, (id % 7) / 7.0E0 AS fax, CASE id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' ELSE 'uncertain' END AS pv,
  CASE id % 2 WHEN 0 THEN 'valid' ELSE 'invalid' END AS fv FROM org)
SELECT id, round(least(1.0E0, greatest(0.0E0, phone * CASE pv WHEN 'valid' THEN 1.1E0 WHEN 'invalid' THEN 0.6E0 ELSE 1.0E0 END)), 6) AS phone,
  round(least(1.0E0, greatest(0.0E0, fax * CASE fv WHEN 'valid' THEN 1.1E0 WHEN 'invalid' THEN 0.6E0 ELSE 1.0E0 END)), 6) AS fax FROM m""")
def confidence_adjust(spark, d):
    i = c("id")
    scored = T.organizations(spark, d).select(
        "id", F.create_map(F.lit("phone"), (i % 10) / F.lit(10.0), F.lit("fax"), (i % 7) / F.lit(7.0)).alias("scores"),
        F.create_map(F.lit("phone"), F.when(i % 3 == 0, "valid").when(i % 3 == 1, "invalid").otherwise("uncertain"),
                     F.lit("fax"), F.when(i % 2 == 0, "valid").otherwise("invalid")).alias("verdicts"))
    adjusted = VD.adjust_confidence(c("scores"), c("verdicts"))
    return scored.select("id", F.round(adjusted["phone"], 6).alias("phone"), F.round(adjusted["fax"], 6).alias("fax"))


@query("record_rules", f"""
SELECT id, concat_ws(',', CASE WHEN {q.blank('name')} THEN 'name_required' END, CASE WHEN {q.filled('email')} AND NOT {_EM} THEN 'email_format' END,
  CASE WHEN NOT ({_model_sql('phone')}) THEN 'phone_format' END,
  CASE WHEN {q.filled('homepage')} AND NOT regexp_matches(trim(homepage), '^https?://.+') THEN 'homepage_format' END,
  CASE WHEN 1790 + id % 300 NOT BETWEEN 1800 AND 2001 THEN 'founding_year_range' END,
  CASE WHEN length(trim(name)) NOT BETWEEN 2 AND 100 THEN 'name_length' END) AS errors FROM org""")
def record_rules(spark, d):
    orgs = T.organizations(spark, d).withColumn("founding_year", 1790 + c("id") % 300)
    return orgs.select("id", F.array_join(VD.record_errors(last_year=2001), ",").alias("errors"))


@query("user_record_rules", f"""
WITH u AS (SELECT id, CASE WHEN team = 'team0' THEN '' ELSE username END AS username, CASE WHEN is_active THEN full_name END AS full_name,
  CASE WHEN team = 'team1' THEN username || '@corp.co.kr' ELSE 'u' || CAST(id AS VARCHAR) || '@corp.co.kr' END AS email, CASE WHEN team = 'team2' THEN '02.123.4567' ELSE '02-123-4567' END AS phone FROM users)
SELECT id, concat_ws(',', CASE WHEN {q.blank('username')} THEN 'username_required' END, CASE WHEN {q.blank('full_name')} THEN 'full_name_required' END,
  CASE WHEN {q.filled('email')} AND NOT {_EM} THEN 'email_format' END, CASE WHEN NOT ({_model_sql('phone')}) THEN 'phone_format' END) AS errors FROM u""", uses=("users",))
def user_record_rules(spark, d):
    u = T.view(spark, d, "users").select(
        "id", F.when(c("team") == "team0", "").otherwise(c("username")).alias("username"), F.when(c("is_active"), c("full_name")).alias("full_name"),
        F.when(c("team") == "team1", F.concat("username", F.lit("@corp.co.kr"))).otherwise(F.concat(F.lit("u"), c("id").cast("string"), F.lit("@corp.co.kr"))).alias("email"),
        F.when(c("team") == "team2", "02.123.4567").otherwise("02-123-4567").alias("phone"))
    return u.select("id", F.array_join(VD.user_errors(), ",").alias("errors"))


@query("date_coercion", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS text, CASE WHEN event_id % 7 = 0 THEN '{}' ELSE props END AS json FROM events""", uses=())
def date_coercion(spark, d):
    raw = T.given(spark, d, "events").select("event_id", F.when(c("event_id") % 10 == 0, "not a date").otherwise(c("ts").cast("string")).alias("text"),
                                             F.when(c("event_id") % 7 == 0, "{broken").otherwise(c("props")).alias("json"))
    return VD.coerce_dates(raw, {"text": "timestamp_ntz"}, ["json"])


@query("health_status", """
SELECT event_id, CASE WHEN cpu_usage > 95 OR memory_usage > 95 OR disk_usage > 95 THEN 'critical'
  WHEN cpu_usage > 80 OR memory_usage > 80 OR disk_usage > 80 OR error_count > 10 OR response_time > 5 THEN 'warning' ELSE 'healthy' END AS overall_status FROM health""",
       uses=("health",))
def health_status(spark, d):
    return T.view(spark, d, "health").select("event_id", S.health_status().alias("overall_status"))


@query("url_confidence", r"""
SELECT page_id, CASE WHEN url IS NULL OR NOT regexp_matches(url, '^https?://[-0-9A-Za-z_.]+') THEN 0.0E0 WHEN starts_with(url, 'https://') THEN 0.9E0 ELSE 0.7E0 END AS confidence FROM pages""", uses=())
def url_confidence(spark, d):
    return T.given(spark, d, "pages").select("page_id", W.url_confidence("url").alias("confidence"))
