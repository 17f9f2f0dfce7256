"""Aggregations, distributions, reports and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orgloom.functions import extract as X
from orgloom.functions import fixed_values as V
from orgloom.functions import scoring as S
from orgloom.functions.blank import is_filled, missing_fields
from orgloom.operators import coverage as C
from orgloom.operators import ranking as R
from orgloom.session import checkpoint_root
from orgloom.sources import sinks
from orgloom.sources import tables as T

from . import sqlparts as q
from .registry import query

COVERED = C.COVERED
ORG_AS_OF = f"TIMESTAMP '{T.AS_OF_ORG}'"


def as_of_org():
    return F.expr(f"TIMESTAMP_NTZ '{T.AS_OF_ORG}'")


def scratch(spark, name: str) -> str:
    """A fresh folder in the shared checkpoint area."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def exported(spark, df, sort: str | None = None):
    """``df`` as CSV files, and what they hold."""
    path = scratch(spark, "export")
    sinks.write_csv(df, path, sort)
    return sinks.read_back(df, path)


def _counts(fields=COVERED) -> str:
    return ", ".join(f"{q.count(q.filled(f))} AS {f}_count" for f in fields)


_COMPLETE = " AND ".join(q.filled(f) for f in ("phone", "fax", "email"))
_RATES = ", ".join(f"{q.pct(f + '_count', 'total')} AS {f}_rate" for f in COVERED)


@query("contact_coverage", f"""
WITH a AS (SELECT count(*) AS total, {_counts()}, {q.count(_COMPLETE)} AS complete_count FROM org WHERE is_active)
SELECT *, total - complete_count AS incomplete_count, {_RATES}, {q.pct('complete_count', 'total')} AS completeness_rate FROM a""")
def contact_coverage(spark, d):
    return C.contact_coverage(T.active_organizations(spark, d))


_CAT = f"""
WITH a AS (SELECT category, count(*) AS total, {_counts()} FROM org WHERE is_active GROUP BY category),
cov AS (SELECT *, {', '.join(f"{q.pct(f + '_count', 'total')} AS {f}_coverage" for f in COVERED)} FROM a)
"""


@query("category_coverage", _CAT + "SELECT * FROM cov ORDER BY total DESC, category")
def category_coverage(spark, d):
    return C.category_coverage(T.active_organizations(spark, d))


@query("category_ranking", _CAT + """
SELECT category, total AS total_organizations,
  round((phone_coverage + fax_coverage + email_coverage + homepage_coverage) / 4, 1) AS average_coverage,
  phone_coverage, fax_coverage, email_coverage, homepage_coverage FROM cov ORDER BY average_coverage DESC, category""")
def category_ranking(spark, d):
    return C.category_ranking(T.active_organizations(spark, d))


@query("export_category_csv", _CAT + """
SELECT category AS "Category", total AS "Total", phone_coverage AS "Phone_Coverage", fax_coverage AS "Fax_Coverage",
  email_coverage AS "Email_Coverage", homepage_coverage AS "Homepage_Coverage" FROM cov""")
def export_category_csv(spark, d):
    return exported(spark, C.category_csv(T.active_organizations(spark, d)))


_BOTH = """both_numbers AS (SELECT 'phone' AS kind, phone AS number FROM org WHERE is_active
  UNION ALL SELECT 'fax', fax FROM org WHERE is_active)"""


@query("phone_validity", f"""
WITH {_BOTH}, r AS (SELECT kind, {q.reason('number')} AS reason, count(*) AS n FROM both_numbers WHERE {q.filled('number')} GROUP BY 1, 2),
t AS (SELECT kind, CAST(sum(n) AS BIGINT) AS filled, CAST(sum(CASE WHEN reason = 'valid' THEN n ELSE 0 END) AS BIGINT) AS valid FROM r GROUP BY kind)
SELECT r.kind, r.reason, r.n, t.filled, {q.pct('t.valid', 't.filled')} AS validity_rate FROM r JOIN t ON t.kind = r.kind""")
def phone_validity(spark, d):
    return C.phone_validity(T.active_organizations(spark, d))


@query("area_distribution", f"""
WITH {_BOTH}, v AS (SELECT kind, {q.area(q.digits('number'))} AS area_code FROM both_numbers WHERE {q.reason('number')} = 'valid')
SELECT area_code, count(*) AS total_contacts, {q.count("kind = 'phone'")} AS phone_count, {q.count("kind = 'fax'")} AS fax_count,
  {q.area_name('area_code', "'알 수 없음'")} AS area_name
FROM v GROUP BY area_code ORDER BY total_contacts DESC, area_code LIMIT 20""")
def area_distribution(spark, d):
    return C.area_distribution(T.active_organizations(spark, d))


_DOM = f"""dom AS (SELECT {q.email_domain('email')} AS domain, count(*) AS n FROM org WHERE is_active AND contains(email, '@')
  GROUP BY 1 HAVING {q.email_domain('email')} <> '')"""


@query("email_domain_top", f"""
WITH {_DOM} SELECT domain, n, (SELECT count(*) FROM dom) AS total_unique_domains FROM dom ORDER BY n DESC, domain LIMIT 20""")
def email_domain_top(spark, d):
    return C.email_domain_top(T.active_organizations(spark, d))


@query("email_domain_classes", f"""
WITH {_DOM} SELECT {q.email_class('domain')} AS email_class, CAST(sum(n) AS BIGINT) AS n FROM dom GROUP BY 1""")
def email_domain_classes(spark, d):
    return C.email_domain_classes(T.active_organizations(spark, d))


_EMAIL_RE = r"([a-zA-Z0-9._%-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
_DOC_DOM = f"""m AS (SELECT unnest(regexp_extract_all(text, '{_EMAIL_RE}', 1)) AS email FROM documents WHERE contains(text, '@')),
dom AS (SELECT lower(split_part(email, '@', 2)) AS domain, count(*) AS n FROM m GROUP BY 1)"""


def _doc_emails(spark, d):
    docs = T.given(spark, d, "documents").select("text")
    return docs.select(F.explode(X.all_matches("text", V.EMAIL_PATTERNS[1:], "")).alias("email"))


@query("email_domain_top_documents", f"""
WITH {_DOC_DOM} SELECT domain, n, (SELECT count(*) FROM dom) AS total_unique_domains FROM dom ORDER BY n DESC, domain LIMIT 20""", uses=())
def email_domain_top_documents(spark, d):
    return C.email_domain_top(_doc_emails(spark, d))


@query("email_domain_classes_documents", f"""
WITH {_DOC_DOM} SELECT {q.email_class('domain')} AS email_class, CAST(sum(n) AS BIGINT) AS n FROM dom GROUP BY 1""", uses=())
def email_domain_classes_documents(spark, d):
    return C.email_domain_classes(_doc_emails(spark, d))


def _history_sql(days: int) -> str:
    return f"""
WITH h AS (SELECT CAST(CAST(updated_at AS DATE) AS VARCHAR) AS day, count(*) AS updated_count FROM org
  WHERE is_active AND updated_at >= {ORG_AS_OF} - INTERVAL {days} DAY GROUP BY 1)
SELECT day, updated_count, CAST(sum(updated_count) OVER () AS BIGINT) AS total_updates,
  round(avg(updated_count) OVER (), 1) AS average_daily_updates FROM h"""


@query("enrichment_history", _history_sql(30))
def enrichment_history(spark, d):
    return C.enrichment_history(T.active_organizations(spark, d), as_of_org())


_QUALITY = f"""
WITH a AS (SELECT count(*) AS total, {_counts()}, {q.count(_COMPLETE)} AS complete_count,
  {q.count(q.reason('phone') + " = 'valid'")} AS valid_phones, {q.count(q.reason('fax') + " = 'valid'")} AS valid_faxes FROM org WHERE is_active),
r AS (SELECT total, {_RATES}, {q.pct('valid_phones', 'phone_count')} AS phone_validity_rate,
  {q.pct('valid_faxes', 'fax_count')} AS fax_validity_rate, {q.pct('complete_count', 'total')} AS completeness_score FROM a),
s AS (SELECT *, (phone_rate + fax_rate + email_rate + homepage_rate) / 4 AS coverage, (phone_validity_rate + fax_validity_rate) / 2 AS validity FROM r),
rep AS (SELECT total, phone_validity_rate, fax_validity_rate, completeness_score, round(coverage, 1) AS coverage_score,
  round(validity, 1) AS validity_score, round(coverage * 0.4E0 + validity * 0.3E0 + completeness_score * 0.3E0, 1) AS overall_score,
  phone_validity_rate < 90 AS needs_phone_cleanup, completeness_score < 50 AS needs_enrichment, email_rate < 30 AS needs_email_collection FROM s)
"""


@query("quality_report", _QUALITY + "SELECT * FROM rep")
def quality_report(spark, d):
    return C.quality_report(T.active_organizations(spark, d))


@query("quality_recommendations", _QUALITY + """
SELECT 'high' AS priority, 'data_quality' AS category, 'needs_phone_cleanup' AS rule, phone_validity_rate AS value FROM rep WHERE needs_phone_cleanup
UNION ALL SELECT 'medium', 'data_coverage', 'needs_enrichment', completeness_score FROM rep WHERE needs_enrichment
UNION ALL SELECT 'medium', 'data_coverage', 'needs_email_collection', NULL FROM rep WHERE needs_email_collection""")
def quality_recommendations(spark, d):
    return C.quality_recommendations(C.quality_report(T.active_organizations(spark, d)))


# --- rows with parsed contact lists: the organization keeps its own e-mail and phone
#     in the lists so that every branch of the nested layout is present
def nested_contacts(spark, d):
    c = F.col
    return T.organizations(spark, d).select(
        "id", "name", "category", "homepage",
        F.when(c("id") % 2 == 0, c("phone")).otherwise("").alias("phone"),
        F.when(c("id") % 3 == 0, "").otherwise(c("fax")).alias("fax"),
        F.array_compact(F.array("phone", "fax")).alias("phones"),
        F.array_compact(F.array("fax")).alias("faxes"),
        F.when(is_filled("email"), F.array("email", F.concat(F.lit("info."), c("email")))).otherwise(F.array().cast("array<string>")).alias("emails"))


NESTED = """nested AS (SELECT id, name, category, homepage, CASE WHEN id % 2 = 0 THEN phone ELSE '' END AS phone,
  CASE WHEN id % 3 = 0 THEN '' ELSE fax END AS fax,
  list_filter([phone, fax], lambda x: x IS NOT NULL) AS phones, list_filter([fax], lambda x: x IS NOT NULL) AS faxes,
  CASE WHEN email IS NOT NULL AND email <> '' THEN [email, 'info.' || email] ELSE CAST([] AS VARCHAR[]) END AS emails FROM org)"""


def joined(c: str) -> str:
    return f"coalesce(array_to_string({c}, ', '), '')"


@query("file_quality_report", f"""
WITH {NESTED}, j AS (SELECT category, homepage, coalesce(nullif(phone, ''), {joined('phones')}) AS phone,
  coalesce(nullif(fax, ''), {joined('faxes')}) AS fax, {joined('emails')} AS email FROM nested),
f AS (SELECT *, trim(split_part(phone, ',', 1)) AS first_phone, trim(split_part(fax, ',', 1)) AS first_fax FROM j),
a AS (SELECT category, count(*) AS total, {_counts()}, {q.count(_COMPLETE)} AS complete_count,
  {q.count(q.filled('phone') + ' AND ' + q.reason('first_phone') + " = 'valid'")} AS valid_phones,
  {q.count(q.filled('fax') + ' AND ' + q.reason('first_fax') + " = 'valid'")} AS valid_faxes FROM f GROUP BY category)
SELECT *, {q.pct('phone_count', 'total')} AS phone_rate, {q.pct('valid_phones', 'phone_count')} AS phone_validity,
  {q.pct('complete_count', 'total')} AS completeness FROM a""")
def file_quality_report(spark, d):
    return C.file_quality_report(nested_contacts(spark, d))


_ALL_FILLED = " + ".join(f"n_{f}" for f in q.FIELDS)


@query("contact_statistics", f"""
WITH a AS (SELECT count(*) AS t, {', '.join(f"{q.count(q.filled(f))} AS n_{f}" for f in q.FIELDS)}, {q.count(q.any_missing())} AS needing FROM org WHERE is_active),
r AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, t AS total, n_{f} AS filled FROM a" for f in q.FIELDS)}
  UNION ALL SELECT 'all_fields', t * 5, {_ALL_FILLED} FROM a UNION ALL SELECT 'complete_organizations', t, t - needing FROM a)
SELECT field, total, filled, total - filled AS missing, round({q.pct('filled', 'total', None)}, 6) AS completion_rate FROM r""")
def contact_statistics(spark, d):
    return C.contact_statistics(T.active_organizations(spark, d))


@query("missing_count_histogram", f"""
SELECT {q.missing_count()} AS missing_count, count(*) AS org_count FROM org WHERE is_active GROUP BY 1""")
def missing_count_histogram(spark, d):
    return C.missing_histogram(T.active_organizations(spark, d))


@query("missing_field_distribution", f"""
WITH c AS (SELECT * FROM org WHERE is_active AND {q.any_missing()}),
a AS (SELECT count(*) AS n, {', '.join(f"{q.count(q.blank(f))} AS n_{f}" for f in q.FIELDS)} FROM c), t AS (SELECT *, {_ALL_FILLED} AS t FROM a)
{' UNION ALL '.join(f"SELECT '{f}' AS field, n_{f} AS org_count, n AS total_candidates, t AS total_missing_fields, round(CASE WHEN n > 0 THEN CAST(t AS DOUBLE) / n ELSE 0.0E0 END, 6) AS avg_missing_per_org FROM t" for f in q.FIELDS)}""")
def missing_field_distribution(spark, d):
    return C.missing_field_distribution(R.missing_any_contact(T.active_organizations(spark, d)))


@query("dashboard_stats", f"""
SELECT 'status' AS metric, contact_status AS key, count(*) AS value FROM org WHERE is_active GROUP BY contact_status
UNION ALL SELECT 'organizations', '', count(*) FROM org WHERE is_active
UNION ALL SELECT 'users', '', count(*) FROM users WHERE is_active
UNION ALL SELECT 'recent_activities', '', count(*) FROM activities WHERE created_at >= {ORG_AS_OF} - INTERVAL 7 DAY
UNION ALL SELECT 'follow_ups_this_week', '', count(*) FROM activities WHERE created_at >= {ORG_AS_OF} - INTERVAL 7 DAY AND NOT is_completed""",
       uses=("org", "users", "activities"))
def dashboard_stats(spark, d):
    return C.dashboard_stats(T.organizations(spark, d), T.view(spark, d, "users"), T.view(spark, d, "activities"), as_of_org())


@query("type_source_distribution", """
SELECT 'type' AS dimension, type AS key, count(*) AS n FROM org WHERE is_active GROUP BY type
UNION ALL SELECT 'source', assigned_to, count(*) FROM org WHERE is_active GROUP BY assigned_to""")
def type_source_distribution(spark, d):
    return C.type_source_distribution(T.active_organizations(spark, d).withColumnRenamed("assigned_to", "data_source"))


@query("summary_stats", f"""
WITH a AS (SELECT count(*) AS t, {', '.join(f"{q.count(q.filled(f))} AS n_{f}" for f in q.FIELDS)}, {q.count(q.any_missing())} AS needing FROM org WHERE is_active)
SELECT t AS total_organizations, round({q.pct('(' + _ALL_FILLED + ')', '(t * 5)', None)}, 6) AS contact_completion_rate,
  needing AS organizations_needing_enrichment, t - needing AS complete_organizations FROM a""")
def summary_stats(spark, d):
    return C.summary_stats(T.active_organizations(spark, d))


_LEVEL = "CASE role " + " ".join(f"WHEN '{r}' THEN {v['level']}" for r, v in V.ROLES.items()) + " ELSE 0 END"


@query("role_statistics", f"""
SELECT role, count(*) AS user_count, {q.count('is_active')} AS active_count, {q.count('NOT is_active')} AS inactive_count, {_LEVEL} AS level
FROM users WHERE role IN {q.in_list(V.ROLES['대표']['view'])} GROUP BY role""", uses=("users",))
def role_statistics(spark, d):
    return C.role_statistics(T.view(spark, d, "users"), "대표")


@query("crawl_statistics", f"""
SELECT count(*) AS total_organizations, {q.count('ai_crawled')} AS ai_crawled_count, {_counts(("phone", "fax", "homepage", "email"))} FROM org""")
def crawl_statistics(spark, d):
    return C.crawl_statistics(T.organizations(spark, d))


@query("crawl_grade_histogram", """
SELECT json_extract_string(crawling_data, '$.data_quality_grade') AS grade, count(*) AS n FROM org
WHERE ai_crawled AND crawling_data IS NOT NULL GROUP BY 1 HAVING json_extract_string(crawling_data, '$.data_quality_grade') <> ''""")
def crawl_grade_histogram(spark, d):
    return C.crawl_grades(T.organizations(spark, d))


@query("crawl_recent_stats", f"""
SELECT count(*) AS recently_crawled, round(avg(CAST(json_extract_string(crawling_data, '$.validation_score') AS DOUBLE)), 6) AS avg_validation_score
FROM org WHERE last_crawled_at >= {ORG_AS_OF} - INTERVAL 1 DAY AND crawling_data IS NOT NULL""")
def crawl_recent_stats(spark, d):
    return C.crawl_recent_stats(T.organizations(spark, d), as_of_org())


@query("crawl_tracking_counts", f"""
SELECT count(*) AS total, {q.count('ai_crawled')} AS crawled, {q.count('NOT coalesce(ai_crawled, false)')} AS not_crawled FROM org WHERE is_active""")
def crawl_tracking_counts(spark, d):
    return C.crawl_tracking_counts(T.active_organizations(spark, d))


JOB_SQL = f"""
WITH a AS (SELECT job_id, count(*) AS total_count, {q.count("status = 'COMPLETED'")} AS processed_count,
  {q.count("status = 'FAILED'")} AS failed_count, {q.count("status = 'PROCESSING'")} AS open_count FROM results GROUP BY job_id)
SELECT job_id, total_count, processed_count, failed_count, {q.pct('processed_count', 'total_count', 6)} AS progress_percentage,
  open_count > 0 AS is_running FROM a"""


@query("job_progress", JOB_SQL, uses=("results",))
def job_progress(spark, d):
    return C.job_progress(T.view(spark, d, "results"))


@query("enrichment_run_summary", f"""
WITH r AS (SELECT {q.missing_fields()} AS m, candidate, id FROM (SELECT *, 'f' || CAST(id % 5 AS VARCHAR) AS candidate FROM org WHERE is_active AND {q.any_missing()})),
f AS (SELECT list_filter(m, lambda x: (id + length(x)) % 2 = 0) AS found, CAST(id % 10 AS DOUBLE) AS processing_time FROM r)
SELECT count(*) AS processed_count, {q.count('len(found) > 0')} AS successful_count, CAST(coalesce(sum(len(found)), 0) AS BIGINT) AS total_fields_found,
  round(avg(processing_time), 6) AS avg_processing_time, {', '.join(f"{q.count(f"list_contains(found, '{f}')")} AS found_{f}" for f in q.FIELDS)} FROM f""")
def enrichment_run_summary(spark, d):
    found = F.filter(missing_fields(), lambda x: (F.col("id") + F.length(x)) % 2 == 0)
    runs = R.missing_any_contact(T.active_organizations(spark, d)).select(
        found.alias("found"), (F.col("id") % 10).cast("double").alias("processing_time"))
    return C.enrichment_run_summary(runs)


@query("migration_summary", f"""
WITH o AS (SELECT type AS source, CASE WHEN {q.blank('phone')} THEN 'failed' WHEN is_active THEN 'migrated' ELSE 'duplicate' END AS outcome FROM org),
a AS (SELECT source, {q.count("outcome = 'migrated'")} AS migrated, {q.count("outcome = 'duplicate'")} AS duplicate, {q.count("outcome = 'failed'")} AS failed FROM o GROUP BY source)
SELECT source, migrated + duplicate + failed AS processed, migrated, duplicate, failed,
  {q.pct('migrated', '(migrated + duplicate + failed)')} AS success_rate FROM a""")
def migration_summary(spark, d):
    outcome = F.when(F.coalesce(F.trim("phone"), F.lit("")) == "", "failed").when(F.col("is_active"), "migrated").otherwise("duplicate")
    return C.outcome_summary(T.organizations(spark, d).select(F.col("type").alias("source"), outcome.alias("outcome")))


@query("search_run_summary", f"""
WITH a AS (SELECT count(*) AS total_processed, {q.count("status <> 'FAILED'")} AS successful_searches,
  {q.count("status = 'FAILED'")} AS failed_searches, {q.count(q.filled('phone'))} AS contacts_found FROM results)
SELECT *, {q.pct('successful_searches', 'total_processed')} AS success_rate FROM a""", uses=("results",))
def search_run_summary(spark, d):
    return C.search_run_summary(T.view(spark, d, "results"))


_FN, _PN = q.normalize_groups("fax"), q.normalize_groups("phone")
FAX_STRICT = f"""(CASE WHEN NOT {q.filled('fax')} THEN false ELSE {q.valid_prefix('fn')} AND (CASE WHEN {q.filled('phone')} THEN fn <> pn
  AND ({q.area_len('fd')}) = ({q.area_len('pd')}) AND NOT {q.too_similar('fd', 'pd')} ELSE true END) AND {q.fits_address('fn', 'address')} END)"""
FAX_RELAXED = f"""(CASE WHEN NOT {q.filled('fax')} THEN false ELSE {q.valid_prefix('fn')} AND (CASE WHEN NOT {q.blank('phone')} AND {q.valid_prefix('pn')}
  AND (fn = pn OR {q.too_similar('fd', 'pd')}) THEN {q.fits_address('fn', 'address', V.AREA_REGIONS_WIDE)} ELSE true END) END)"""
FAXED = f"""n0 AS (SELECT *, {_FN} AS fn, {_PN} AS pn FROM org), n1 AS (SELECT *, {q.digits('fn')} AS fd, {q.digits('pn')} AS pd FROM n0),
faxed AS (SELECT *, coalesce({FAX_STRICT}, false) AS ok_strict, coalesce({FAX_RELAXED}, false) AS ok_relaxed FROM n1)"""


@query("extraction_result_counts", f"""
WITH {FAXED}, a AS (SELECT count(*) AS total_count, {q.count(q.filled('fax'))} AS fax_count, {q.count(q.filled('homepage'))} AS homepage_count,
  {q.count(q.filled('fax') + ' AND ok_strict')} AS success_count, {q.count(q.filled('fax') + ' AND NOT ok_strict')} AS duplicate_count FROM faxed)
SELECT *, {q.pct('fax_count', 'total_count')} AS fax_rate, {q.pct('homepage_count', 'total_count')} AS homepage_rate FROM a""")
def extraction_result_counts(spark, d):
    return C.extraction_result_counts(T.organizations(spark, d))


@query("purge_invalid_fax", f"""
WITH {FAXED} SELECT id, CASE WHEN NOT {q.blank('fax')} AND NOT ok_relaxed THEN '' ELSE fax END AS fax,
  NOT {q.blank('fax')} AND NOT ok_relaxed AS fax_purged FROM faxed""")
def purge_invalid_fax(spark, d):
    return C.purge_invalid_fax(T.organizations(spark, d)).select("id", "fax", "fax_purged")


@query("purge_invalid_fax_counts", f"""
WITH {FAXED}, a AS (SELECT count(*) AS total_count, {q.count(q.filled('fax'))} AS fax_count,
  {q.count('NOT ' + q.blank('fax') + ' AND NOT ok_relaxed')} AS invalid_fax_count FROM faxed)
SELECT *, fax_count - invalid_fax_count AS valid_fax_count FROM a""")
def purge_invalid_fax_counts(spark, d):
    return C.purge_counts(T.organizations(spark, d))


@query("dataset_basic_stats", f"""
SELECT count(*) AS total_records, count(DISTINCT nullif(name, '')) AS unique_names, count(DISTINCT nullif(category, '')) AS unique_categories,
  {', '.join(f"{q.count(q.filled(f))} AS has_{f}" for f in ("homepage", "phone", "email"))} FROM org""")
def dataset_basic_stats(spark, d):
    return C.dataset_basic_stats(T.organizations(spark, d))


FILL_COLS = ["name", "category", "type", "phone", "fax", "email", "homepage", "address", "priority", "crawling_data"]


@query("dataset_field_fill", f"""
WITH a AS (SELECT count(*) AS t, {', '.join(f"{q.count('NOT ' + q.blank(f))} AS n_{f}" for f in FILL_COLS)} FROM org)
{' UNION ALL '.join(f"SELECT '{f}' AS field, t AS total_count, n_{f} AS non_empty_count, round({q.pct('n_' + f, 't', None)}, 6) AS fill_rate FROM a" for f in FILL_COLS)}""")
def dataset_field_fill(spark, d):
    return C.dataset_field_fill(T.organizations(spark, d).select(*FILL_COLS))


_REQ, _OPT = ("name", "category"), ("phone", "fax", "email", "address")


def _mean(cols):
    return "((" + " + ".join(q.pct("n_" + c, "t", None) for c in cols).replace("CASE", "(CASE").replace("END", "END)") + f") / {len(cols)})"


@query("dataset_quality_metrics", f"""
WITH a AS (SELECT count(*) AS t, {', '.join(f"{q.count('NOT ' + q.blank(f))} AS n_{f}" for f in _REQ + _OPT)} FROM org)
SELECT round({_mean(_REQ)}, 6) AS required_fields_score, round({_mean(_OPT)}, 6) AS optional_fields_score,
  round({_mean(_REQ)} * 0.7E0 + {_mean(_OPT)} * 0.3E0, 6) AS overall_score FROM a""")
def dataset_quality_metrics(spark, d):
    return C.dataset_quality_metrics(T.organizations(spark, d))


@query("grade_distribution", f"""
SELECT {q.grade()} AS grade, count(*) AS n,
  round(avg((CASE WHEN {q.filled('phone')} THEN 1 ELSE 0 END + CASE WHEN {q.filled('fax')} THEN 1 ELSE 0 END + CASE WHEN {q.filled('email')} THEN 1 ELSE 0 END + CASE WHEN {q.filled('homepage')} THEN 1 ELSE 0 END) / 4.0E0), 6) AS avg_confidence,
  CAST(sum(CASE WHEN {q.filled('phone')} THEN 1 ELSE 0 END + CASE WHEN {q.filled('email')} THEN 1 ELSE 0 END + CASE WHEN {q.filled('homepage')} THEN 1 ELSE 0 END) AS BIGINT) AS total_contacts
FROM org GROUP BY 1""")
def grade_distribution(spark, d):
    contacts = sum((is_filled(f).cast("int") for f in ("email", "homepage")), is_filled("phone").cast("int"))
    return C.grade_distribution(T.organizations(spark, d).select(
        S.grade_by_fields().alias("grade"), S.field_share(["phone", "fax", "email", "homepage"]).alias("confidence"), contacts.alias("contacts")))


STAT_COLS = ["name", "category", "phone", "fax", "email", "homepage", "address"]


@query("field_stats_sheet", f"""
WITH a AS (SELECT count(*) AS t, {', '.join(f"{q.count('NOT ' + q.blank(f))} AS n_{f}, min({f}) AS s_{f}" for f in STAT_COLS)} FROM org WHERE is_active)
{' UNION ALL '.join(f"SELECT '{f}' AS field, t AS total_records, n_{f} AS non_empty_records, {q.pct('n_' + f, 't')} AS fill_percent, coalesce(substr(s_{f}, 1, 50), '') AS sample FROM a" for f in STAT_COLS)}""")
def field_stats_sheet(spark, d):
    return C.field_stats(T.active_organizations(spark, d), STAT_COLS)


@query("column_profile", f"""
WITH v AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, trim({f}) AS value FROM org" for f in STAT_COLS)}),
s AS (SELECT field, count(*) AS total_rows, {q.count("coalesce(value, '') <> ''")} AS non_empty_count,
  count(DISTINCT CASE WHEN value <> '' THEN value END) AS unique_values FROM v GROUP BY field),
dv AS (SELECT DISTINCT field, value FROM v WHERE value <> ''), rk AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY value) AS rn FROM dv),
sm AS (SELECT field, string_agg(value, '|' ORDER BY rn) AS samples FROM rk WHERE rn <= 5 GROUP BY field)
SELECT s.field, total_rows, non_empty_count, {q.pct('non_empty_count', 'total_rows')} AS fill_rate, unique_values, coalesce(samples, '') AS samples
FROM s LEFT JOIN sm ON sm.field = s.field""")
def column_profile(spark, d):
    return C.column_profile(T.organizations(spark, d), STAT_COLS)


UNIQUE_COLS = ["name", "category", "type", "phone", "homepage", "address"]


@query("table_profile", f"""
WITH a AS (SELECT count(*) AS t, {', '.join(f"{q.count(f + ' IS NULL')} AS n_{f}" for f in FILL_COLS)},
  {', '.join(f"count(DISTINCT {f}) AS u_{f}" for f in UNIQUE_COLS)} FROM org)
{' UNION ALL '.join(f"SELECT '{f}' AS field, t AS total_rows, n_{f} AS null_count, {q.pct('n_' + f, 't')} AS null_percent, {('u_' + f) if f in UNIQUE_COLS else 'NULL'} AS unique_count FROM a" for f in FILL_COLS)}""")
def table_profile(spark, d):
    return C.table_profile(T.organizations(spark, d).select(*FILL_COLS), UNIQUE_COLS)
