"""File sources and sinks. Files are written by Spark from the organization table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orgloom.functions import fixed_values as V
from orgloom.operators import ingest as I
from orgloom.session import wide
from orgloom.sources import files, sinks, workbooks
from orgloom.sources import tables as T

from . import sqlparts as q
from .coverage import NESTED, exported, joined, nested_contacts, scratch
from .registry import query

c = F.col
TEXT = ["name", "homepage", "phone", "fax", "email", "address", "category"]
_TEXT = ", ".join(TEXT)




def _json_docs(spark, d):
    """Documents of at most 100 organizations each, as {category: [organizations]}."""
    o = T.organizations(spark, d).select("id", *TEXT)
    per = o.groupBy(F.floor(c("id") / 100).alias("chunk"), c("category").alias("k")).agg(F.collect_list(F.struct(*TEXT[:-1])).alias("v"))
    docs = per.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    # beside the lists: an object and a number that are no organizations
    return docs.select(F.concat(F.lit('{"metadata": {"version": 1, "tags": ["x"]}, "pages": 3, '), F.substring(F.to_json("m"), 2, 1 << 30)).alias("value"))


def _written_json(spark, d, docs):
    path = scratch(spark, "json")
    docs.write.text(path)
    return path


@query("read_json_by_category", f"SELECT {_TEXT} FROM org")
def read_json_by_category(spark, d):
    return files.read_json_by_category(spark, _written_json(spark, d, _json_docs(spark, d)), lines=True).select(*TEXT)


@query("count_by_file_category", """
SELECT category, count(*) AS n FROM org GROUP BY category
UNION ALL SELECT unnest(['metadata', 'pages']), count(DISTINCT id // 100) FROM org""")
def count_by_file_category(spark, d):
    return files.count_json_categories(spark, _written_json(spark, d, _json_docs(spark, d)), lines=True)


@query("read_json_wrapped", f"SELECT {_TEXT} FROM org")
def read_json_wrapped(spark, d):
    o = T.organizations(spark, d).select("id", *TEXT)
    items = o.groupBy(F.floor(c("id") / 100).alias("chunk")).agg(F.collect_list(F.struct(*TEXT)).alias("v"))
    as_list = F.to_json("v")
    docs = items.select(F.when(c("chunk") % 2 == 0, F.concat(F.lit('{"churches": '), as_list, F.lit("}"))).otherwise(as_list).alias("value"))
    return files.read_json_wrapped(spark, _written_json(spark, d, docs), lines=True).select(*TEXT)


@query("read_json_document", f"SELECT {_TEXT} FROM org")
def read_json_document(spark, d):
    """Documents of many lines, one per file, each {category: [organizations]}."""
    o = T.organizations(spark, d).select("id", *TEXT).withColumn("chunk", F.floor(c("id") / 500))
    w = Window.partitionBy("chunk")
    inner = Window.partitionBy("chunk", "category").orderBy("id")
    turn, last = F.row_number().over(inner), F.count("*").over(Window.partitionBy("chunk", "category"))
    opens = F.when(turn == 1, F.concat(F.to_json(F.struct(F.array("category").alias("k"))), F.lit("")))
    key = F.concat(F.substring(opens, 7, 1 << 20).substr(F.lit(1), F.length(opens) - 8), F.lit(": [\n"))
    first = c("category") == F.min("category").over(w)
    final = c("category") == F.max("category").over(w)
    start = F.when(turn == 1, F.concat(F.when(first, "{\n").otherwise(",\n"), key)).otherwise(",\n")
    end = F.when(turn == last, F.concat(F.lit("\n]"), F.when(final, "\n}").otherwise(""))).otherwise("")
    lines = o.select("chunk", "category", "id", F.concat(start, F.to_json(F.struct(*TEXT[:-1])), end).alias("value"))
    path = scratch(spark, "json")
    lines.repartition("chunk").sortWithinPartitions("chunk", "category", "id").select("chunk", "value").write.partitionBy("chunk").text(path)
    return files.read_json_by_category(spark, f"{path}/*").select(*TEXT)


KOREAN = {"name": "기관명", "category": "분류", "phone": "전화번호", "fax": "팩스번호", "email": "이메일", "homepage": "홈페이지", "address": "주소"}


def _korean_sheet(spark, d):
    return T.organizations(spark, d).select(*[c(k).alias(v) for k, v in KOREAN.items()])


def _written_csv(spark, df, encoding: str = "utf-8", path: str | None = None):
    path = path or scratch(spark, "csv")
    with files.jvm_charsets(spark):
        df.write.csv(path, header=True, quote='"', escape='"', emptyValue="", encoding=files.java_charset(spark, encoding),
                     ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


_BACK = ", ".join(f"nullif({k}, '') AS \"{v}\"" for k, v in KOREAN.items())


@query("read_csv_encodings", f"SELECT {_BACK} FROM org")
def read_csv_encodings(spark, d):
    # one folder, files in two encodings
    o = T.organizations(spark, d)
    path = scratch(spark, "csv")
    for i, encoding in enumerate(("cp949", "utf-8")):
        _written_csv(spark, o.filter(c("id") % 2 == i).select(*[c(k).alias(v) for k, v in KOREAN.items()]), encoding, f"{path}/{i}")
    df = files.read_csv_encodings(spark, f"{path}/*")
    return df.select(*[F.nullif(f"`{n}`", F.lit("")).alias(n) for n in KOREAN.values()])


@query("read_csv_multi_line", f"SELECT {_BACK.replace('nullif(address', 'nullif(replace(address, chr(32), chr(10))')} FROM org")
def read_csv_multi_line(spark, d):
    # addresses of several lines, in quotes
    o = _korean_sheet(spark, d).withColumn("주소", F.replace(c("주소"), F.lit(" "), F.lit("\n")))
    return files.read_csv_encodings(spark, _written_csv(spark, o), multi_line=True)


@query("read_sheet", f"SELECT {', '.join(f'nullif({k}, {chr(39) * 2}) AS {k}' for k in KOREAN)} FROM org")
def read_sheet(spark, d):
    path = _written_csv(spark, _korean_sheet(spark, d))
    df = files.read_sheet(spark, path)
    return df.select(*[F.nullif(f"`{v}`", F.lit("")).alias(k) for k, v in KOREAN.items()])


def _tidy(f: str) -> str:
    return f"CASE WHEN {q.valid_strict(f)} THEN {q.format_phone(f)} ELSE coalesce({f}, '') END AS {f}"


@query("read_sheet_positional", f"SELECT name, {_tidy('phone')}, {_tidy('fax')}, coalesce(email, '') AS email, coalesce(homepage, '') AS homepage FROM org WHERE {q.filled('name')}")
def read_sheet_positional(spark, d):
    o = T.organizations(spark, d).select("name", "phone", "fax", "email", "homepage")
    # CSV readers trim nothing: keep the blank phones as they are
    return files.read_sheet_positional(spark, _written_csv(spark, o))


def _written_workbooks(spark, df, **options):
    path = scratch(spark, "xlsx")
    # a workbook is written and read by one task
    workbooks.write_workbooks(df.repartition(wide(spark)), path, **options)
    return path


@query("read_workbook", f"SELECT {', '.join(f'nullif({k}, {chr(39) * 2}) AS {k}' for k in KOREAN)} FROM org")
def read_workbook(spark, d):
    # title lines above the header, as in exported lists
    path = _written_workbooks(spark, _korean_sheet(spark, d), title="기관 현황\n기준 2024")
    return workbooks.read_workbook(spark, path, header_row=2).select(*[c(f"`{v}`").alias(k) for k, v in KOREAN.items()])


@query("read_workbook_positional", f"SELECT name, {_tidy('phone')}, {_tidy('fax')}, coalesce(email, '') AS email, coalesce(homepage, '') AS homepage FROM org WHERE {q.filled('name')}")
def read_workbook_positional(spark, d):
    o = T.organizations(spark, d).select("name", "phone", "fax", "email", "homepage")
    return files.positional(workbooks.read_workbook(spark, _written_workbooks(spark, o), sheet="active"))


def _clean(f: str) -> str:
    return f"CASE WHEN trim(coalesce({f}, '')) IN {q.in_list(V.BLANK_WORDS)} THEN '' ELSE trim(coalesce({f}, '')) END"


_URLED = "CASE WHEN NOT starts_with(u, 'http://') AND NOT starts_with(u, 'https://') AND (starts_with(u, 'www.') OR contains(u, '.')) THEN 'http://' || u ELSE u END"


@query("map_columns_exact", f"""
WITH k AS (SELECT {', '.join(f'{_clean(f)} AS {f}' for f in ('name', 'category', 'phone', 'fax', 'email', 'address'))}, {_clean('homepage')} AS u FROM org)
SELECT name, category, {_URLED} AS homepage, CASE WHEN {q.valid_strict('phone')} THEN {q.format_phone('phone')} ELSE phone END AS phone,
  CASE WHEN {q.valid_strict('fax')} THEN {q.format_phone('fax')} ELSE fax END AS fax, CASE WHEN contains(email, '@') AND contains(email, '.') THEN email ELSE '' END AS email,
  '' AS mobile, '' AS postal_code, address FROM k WHERE name <> ''""")
def map_columns_exact(spark, d):
    df = files.read_csv_encodings(spark, _written_csv(spark, _korean_sheet(spark, d)))
    return I.clean_rows(I.map_columns(df, I.exact_mapping(df.columns), I.CANONICAL))


@query("map_columns_keyword", """
SELECT name, address AS address, phone, fax, email, homepage, category, '' AS subcategory FROM org""")
def map_columns_keyword(spark, d):
    o = T.organizations(spark, d).select(
        c("type").alias("옛 상호명"), c("name").alias("학원명(상호명)"), c("address").alias("도로명주소"), c("phone").alias("대표 전화번호"),
        c("fax").alias("팩스 전화번호"), c("email").alias("E-Mail"), c("homepage").alias("Website URL"), c("category").alias("분야명"))
    return I.map_columns(o, I.keyword_mapping(o.columns), ["name", "address", "phone", "fax", "email", "homepage", "category", "subcategory"])


@query("map_columns_candidates", f"""
WITH n AS (SELECT {', '.join(f"CASE WHEN trim({f}) <> '' AND lower(trim({f})) NOT IN ('nan', 'none', 'null') THEN trim({f}) END AS {f}" for f in ('name', 'category', 'homepage', 'phone', 'fax', 'email', 'address'))} FROM org)
SELECT coalesce(name, '') AS name, coalesce(category, '') AS category, coalesce(homepage, '') AS homepage, coalesce(phone, fax, '') AS phone, coalesce(fax, '') AS fax, coalesce(email, '') AS email,
  '' AS mobile, '' AS postal_code, coalesce(address, '') AS address FROM n""")
def map_columns_candidates(spark, d):
    o = T.organizations(spark, d).select(c("name").alias("업체명"), c("category").alias("업종"), "homepage", "phone", c("fax").alias("전화"), c("fax").alias("팩스"), c("email").alias("mail"), c("address").alias("소재지"))
    return I.first_nonblank_columns(o)


@query("normalize_schema", "SELECT id, name, address, phone, '' AS fax, '' AS homepage FROM org")
def normalize_schema(spark, d):
    o = T.organizations(spark, d).select("id", c("name").alias("기관명"), c("address").alias("주소"), c("phone").alias("전화번호"))
    return I.normalize_schema(o)


@query("add_columns_if_absent", "SELECT id, name, ai_crawled, CAST(NULL AS TIMESTAMP) AS last_crawled_at FROM org")
def add_columns_if_absent(spark, d):
    o = T.organizations(spark, d).select("id", "name", "ai_crawled")
    return I.add_columns_if_absent(o, {"ai_crawled": F.lit(False), "last_crawled_at": F.lit(None).cast("timestamp_ntz")})


def _t(f: str) -> str:
    return f"trim(coalesce({f}, '')) AS {f}"


@query("shape_organization", f"""
SELECT id, {_t('name')}, 'CHURCH' AS type, coalesce(category, '종교시설') AS category, {', '.join(_t(f) for f in ('homepage', 'phone', 'fax', 'email', 'address'))}, '' AS mobile, '' AS postal_code,
  'NEW' AS contact_status, 'MEDIUM' AS priority, 'DATABASE' AS lead_source, '{{"page_title":"' || name || '","ai_summary":"' || type || '"}}' AS crawling_data, 'MIGRATION' AS created_by FROM org""")
def shape_organization(spark, d):
    o = T.organizations(spark, d).select("id", "name", "category", "homepage", "phone", "fax", "email", "address", c("name").alias("page_title"), c("type").alias("ai_summary"))
    return I.shape_organization(o)


@query("shape_sheet_row", f"""
SELECT id, {_t('name')}, CASE WHEN contains(type, 'ACADEMY') THEN 'ACADEMY' ELSE 'CHURCH' END AS type,
  coalesce(nullif(trim(coalesce(priority, '')), ''), CASE WHEN contains(type, 'ACADEMY') THEN '학원' ELSE '종교시설' END) AS category,
  {', '.join(_t(f) for f in ('phone', 'fax', 'email', 'homepage', 'address'))}, 'NEW' AS contact_status, 'MEDIUM' AS priority, 'EXCEL_' || type AS data_source FROM org""")
def shape_sheet_row(spark, d):
    o = T.organizations(spark, d).select("id", "name", c("priority").alias("category"), "phone", "fax", "email", "homepage", "address", F.concat(F.lit("EXCEL_"), "type").alias("data_source"))
    return I.shape_sheet_row(o)


FLAT = f"""flat AS (SELECT id, name, coalesce(nullif(phone, ''), {joined('phones')}) AS phone, coalesce(nullif(fax, ''), {joined('faxes')}) AS fax, {joined('emails')} AS email, coalesce(homepage, '') AS url FROM nested)"""


@query("export_contact_flat", f"WITH {NESTED}, {FLAT} SELECT name, phone, fax, email, url FROM flat")
def export_contact_flat(spark, d):
    return exported(spark, sinks.contact_flat(nested_contacts(spark, d)))


@query("export_sheet_with_flag", f"""
WITH {NESTED}, {FLAT} SELECT name, phone, fax, email, url, CASE WHEN phone <> '' OR email <> '' THEN '검증완료' ELSE '정보부족' END AS review_status,
  CASE WHEN phone <> '' OR email <> '' THEN '100' ELSE '50' END AS review_score, CASE WHEN phone <> '' OR email <> '' THEN '높음' ELSE '낮음' END AS confidence FROM flat""")
def export_sheet_with_flag(spark, d):
    return exported(spark, sinks.sheet_with_flag(sinks.contact_flat(nested_contacts(spark, d))))


@query("export_workbook_with_flag", f"""
WITH {NESTED}, {FLAT} SELECT name, nullif(phone, '') AS phone, nullif(fax, '') AS fax, nullif(email, '') AS email, nullif(url, '') AS url,
  CASE WHEN phone <> '' OR email <> '' THEN '검증완료' ELSE '정보부족' END AS review_status,
  CASE WHEN phone <> '' OR email <> '' THEN '100' ELSE '50' END AS review_score, CASE WHEN phone <> '' OR email <> '' THEN '높음' ELSE '낮음' END AS confidence FROM flat""")
def export_workbook_with_flag(spark, d):
    return workbooks.read_workbook(spark, _written_workbooks(spark, sinks.sheet_with_flag(sinks.contact_flat(nested_contacts(spark, d))), sheet_name="연락처"), sheet="연락처")


@query("export_org_snapshot", f"""
SELECT id, {', '.join(f"coalesce({f}, '') AS {f}" for f in ('name', 'type', 'category', 'homepage', 'phone', 'fax', 'email'))}, '' AS postal_code, coalesce(address, '') AS address FROM org WHERE is_active ORDER BY id""")
def export_org_snapshot(spark, d):
    return exported(spark, sinks.org_snapshot(T.active_organizations(spark, d)), "id")


@query("exclude_and_reorder", "SELECT name, category, phone, fax, email, address, id, type, priority FROM org")
def exclude_and_reorder(spark, d):
    o = T.organizations(spark, d).select("id", "type", "priority", "address", "email", "fax", "phone", "homepage", "category", "name",
                                         F.lit("x").alias("merge_status"), F.lit("y").alias("ai_analysis"))
    return I.exclude_and_reorder(o)


def _source_sql(name: str, columns: list[str]) -> str:
    packed = "{" + ", ".join(f"{x}: {x}" for x in columns) + "}"
    return (f"SELECT '{name[0]}' AS source, (SELECT count(*) FROM {name[1]}) AS row_count, '{','.join(columns)}' AS columns, "
            f"(SELECT string_agg(to_json({packed})::VARCHAR, chr(10) ORDER BY id) FROM (SELECT * FROM {name[1]} ORDER BY id LIMIT 3)) AS sample")


USER_COLUMNS = ["id", "username", "full_name", "role", "team", "is_active"]
ACTIVITY_COLUMNS = ["id", "organization_id", "activity_type", "subject", "is_completed"]


@query("source_profile", " UNION ALL ".join([_source_sql(("organizations", "org"), ["id", *TEXT]), _source_sql(("users", "users"), USER_COLUMNS),
                                             _source_sql(("activities", "activities"), ACTIVITY_COLUMNS)]), uses=("org", "users", "activities"))
def source_profile(spark, d):
    return I.source_profile({"organizations": T.organizations(spark, d).select("id", *TEXT), "users": T.view(spark, d, "users").select(*USER_COLUMNS),
                             "activities": T.view(spark, d, "activities").select(*ACTIVITY_COLUMNS)})
