"""Tables the queries run on.

The organization tables are views over the given parquet tables, written in
plain SQL that Spark and DuckDB both accept, so a check never depends on our
own code. Each view is one scan (plus one pre-aggregated join where dates are
needed) and prunes to the columns a query uses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from orgloom.session import wide

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_LO = """
  SELECT o_custkey AS k, MAX(o_orderdate) AS last_o, MIN(o_orderdate) AS first_o, COUNT(*) AS n_o
  FROM orders GROUP BY o_custkey"""

_B = """
  SELECT c.c_custkey AS k, c.c_name, c.c_mktsegment, c.c_nationkey, lo.last_o, lo.first_o, lo.n_o,
    CASE c.c_custkey % 17 WHEN 0 THEN '02' WHEN 1 THEN '031' WHEN 2 THEN '032' WHEN 3 THEN '033' WHEN 4 THEN '041'
      WHEN 5 THEN '042' WHEN 6 THEN '043' WHEN 7 THEN '044' WHEN 8 THEN '051' WHEN 9 THEN '052' WHEN 10 THEN '053'
      WHEN 11 THEN '054' WHEN 12 THEN '055' WHEN 13 THEN '061' WHEN 14 THEN '062' WHEN 15 THEN '063' ELSE '064' END AS ac,
    CASE c.c_custkey % 17 WHEN 0 THEN '서울' WHEN 1 THEN '경기' WHEN 2 THEN '인천' WHEN 3 THEN '강원' WHEN 4 THEN '충남'
      WHEN 5 THEN '대전' WHEN 6 THEN '충북' WHEN 7 THEN '세종' WHEN 8 THEN '부산' WHEN 9 THEN '울산' WHEN 10 THEN '대구'
      WHEN 11 THEN '경북' WHEN 12 THEN '경남' WHEN 13 THEN '전남' WHEN 14 THEN '광주' WHEN 15 THEN '전북' ELSE '제주' END AS region,
    lpad(CAST((c.c_custkey * 37) % 1000 AS STRING), 3, '0') AS mid,
    lpad(CAST((c.c_custkey * 7919) % 10000 AS STRING), 4, '0') AS last4,
    lpad(CAST((c.c_custkey * 7919 + 1) % 10000 AS STRING), 4, '0') AS last4b,
    lpad(CAST((c.c_custkey * 6007 + 1234) % 10000 AS STRING), 4, '0') AS last4c
  FROM customer c LEFT JOIN lo ON lo.k = c.c_custkey"""

_ORG = """
SELECT k AS id, c_name AS name, c_mktsegment AS category,
  CASE k % 4 WHEN 0 THEN 'CHURCH' WHEN 1 THEN 'ACADEMY' WHEN 2 THEN 'PUBLIC' ELSE 'SCHOOL' END AS type,
  CASE k % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN '033-333-3333'
    WHEN 4 THEN '+82-' || substr(ac, 2) || '-' || mid || '-' || last4 WHEN 5 THEN ac || mid || last4
    WHEN 6 THEN ac || '.' || mid || '.' || last4 WHEN 7 THEN '(' || ac || ') ' || mid || '-' || last4
    WHEN 8 THEN '080-1234-5678' WHEN 9 THEN '12345' ELSE ac || '-' || mid || '-' || last4 END AS phone,
  CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ac || '-' || mid || '-' || last4 WHEN 3 THEN ac || '-' || mid || '-' || last4b
    WHEN 4 THEN '070-1' || mid || '-' || last4 WHEN 5 THEN '02-' || mid || '-' || last4c ELSE ac || '-' || mid || '-' || last4c END AS fax,
  CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'u' || CAST(k AS STRING) || '@naver.com' WHEN 3 THEN 'u' || CAST(k AS STRING) || '@city.go.kr'
    WHEN 4 THEN 'u' || CAST(k AS STRING) || '@Univ.ac.kr' WHEN 5 THEN 'u' || CAST(k AS STRING) || '@corp.co.kr'
    WHEN 6 THEN 'u' || CAST(k AS STRING) || '@gracechurch.org' ELSE 'no-at-sign.example' END AS email,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'www.org' || CAST(k AS STRING) || '.or.kr' WHEN 3 THEN 'https://blog.naver.com/o' || CAST(k AS STRING)
    ELSE 'https://org' || CAST(k AS STRING) || '.or.kr' END AS homepage,
  CASE WHEN k % 9 = 0 THEN NULL WHEN k % 11 = 0 THEN '제주 중구 중앙로 ' || CAST(k AS STRING) ELSE region || ' 중구 중앙로 ' || CAST(k AS STRING) END AS address,
  CASE k % 7 WHEN 0 THEN 'NEW' WHEN 1 THEN 'CONTACTED' WHEN 2 THEN 'INTERESTED' WHEN 3 THEN 'NEGOTIATING' WHEN 4 THEN 'CLOSED_WON' WHEN 5 THEN 'CLOSED_LOST' ELSE 'FOLLOW_UP' END AS contact_status,
  CASE k % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE NULL END AS priority,
  'user' || CAST(k % 5 AS STRING) AS assigned_to,
  k % 3 = 0 AS ai_crawled,
  CASE WHEN k % 3 = 0 THEN last_o ELSE NULL END AS last_crawled_at,
  CASE WHEN k % 3 = 0 THEN '{"data_quality_grade":"' || substr('ABCDEF', CAST((k % 18) / 3 AS INT) + 1, 1) || '","validation_score":0.' || CAST(k % 10 AS STRING) || '}' ELSE NULL END AS crawling_data,
  coalesce(first_o, TIMESTAMP '1995-01-01 00:00:00') AS created_at,
  coalesce(last_o, TIMESTAMP '1995-01-01 00:00:00') AS updated_at,
  k % 13 <> 0 AS is_active
FROM b"""

_USERS = """
SELECT s_suppkey AS id, s_name AS username, s_name AS full_name,
  CASE s_suppkey % 10 WHEN 0 THEN '개발자' WHEN 1 THEN '대표' WHEN 2 THEN '팀장' WHEN 3 THEN '팀장' ELSE '일반사원' END AS role,
  'team' || CAST(s_nationkey % 3 AS STRING) AS team, s_suppkey % 7 <> 0 AS is_active, s_acctbal AS rank_value FROM supplier"""

_ACTIVITIES = """
SELECT o_orderkey AS id, o_custkey AS organization_id,
  CASE o_orderstatus WHEN 'F' THEN 'CALL' WHEN 'O' THEN 'EMAIL' ELSE 'NOTE' END AS activity_type,
  o_orderpriority AS subject, o_orderdate AS created_at, o_orderstatus = 'F' AS is_completed FROM orders"""

_METRICS = """
SELECT event_id, event_type AS agent_name, 'task' || CAST(user_id % 4 AS STRING) AS task_type, ts AS start_time,
  value / 10.0E0 AS duration, event_type <> 'error' AS success,
  CASE WHEN event_id % 5 = 0 THEN 0.0E0 ELSE (event_id % 100) / 100.0E0 END AS confidence_score FROM events"""

_HEALTH = """
SELECT event_id, ts, CAST(event_id % 101 AS DOUBLE) AS cpu_usage, CAST((event_id * 7) % 101 AS DOUBLE) AS memory_usage,
  CAST((event_id * 3) % 90 AS DOUBLE) AS disk_usage, CAST(event_id % 14 AS INT) AS error_count, value / 30.0E0 AS response_time,
  CAST(user_id % 6 AS INT) AS active_agents FROM events"""

_RESULTS = """
SELECT event_id, user_id AS organization_id, ts, 'job' || CAST(event_id % 7 AS STRING) AS job_id,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE '02-' || lpad(CAST(event_id % 1000 AS STRING), 3, '0') || '-' || lpad(CAST((event_id * 13) % 10000 AS STRING), 4, '0') END AS phone,
  value AS processing_time FROM events"""

# newest completed crawl result per organization, with values to write back: blanks,
# NULLs, well-formed and broken ones
_FOUND = """
SELECT id, event_id, found_at, name, phone, fax, email, homepage, processing_time FROM (
  SELECT user_id AS id, event_id, ts AS found_at, 'Customer#' || lpad(CAST(user_id * 11 AS STRING), 9, '0') AS name,
    CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'call us' ELSE '02-' || lpad(CAST(event_id % 1000 AS STRING), 3, '0') || '-' || lpad(CAST((event_id * 13) % 10000 AS STRING), 4, '0') END AS phone,
    CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE '031-' || lpad(CAST((event_id * 7) % 1000 AS STRING), 3, '0') || '-' || lpad(CAST((event_id * 17) % 10000 AS STRING), 4, '0') END AS fax,
    CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'broken@' ELSE 'mail' || CAST(event_id AS STRING) || '@found.co.kr' END AS email,
    CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'found' || CAST(event_id AS STRING) || '.kr' ELSE 'https://found' || CAST(event_id AS STRING) || '.kr' END AS homepage,
    value AS processing_time,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type <> 'error' AND event_type <> 'view') x
WHERE rn = 1"""

VIEWS = {"found": _FOUND, "users": _USERS, "activities": _ACTIVITIES, "metrics": _METRICS, "health": _HEALTH, "results": _RESULTS}

# texts: the documents plus one contact card per organization
_TEXTS = """
SELECT doc_id AS id, text FROM documents
UNION ALL SELECT 1000000000 + id, name || chr(10) || '주소: ' || coalesce(address, '') || chr(10) || '전화: ' || coalesce(phone, '') || ' / 팩스: ' || coalesce(fax, '')
  || chr(10) || '이메일: ' || coalesce(email, '') || chr(10) || '홈페이지: ' || coalesce(homepage, '') || chr(10) || '담당자 ' || coalesce(phone, '')
  || ' 우편번호 ' || lpad(CAST((id * 7919) % 100000 AS STRING), 5, '0') || chr(10) || 'Tel ' || coalesce(phone, '') || ' fax ' || coalesce(fax, '') FROM org"""

# HTML: the pages plus one page per organization with meta tags, a footer, links and JSON-LD
_HTMLS = """
SELECT page_id AS id, url, html FROM pages
UNION ALL SELECT 1000000000 + id, 'https://org' || CAST(id AS STRING) || '.or.kr/main/index.html?x=1',
  '<html><head><title> ' || name || ' &amp; more </title><meta name="description" content="About ' || name || '"><meta content="k' || CAST(id AS STRING) || ',org" name="keywords">'
  || '<meta property="og:title" content="' || name || '"><script type="application/ld+json">{"@type": "' || CASE WHEN type = 'CHURCH' THEN 'Organization' WHEN type = 'SCHOOL' THEN 'Thing' ELSE 'LocalBusiness' END
  || '", "telephone": "' || coalesce(phone, '') || '", "faxNumber": "' || coalesce(fax, '') || '", "url": "' || coalesce(homepage, '') || '"}</script><style>p {margin: 0}</style></head><body><nav><a href="/contact">연락처</a>'
  || '<a class="n" href="about.html">About</a><a href="https://map.example.org/' || CAST(id AS STRING) || '">오시는길 <b>지도</b></a></nav><main><p>' || name || ' welcomes you. ' || repeat('Open all week. ', CAST(id % 20 AS INT))
  || '</p></main><div class="contact-info">전화 ' || coalesce(phone, '') || ' 팩스: ' || coalesce(fax, '') || '</div><footer class="bottom">' || coalesce(address, '') || '</footer></body></html>' FROM org"""

# free-text replies: conversation turns plus replies that hold a block or key lines
_REPLIES = """
SELECT conv_id * 1000 + turn AS id, text FROM conversations
UNION ALL SELECT 1000000000 + id, CASE WHEN type = 'CHURCH' THEN 'Result:' || chr(10) || '```json' || chr(10) || '{"summary": "About ' || name || '", "category": "' || category || '", "main_services": ["a", "b", "c", "d"]}' || chr(10) || '```' || chr(10) || 'done'
  WHEN type = 'ACADEMY' THEN 'Here {"summary": "About ' || name || '", "category": "' || category || '"} end'
  WHEN type = 'PUBLIC' THEN 'SUMMARY: About ' || name || chr(10) || 'CATEGORY: ' || category || chr(10) || 'SERVICES: [x, y]' ELSE 'Nothing known about ' || name END FROM org"""

OVER_ORG = {"texts": _TEXTS, "htmls": _HTMLS, "replies": _REPLIES}

# as_of moments for time-relative queries (the data has no "now")
AS_OF_ORG = "2001-08-02 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"


def cte(*names: str) -> str:
    """The WITH clause that defines the named views for an oracle."""
    parts = []
    for name in names:
        if name == "org":
            parts += [f"lo AS ({_LO})", f"b AS ({_B})", f"org AS ({_ORG})"]
        else:
            parts.append(f"{name} AS ({VIEWS.get(name) or OVER_ORG[name]})")
    return "WITH " + ",\n".join(parts)


def _for_spark(sql: str, path: str) -> str:
    """Point table names at parquet files and keep timestamps zone-free."""
    sql = re.sub(r"\bFROM (\w+)", lambda m: f"FROM parquet.`{path}/{m[1]}.parquet`" if m[1] in GIVEN else m[0], sql)
    return sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


def _dealt(sql: str, tasks: int) -> str:
    """Deal the customers over ``tasks`` tasks: their rows fill few file splits, but each becomes a text or page that costs a thousand times its reading."""
    return re.sub(r"FROM (parquet\.`[^`]*/customer\.parquet`) c\b", rf"FROM (SELECT /*+ REPARTITION({tasks}) */ * FROM \1) c", sql)


def given(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def view(spark: SparkSession, path: str, name: str) -> DataFrame:
    if name in OVER_ORG:
        return spark.sql(_dealt(_for_spark(f"WITH lo AS ({_LO}), b AS ({_B}), org AS ({_ORG}) {OVER_ORG[name]}", path), wide(spark)))
    return spark.sql(_for_spark(VIEWS[name], path))


def organizations(spark: SparkSession, path: str) -> DataFrame:
    """The organization table; Catalyst drops the order-date join where no date is used."""
    return spark.sql(_for_spark(f"WITH lo AS ({_LO}), b AS ({_B}) {_ORG}", path))


def active_organizations(spark: SparkSession, path: str) -> DataFrame:
    return organizations(spark, path).filter("is_active")

