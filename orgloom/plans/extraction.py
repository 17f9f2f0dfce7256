"""Contacts, meta data and links out of texts and HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from orgloom.functions import extract as X
from orgloom.functions import fixed_values as V
from orgloom.functions import web as W
from orgloom.operators import extraction as E
from orgloom.sources import tables as T

from . import sqlparts as q
from .registry import query

TEXTS = ("org", "texts")
HTMLS = ("org", "htmls")


def joined(df, key: str = "id"):
    """Arrays as '|' lists, other columns as they are."""
    cols = [F.array_join(f.name, "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    return df.select(*cols)


def _group(p: str) -> int:
    return 1 if "(" in p.replace("(?:", "").replace(r"\(", "") else 0


def found(text: str, patterns, flags: str = "(?i)", group: int | None = None) -> str:
    parts = [f"regexp_extract_all({text}, {q.lit(flags + p)}, {_group(p) if group is None else group})" for p in patterns]
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def od(col: str) -> str:
    """Distinct, first occurrence first."""
    return f"list_filter({col}, lambda x, i: list_position({col}, x) = i)"


def no_null(expr: str) -> str:
    return f"list_filter({expr}, lambda x: x IS NOT NULL)"


def mapped(col: str, expr: str) -> str:
    return no_null(f"list_transform({col}, lambda y: {expr})")


def text_list(col: str) -> str:
    return f"array_to_string({col}, '|')"


_FMT = q.format_digits("regexp_replace(y, '[^0-9]', '', 'g')")
_ADDR1 = r"trim(regexp_replace(y, '\s+', ' ', 'g'))"
_ADDR = rf"CASE WHEN length({_ADDR1}) >= 10 THEN regexp_replace({_ADDR1}, '[^0-9A-Za-z_가-힣ㄱ-ㅎㅏ-ㅣÀ-ÖØ-öø-ÿ\s\-.,()]', '', 'g') END"
_SITE1 = ("CASE WHEN NOT starts_with(trim(y), 'http://') AND NOT starts_with(trim(y), 'https://') AND (starts_with(trim(y), 'www.') OR contains(trim(y), '.')) "
          "THEN 'http://' || trim(y) ELSE trim(y) END")
_SITE = f"CASE WHEN regexp_matches({_SITE1}, '^https?://[^\\s]+\\.[^\\s]+') THEN {_SITE1} END"


def contacts_sql(source: str, text: str = "text") -> str:
    return f"""m AS (SELECT *, {mapped(found(text, V.PHONE_PATTERNS, '(?im)'), _FMT)} AS p0, {mapped(found(text, V.FAX_PATTERNS, '(?im)'), _FMT)} AS f0,
  {found(text, V.EMAIL_PATTERNS)} AS e0, {mapped(found(text, V.ADDRESS_PATTERNS, '(?im)'), _ADDR)} AS a0, {mapped(found(text, V.WEBSITE_PATTERNS), _SITE)} AS w0 FROM {source}),
contact AS (SELECT *, {text_list(od('p0'))} AS phones, {text_list(od('f0'))} AS faxes, {text_list(od('e0'))} AS emails, {text_list(od('a0'))} AS addresses, {text_list(od('w0'))} AS websites FROM m)"""


@query("extract_contacts", f"WITH {contacts_sql('texts')} SELECT id, phones, faxes, emails, addresses, websites FROM contact", uses=TEXTS)
def extract_contacts(spark, d):
    return joined(E.extract_contacts(T.view(spark, d, "texts")))


_AGENT = r"^0[2-9]{1,2}-[0-9]{3,4}-[0-9]{4}$|^01[0-9]-[0-9]{3,4}-[0-9]{4}$|^070-[0-9]{3,4}-[0-9]{4}$"


def _agent_numbers(patterns) -> str:
    return (f"list_sort(list_transform(list_filter(list_distinct({found('text', patterns)}), lambda y: regexp_matches(regexp_replace(y, '[.\\s]', '-', 'g'), '{_AGENT}')), "
            "lambda y: regexp_replace(y, '[.\\s]', '-', 'g')))")


@query("extract_contacts_agent", f"""
WITH a AS (SELECT id, {_agent_numbers(V.AGENT_PHONE_PATTERNS)} AS phone, {_agent_numbers(V.AGENT_FAX_PATTERNS)} AS fax,
  list_sort(list_filter(list_distinct({found('text', V.AGENT_EMAIL_PATTERNS)}), lambda y: regexp_matches(y, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$'))) AS email,
  list_sort(list_transform(list_distinct({found('text', V.AGENT_WEBSITE_PATTERNS)}), lambda y: CASE WHEN starts_with(y, 'http://') OR starts_with(y, 'https://') THEN y ELSE 'http://' || y END)) AS website FROM texts)
SELECT id, {', '.join(f"{text_list(k)} AS {k}, CAST(len({k}) AS INTEGER) AS total_{k}" for k in ('phone', 'fax', 'email', 'website'))} FROM a""", uses=TEXTS)
def extract_contacts_agent(spark, d):
    return joined(E.extract_contacts_agent(T.view(spark, d, "texts")))


_HELP = q.normalize_helper("y")
_WORDS = " + ".join(f"CAST(contains(y, '{w}') AS INTEGER)" for w in V.ADDRESS_WORDS)


@query("extract_contacts_helper", f"""
WITH h AS (SELECT id, {mapped("list_concat(" + found('text', V.HELPER_PHONE_PATTERNS[:-1], group=0) + r", regexp_extract_all(text, '(?i)\+82-(\d{1,2}-\d{3,4}-\d{4})', 1))", _HELP)} AS p0,
  {mapped(found('text', V.HELPER_FAX_PATTERNS), _HELP)} AS f0, list_sort(list_distinct(list_transform({found('text', [V.HELPER_EMAIL_PATTERN], group=0)}, lambda y: lower(y)))) AS emails,
  list_filter(list_transform(string_split(text, chr(10)), lambda y: trim(y)), lambda y: y <> '' AND ({_WORDS}) >= 2) AS addresses FROM texts)
SELECT id, {text_list(od('p0'))} AS phone_numbers, {text_list('emails')} AS email_addresses, {text_list(od('f0'))} AS fax_numbers, {text_list('addresses')} AS addresses FROM h""", uses=TEXTS)
def extract_contacts_helper(spark, d):
    return joined(E.extract_contacts_helper(T.view(spark, d, "texts")).drop("urls"))


_URL_RE2 = r"(?i)https?://[-\p{L}\p{M}\p{N}\p{Pc}.]+(?:[:\d]+)?(?:/[\p{L}\p{M}\p{N}\p{Pc}/.]*(?:\?[\p{L}\p{M}\p{N}\p{Pc}&=%.]*)?(?:#[\p{L}\p{M}\p{N}\p{Pc}.]*)?)?"


@query("extract_urls_helper", f"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_URL_RE2}'))), '|') AS urls FROM texts", uses=TEXTS)
def extract_urls_helper(spark, d):
    return joined(E.extract_contacts_helper(T.view(spark, d, "texts")).select("id", "urls"))


_ENH = "list_filter(list_transform({m}, lambda y: replace(y, '.', '-')), lambda y: length(replace(y, '-', '')) >= 9)"


@query("extract_contacts_enhanced", f"""
WITH h AS (SELECT id, {_ENH.format(m=found('text', V.ENHANCED_PHONE_PATTERNS))} AS p0, {_ENH.format(m=found('text', V.ENHANCED_FAX_PATTERNS))} AS f0,
  {found('text', [V.HELPER_EMAIL_PATTERN], group=0)} AS e0 FROM texts)
SELECT id, {text_list(od('p0'))} AS phones, {text_list(od('f0'))} AS faxes, {text_list(od('e0'))} AS emails FROM h""", uses=TEXTS)
def extract_contacts_enhanced(spark, d):
    return joined(E.extract_contacts_enhanced(T.view(spark, d, "texts")))


_SP = V.SEARCH_PHONE_PATTERNS
_YD = "regexp_replace(y, '[^0-9]', '', 'g')"
_SEARCHED = f"CASE WHEN length({_YD}) BETWEEN 9 AND 11 AND len(list_distinct(string_split({_YD}, ''))) > 2 THEN {q.dash_any(_YD)} END"


@query("extract_phones_search", f"""
WITH h AS (SELECT id, {mapped('list_concat(' + found('text', _SP[:-2], group=0) + ', ' + found('text', _SP[-2:], group=1) + ')', _SEARCHED)} AS p0 FROM texts)
SELECT id, {text_list(od('p0'))} AS phones FROM h""", uses=TEXTS)
def extract_phones_search(spark, d):
    return joined(T.view(spark, d, "texts").select("id", X.search_phones("text").alias("phones")))


_MAPOK = r"^0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}$|^01[0-9]-[0-9]{3,4}-[0-9]{4}$"


def _first_number(patterns: list[str]) -> str:
    cleaned = f"list_transform({found('text', patterns, '')}, lambda y: regexp_replace(y, '[^0-9-]', '', 'g'))"
    return f"coalesce(list_filter({cleaned}, lambda y: regexp_matches(y, '{_MAPOK}'))[1], '')"


_FIRST_ADDR = f"""coalesce(list_filter(list_transform({found('text', [r'[가-힣]+[시도]\s[가-힣]+[시군구]\s[가-힣0-9\s\-]+', r'\d{5}\s*[가-힣]+[시도]\s[가-힣]+[시군구][가-힣0-9\s\-]+',
    r'(?:주소|위치|소재지)[:\s]*([가-힣0-9\s\-,]+[시도구군][가-힣0-9\s\-,]*)'], '')}, lambda y: trim(y)), lambda y: length(y) > 10 AND (contains(y, '시') OR contains(y, '구') OR contains(y, '군')))[1], '')"""


@query("extract_first_contact", f"""
WITH h AS (SELECT id, {_first_number([r'\d{2,3}-\d{3,4}-\d{4}', r'(?:전화|TEL|Tel|tel)[:\s]*(\d{2,3}[-\s]\d{3,4}[-\s]\d{4})'])} AS phone,
  {_first_number([r'(?:팩스|FAX|Fax|fax)[:\s]*(\d{2,3}[-\s]\d{3,4}[-\s]\d{4})', r'(?:F|f)[:\s]*(\d{2,3}[-\s]\d{3,4}[-\s]\d{4})'])} AS fax, {_FIRST_ADDR} AS address,
  coalesce(list_filter(regexp_extract_all(text, '\\b\\d{{5}}\\b'), lambda y: regexp_matches(y, '^[0-6]'))[1], '') AS postal_code FROM texts)
SELECT *, phone <> '' OR fax <> '' OR address <> '' OR postal_code <> '' AS found FROM h""", uses=TEXTS)
def extract_first_contact(spark, d):
    return E.extract_first_contact(T.view(spark, d, "texts"))


@query("extract_fax_patterns", f"""
WITH h AS (SELECT id, list_transform({found('html', V.CRAWL_FAX_PATTERNS)}, lambda y: {q.normalize_groups('y')}) AS f0 FROM htmls)
SELECT id, {text_list(od('f0'))} AS faxes, list_filter(f0, lambda y: {q.valid_prefix('y')})[1] AS first_valid FROM h""", uses=HTMLS)
def extract_fax_patterns(spark, d):
    from orgloom.functions import phone as P

    faxes = T.view(spark, d, "htmls").select("id", X.crawl_faxes("html").alias("faxes"))
    return joined(faxes.withColumn("first_valid", X.first_valid(F.col("faxes"), P.valid_prefix)))


@query("extract_additional_phones", f"""
WITH h AS (SELECT id, {found('text', V.ADDITIONAL_PHONE_PATTERNS, '')} AS p0 FROM texts) SELECT id, {text_list(od('p0'))} AS phones FROM h""", uses=TEXTS)
def extract_additional_phones(spark, d):
    return joined(T.view(spark, d, "texts").select("id", X.additional_phones("text").alias("phones")))


_POSTAL = r"list_sort(list_distinct(regexp_extract_all(text, '\b\d{5}\b')))"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STRIPPED = "list_transform({m}, lambda z: trim(z, " + _WS + "))"


def listed(m: str) -> str:
    return _STRIPPED.format(m=f"list_filter({m}, lambda x, i: NOT list_contains({_STRIPPED.format(m=f'{m}[1:i - 1]')}, x))")


_DUMMY = "^(033-333-3333|02-222-2222|031-111-1111|" + "|".join(f"{n * 3}-{n * 3}-{n * 4}" for n in "0123456789") + r"|0\d{1,2}-000-0000|0\d{1,2}-123-4567|0\d{1,2}-1234-5678|000-000-0000|999-999-9999)"
_GOOD = f"length({_YD}) BETWEEN 9 AND 11 AND ({q.area(_YD)}) IS NOT NULL AND NOT regexp_matches(y, '{_DUMMY}')"


@query("extract_postal_codes", f"""
WITH m AS (SELECT id, {_POSTAL} AS pc, list_filter(list_sort(list_distinct(regexp_extract_all(text, '{V.SHORT_ADDRESS_PATTERN}'))), lambda y: length(y) > 10) AS ad,
  {found('text', V.PHONE_PATTERNS, '')} AS p, {found('text', V.FAX_PATTERNS, '')} AS f, {found('text', V.EMAIL_PATTERNS, '')} AS e FROM texts)
SELECT id, {text_list('pc')} AS postal_codes, {text_list('ad')} AS addresses, CAST(len(list_filter({listed('p')}, lambda y: {_GOOD})) AS INTEGER) AS phones_validated,
  CAST(len(list_filter({listed('f')}, lambda y: {_GOOD})) AS INTEGER) AS faxes_validated, CAST(len({listed('e')}) AS INTEGER) AS emails_validated,
  CAST(len(ad) AS INTEGER) AS addresses_found, CAST(len(pc) AS INTEGER) AS postal_codes_found FROM m""", uses=TEXTS)
def extract_postal_codes(spark, d):
    return joined(E.extract_postal_codes(T.view(spark, d, "texts")))


PAGE_DASH = """CASE WHEN length({d}) BETWEEN 9 AND 11 THEN CASE WHEN starts_with({d}, '02') AND length({d}) = 9 THEN substr({d},1,2) || '-' || substr({d},3,3) || '-' || substr({d},6)
  WHEN starts_with({d}, '02') THEN substr({d},1,2) || '-' || substr({d},3,4) || '-' || substr({d},7)
  WHEN substr({d},1,3) NOT IN ('010','011','016','017','018','019','070') AND length({d}) = 10 THEN substr({d},1,3) || '-' || substr({d},4,3) || '-' || substr({d},7)
  ELSE substr({d},1,3) || '-' || substr({d},4,4) || '-' || substr({d},8) END END"""


@query("extract_contacts_page", f"""
WITH m AS (SELECT id, {mapped(found('text', V.PHONE_PATTERNS), PAGE_DASH.format(d=_YD))} AS p0, {mapped(found('text', V.FAX_PATTERNS), PAGE_DASH.format(d=_YD))} AS f0,
  list_filter({found('text', V.EMAIL_PATTERNS)}, lambda y: regexp_matches(y, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$')) AS e0,
  {mapped(found('text', V.ADDRESS_PATTERNS), f"CASE WHEN length({_ADDR1}) >= 10 THEN {_ADDR1} END")} AS a0 FROM texts)
SELECT id, {text_list(od('p0'))} AS phones, {text_list(od('f0'))} AS faxes, {text_list(od('e0'))} AS emails, {text_list(od('a0'))} AS addresses FROM m""", uses=TEXTS)
def extract_contacts_page(spark, d):
    return joined(E.extract_contacts_page(T.view(spark, d, "texts")))


_BLOCK = r"coalesce(nullif(trim(regexp_extract(text, '(?s)```json\s*(.*?)```', 1)), ''), nullif(regexp_extract(text, '(?s)(\{.*\})', 1), ''))"


def _line(key: str) -> str:
    return rf"nullif(trim(regexp_extract(text, '(?m)^\s*{key}:(.*)$', 1)), '')"


@query("extract_json_block", f"""
WITH r AS (SELECT id, text, {_BLOCK} AS block FROM replies), j AS (SELECT *, CASE WHEN json_valid(block) THEN block END AS js FROM r)
SELECT id, coalesce(json_extract_string(js, '$.summary'), {_line('SUMMARY')}, '') AS summary, coalesce(json_extract_string(js, '$.category'), {_line('CATEGORY')}, '{V.OTHER}') AS category,
  coalesce(json_extract_string(js, '$.summary'), json_extract_string(js, '$.category'), {_line('SUMMARY')}, {_line('CATEGORY')}) IS NOT NULL AS found FROM j""", uses=("org", "replies"))
def extract_json_block(spark, d):
    return T.view(spark, d, "replies").select("id", X.response_fields("text").alias("r")).select("id", "r.summary", "r.category", "r.found")


_DROPPED = "html"
for _tag in ("script", "style", "noscript"):
    _DROPPED = f"regexp_replace({_DROPPED}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', '', 'g')"
_DROPPED = f"regexp_replace(regexp_replace({_DROPPED}, '(?s)<!--.*?-->', '', 'g'), '(?i)<(meta|link)\\b[^>]*>', '', 'g')"
_BARE = f"regexp_replace({_DROPPED}, '(?s)<[^>]*>', '', 'g')"


def decoded(e: str) -> str:
    for name, char in X._ENTITIES:
        e = f"replace({e}, {q.lit(name)}, {q.lit(char)})"
    return e


HTML_TEXT = f"trim(regexp_replace({decoded(_BARE)}, '[\\s\\x{{A0}}]+', ' ', 'g'))"


HTML_PLAIN = decoded(_BARE)
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def text_of(block: str) -> str:
    return HTML_TEXT.replace("(html,", f"({block},")


def plain_of(block: str) -> str:
    return f"trim({HTML_PLAIN.replace('(html,', f'({block},')}, {_WHITE})"


@query("html_text", f"SELECT id, {HTML_TEXT} AS text FROM htmls", uses=HTMLS)
def html_text(spark, d):
    return T.view(spark, d, "htmls").select("id", X.html_text("html").alias("text"))


_TITLE = decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_DESC = "regexp_extract(html, '(?is)<meta\\b[^>]*name\\s*=\\s*\"description\"[^>]*content\\s*=\\s*\"([^\"]*)\"', 1)"
_KEYS = "regexp_extract(html, '(?is)<meta\\b[^>]*content\\s*=\\s*\"([^\"]*)\"[^>]*name\\s*=\\s*\"keywords\"', 1)"
_OG = "regexp_extract(html, '(?is)<meta\\b[^>]*property\\s*=\\s*\"og:title\"[^>]*content\\s*=\\s*\"([^\"]*)\"', 1)"


@query("html_meta", f"SELECT id, trim({_TITLE}) AS title, {_DESC} AS description, {_KEYS} AS keywords, '' AS author, {_OG} AS og_title, '' AS og_description FROM htmls", uses=HTMLS)
def html_meta(spark, d):
    return T.view(spark, d, "htmls").select(
        "id", X.html_title("html").alias("title"), *[X.html_meta("html", "name", k).alias(k) for k in ("description", "keywords", "author")],
        X.html_meta("html", "property", "og:title").alias("og_title"), X.html_meta("html", "property", "og:description").alias("og_description"))


def _marked(tag: str, words: str, attributes: str) -> str:
    return f"regexp_extract_all(html, '(?is)<{tag}\\b[^>]*\\b(?:{attributes})\\s*=\\s*\"[^\"]*(?:{words})[^\"]*\"[^>]*>(.*?)</{tag}\\s*>', 1)"


_FOOT = f"list_concat({_marked('div', 'footer|bottom|contact|info', 'class')}, {_marked('footer', 'footer|bottom|contact|info', 'class')})"


@query("html_footer", f"""
WITH h AS (SELECT id, list_filter(list_transform({_FOOT}, lambda y: {plain_of('y')}), lambda y: length(y) > 10) AS fs, {HTML_PLAIN} AS w FROM htmls)
SELECT id, CASE WHEN len(fs) > 0 THEN array_to_string(fs, chr(10)) ELSE w END AS footer FROM h""", uses=HTMLS)
def html_footer(spark, d):
    return T.view(spark, d, "htmls").select("id", X.html_footer("html").alias("footer"))


_LD = "regexp_extract(html, '(?is)<script\\b[^>]*type\\s*=\\s*\"application/ld\\+json\"[^>]*>(.*?)</script\\s*>', 1)"


@query("html_jsonld", f"""
WITH h AS (SELECT id, {_LD} AS b FROM htmls), j AS (SELECT id, CASE WHEN b <> '' AND json_valid(b) THEN b END AS b FROM h),
k AS (SELECT id, CASE WHEN json_extract_string(b, '$."@type"') IN ('Organization', 'LocalBusiness') THEN b END AS b FROM j)
SELECT id, json_extract_string(b, '$.telephone') AS phone, json_extract_string(b, '$.faxNumber') AS fax, json_extract_string(b, '$.address') AS address, json_extract_string(b, '$.url') AS website FROM k""", uses=HTMLS)
def html_jsonld(spark, d):
    return T.view(spark, d, "htmls").select("id", X.html_jsonld("html").alias("o")).select("id", "o.*")


_ANCHOR = "(?is)<a\\b[^>]*?href\\s*=\\s*\"([^\"]*)\"[^>]*>(.*?)</a\\s*>"
_KW = "CASE " + " ".join(f"WHEN contains(lower(text), {q.lit(w)}) THEN {q.lit(w)}" for w in V.CONTACT_LINK_WORDS) + " END"
_RESOLVED = """CASE WHEN starts_with(href, 'http://') OR starts_with(href, 'https://') THEN href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
  ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || href END"""
LINKS = f"""a AS (SELECT id, url, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS href, unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS raw,
  generate_subscripts(regexp_extract_all(html, '{_ANCHOR}', 1), 1) AS pos FROM htmls),
t AS (SELECT *, trim({decoded("regexp_replace(raw, '(?s)\\s*<[^>]*>\\s*', '', 'g')")}) AS text FROM a)"""


@query("html_contact_links", f"""
WITH {LINKS}, k AS (SELECT *, {_KW} AS keyword FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank FROM k WHERE keyword IS NOT NULL)
SELECT id, CAST(rank AS INTEGER) AS rank, {_RESOLVED} AS url, text, keyword FROM r""", uses=HTMLS)
def html_contact_links(spark, d):
    return E.contact_links(T.view(spark, d, "htmls"))


@query("url_resolve", f"""
WITH {LINKS} SELECT id, CAST(pos AS INTEGER) AS pos, {_RESOLVED} AS resolved FROM t""", uses=HTMLS)
def url_resolve(spark, d):
    links = T.view(spark, d, "htmls").select("id", "url", F.posexplode(X.html_anchors("html")).alias("pos", "a"))
    return links.select("id", (F.col("pos") + 1).alias("pos"), W.resolve_url(F.col("a.href"), F.col("url")).alias("resolved"))


def _area_sql(tags: list[str], marks: str, least: int) -> str:
    blocks = "list_concat(" + ", ".join(f"regexp_extract_all(html, '(?is)<{t}\\b[^>]*>(.*?)</{t}\\s*>', 1)" for t in tags) + f", {_marked('div', marks, 'class|id')})"
    return f"array_to_string(list_filter(list_transform({blocks}, lambda y: {text_of('y')}), lambda y: length(y) > {least}), ' ')"


@query("html_best_text", f"""
WITH h AS (SELECT id, {HTML_TEXT} AS f, {_area_sql(X.MAIN_TAGS, X.MAIN_MARKS, 100)} AS m, {_area_sql(X.CONTACT_TAGS, X.CONTACT_MARKS, 20)} AS c FROM htmls)
SELECT id, CASE WHEN length(f) >= length(m) AND length(f) >= length(c) THEN 'full' WHEN length(m) >= length(c) THEN 'main' ELSE 'contact' END AS method,
  CASE WHEN length(f) >= length(m) AND length(f) >= length(c) THEN f WHEN length(m) >= length(c) THEN m ELSE c END AS text FROM h""", uses=HTMLS)
def html_best_text(spark, d):
    return E.best_text(T.view(spark, d, "htmls"))


def _selected(css: str) -> str:
    """Texts of one simple selector on pages without nested elements of one name."""
    if css[0] in ".#":
        value = rf'"(?:[^"]* )?{css[1:]}(?: [^"]*)?"' if css[0] == "." else f'"{css[1:]}"'
        attribute = "class" if css[0] == "." else "id"
    elif css[0] == "[":
        attribute, sign, part = css[1:-1].partition("*=" if "*=" in css else "=")
        part = part.strip('"')
        value = f'"[^"]*{part}[^"]*"' if sign == "*=" else f'"{part}"'
    else:
        return f"regexp_extract_all(html, '(?is)<{css}\\b[^>]*>(.*?)</{css}\\s*>', 1)"
    blocks = [f"regexp_extract_all(html, '(?is)<{t}\\b[^>]*\\b{attribute}\\s*=\\s*{value}[^>]*>(.*?)</{t}\\s*>', 1)" for t in ("div", "footer", "main", "section", "article", "p", "address")]
    return "list_concat(" + ", ".join(blocks) + ")"


def _selected_sql(selectors: list[str], least: int) -> str:
    lists = ", ".join(f"list_sort(list_filter(list_transform({_selected(css)}, lambda y: {text_of('y')}), lambda y: length(y) > {least}))" for css in selectors)
    return f"array_to_string(list_concat({lists}), '|')"


@query("html_selected_areas", f"SELECT id, {_selected_sql(X.CONTENT_SELECTORS, 0)} AS content, {_selected_sql(X.CONTACT_SELECTORS, 0)} AS contact FROM htmls", uses=HTMLS)
def html_selected_areas(spark, d):
    """Texts by selector, in the order of the selectors; of one selector sorted, as the check SQL can't tell their order over tags."""
    n = len(X.CONTENT_SELECTORS)
    pages = T.view(spark, d, "htmls").select("id", X.html_select("html", [*X.CONTENT_SELECTORS, *X.CONTACT_SELECTORS]).alias("a"))
    tidy = lambda a: F.array_join(F.flatten(F.transform(a, lambda t: F.array_sort(F.filter(F.transform(t, X.one_line), lambda x: F.length(x) > 0)))), "|")
    return pages.select("id", tidy(F.slice("a", 1, n)).alias("content"), tidy(F.slice("a", n + 1, len(X.CONTACT_SELECTORS))).alias("contact"))


@query("page_record", f"""
WITH h AS (SELECT id, url, trim({_TITLE}) AS title, {_DESC} AS description, {HTML_TEXT} AS text FROM htmls), {contacts_sql('h')}
SELECT id, url, title, description, CAST(length(text) AS INTEGER) AS text_length, phones, faxes, emails, CASE WHEN length(text) < 100 THEN 'warning' ELSE 'success' END AS status FROM contact""", uses=HTMLS)
def page_record(spark, d):
    r = E.page_record(T.view(spark, d, "htmls"))
    return joined(r.select("id", "url", "title", "description", "text_length", "contacts.phones", "contacts.faxes", "contacts.emails", "status"))
