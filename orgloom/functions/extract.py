"""Contact extraction from text and HTML as array expressions.

Every pattern is one ``regexp_extract_all``. Texts without a run of digits (or
without '@') skip the patterns that could not match, so most rows cost one
cheap scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from .blank import _c, strip
from . import fixed_values as V
from . import phone as P
from . import address as A
from . import html_tree as H
from . import web as W

_NO_STRINGS = "array<string>"


# --- fixed values: white space beyond ASCII, which the patterns' \s is meant to take ---
_SPACES = "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


_ANY_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once however often it is used."""
    return F.transform(F.array(value), use).getItem(0)


def spaced(text: Column | str) -> Column:
    """Every kind of white space but line ends as a space; as long as before. Most texts have none and stay as they are."""
    text = _c(text)
    return F.when(text.rlike(_ANY_SPACE), F.translate(text, _SPACES, " " * len(_SPACES))).otherwise(text)


def all_matches(text: Column | str, patterns: list[str], flags: str = "(?i)", group: int | None = None) -> Column:
    """Matches of each pattern in a :func:`spaced` text, concatenated in pattern order."""
    text = _c(text)
    parts = []
    for p in patterns:
        g = group if group is not None else (1 if "(" in p.replace("(?:", "").replace(r"\(", "") else 0)
        parts.append(F.regexp_extract_all(text, F.lit(flags + p), F.lit(g)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _guard(text: Column, test: str, value: Column) -> Column:
    return F.when(text.rlike(test), value).otherwise(F.array().cast(_NO_STRINGS))


# nine digits with nothing but separators between them: shorter runs are never numbers
_LONG_RUN = r"[0-9](?:[-\.\(\)\s]*[0-9]){8}"


def _has_number(text: Column, value: Column) -> Column:
    return _guard(text, _LONG_RUN, value)


def keep(arr: Column, to: object) -> Column:
    """Map, drop NULLs, keep the first of equal values; equal matches are mapped once."""
    return F.array_distinct(F.array_compact(F.transform(F.array_distinct(arr), to)))


def _phones(text: Column, patterns: list[str] = V.PHONE_PATTERNS) -> Column:
    return keep(_has_number(text, all_matches(text, patterns, "(?im)")), lambda x: let(P.digits(x), P.format_digits))


def _emails(text: Column, patterns: list[str] = V.EMAIL_PATTERNS) -> Column:
    return F.array_distinct(_guard(text, "@", all_matches(text, patterns)))


def _addresses(text: Column) -> Column:
    return keep(_guard(text, "[시군구동로길]", all_matches(text, V.ADDRESS_PATTERNS, "(?im)")), _clean_address)


def _clean_address(x: Column) -> Column:
    return let(A.one_space(x), lambda a: A.clean_spaced(a))


def _websites(text: Column) -> Column:
    return keep(_guard(text, r"(?i)https?://|www\.|홈페이지|웹사이트|website|homepage",
                       all_matches(text, V.WEBSITE_PATTERNS)), lambda x: let(W.url_with_scheme(x), W.url_shaped))


def phones(text: Column | str, patterns: list[str] = V.PHONE_PATTERNS) -> Column:
    return let(spaced(text), lambda t: _phones(t, patterns))


def faxes(text: Column | str) -> Column:
    return phones(text, V.FAX_PATTERNS)


def emails(text: Column | str, patterns: list[str] = V.EMAIL_PATTERNS) -> Column:
    return let(spaced(text), lambda t: _emails(t, patterns))


def addresses(text: Column | str) -> Column:
    return let(spaced(text), _addresses)


def websites(text: Column | str) -> Column:
    return let(spaced(text), _websites)


def contacts(text: Column | str) -> Column:
    return let(spaced(text), lambda t: F.struct(
        _phones(t).alias("phones"), _phones(t, V.FAX_PATTERNS).alias("faxes"), _emails(t).alias("emails"),
        _addresses(t).alias("addresses"), _websites(t).alias("websites")))


def agent_items(text: Column | str, kind: str) -> Column:
    """Validated, sorted items of one kind (phone, fax, email, website)."""
    return let(spaced(text), lambda t: _agent_items(t, kind))


def _agent_items(text: Column, kind: str) -> Column:
    if kind in ("phone", "fax"):
        pats = V.AGENT_PHONE_PATTERNS if kind == "phone" else V.AGENT_FAX_PATTERNS
        raw = F.array_distinct(_has_number(text, all_matches(text, pats)))
        ok = F.filter(raw, lambda x: P.valid_loose(x, "agent"))
        return F.array_sort(F.transform(ok, lambda x: F.regexp_replace(x, r"[.\s]", "-")))
    if kind == "email":
        raw = _emails(text, V.AGENT_EMAIL_PATTERNS)
        return F.array_sort(F.filter(raw, lambda x: W.email_valid(x, "strict")))
    raw = F.array_distinct(_guard(text, r"(?i)https?://|www\.", all_matches(text, V.AGENT_WEBSITE_PATTERNS)))
    return F.array_sort(F.transform(raw, lambda x: F.when(
        x.startswith("http://") | x.startswith("https://"), x).otherwise(F.concat(F.lit("http://"), x))))


def helper_phones(text: Column | str) -> Column:
    return let(spaced(text), _helper_phones)


def _helper_phones(text: Column) -> Column:
    pats = V.HELPER_PHONE_PATTERNS[:-1]
    raw = F.concat(all_matches(text, pats, group=0),
                   F.regexp_extract_all(text, F.lit(r"\+82-(\d{1,2}-\d{3,4}-\d{4})"), F.lit(1)))
    return keep(_has_number(text, raw), _normalized)


def _normalized(x: Column) -> Column:
    return let(P.digits(x), lambda d: let(P.strip_country(d), P.dash_helper))


def helper_faxes(text: Column | str) -> Column:
    return let(spaced(text), _helper_faxes)


def _helper_faxes(text: Column) -> Column:
    return keep(_has_number(text, all_matches(text, V.HELPER_FAX_PATTERNS)), _normalized)


def helper_emails(text: Column | str) -> Column:
    return let(spaced(text), _helper_emails)


def _helper_emails(text: Column) -> Column:
    found = _guard(text, "@", all_matches(text, [V.HELPER_EMAIL_PATTERN], group=0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def helper_urls(text: Column | str) -> Column:
    return let(spaced(text), _helper_urls)


def _helper_urls(text: Column) -> Column:
    return F.array_sort(F.array_distinct(
        _guard(text, "(?i)https?://", all_matches(text, [V.HELPER_URL_PATTERN], "(?iU)", group=0))))


def helper_addresses(text: Column | str) -> Column:
    """Lines with two or more address words."""
    lines = F.transform(F.split(_c(text), "\n"), lambda x: strip(x))

    def enough(line: Column) -> Column:
        return sum((line.contains(w).cast("int") for w in V.ADDRESS_WORDS), F.lit(0)) >= 2

    return F.filter(lines, lambda x: (x != "") & enough(x))


def enhanced_numbers(text: Column | str, kind: str = "phone") -> Column:
    return let(spaced(text), lambda t: _enhanced_numbers(t, kind))


def _enhanced_numbers(text: Column, kind: str) -> Column:
    pats = V.ENHANCED_PHONE_PATTERNS if kind == "phone" else V.ENHANCED_FAX_PATTERNS
    dashed = F.transform(F.array_distinct(_has_number(text, all_matches(text, pats))), lambda x: F.regexp_replace(x, r"\.", "-"))
    return F.array_distinct(F.filter(dashed, lambda x: F.length(P.digits(x)) >= 9))


def search_phones(text: Column | str) -> Column:
    """Search-page patterns; 9-11 digits with more than two different ones."""
    return let(spaced(text), _search_phones)


def _search_phones(text: Column) -> Column:
    pats = V.SEARCH_PHONE_PATTERNS
    raw = F.concat(all_matches(text, pats[:-2], group=0), all_matches(text, pats[-2:], group=1))
    return keep(_has_number(text, raw), lambda x: let(P.digits(x), lambda d: F.when(
        F.length(d).between(9, 11) & ~P.few_digits(d), P.dash_any(d))))


def crawl_faxes(text: Column | str) -> Column:
    """Labelled fax numbers, digit groups joined by dashes."""
    return let(spaced(text), _crawl_faxes)


def _crawl_faxes(text: Column) -> Column:
    return F.array_distinct(F.transform(
        _has_number(text, all_matches(text, V.CRAWL_FAX_PATTERNS)), P.normalize_groups))


def additional_phones(text: Column | str) -> Column:
    return let(spaced(text), _additional_phones)


def _additional_phones(text: Column) -> Column:
    return F.array_distinct(_has_number(text, all_matches(text, V.ADDITIONAL_PHONE_PATTERNS, "")))


def postal_codes(text: Column | str) -> Column:
    """Distinct five-digit tokens, sorted."""
    return let(spaced(text), _postal_codes)


def _postal_codes(text: Column) -> Column:
    return F.array_sort(F.array_distinct(
        _guard(text, "[0-9]{5}", F.regexp_extract_all(text, F.lit(r"\b\d{5}\b"), F.lit(0)))))


def first_valid(arr: Column, ok: object) -> Column:
    return F.try_element_at(F.filter(arr, ok), F.lit(1))


# --- HTML -------------------------------------------------------------------
_DROP = r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<(meta|link)\b[^>]*>"
# --- fixed values: character references decoded by name, '&amp;' last -------
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
             ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&bull;", "•"), ("&hellip;", "…"),
             ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
             ("&laquo;", "«"), ("&raquo;", "»"), ("&times;", "×"), ("&commat;", "@"), ("&lpar;", "("), ("&rpar;", ")"),
             ("&hyphen;", "-"), ("&period;", "."), ("&colon;", ":"), ("&sol;", "/"), ("&amp;", "&")]
_NUMERIC = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _character(ref: Column) -> Column:
    """The character of a decimal or hexadecimal reference; U+FFFD for none."""
    body = F.regexp_replace(ref, "[&#;]", "")
    code = F.when(F.lower(body).startswith("x"), F.conv(F.substring(body, 2, 8), 16, 10)).otherwise(body).cast("int")
    high = F.expr("1 = 0") | ((code >= 0xD800) & (code <= 0xDFFF)) | (code > 0x10FFFF) | (code == 0)
    wide = F.lpad(F.hex(F.when(high, 0xFFFD).when(code == 160, 32).otherwise(code)), 8, "0")
    return F.decode(F.unhex(wide), "UTF-32")


def decode_entities(c: Column) -> Column:
    return let(c, _decode_entities)


def _decode_entities(c: Column) -> Column:
    # numeric references first; one that gives '&' must not start another reference, so named ones are decoded in the pieces between
    texts = F.transform(F.split(c, _NUMERIC, -1), _decode_named)
    refs = F.regexp_extract_all(c, F.lit(_NUMERIC), F.lit(0))
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(texts.alias("t"), refs.alias("r")), lambda z: F.array(z["t"], F.coalesce(_character(z["r"]), F.lit(""))))), "")
    return F.when(c.contains("&#"), joined).when(c.contains("&"), _decode_named(c)).otherwise(c)


def _decode_named(c: Column) -> Column:
    for name, char in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_plain(html: Column | str) -> Column:
    """Text nodes in order: script, style, comments and tags dropped, entities decoded."""
    return decode_entities(F.regexp_replace(F.regexp_replace(_c(html), _DROP, ""), r"(?s)<[^>]*>", ""))


def one_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def html_text(html: Column | str) -> Column:
    """The text nodes with single spaces."""
    return one_line(html_plain(html))


def html_title(html: Column | str) -> Column:
    return strip(decode_entities(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_meta(html: Column | str, attr: str, key: str) -> Column:
    """content of <meta attr="key">, in either attribute order, '' when absent."""
    html = _c(html)
    name = rf"""{attr}\s*=\s*["']{key}["']"""
    content = r"""content\s*=\s*["']([^"']*)["']"""
    return F.coalesce(
        F.nullif(F.regexp_extract(html, rf"(?is)<meta\b[^>]*{name}[^>]*{content}", 1), F.lit("")),
        F.regexp_extract(html, rf"(?is)<meta\b[^>]*{content}[^>]*{name}", 1),
    )


# --- fixed values: elements that hold the main text and the contact text ------
MAIN_TAGS = ["main", "article", "section"]
MAIN_MARKS = r"\b(?:content|main-content|container|wrapper|section|page-content|post-content|entry-content|main)\b"
CONTACT_TAGS = ["footer", "address"]
CONTACT_MARKS = r"contact|footer|\b(?:address|phone|tel|email)\b"
FOOTER_MARKS = "footer|bottom|contact|info"

# --- fixed values: where the main text and the contact text of a page are looked for, in this order ---
CONTENT_SELECTORS = ["main", "article", ".content", "#content", ".main-content", ".container", ".wrapper", "section", ".section", ".page-content", ".post-content",
                     ".entry-content", '[role="main"]', ".main"]
CONTACT_SELECTORS = [".contact", "#contact", ".contact-info", ".contact-us", ".footer", "#footer", ".footer-info", ".address", ".phone", ".tel", ".email",
                     '[class*="contact"]', '[id*="contact"]', '[class*="footer"]', '[id*="footer"]', "footer", "address"]


def opens(tags: str, words: str | None = None, attributes: str = "class|id|role") -> str:
    """Pattern of an opening tag, with an attribute (quoted or not) that holds one of ``words``."""
    if words is None:
        return rf"(?is)^<(?:{tags})(?=[\s/>])"
    value = "|".join((rf'"[^"]*(?:{words})[^"]*"', rf"'[^']*(?:{words})[^']*'", rf"""(?!["'])[^\s>]*(?:{words})"""))
    return rf"(?is)^<(?:{tags})(?=\s).*?\s(?:{attributes})\s*=\s*(?:{value})"


def _decoded(areas: Column) -> Column:
    return F.transform(areas, lambda texts: F.transform(texts, decode_entities))


def html_areas(html: Column | str, patterns: Sequence[str]) -> Column:
    """array<array<string>>: for each pattern of an opening tag the text of the elements it matches, in document order. The page is passed once."""
    return _decoded(H.area_texts(F.regexp_replace(_c(html), _DROP, ""), lambda: [H.tag_pattern(p) for p in patterns]))


def html_select(html: Column | str, selectors: Sequence[str]) -> Column:
    """As :func:`html_areas` for simple CSS selectors."""
    for css in selectors:
        H.selector(css)
    return _decoded(H.area_texts(F.regexp_replace(_c(html), _DROP, ""), lambda: [H.selector(css) for css in selectors]))


def html_footer(html: Column | str, last: int | None = None) -> Column:
    """Text of footer-like elements with more than 10 characters, else the whole page's (or its ``last`` characters)."""
    html = _c(html)
    return _footer(html, html_areas(html, [opens("footer|div", FOOTER_MARKS, "class")]).getItem(0), last)


def _footer(html: Column, areas: Column, last: int | None) -> Column:
    whole = html_plain(html)
    return let(F.filter(F.transform(areas, lambda x: strip(x)), lambda x: F.length(x) > 10), lambda texts: F.when(
        F.size(texts) > 0, F.array_join(texts, "\n")).otherwise(whole if last is None else F.right(whole, F.lit(last))))


def anchor_text(html: Column) -> Column:
    """Stripped text nodes joined without spaces between them."""
    bare = F.regexp_replace(F.regexp_replace(html, _DROP, ""), r"(?s)\s*<[^>]*>\s*", "")
    return strip(decode_entities(bare))


def html_anchors(html: Column | str) -> Column:
    """array<struct<href, text>> in document order."""
    html = _c(html)
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>.*?</a\s*>"), F.lit(0))
    href = r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    at = lambda a: F.concat(*(F.regexp_extract(a, href, g) for g in (1, 2, 3)))
    return F.transform(F.filter(found, lambda a: a.rlike(href)), lambda a: F.struct(at(a).alias("href"), anchor_text(a).alias("text")))


_LD = "struct<`@type`:string,telephone:string,faxNumber:string,address:string,url:string>"


def html_jsonld(html: Column | str) -> Column:
    """phone, fax, address, website of the last organization block per field."""
    blocks = F.regexp_extract_all(_c(html), F.lit(
        r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""), F.lit(1))
    orgs = F.filter(F.transform(blocks, lambda b: F.from_json(b, _LD)),
                    lambda o: o["@type"].isin("Organization", "LocalBusiness"))

    def last(field: str) -> Column:
        return F.try_element_at(F.array_compact(F.transform(orgs, lambda o: o[field])), F.lit(-1))

    return F.struct(last("telephone").alias("phone"), last("faxNumber").alias("fax"),
                    last("address").alias("address"), last("url").alias("website"))


# --- structured blocks inside free text --------------------------------------
_RESPONSE = "struct<summary:string,category:string,main_services:array<string>,extracted_features:array<string>>"


def json_block(text: Column | str) -> Column:
    """Fenced json block, else from the first '{' to the last '}', else NULL."""
    text = _c(text)
    fence = F.regexp_extract(text, r"(?s)```json\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(F.trim(fence), F.lit("")), F.nullif(braces, F.lit("")))


def response_fields(text: Column | str) -> Column:
    """summary, category and services from a block or from 'KEY: value' lines."""
    text = _c(text)
    block = F.from_json(json_block(text), _RESPONSE)

    def line(key: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^\s*{key}:(.*)$", 1)), F.lit(""))

    services = F.transform(F.split(F.regexp_replace(line("SERVICES"), r"^\[|\]$", ""), ","), lambda x: F.trim(F.regexp_replace(x, r"[\"']", "")))
    return F.struct(
        F.coalesce(block["summary"], line("SUMMARY"), F.lit("")).alias("summary"),
        F.coalesce(block["category"], line("CATEGORY"), F.lit(V.OTHER)).alias("category"),
        F.coalesce(block["main_services"], services, F.array().cast(_NO_STRINGS)).alias("main_services"),
        F.coalesce(block["summary"], block["category"], line("SUMMARY"), line("CATEGORY")).isNotNull().alias("found"),
    )
