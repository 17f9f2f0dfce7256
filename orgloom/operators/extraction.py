"""Extraction jobs: one projection per table of texts or pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orgloom.functions import address as A
from orgloom.functions import extract as X
from orgloom.functions import fixed_values as V
from orgloom.functions import phone as P
from orgloom.functions import web as W
from orgloom.functions.blank import strip


def extract_contacts(texts: DataFrame, key: str = "id") -> DataFrame:
    return texts.select(key, X.contacts("text").alias("c")).select(key, "c.*")


def extract_contacts_agent(texts: DataFrame, kind: str = "all", key: str = "id") -> DataFrame:
    """Validated items per kind with their counts."""
    kinds = ("phone", "fax", "email", "website") if kind == "all" else (kind,)
    items = texts.select(key, *[X.agent_items("text", k).alias(k) for k in kinds])
    return items.select(key, *kinds, *[F.size(k).alias(f"total_{k}") for k in kinds])


def extract_contacts_helper(texts: DataFrame, key: str = "id") -> DataFrame:
    return texts.select(
        key, X.helper_phones("text").alias("phone_numbers"), X.helper_emails("text").alias("email_addresses"),
        X.helper_faxes("text").alias("fax_numbers"), X.helper_urls("text").alias("urls"), X.helper_addresses("text").alias("addresses"))


def extract_contacts_enhanced(texts: DataFrame, key: str = "id") -> DataFrame:
    emails = F.array_distinct(X.emails("text", [V.HELPER_EMAIL_PATTERN]))
    return texts.select(key, X.enhanced_numbers("text").alias("phones"), X.enhanced_numbers("text", "fax").alias("faxes"), emails.alias("emails"))


def extract_first_contact(texts: DataFrame, key: str = "id") -> DataFrame:
    """First valid phone, fax, address and postal code of a text."""
    texts = texts.select(key, X.spaced("text").alias("text"))
    t = F.col("text")
    number = lambda arr: X.first_valid(F.transform(arr, lambda x: F.regexp_replace(x, "[^0-9-]", "")), lambda x: P.valid_loose(x, "map"))
    phones, faxes, addresses = (X.all_matches(t, pats, "") for pats in (V.FIRST_PHONES, V.FIRST_FAXES, V.FIRST_ADDRESSES))
    fit = lambda a: (F.length(a) > 10) & A.contains_any(a, ["시", "구", "군"])
    empty = F.array().cast("array<string>")
    has_digits = t.rlike(X._LONG_RUN)
    out = texts.select(
        key, F.coalesce(number(F.when(has_digits, phones).otherwise(empty)), F.lit("")).alias("phone"),
        F.coalesce(number(F.when(has_digits, faxes).otherwise(empty)), F.lit("")).alias("fax"),
        F.coalesce(X.first_valid(F.transform(F.when(t.rlike("[시군구]"), addresses).otherwise(empty), lambda x: strip(x)), fit), F.lit("")).alias("address"),
        F.coalesce(X.first_valid(F.regexp_extract_all(t, F.lit(r"\b\d{5}\b"), F.lit(0)), lambda x: x.rlike("^[0-6]")), F.lit("")).alias("postal_code"))
    return out.withColumn("found", (F.col("phone") != "") | (F.col("fax") != "") | (F.col("address") != "") | (F.col("postal_code") != ""))


def _listed(matches: Column) -> Column:
    """Stripped matches; one is skipped when its raw text is already listed."""
    return X.let(F.transform(matches, lambda x: strip(x)), lambda stripped: F.transform(
        F.filter(matches, lambda x, i: ~F.array_contains(F.slice(stripped, F.lit(1), i), x)), lambda x: strip(x)))


def extract_postal_codes(texts: DataFrame, key: str = "id") -> DataFrame:
    """Postal codes and short-form addresses, with the validated count of every kind."""
    texts = texts.select(key, X.spaced("text").alias("text"))
    t = F.col("text")
    none = F.array().cast("array<string>")
    found = texts.select(
        key, X.postal_codes("text").alias("postal_codes"),
        F.when(t.rlike("[시군구]"), F.regexp_extract_all(t, F.lit(V.SHORT_ADDRESS_PATTERN), F.lit(0))).otherwise(none).alias("a"),
        X._has_number(t, X.all_matches(t, V.PHONE_PATTERNS, "")).alias("p"), X._has_number(t, X.all_matches(t, V.FAX_PATTERNS, "")).alias("f"),
        F.when(t.contains("@"), X.all_matches(t, V.EMAIL_PATTERNS, "")).otherwise(none).alias("e"))
    long_ones = F.filter(F.array_sort(F.array_distinct("a")), lambda a: F.length(a) > 10)
    good = lambda c: F.size(F.filter(_listed(F.col(c)), lambda x: X.let(P.digits(x), P.digits_in_text) & ~P.placeholder(x)))
    return found.select(
        key, "postal_codes", long_ones.alias("addresses"), good("p").alias("phones_validated"), good("f").alias("faxes_validated"),
        F.size(_listed(F.col("e"))).alias("emails_validated"), F.size(long_ones).alias("addresses_found"), F.size("postal_codes").alias("postal_codes_found"))


def extract_contacts_page(texts: DataFrame, key: str = "id") -> DataFrame:
    """The page policy: any prefix, full e-mail pattern, addresses with their symbols."""
    texts = texts.select(key, X.spaced("text").alias("text"))
    t = F.col("text")
    numbers = lambda pats: X.keep(X._has_number(t, X.all_matches(t, pats)), lambda x: X.let(P.digits(x), P.dash_page))
    addresses = X.keep(F.when(t.rlike("[시군구동로길]"), X.all_matches(t, V.ADDRESS_PATTERNS)).otherwise(F.array().cast("array<string>")),
                       lambda x: A.clean_address(x, keep_symbols=True))
    return texts.select(key, numbers(V.PHONE_PATTERNS).alias("phones"), numbers(V.FAX_PATTERNS).alias("faxes"),
                        F.filter(X.emails(t), lambda x: W.email_valid(x, "strict")).alias("emails"), addresses.alias("addresses"))


def page_record(pages: DataFrame, key: str = "id") -> DataFrame:
    """url, title, text length, contacts, description and status of each page."""
    base = pages.select(key, "url", X.html_title("html").alias("title"), X.html_meta("html", "name", "description").alias("description"),
                        X.html_text("html").alias("text"))
    return base.select(
        key, "url", "title", "description", F.length("text").alias("text_length"), X.contacts("text").alias("contacts"),
        F.when(F.length("text") < 100, "warning").otherwise("success").alias("status"))


def best_text(pages: DataFrame, key: str = "id", max_chars: int | None = None) -> DataFrame:
    """Longest of the full, main-area and contact-area text with the area it came from."""
    def patterns(tags: list[str], marks: str) -> list[str]:
        return [*(X.opens(t) for t in tags), X.opens(r"[a-z][a-z0-9]*", marks)]

    main, contact = patterns(X.MAIN_TAGS, X.MAIN_MARKS), patterns(X.CONTACT_TAGS, X.CONTACT_MARKS)
    areas = pages.select(key, "html", X.html_areas("html", [*main, *contact]).alias("areas"))
    return _best(areas, len(main), key, max_chars)


def best_selected_text(pages: DataFrame, key: str = "id", max_chars: int | None = None) -> DataFrame:
    """As :func:`best_text`, areas by CSS selectors; an element that several selectors name counts for each."""
    areas = pages.select(key, "html", X.html_select("html", [*X.CONTENT_SELECTORS, *X.CONTACT_SELECTORS]).alias("areas"))
    return _best(areas, len(X.CONTENT_SELECTORS), key, max_chars)


def _best(areas: DataFrame, n_main: int, key: str, max_chars: int | None) -> DataFrame:
    def area(first: int, n: Column | int, least: int) -> Column:
        texts = F.transform(F.flatten(F.slice("areas", F.lit(first), F.lit(n) if isinstance(n, int) else n)), X.one_line)
        return F.array_join(F.filter(texts, lambda x: F.length(x) > least), " ")

    def candidate(order: int, name: str, text: Column) -> Column:
        return F.struct(F.length(text).alias("n"), F.lit(-order).alias("order"), F.lit(name).alias("method"), text.alias("text"))

    texts = areas.select(key, X.html_text("html").alias("full"), area(1, n_main, 100).alias("main"), area(n_main + 1, F.size("areas"), 20).alias("contact"))
    best = F.array_max(F.array(candidate(0, "full", F.col("full")), candidate(1, "main", F.col("main")), candidate(2, "contact", F.col("contact"))))
    chosen = texts.select(key, best.alias("b"))
    text = F.col("b.text") if max_chars is None else F.substring("b.text", 1, max_chars)
    return chosen.select(key, F.col("b.method").alias("method"), text.alias("text"))


def contact_links(pages: DataFrame, key: str = "id", limit: int | None = None) -> DataFrame:
    """All (or the first ``limit``) links whose text holds a contact word, resolved against the page."""
    words = V.CONTACT_LINK_WORDS
    links = F.transform(X.html_anchors("html"), lambda a: F.struct(
        F.coalesce(*[F.when(F.lower(a["text"]).contains(w), F.lit(w)) for w in words]).alias("keyword"), a["href"].alias("href"), a["text"].alias("text")))
    hits = F.filter(links, lambda x: x["keyword"].isNotNull())
    if limit is not None:
        hits = F.slice(hits, 1, limit)
    rows = pages.select(key, "url", F.posexplode(hits).alias("pos", "link"))
    return rows.select(key, (F.col("pos") + 1).alias("rank"), W.resolve_url(F.col("link.href"), F.col("url")).alias("url"),
                       F.col("link.text").alias("text"), F.col("link.keyword").alias("keyword"))
