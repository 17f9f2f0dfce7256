"""E-mail and URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .address import contains_any
from .blank import _c, is_filled, strip
from . import fixed_values as V


def email_domain(email: Column | str) -> Column:
    """Lower-cased text between the first and second '@', NULL without one."""
    email = _c(email)
    return F.when(email.contains("@"), F.lower(F.split_part(email, F.lit("@"), F.lit(2))))


def email_class(domain: Column) -> Column:
    def ends(suffixes: list[str]) -> Column:
        out = domain.endswith(suffixes[0])
        for s in suffixes[1:]:
            out = out | domain.endswith(s)
        return out

    portal, government, education, business, religious, other = V.EMAIL_CLASSES
    return (
        F.when(domain.isin(*V.PORTAL_DOMAINS), portal)
        .when(ends(V.GOVERNMENT_SUFFIXES), government)
        .when(ends(V.EDUCATION_SUFFIXES), education)
        .when(ends(V.BUSINESS_SUFFIXES), business)
        .when(contains_any(domain, V.RELIGIOUS_WORDS), religious)
        .otherwise(other)
    )


def email_valid(email: Column | str, policy: str = "anchored") -> Column:
    """anchored: full pattern, blank allowed; strict: blank refused; simple: '@' and '.'."""
    email = _c(email)
    if policy == "simple":
        return F.coalesce(email.contains("@") & email.contains("."), F.lit(False))
    matched = F.coalesce(strip(email).rlike(V.EMAIL_ANCHORED), F.lit(False))
    return matched if policy == "strict" else ~is_filled(email) | matched


def email_confidence(email: Column | str) -> Column:
    email = _c(email)
    ok = email.rlike("^" + V.HELPER_EMAIL_PATTERN)
    return (
        F.when(~is_filled(email) | ~ok, 0.0)
        .when(email_domain(email).isin(*V.COMMON_DOMAINS), 0.9)
        .otherwise(0.7)
    )


def url_with_scheme(url: Column | str) -> Column:
    """Trimmed, with http:// put before bare host names; '' for NULL."""
    t = F.coalesce(strip(url), F.lit(""))
    bare = ~t.startswith("http://") & ~t.startswith("https://")
    return F.when(bare & (t.startswith("www.") | t.contains(".")), F.concat(F.lit("http://"), t)).otherwise(t)


def url_or_null(url: Column | str) -> Column:
    """``url_with_scheme`` when the result looks like a URL, else NULL."""
    return url_shaped(url_with_scheme(url))


def url_shaped(t: Column) -> Column:
    return F.when(t.rlike(r"^https?://[^\s]+\.[^\s]+"), t)


def url_confidence(url: Column | str) -> Column:
    url = _c(url)
    return (
        F.when(~is_filled(url) | ~url.rlike(r"^https?://[-\w.]+"), 0.0)
        .when(url.startswith("https://"), 0.9)
        .otherwise(0.7)
    )


def url_host(url: Column | str) -> Column:
    """Host and port, lower case; '' when there is no scheme."""
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def unwrap_redirect(url: Column | str) -> Column:
    """Target of a '/url?q=' search redirect, other text unchanged."""
    url = _c(url)
    target = F.split_part(F.substr(url, F.lit(8)), F.lit("&"), F.lit(1))
    return F.when(url.startswith("/url?q="), target).otherwise(url)


def homepage_allowed(url: Column | str, excluded: list[str] = V.SEARCH_EXCLUDED_DOMAINS) -> Column:
    return ~F.coalesce(contains_any(url_host(unwrap_redirect(url)), excluded), F.lit(False))


def social_platform(url: Column | str) -> Column:
    host = url_host(url)
    return F.coalesce(*[F.when(host.contains(d), F.lit(label)) for d, label in V.SOCIAL_DOMAINS])


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """Absolute kept; '/x' on scheme and host; else beside the base document."""
    href, base = _c(href), _c(base)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(plain == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(plain, "[^/]*$", ""))
    return (
        F.when(href.startswith("http://") | href.startswith("https://"), href)
        .when(href.startswith("/"), F.concat(root, href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(plain, href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(\./)+", "")))
    )
