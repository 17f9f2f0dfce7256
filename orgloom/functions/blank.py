"""The two readings of "missing": NULL or '' for counts, blank text for lists."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from .fixed_values import BLANK_WORDS, CONTACT_FIELDS


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without surrounding white space of any kind (TRIM alone removes only spaces)."""
    return F.trim(_c(c), F.lit(" \t\n\r\f\v"))


def is_missing(c: Column | str) -> Column:
    """NULL or empty string; whitespace counts as a value. The column is read once."""
    return F.coalesce(_c(c), F.lit("")) == ""


def is_filled(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit("")) != ""


def is_blank(c: Column | str) -> Column:
    """NULL, empty or only spaces."""
    return F.coalesce(strip(c), F.lit("")) == ""


def has_text(c: Column | str) -> Column:
    return ~is_blank(c)


def any_missing(fields: Iterable[str] = CONTACT_FIELDS) -> Column:
    return reduce(lambda a, b: a | b, [is_missing(f) for f in fields])


def missing_count(fields: Iterable[str] = CONTACT_FIELDS) -> Column:
    return reduce(lambda a, b: a + b, [is_missing(f).cast("int") for f in fields])


def missing_fields(fields: Iterable[str] = CONTACT_FIELDS) -> Column:
    """Array of the field names whose text is blank."""
    return F.array_compact(F.array(*[F.when(is_blank(f), F.lit(f)) for f in fields]))


def first_text(*cols: Column | str) -> Column:
    """First argument that is neither NULL nor ''."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def clean_value(c: Column | str) -> Column:
    """Trimmed text with placeholder words turned into ''."""
    t = F.coalesce(strip(c), F.lit(""))
    return F.when(t.isin(*BLANK_WORDS), "").otherwise(t)


def first_nonblank(*cols: Column | str) -> Column:
    """First value whose trimmed text is not empty, nan, none or null."""
    picks = []
    for c in cols:
        t = strip(c)
        picks.append(F.when((t != "") & ~F.lower(t).isin("nan", "none", "null"), t))
    return F.coalesce(*picks, F.lit(""))


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    """100 * part / whole, 0 for an empty whole."""
    value = F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))
    return value if digits is None else F.round(value, digits)
