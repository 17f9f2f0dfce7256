"""Phone and fax number rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .blank import _c, is_filled
from . import fixed_values as V

_THREE_DIGIT_CODES = [c for c in V.AREA_NAMES if len(c) == 3]


def digits(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "[^0-9]", "")


def strip_country(d: Column) -> Column:
    """Leading 82 becomes 0."""
    return F.when(d.startswith("82"), F.concat(F.lit("0"), F.substr(d, F.lit(3)))).otherwise(d)


def area_code(d: Column) -> Column:
    """Known area code that prefixes the digits, else NULL."""
    head = F.substring(d, 1, 3)
    return F.when(d.startswith("02"), "02").when(head.isin(*_THREE_DIGIT_CODES), head)


def area_code_by_length(d: Column) -> Column:
    """Area code judged from the digit count alone, whether known or not."""
    return (
        F.when(F.length(d) < 9, F.substring(d, 1, 2))
        .when(d.startswith("02"), "02")
        .otherwise(F.substring(d, 1, 3))
    )


def area_name(code: Column, unknown: str | None = V.UNKNOWN_AREA) -> Column:
    names = F.create_map(*[F.lit(x) for kv in V.AREA_NAMES.items() for x in kv])
    # an absent key gives NULL under try_element_at, in ANSI mode as well
    return F.coalesce(F.try_element_at(names, code), F.lit(unknown)) if unknown else F.try_element_at(names, code)


def _dashed(d: Column, a: int, b: int) -> Column:
    return F.concat_ws("-", F.substring(d, 1, a), F.substring(d, a + 1, b), F.substr(d, F.lit(a + b + 1)))


def dash(d: Column, code: Column) -> Column:
    """Dashes by area code: 02 is 2-3-4 or 2-4-rest, mobile 3-4-rest, others by length."""
    n = F.length(d)
    return (
        F.when((code == "02") & (n == 9), _dashed(d, 2, 3))
        .when(code == "02", _dashed(d, 2, 4))
        .when(code.isin("010", "017", "070"), _dashed(d, 3, 4))
        .when(n == 10, _dashed(d, 3, 3))
        .otherwise(_dashed(d, 3, 4))
    )


def format_digits(d: Column) -> Column:
    """Formatted number, NULL unless 9-11 digits under a known area code."""
    code = area_code(d)
    return F.when(F.length(d).between(9, 11) & code.isNotNull(), dash(d, code))


def format_phone(c: Column | str) -> Column:
    return format_digits(strip_country(digits(c)))


def dash_any(d: Column) -> Column:
    """Dashes for any 9-11 digits; 9 digits outside 02 are 3-3-3."""
    n = F.length(d)
    seoul = d.startswith("02")
    return (
        F.when((n == 9) & seoul, _dashed(d, 2, 3))
        .when((n == 10) & seoul, _dashed(d, 2, 4))
        .when(n.isin(9, 10), _dashed(d, 3, 3))
        .when(n == 11, _dashed(d, 3, 4))
    )


def dash_helper(d: Column) -> Column:
    """As ``dash_any`` but every 9-digit number is 2-3-4."""
    n = F.length(d)
    return (
        F.when(n == 9, _dashed(d, 2, 3))
        .when((n == 10) & d.startswith("02"), _dashed(d, 2, 4))
        .when(n == 10, _dashed(d, 3, 3))
        .when(n == 11, _dashed(d, 3, 4))
    )


def dash_page(d: Column) -> Column:
    """Page policy: 9-11 digits under any prefix; mobile prefixes 3-4-rest."""
    n = F.length(d)
    mobile = F.substring(d, 1, 3).isin("010", "011", "016", "017", "018", "019", "070")
    return F.when(n.between(9, 11), F.when(d.startswith("02") & (n == 9), _dashed(d, 2, 3)).when(d.startswith("02"), _dashed(d, 2, 4))
                  .when(mobile, _dashed(d, 3, 4)).when(n == 10, _dashed(d, 3, 3)).otherwise(_dashed(d, 3, 4)))


def normalize_helper(c: Column | str) -> Column:
    return dash_helper(strip_country(digits(c)))


def normalize_validator(c: Column | str) -> Column:
    """Validator policy: 10-11 digits only and 10-digit 02 numbers as 2-3-5."""
    return dash_validator(strip_country(digits(c)))


def dash_validator(d: Column) -> Column:
    n = F.length(d)
    return F.coalesce(
        F.when(d.startswith("02") & (n == 10), _dashed(d, 2, 3))
        .when(d.startswith("02"), "")
        .when(d.startswith("0") & (n == 11), _dashed(d, 3, 4))
        .when(d.startswith("0") & (n == 10), _dashed(d, 3, 3)),
        F.lit(""),
    )


def normalize_groups(c: Column | str) -> Column:
    """The first three runs of digits joined by dashes; unchanged without digits."""
    c = _c(c)
    runs = F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    return F.when(F.size(runs) == 0, c).otherwise(F.array_join(F.slice(runs, 1, 3), "-"))


def _length_fits(d: Column, code: Column, rules: dict[str, tuple[int, int]]) -> Column:
    lo = F.create_map(*[F.lit(x) for k, (a, _) in rules.items() for x in (k, a)])
    hi = F.create_map(*[F.lit(x) for k, (_, b) in rules.items() for x in (k, b)])
    n = F.length(d)
    return (n >= F.try_element_at(lo, code)) & (n <= F.try_element_at(hi, code))


def valid_strict(c: Column | str) -> Column:
    d = strip_country(digits(c))
    code = area_code(d)
    ok = (
        F.length(d).between(9, 11)
        & code.isNotNull()
        & _length_fits(d, code, V.AREA_LENGTHS)
        & dash(d, code).rlike(V.ANCHORED_PHONE)
    )
    return F.coalesce(ok, F.lit(False))


def valid_length_table(c: Column | str) -> Column:
    """Only the length table, 080 included and no country strip."""
    d = digits(c)
    head = F.substring(d, 1, 3)
    code = F.when(d.startswith("02"), "02").when(head.isin(*[k for k in V.AREA_LENGTHS if k != "02"]), head)
    return F.coalesce((F.length(d) >= 9) & _length_fits(d, code, V.AREA_LENGTHS), F.lit(False))


def invalid_reason(c: Column | str) -> Column:
    """'valid' or the first rule broken: empty, length, area, mismatch."""
    c = _c(c)
    d = digits(c)
    n = F.length(d)
    code = area_code(d)
    return (
        F.when(~is_filled(c), "empty")
        .when(~n.between(9, 11), "length")
        .when(code.isNull(), "area")
        .when((code == "02") & ~n.isin(9, 10), "mismatch")
        .when(code.isin("070", "010", "017") & (n != 11), "mismatch")
        .when(~code.isin("02", "070", "010", "017") & ~n.isin(10, 11), "mismatch")
        .otherwise("valid")
    )


def is_valid(c: Column | str) -> Column:
    return invalid_reason(c) == "valid"


def valid_prefix(c: Column | str) -> Column:
    d = digits(c)
    return F.coalesce(F.length(d).between(8, 11) & d.rlike("|".join(V.PREFIX_PHONES)), F.lit(False))


def valid_loose(c: Column | str, policy: str = "model") -> Column:
    """Dashed-text checks; ``policy`` is model, agent, checker or map."""
    c = _c(c)
    if policy == "model":
        return F.when(~is_filled(c), True).otherwise(F.trim(c).rlike(V.LOOSE_PHONE))
    if policy == "agent":
        return F.coalesce(F.regexp_replace(c, r"[.\s]", "-").rlike("|".join(V.AGENT_PHONES)), F.lit(False))
    patterns = {"checker": V.CHECKER_PHONES, "map": V.MAP_PHONES}[policy]
    return F.coalesce(c.rlike("|".join(patterns)), F.lit(False))


def valid_for_save(c: Column | str) -> Column:
    """9-11 digits under one of the prefixes accepted when results are stored."""
    d = digits(c)
    ok = F.length(d).between(9, 11) & (
        d.startswith("02") | F.substring(d, 1, 3).isin(*[p for p in V.SAVE_PREFIXES if len(p) == 3]))
    return F.coalesce(ok, F.lit(False))


def confidence(c: Column | str) -> Column:
    d = digits(normalize_helper(c))
    return (
        F.when(d.isNull(), 0.0)
        .when(F.substring(d, 1, 3).isin("010", "011", "016") | d.startswith("02"), 0.9)
        .when(d.startswith("0"), 0.8)
        .otherwise(0.6)
    )


_DUMMY = "^(?:" + "|".join(V.DUMMY_PHONES) + ")"


def is_dummy(c: Column | str) -> Column:
    """Placeholder numbers; what cannot be normalized counts as one."""
    n = F.coalesce(normalize_validator(c), F.lit(""))
    return n.rlike("^$|" + _DUMMY)


def few_digits(c: Column | str) -> Column:
    """At most two different digits."""
    return F.size(F.array_distinct(F.filter(F.split(digits(c), ""), lambda x: x != ""))) <= 2


def valid_in_text(c: Column | str) -> Column:
    """9-11 digits under a known area and not written like a placeholder."""
    c = _c(c)
    return digits_in_text(digits(c)) & ~c.rlike(_DUMMY)


def digits_in_text(d: Column) -> Column:
    """9-11 digits under a known area."""
    return F.length(d).between(9, 11) & area_code(d).isNotNull()


def placeholder(c: Column) -> Column:
    return c.rlike(_DUMMY)


def validator_verdict(value: Column, normalized: Column) -> Column:
    """'ok', 'empty', 'dummy', 'area' or 'pattern' for a value and its validator form."""
    n = F.coalesce(normalized, F.lit(""))
    return (
        F.when(~is_filled(value), "empty")
        .when(n.rlike("^$|" + _DUMMY), "dummy")
        .when(~F.split_part(n, F.lit("-"), F.lit(1)).isin(*V.AREA_NAMES), "area")
        .when(~n.rlike(V.ANCHORED_PHONE), "pattern")
        .otherwise("ok")
    )


def same_digits(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(is_filled(a) & is_filled(b) & (digits(a) == digits(b)), F.lit(False))


def same_number(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(is_filled(a) & is_filled(b) & (format_phone(a) == format_phone(b)), F.lit(False))


def exchange(formatted: Column) -> Column:
    """Second dashed part, NULL when there is none."""
    return F.nullif(F.split_part(formatted, F.lit("-"), F.lit(2)), F.lit(""))


def differing_positions(a: Column, b: Column, start: int | Column = 1) -> Column:
    """Positions where two equally long digit strings differ (Hamming)."""
    start = F.lit(start) if isinstance(start, int) else start
    n = F.length(a)
    pos = F.when(n >= start, F.sequence(start, n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(pos, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))


def too_similar(fax_digits: Column, phone_digits: Column) -> Column:
    """Same length of 8 or more, same area, at most one other digit after it."""
    fa, pa = area_code_by_length(fax_digits), area_code_by_length(phone_digits)
    n = F.length(fax_digits)
    return F.coalesce(
        (n == F.length(phone_digits))
        & (n >= 8)
        & (fa == pa)
        & (differing_positions(fax_digits, phone_digits, F.length(fa) + 1) <= 1),
        F.lit(False),
    )


def similarity(a: Column | str, b: Column | str) -> Column:
    """Share of equal positions, 0 for unequal length or a missing side."""
    da, db = digits(a), digits(b)
    n = F.length(da)
    ok = is_filled(a) & is_filled(b) & (n == F.length(db)) & (n > 0)
    return F.when(ok, (n - differing_positions(da, db)) / n.cast("double")).otherwise(F.lit(0.0))


def relation(a: Column, b: Column) -> Column:
    """exact_match, similar_pattern (same area and exchange) or different."""
    da, db = digits(a), digits(b)
    n = F.length(da)
    head = F.when(n == 10, 6).when(n == 11, 7)
    similar = (n == F.length(db)) & (F.substr(da, F.lit(1), head) == F.substr(db, F.lit(1), head)) & (da != db)
    return F.when(a == b, "exact_match").when(similar, "similar_pattern").otherwise("different")


def _accepts(table: dict[str, list[str]], code: Column, address: Column) -> Column:
    from .address import contains_any

    out = None
    for key, names in table.items():
        cond = code == key
        out = F.when(cond, contains_any(address, names)) if out is None else out.when(cond, contains_any(address, names))
    return out.otherwise(True)


def area_fits_address(code: Column, address: Column, wide: bool = False) -> Column:
    """The area is accepted for the address; unknown areas and 070 pass, as does no address."""
    fits = _accepts(V.AREA_REGIONS_WIDE if wide else V.AREA_REGIONS, code, address)
    return F.when(~is_filled(address), True).otherwise(fits)


def fax_fits_address(fax: Column, address: Column, wide: bool = False) -> Column:
    return area_fits_address(area_code_by_length(digits(fax)), address, wide)


def fax_valid_strict(fax: Column | str, phone: Column | str, address: Column | str) -> Column:
    fax, phone, address = _c(fax), _c(phone), _c(address)
    f, p = normalize_groups(fax), normalize_groups(phone)
    df, dp = digits(f), digits(p)
    against_phone = F.when(
        is_filled(phone),
        (f != p) & (area_code_by_length(df) == area_code_by_length(dp)) & ~too_similar(df, dp),
    ).otherwise(True)
    return is_filled(fax) & valid_prefix(f) & against_phone & fax_fits_address(f, address)
