"""Address and region rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .blank import _c, is_filled
from . import fixed_values as V
from . import phone as P


def contains_any(c: Column, words: list[str]) -> Column:
    """True when one of the (literal) words occurs in the text."""
    # a name that contains a shorter listed name adds nothing to the test
    core = [w for w in words if not any(o != w and o in w for o in words)]
    out = c.contains(core[0])
    for w in core[1:]:
        out = out | c.contains(w)
    return out


def _reachable(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Names that can be the first hit: one that contains an earlier name never is."""
    return [(n, v) for i, (n, v) in enumerate(pairs) if not any(o in n for o, _ in pairs[:i])]


def region_key(address: Column | str) -> Column:
    """First region or city name found in the address, else NULL."""
    address = _c(address)
    return F.coalesce(*[F.when(address.contains(name), F.lit(name)) for name, _ in _reachable(V.REGION_NAMES)])


def region_short(address: Column | str) -> Column:
    """First of the 17 short region names found, else ''."""
    address = _c(address)
    return F.coalesce(*[F.when(address.contains(r), F.lit(r)) for r, _ in V.REGION_CODES], F.lit(""))


def _code_of(pairs: list[tuple[str, str]], address: Column) -> Column:
    return F.coalesce(*[F.when(address.contains(name), F.lit(code)) for name, code in _reachable(pairs)])


def region_city(address: Column | str, with_city: bool = True) -> Column:
    """'province city' (or province only) by the first rule that matches, else ''."""
    address = _c(address)
    tails = {"시군": r"\s+(\S+시|\S+군)", "구": r"\s+(\S+구)", "시": r"\s+(\S+시)", "": ""}
    picks = []
    for names, kind in V.REGION_CITY_RULES:
        pattern = f"({names}){tails[kind]}"
        hit = address.rlike(pattern)
        value = F.regexp_extract(address, pattern, 1)
        if with_city and kind:
            value = F.concat(value, F.lit(" "), F.regexp_extract(address, pattern, 2))
        picks.append(F.when(hit, value))
    return F.coalesce(*picks, F.lit(""))


def region_of_phone(phone: Column | str, address: Column | str) -> Column:
    """Area name of the number; mobile, internet and unknown fall back to the address."""
    phone, address = _c(phone), _c(address)
    name = F.coalesce(P.area_name(P.area_code_by_length(P.digits(phone)), None), F.lit(""))
    by_address = region_city(address, with_city=False)
    return (
        F.when(~is_filled(phone), F.when(is_filled(address), by_address).otherwise(""))
        .when(name.isin("핸드폰", "인터넷전화", "") & is_filled(address), by_address)
        .otherwise(name)
    )


def phone_fits_region(phone: Column | str, address: Column | str, policy: str = "exact") -> Column:
    """Does the number's area belong to the address?

    exact: full name list, passes without a known region; neighbour: the
    accepted-region table; strict: 17 short names, unknown region fails.
    """
    phone, address = _c(phone), _c(address)
    if policy == "neighbour":
        return P.fax_fits_address(phone, address)
    if policy == "strict":
        code = F.when(phone.contains("-"), F.split_part(phone, F.lit("-"), F.lit(1))).otherwise(F.substring(phone, 1, 3))
        return F.coalesce(code == _code_of(V.REGION_CODES, address), F.lit(False))
    code = P.area_code(P.digits(phone))
    return (
        F.when(~is_filled(phone) | ~is_filled(address), True)
        .when(code.isNull(), False)
        .otherwise(F.coalesce(code == _code_of(V.REGION_NAMES, address), F.lit(True)))
    )


def clean_address(address: Column | str, keep_symbols: bool = False) -> Column:
    """Single spaces, NULL under 10 characters, other symbols dropped."""
    return clean_spaced(one_space(address), keep_symbols)


def one_space(address: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(address), r"(?U)\s+", " "))


def clean_spaced(address: Column, keep_symbols: bool = False) -> Column:
    cleaned = address if keep_symbols else F.regexp_replace(address, r"(?U)[^\w\s\-.,()가-힣]", "")
    return F.when(F.length(address) >= 10, cleaned)


def plausible(address: Column | str) -> Column:
    address = _c(address)
    return F.coalesce(
        contains_any(address, [r for r, _ in V.REGION_CODES])
        | address.rlike(r"(로|길)\s*[0-9]+")
        | address.rlike(r"[0-9]+-[0-9]+")
        | (F.length(address) > 10),
        F.lit(False),
    )
