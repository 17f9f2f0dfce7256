"""SQL text used by several check queries (DuckDB side only)."""

from __future__ import annotations

from orgloom.functions import fixed_values as V

FIELDS = V.CONTACT_FIELDS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def filled(f: str) -> str:
    return f"({f} IS NOT NULL AND {f} <> '')"


def missing(f: str) -> str:
    return f"({f} IS NULL OR {f} = '')"


def blank(f: str) -> str:
    return f"(coalesce(trim({f}), '') = '')"


def count(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def pct(part: str, whole: str, digits: int | None = 1) -> str:
    v = f"CASE WHEN {whole} > 0 THEN {part} * 100.0E0 / {whole} ELSE 0.0E0 END"
    return v if digits is None else f"round({v}, {digits})"


def any_missing(fields=FIELDS) -> str:
    return "(" + " OR ".join(missing(f) for f in fields) + ")"


def missing_count(fields=FIELDS) -> str:
    return "(" + " + ".join(f"CASE WHEN {missing(f)} THEN 1 ELSE 0 END" for f in fields) + ")"


def missing_fields(fields=FIELDS) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {blank(f)} THEN '{f}' END" for f in fields) + "], lambda x: x IS NOT NULL)"


def digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def strip(d: str) -> str:
    return f"CASE WHEN starts_with({d}, '82') THEN '0' || substr({d}, 3) ELSE {d} END"


def area(d: str) -> str:
    codes = in_list([c for c in V.AREA_NAMES if len(c) == 3])
    return f"CASE WHEN starts_with({d}, '02') THEN '02' WHEN substr({d}, 1, 3) IN {codes} THEN substr({d}, 1, 3) END"


def area_len(d: str) -> str:
    return (f"CASE WHEN length({d}) < 9 THEN substr({d}, 1, 2) WHEN starts_with({d}, '02') THEN '02' "
            f"ELSE substr({d}, 1, 3) END")


def area_name(code: str, other: str) -> str:
    return "CASE " + code + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.AREA_NAMES.items()) + f" ELSE {other} END"


def _dash(d: str, a: int, b: int) -> str:
    return f"substr({d},1,{a}) || '-' || substr({d},{a + 1},{b}) || '-' || substr({d},{a + b + 1})"


def dash(d: str, a: str) -> str:
    return (f"CASE WHEN {a} = '02' AND length({d}) = 9 THEN {_dash(d, 2, 3)} WHEN {a} = '02' THEN {_dash(d, 2, 4)} "
            f"WHEN {a} IN ('010','017','070') THEN {_dash(d, 3, 4)} WHEN length({d}) = 10 THEN {_dash(d, 3, 3)} "
            f"ELSE {_dash(d, 3, 4)} END")


def format_digits(d: str) -> str:
    return f"CASE WHEN length({d}) BETWEEN 9 AND 11 AND ({area(d)}) IS NOT NULL THEN {dash(d, '(' + area(d) + ')')} END"


def format_phone(c: str) -> str:
    return format_digits(f"({strip(digits(c))})")


def normalize_helper(c: str) -> str:
    d = f"({strip(digits(c))})"
    return (f"CASE WHEN length({d}) = 9 THEN {_dash(d, 2, 3)} WHEN length({d}) = 10 AND starts_with({d}, '02') THEN {_dash(d, 2, 4)} "
            f"WHEN length({d}) = 10 THEN {_dash(d, 3, 3)} WHEN length({d}) = 11 THEN {_dash(d, 3, 4)} END")


def dash_any(d: str) -> str:
    return (f"CASE WHEN length({d}) = 9 AND starts_with({d}, '02') THEN {_dash(d, 2, 3)} "
            f"WHEN length({d}) = 10 AND starts_with({d}, '02') THEN {_dash(d, 2, 4)} "
            f"WHEN length({d}) IN (9, 10) THEN {_dash(d, 3, 3)} WHEN length({d}) = 11 THEN {_dash(d, 3, 4)} END")


def normalize_validator(c: str) -> str:
    d = f"({strip(digits(c))})"
    return (f"coalesce(CASE WHEN starts_with({d}, '02') AND length({d}) = 10 THEN {_dash(d, 2, 3)} WHEN starts_with({d}, '02') THEN '' "
            f"WHEN starts_with({d}, '0') AND length({d}) = 11 THEN {_dash(d, 3, 4)} "
            f"WHEN starts_with({d}, '0') AND length({d}) = 10 THEN {_dash(d, 3, 3)} END, '')")


def normalize_groups(c: str) -> str:
    runs = f"regexp_extract_all({c}, '[0-9]+')"
    return f"CASE WHEN len({runs}) = 0 THEN {c} ELSE array_to_string({runs}[1:3], '-') END"


def reason(c: str) -> str:
    d = digits(c)
    a = f"({area(d)})"
    n = f"length({d})"
    return (f"CASE WHEN NOT {filled(c)} THEN 'empty' WHEN {n} NOT BETWEEN 9 AND 11 THEN 'length' WHEN {a} IS NULL THEN 'area' "
            f"WHEN {a} = '02' AND {n} NOT IN (9, 10) THEN 'mismatch' WHEN {a} IN ('070','010','017') AND {n} <> 11 THEN 'mismatch' "
            f"WHEN {a} NOT IN ('02','070','010','017') AND {n} NOT IN (10, 11) THEN 'mismatch' ELSE 'valid' END")


def _length_rule(a: str, n: str) -> str:
    return ("CASE " + a + " " + " ".join(f"WHEN '{k}' THEN {n} BETWEEN {lo} AND {hi}" for k, (lo, hi) in V.AREA_LENGTHS.items())
            + " ELSE false END")


def valid_strict(c: str) -> str:
    d = f"({strip(digits(c))})"
    a = f"({area(d)})"
    return (f"coalesce(length({d}) BETWEEN 9 AND 11 AND {a} IS NOT NULL AND ({_length_rule(a, f'length({d})')}) "
            f"AND regexp_matches({dash(d, a)}, '^0[0-9]{{1,2}}-[0-9]{{3,4}}-?[0-9]{{4}}'), false)")


def valid_length_table(c: str) -> str:
    d = digits(c)
    codes = in_list([k for k in V.AREA_LENGTHS if k != "02"])
    a = f"(CASE WHEN starts_with({d}, '02') THEN '02' WHEN substr({d},1,3) IN {codes} THEN substr({d},1,3) END)"
    return f"coalesce(length({d}) >= 9 AND ({_length_rule(a, f'length({d})')}), false)"


def valid_prefix(c: str) -> str:
    d = digits(c)
    pat = r"^02[0-9]{7,8}$|^0[3-6][0-9]{7,8}$|^070[0-9]{7,8}$|^1[5-9][0-9]{6,7}$|^080[0-9]{7,8}$"
    return f"coalesce(length({d}) BETWEEN 8 AND 11 AND regexp_matches({d}, '{pat}'), false)"


def dummy(c: str) -> str:
    n = normalize_validator(c)
    pat = ("^(033-333-3333|02-222-2222|031-111-1111|" + "|".join(f"{d*3}-{d*3}-{d*4}" for d in "0123456789")
           + r"|0[0-9]{1,2}-000-0000|0[0-9]{1,2}-123-4567|0[0-9]{1,2}-1234-5678|000-000-0000|999-999-9999)")
    return f"(({n}) = '' OR regexp_matches({n}, '{pat}'))"


def contains_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ")"


def first_contained(c: str, pairs, value=lambda p: p[0], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, {lit(p[0])}) THEN {lit(value(p))}" for p in pairs) + f" ELSE {other} END"


def fits_address(fax: str, address: str, table=V.AREA_REGIONS) -> str:
    a = f"({area_len(digits(fax))})"
    body = " ".join(f"WHEN '{k}' THEN {contains_any(address, ws)}" for k, ws in table.items())
    return f"(CASE WHEN NOT {filled(address)} THEN true ELSE CASE {a} {body} ELSE true END END)"


def hamming(a: str, b: str, start: str = "1") -> str:
    return f"len(list_filter(range({start}, length({a}) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1)))"


def too_similar(a: str, b: str) -> str:
    fa, fb = f"({area_len(a)})", f"({area_len(b)})"
    return (f"coalesce(length({a}) = length({b}) AND length({a}) >= 8 AND {fa} = {fb} "
            f"AND {hamming(a, b, f'(length({fa}) + 1)')} <= 1, false)")


def email_domain(c: str) -> str:
    return f"CASE WHEN contains({c}, '@') THEN lower(split_part({c}, '@', 2)) END"


def email_class(d: str) -> str:
    def ends(ws):
        return "(" + " OR ".join(f"ends_with({d}, '{w}')" for w in ws) + ")"

    p, g, e, b, r, o = V.EMAIL_CLASSES
    return (f"CASE WHEN {d} IN {in_list(V.PORTAL_DOMAINS)} THEN '{p}' WHEN {ends(V.GOVERNMENT_SUFFIXES)} THEN '{g}' "
            f"WHEN {ends(V.EDUCATION_SUFFIXES)} THEN '{e}' WHEN {ends(V.BUSINESS_SUFFIXES)} THEN '{b}' "
            f"WHEN {contains_any(d, V.RELIGIOUS_WORDS)} THEN '{r}' ELSE '{o}' END")


def rank(p: str, other: int = 3) -> str:
    return f"CASE {p} WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE {other} END"


def given(new: str, old: str) -> str:
    return f"CASE WHEN {blank(new)} THEN {old} ELSE {new} END"


def grade(mobile: str = "''") -> str:
    base = f"{filled('name')} AND {filled('address')} AND {filled('phone')}"
    return (f"CASE WHEN {base} AND {filled('fax')} AND {filled('homepage')} AND {filled('email')} AND {filled(mobile)} THEN 'A' "
            f"WHEN {base} AND {filled('fax')} AND {filled('homepage')} THEN 'B' WHEN {base} AND {filled('fax')} THEN 'C' "
            f"WHEN {base} AND {filled('homepage')} THEN 'D' WHEN {base} THEN 'E' ELSE 'F' END")
