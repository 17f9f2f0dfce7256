"""Record-level validation: pairs, lists, scores and error lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orgloom.functions import fixed_values as V
from orgloom.functions import phone as P
from orgloom.functions import scoring as S
from orgloom.functions import web as W
from orgloom.functions.blank import is_blank, is_filled


def clean_contact_pair(orgs: DataFrame) -> DataFrame:
    """Validated phone and fax; an equal fax is blanked; what happened is listed."""
    # staged so that each form is computed once and only referred to afterwards
    bare = orgs.withColumns({f"{f}_digits": P.strip_country(P.digits(f)) for f in ("phone", "fax")})
    formed = bare.withColumns({"pn": P.dash_validator(F.col("phone_digits")), "fn": P.dash_validator(F.col("fax_digits"))})
    judged = formed.withColumns({
        "phone_verdict": P.validator_verdict(F.col("phone"), F.col("pn")), "fax_verdict": P.validator_verdict(F.col("fax"), F.col("fn"))})
    ok_p, ok_f = F.col("phone_verdict") == "ok", F.col("fax_verdict") == "ok"
    both = judged.withColumn("is_duplicate", ok_p & ok_f & (F.col("pn") == F.col("fn")))
    dup = F.col("is_duplicate")
    return both.withColumns({
        "phone": F.when(ok_p, F.col("pn")).otherwise(""), "fax": F.when(ok_f & ~dup, F.col("fn")).otherwise(""),
        "phone_valid": ok_p, "fax_valid": ok_f & ~dup,
        "messages": F.array_compact(F.array(
            F.when(F.col("phone_verdict") != "empty", F.concat(F.lit("phone:"), "phone_verdict")),
            F.when(F.col("fax_verdict") != "empty", F.concat(F.lit("fax:"), "fax_verdict")),
            F.when(dup, F.lit("fax:removed")))),
    }).drop("pn", "fn", "phone_digits", "fax_digits")


def fax_checks(orgs: DataFrame) -> DataFrame:
    """``ok_strict`` and ``ok_relaxed`` for the stored fax, computed stage by stage."""
    c = F.col
    groups = orgs.withColumns({"__f": P.normalize_groups("fax"), "__p": P.normalize_groups("phone")})
    bare = groups.withColumns({"__fd": P.digits("__f"), "__pd": P.digits("__p")})
    judged = bare.withColumns({
        "__fa": P.area_code_by_length(c("__fd")), "__pa": P.area_code_by_length(c("__pd")),
        "__fok": F.coalesce(is_filled("fax") & P.valid_prefix("__fd"), F.lit(False)), "__pok": P.valid_prefix("__pd")})
    close = judged.withColumn("__near", P.too_similar(c("__fd"), c("__pd")))
    against = F.when(is_filled("phone"), (c("__f") != c("__p")) & (c("__fa") == c("__pa")) & ~c("__near")).otherwise(True)
    near = ~is_blank("phone") & c("__pok") & ((c("__f") == c("__p")) | c("__near"))
    return close.withColumns({
        "ok_strict": c("__fok") & F.coalesce(against, F.lit(False)) & P.area_fits_address(c("__fa"), c("address")),
        "ok_relaxed": c("__fok") & F.when(near, P.area_fits_address(c("__fa"), c("address"), wide=True)).otherwise(True),
    }).select(*orgs.columns, "ok_strict", "ok_relaxed")


def website_ok(x: Column) -> Column:
    return (x.startswith("http://") | x.startswith("https://") | x.startswith("www.")) & x.contains(".")


_CHECKS = (
    ("phone", "phones", lambda x: P.valid_loose(x, "checker")),
    ("fax", "faxes", lambda x: P.valid_loose(x, "checker")),
    ("email", "emails", lambda x: x.rlike(V.EMAIL_ANCHORED)),
    ("site", "websites", website_ok),
)


def list_validation(lists: DataFrame, key: str = "id") -> DataFrame:
    """Valid and invalid counts and success rate for every contact list."""
    cols = []
    for kind, column, check in _CHECKS:
        n, ok = F.size(column), F.size(F.filter(column, check))
        cols += [(ok > 0).alias(f"{kind}_valid"), ok.alias(f"{kind}_valid_count"), (n - ok).alias(f"{kind}_invalid_count"),
                 F.when(n > 0, F.round(ok / n, 6)).otherwise(0.0).alias(f"{kind}_success_rate")]
    return lists.select(key, *cols)


def _areas(column: str) -> Column:
    return F.transform(F.filter(column, lambda x: x.contains("-")), lambda x: F.split_part(x, F.lit("-"), F.lit(1)))


def validation_scores(lists: DataFrame, reliability: Column | None = None, model: Column | None = None, key: str = "id") -> DataFrame:
    """Format, consistency and completeness with the weighted total and its grade.

    The two model scores are input columns; 0 when there is no model.
    """
    reliability = F.lit(0.0) if reliability is None else reliability
    model = F.lit(0.0) if model is None else model
    format_score = sum(((F.size(F.filter(col, check)) > 0).cast("int") for _, col, check in _CHECKS), F.lit(0)) / F.lit(4.0)
    city = is_filled("name") & is_filled("address") & F.col("name").contains("서울") & ~F.col("address").contains("서울")
    pa, fa = _areas("phones"), _areas("faxes")
    apart = (F.size(pa) > 0) & (F.size(fa) > 0) & ~F.arrays_overlap(pa, fa)
    consistency = (F.when(city, 0.8).otherwise(1.0) + F.when(apart, 0.7).otherwise(1.0)) / 2
    required = is_filled("name").cast("int") + (F.size("phones") > 0).cast("int") + is_filled("address").cast("int")
    optional = sum(((F.size(x) > 0).cast("int") for x in ("faxes", "emails", "websites")), F.lit(0))
    completeness = required / F.lit(3.0) * 0.8 + optional / F.lit(3.0) * 0.2
    scored = lists.select(key, format_score.alias("f"), consistency.alias("s"), completeness.alias("m"), reliability.alias("r"), model.alias("c"))
    total = F.round(F.col("f") * 0.25 + F.col("s") * 0.2 + F.col("m") * 0.25 + F.col("r") * 0.2 + F.col("c") * 0.1, 6)
    return scored.select(key, F.round("f", 6).alias("format_score"), F.round("s", 6).alias("consistency_score"),
                         F.round("m", 6).alias("completeness_score"), total.alias("overall_score"), S.grade_by_score(total).alias("grade"))


def overall_confidence(orgs: DataFrame, key: str = "id") -> DataFrame:
    """Sum of the valid confidences over all present values; mean of the stage scores."""
    scored = orgs.select(key, P.confidence("phone").alias("p"), P.confidence("fax").alias("f"), W.email_confidence("email").alias("e"),
                         *[F.col(c).isNotNull().alias(n) for c, n in (("phone", "hp"), ("fax", "hf"), ("email", "he"))])
    total = sum((F.when(F.col(n), F.col(c)).otherwise(0.0) for c, n in (("p", "hp"), ("f", "hf"), ("e", "he"))), F.lit(0.0))
    count = F.col("hp").cast("int") + F.col("hf").cast("int") + F.col("he").cast("int")
    return scored.select(key, F.round(F.when(count > 0, total / count).otherwise(0.0), 6).alias("confidence"),
                         F.round((F.col("p") + F.col("f") + F.col("e")) / 3, 6).alias("stage_mean"))


def adjust_confidence(scores: Column, verdicts: Column) -> Column:
    """x1.1 for a valid field, x0.6 for an invalid one, kept within 0..1."""

    def change(field: Column, value: Column) -> Column:
        verdict = F.try_element_at(verdicts, field)
        factor = F.when(verdict == "valid", 1.1).when(verdict == "invalid", 0.6).otherwise(1.0)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value * factor))

    return F.transform_values(scores, change)


def record_errors(last_year: int, min_name: int = 2, max_name: int = 100) -> Column:
    """Codes of the record rules a row breaks."""
    home = F.trim("homepage").rlike("^https?://.+")
    return F.array_compact(F.array(
        F.when(is_blank("name"), F.lit("name_required")),
        F.when(is_filled("email") & ~W.email_valid("email", "strict"), F.lit("email_format")),
        F.when(~P.valid_loose("phone"), F.lit("phone_format")),
        F.when(is_filled("homepage") & ~home, F.lit("homepage_format")),
        F.when(~F.col("founding_year").between(1800, last_year), F.lit("founding_year_range")),
        F.when(~F.length(F.trim("name")).between(min_name, max_name), F.lit("name_length"))))


def user_errors() -> Column:
    """Codes of the account rules a user row breaks."""
    return F.array_compact(F.array(
        F.when(is_blank("username"), F.lit("username_required")), F.when(is_blank("full_name"), F.lit("full_name_required")),
        F.when(is_filled("email") & ~W.email_valid("email", "strict"), F.lit("email_format")),
        F.when(~P.valid_loose("phone"), F.lit("phone_format"))))


def clean_text(text: Column | str) -> Column:
    """Single spaces; only word characters, Hangul, dots and dashes stay."""
    one = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.coalesce(F.trim(F.regexp_replace(one, r"(?U)[^\w\s가-힣.-]", "")), F.lit(""))


def coerce_dates(df: DataFrame, dates: Mapping[str, str], json: Sequence[str]) -> DataFrame:
    """ISO text to dates or timestamps (NULL when broken); broken JSON becomes {}."""
    out = df
    for column, kind in dates.items():
        out = out.withColumn(column, F.col(column).try_cast(kind))
    for column in json:
        parsed = F.try_parse_json(column)
        out = out.withColumn(column, F.when(parsed.isNull(), "{}").otherwise(F.col(column)))
    return out
