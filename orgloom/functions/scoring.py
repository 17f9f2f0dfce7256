"""Grades, scores and confidences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .blank import has_text, is_filled
from . import fixed_values as V


def completeness(fields: list[str] = V.CONTACT_FIELDS) -> Column:
    """Percent of the fields with text, rounded to a whole number."""
    n = reduce(lambda a, b: a + b, [has_text(f).cast("int") for f in fields])
    return F.floor(n * F.lit(100.0) / len(fields) + F.lit(0.5)).cast("int")


def field_share(fields: list[str]) -> Column:
    """Share (0..1) of the fields that are filled."""
    n = reduce(lambda a, b: a + b, [is_filled(f).cast("int") for f in fields])
    return n / F.lit(float(len(fields)))


def grade_by_fields(mobile: Column | None = None) -> Column:
    """A needs all six groups, then B..E by what is left, F for the rest."""
    base = is_filled("name") & is_filled("address")
    phone, fax, home, mail = (is_filled(f) for f in ("phone", "fax", "homepage", "email"))
    mob = is_filled(mobile) if mobile is not None else F.lit(False)
    return (
        F.when(base & phone & fax & home & mail & mob, "A")
        .when(base & phone & fax & home, "B")
        .when(base & phone & fax, "C")
        .when(base & phone & home, "D")
        .when(base & phone, "E")
        .otherwise("F")
    )


def points(phone: Column, fax: Column, homepage: Column, email: Column, content: Column) -> Column:
    """30 + 20 + 25 + 15 + 10 for the groups that are present."""
    return sum((c.cast("int") * w for c, w in
                ((phone, 30), (fax, 20), (homepage, 25), (email, 15), (content, 10))), F.lit(0))


def grade_by_points(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 70, "B").when(score >= 50, "C")
        .when(score >= 30, "D").when(score >= 10, "E").otherwise("F")
    )


def grade_by_score(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C")
        .when(score >= 0.6, "D").otherwise("F")
    )


def grade_value(grade: Column) -> Column:
    """A 1.0 down to F 0.0 in steps of .2; unknown grades are 0."""
    return F.coalesce(*[F.when(grade == g, F.lit(v)) for g, v in
                        zip("ABCDEF", (1.0, 0.8, 0.6, 0.4, 0.2, 0.0))], F.lit(0.0))


def grade_of_json(crawling_data: Column | str = "crawling_data") -> Column:
    return F.get_json_object(crawling_data, "$.data_quality_grade")


def score_of_json(crawling_data: Column | str = "crawling_data") -> Column:
    return F.get_json_object(crawling_data, "$.validation_score").try_cast("double")


def priority_rank(priority: Column, missing_rank: int = 3) -> Column:
    """HIGH 1, MEDIUM 2, LOW 3, anything else ``missing_rank``."""
    return F.when(priority == "HIGH", 1).when(priority == "MEDIUM", 2).when(priority == "LOW", 3).otherwise(missing_rank)


def enrichment_priority(priority: Column, missing: Column, updated: Column, as_of: Column) -> Column:
    points_ = F.when(priority == "HIGH", 3.0).when(priority == "MEDIUM", 2.0).otherwise(1.0)
    # whole days elapsed, so 30 days and some hours is not yet "more than 30 days"
    stale = F.when(updated < as_of - F.expr("INTERVAL 30 DAYS") - F.expr("INTERVAL 1 DAY") + F.expr("INTERVAL 1 MICROSECOND"), 1.0).otherwise(0.0)
    score = points_ + missing * F.lit(0.5) + stale
    return F.when(score >= 5, "URGENT").when(score >= 3, "HIGH").when(score >= 2, "MEDIUM").otherwise("LOW")


def extraction_confidence(items: Column, model: Column) -> Column:
    """0 without items, else (0.6 + model + up to 0.3 by count) / 2, at most 1."""
    bonus = F.least(F.lit(0.3), items * F.lit(0.05))
    return F.when(items == 0, 0.0).otherwise(F.least(F.lit(1.0), (F.lit(0.6) + model + bonus) / 2))


def org_type(text: Column) -> Column:
    """Type with the most keywords in the text, first listed on ties."""
    low = F.lower(text)
    scored = F.array(*[
        F.struct(
            reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words]).alias("score"),
            F.lit(-i).alias("order"),
            F.lit(name).alias("name"),
        )
        for i, (name, words) in enumerate(V.ORG_TYPE_WORDS)
    ])
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["name"]).otherwise(V.OTHER)


def text_category(text: Column) -> Column:
    """First keyword group with a hit, else the rest label."""
    from .address import contains_any

    low = F.lower(text)
    return F.coalesce(*[F.when(contains_any(low, words), F.lit(name)) for name, words in V.TEXT_CATEGORY_WORDS],
                      F.lit(V.OTHER))


def small_organization(name: Column, category: Column, policy: str = "settings") -> Column:
    from .address import contains_any

    words = V.SMALL_ORG_WORDS if policy == "settings" else V.SMALL_ORG_WORDS_SEARCH
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(category, F.lit(""))))
    hit = contains_any(text, words)
    return hit if policy == "settings" else hit | (F.length(name) <= 10)


def health_status() -> Column:
    worst = F.greatest("cpu_usage", "memory_usage", "disk_usage")
    return (
        F.when(worst > 95, "critical")
        .when((worst > 80) | (F.col("error_count") > 10) | (F.col("response_time") > 5), "warning")
        .otherwise("healthy")
    )
