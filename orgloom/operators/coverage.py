"""Coverage, validity, distributions and quality reports.

Counts are taken in one pass with conditional aggregates; per-field rows are
then unfolded from the single aggregated row, so the data is never multiplied
by the number of fields before it is reduced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orgloom.functions import fixed_values as V
from orgloom.functions import phone as P
from orgloom.functions import scoring as S
from orgloom.functions import web as W
from orgloom.functions.blank import any_missing, has_text, is_filled, missing_count, percent

from .validation import fax_checks

COVERED = ("phone", "fax", "email", "homepage")


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def _rows(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One output row per struct of an already aggregated (small) frame."""
    return df.select(F.inline(F.array(*structs)))


def complete_contact() -> Column:
    return is_filled("phone") & is_filled("fax") & is_filled("email")


def contact_coverage(active: DataFrame) -> DataFrame:
    return contact_rates(active.agg(
        F.count("*").alias("total"),
        *[_n(is_filled(f)).alias(f"{f}_count") for f in COVERED],
        _n(complete_contact()).alias("complete_count"),
    ))


def contact_rates(counts: DataFrame) -> DataFrame:
    """Rates beside the counts of :func:`contact_coverage`."""
    return counts.select(
        "*", (F.col("total") - F.col("complete_count")).alias("incomplete_count"),
        *[percent(F.col(f"{f}_count"), F.col("total")).alias(f"{f}_rate") for f in COVERED],
        percent(F.col("complete_count"), F.col("total")).alias("completeness_rate"),
    )


def category_coverage(active: DataFrame) -> DataFrame:
    return category_rates(active.groupBy("category").agg(
        F.count("*").alias("total"), *[_n(is_filled(f)).alias(f"{f}_count") for f in COVERED]))


def category_rates(counts: DataFrame) -> DataFrame:
    """Rates beside the counts of :func:`category_coverage`, largest category first."""
    return counts.select(
        "*", *[percent(F.col(f"{f}_count"), F.col("total")).alias(f"{f}_coverage") for f in COVERED]
    ).orderBy(F.desc("total"), F.asc_nulls_last("category"))


def category_ranking(active: DataFrame) -> DataFrame:
    """Mean of the four rounded coverages per category, best first."""
    cov = category_coverage(active)
    mean = sum((F.col(f"{f}_coverage") for f in COVERED[1:]), F.col(f"{COVERED[0]}_coverage")) / 4
    return cov.select(
        "category", F.col("total").alias("total_organizations"), F.round(mean, 1).alias("average_coverage"),
        *[f"{f}_coverage" for f in COVERED],
    ).orderBy(F.desc("average_coverage"), F.asc_nulls_last("category"))


def category_csv(active: DataFrame) -> DataFrame:
    """The six export columns of the category table."""
    return category_coverage(active).select(
        F.col("category").alias("Category"), F.col("total").alias("Total"),
        *[F.col(f"{f}_coverage").alias(f"{f.capitalize()}_Coverage") for f in COVERED])


def phone_validity(active: DataFrame) -> DataFrame:
    """Valid over filled numbers per column and per failing rule."""
    numbers = active.select(F.inline(F.array(
        F.struct(F.lit("phone").alias("kind"), F.col("phone").alias("number")),
        F.struct(F.lit("fax").alias("kind"), F.col("fax").alias("number")),
    ))).filter(is_filled("number"))
    reasons = numbers.groupBy("kind", P.invalid_reason("number").alias("reason")).agg(F.count("*").alias("n"))
    # at most 2 kinds x 5 reasons remain here
    per_kind = Window.partitionBy("kind")
    filled = F.sum("n").over(per_kind)
    valid = F.sum(F.when(F.col("reason") == "valid", F.col("n")).otherwise(0)).over(per_kind)
    return reasons.select("kind", "reason", "n", filled.alias("filled"), percent(valid, filled).alias("validity_rate"))


def area_distribution(active: DataFrame, top: int = 20) -> DataFrame:
    """Valid phones and faxes per area code, largest first."""
    both = active.select(F.inline(F.array(
        F.struct(F.lit(1).alias("p"), F.lit(0).alias("f"), F.col("phone").alias("number")),
        F.struct(F.lit(0).alias("p"), F.lit(1).alias("f"), F.col("fax").alias("number")),
    ))).filter(P.is_valid("number"))
    code = P.area_code(P.digits("number")).alias("area_code")
    return (
        both.groupBy(code)
        .agg(F.count("*").alias("total_contacts"), F.sum("p").alias("phone_count"), F.sum("f").alias("fax_count"))
        .withColumn("area_name", P.area_name(F.col("area_code")))
        .orderBy(F.desc("total_contacts"), "area_code").limit(top)
    )


def domain_counts(emails: DataFrame, column: str = "email") -> DataFrame:
    return (
        emails.select(W.email_domain(F.col(column)).alias("domain"))
        .filter(is_filled("domain")).groupBy("domain").agg(F.count("*").alias("n"))
    )


def email_domain_top(emails: DataFrame, column: str = "email", top: int = 20) -> DataFrame:
    """Most used domains next to the number of different ones."""
    counts = domain_counts(emails, column)
    # counting on n keeps the subquery's aggregate equal to the main one, so its shuffle is reused
    distinct = counts.select(F.count_if(F.col("n") > 0)).scalar()
    return counts.orderBy(F.desc("n"), "domain").limit(top).withColumn("total_unique_domains", distinct)


def email_domain_classes(emails: DataFrame, column: str = "email", top: int | None = None) -> DataFrame:
    """Class totals over all domains, or the ``top`` most used ones."""
    best = domain_counts(emails, column)
    if top is not None:
        best = best.orderBy(F.desc("n"), "domain").limit(top)
    return best.groupBy(W.email_class(F.col("domain")).alias("email_class")).agg(F.sum("n").alias("n"))


def enrichment_history(active: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Updates per day in the window, with their total and mean per active day."""
    daily = (
        active.filter(F.col("updated_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
        .groupBy(F.to_date("updated_at").alias("day")).agg(F.count("*").alias("updated_count"))
    )
    # one row per day of the window from here on
    every = Window.partitionBy(F.lit(0))
    return daily.select(
        F.col("day").cast("string").alias("day"), "updated_count",
        F.sum("updated_count").over(every).alias("total_updates"),
        F.round(F.avg("updated_count").over(every), 1).alias("average_daily_updates"),
    )


def quality_counts(active: DataFrame) -> DataFrame:
    """Every count the report needs, in one pass."""
    return active.agg(
        F.count("*").alias("total"),
        *[_n(is_filled(f)).alias(f"{f}_count") for f in COVERED],
        _n(complete_contact()).alias("complete_count"),
        _n(P.is_valid("phone")).alias("valid_phones"),
        _n(P.is_valid("fax")).alias("valid_faxes"),
    )


def quality_report(active: DataFrame) -> DataFrame:
    """Scores (.4 coverage, .3 validity, .3 completeness) and the rules that ask for action."""
    return quality_of(quality_counts(active))


def quality_of(counts: DataFrame) -> DataFrame:
    """The report of the one row that :func:`quality_counts` gives."""
    c = F.col
    rates = counts.select(
        "total", *[percent(c(f"{f}_count"), c("total")).alias(f"{f}_rate") for f in COVERED],
        percent(c("valid_phones"), c("phone_count")).alias("phone_validity_rate"),
        percent(c("valid_faxes"), c("fax_count")).alias("fax_validity_rate"),
        percent(c("complete_count"), c("total")).alias("completeness_score"),
    )
    scored = rates.withColumns({
        "coverage": (c("phone_rate") + c("fax_rate") + c("email_rate") + c("homepage_rate")) / 4,
        "validity": (c("phone_validity_rate") + c("fax_validity_rate")) / 2,
    })
    return scored.select(
        "total", "phone_validity_rate", "fax_validity_rate", "completeness_score",
        F.round("coverage", 1).alias("coverage_score"), F.round("validity", 1).alias("validity_score"),
        F.round(c("coverage") * 0.4 + c("validity") * 0.3 + c("completeness_score") * 0.3, 1).alias("overall_score"),
        (c("phone_validity_rate") < 90).alias("needs_phone_cleanup"),
        (c("completeness_score") < 50).alias("needs_enrichment"),
        (c("email_rate") < 30).alias("needs_email_collection"),
    )


def quality_recommendations(report: DataFrame) -> DataFrame:
    """One row per rule that fired: priority, issue and the measured value."""
    rules = [
        ("needs_phone_cleanup", "high", "data_quality", "phone_validity_rate"),
        ("needs_enrichment", "medium", "data_coverage", "completeness_score"),
        ("needs_email_collection", "medium", "data_coverage", None),
    ]
    return _rows(report, [
        F.struct(F.col(flag).alias("fired"), F.lit(level).alias("priority"), F.lit(group).alias("category"),
                 F.lit(flag).alias("rule"), (F.col(value) if value else F.lit(None).cast("double")).alias("value"))
        for flag, level, group, value in rules
    ]).filter("fired").drop("fired")


def contact_statistics(active: DataFrame) -> DataFrame:
    """Per field: total, filled, missing and rate, then the overall row."""
    agg = active.agg(F.count("*").alias("total"), *[_n(is_filled(f)).alias(f) for f in V.CONTACT_FIELDS],
                     _n(any_missing()).alias("needing"))

    def row(name: str, filled: Column, total: Column) -> Column:
        return F.struct(
            F.lit(name).alias("field"), total.alias("total"), filled.alias("filled"), (total - filled).alias("missing"),
            F.round(percent(filled, total, None), 6).alias("completion_rate"))

    t = F.col("total")
    every = sum((F.col(f) for f in V.CONTACT_FIELDS[1:]), F.col(V.CONTACT_FIELDS[0]))
    return _rows(agg, [
        *[row(f, F.col(f), t) for f in V.CONTACT_FIELDS],
        row("all_fields", every, t * len(V.CONTACT_FIELDS)),
        row("complete_organizations", t - F.col("needing"), t),
    ])


def missing_histogram(active: DataFrame) -> DataFrame:
    return active.groupBy(missing_count().alias("missing_count")).agg(F.count("*").alias("org_count"))


def missing_field_distribution(candidates: DataFrame) -> DataFrame:
    """Per field how many candidates lack it; totals and mean alongside."""
    agg = candidates.agg(
        F.count("*").alias("n"), *[_n(~has_text(f)).alias(f) for f in V.CONTACT_FIELDS])
    total = sum((F.col(f) for f in V.CONTACT_FIELDS[1:]), F.col(V.CONTACT_FIELDS[0]))
    return _rows(agg.withColumn("t", total), [
        F.struct(F.lit(f).alias("field"), F.col(f).alias("org_count"), F.col("n").alias("total_candidates"),
                 F.col("t").alias("total_missing_fields"),
                 F.round(F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(0.0), 6).alias("avg_missing_per_org"))
        for f in V.CONTACT_FIELDS])


def dashboard_stats(orgs: DataFrame, users: DataFrame, activities: DataFrame, as_of: Column) -> DataFrame:
    """metric, key, value rows: active organizations and users, per status, recent activities."""
    o = orgs.filter("is_active").groupBy("contact_status").agg(F.count("*").alias("n"))
    per_status = o.select(F.lit("status").alias("metric"), F.col("contact_status").alias("key"), F.col("n").alias("value"))
    total = o.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value")).select(F.lit("organizations").alias("metric"), F.lit("").alias("key"), "value")
    people = users.filter("is_active").agg(F.count("*").alias("value")).select(F.lit("users").alias("metric"), F.lit("").alias("key"), "value")
    week = activities.filter(F.col("created_at") >= as_of - F.expr("INTERVAL 7 DAYS")).agg(
        F.count("*").alias("recent_activities"), _n(~F.col("is_completed")).alias("follow_ups_this_week"))
    recent = week.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.lit("").alias("key"), F.col(k).alias("value"))
        for k in ("recent_activities", "follow_ups_this_week")])))
    return per_status.unionByName(total).unionByName(people).unionByName(recent)


def type_source_distribution(active: DataFrame, source: str = "data_source") -> DataFrame:
    """Counts per type and per source with one scan."""
    return active.groupingSets([["type"], [source]], "type", source).agg(
        F.count("*").alias("n"), F.grouping("type").cast("int").alias("by_source")
    ).select(F.when(F.col("by_source") == 1, "source").otherwise("type").alias("dimension"),
             F.when(F.col("by_source") == 1, F.col(source)).otherwise(F.col("type")).alias("key"), "n")


def summary_stats(active: DataFrame) -> DataFrame:
    """Headline numbers."""
    agg = active.agg(F.count("*").alias("total_organizations"),
                     *[_n(is_filled(f)).alias(f) for f in V.CONTACT_FIELDS], _n(any_missing()).alias("needing"))
    every = sum((F.col(f) for f in V.CONTACT_FIELDS[1:]), F.col(V.CONTACT_FIELDS[0]))
    t = F.col("total_organizations")
    return agg.select(
        "total_organizations", F.round(percent(every, t * len(V.CONTACT_FIELDS), None), 6).alias("contact_completion_rate"),
        F.col("needing").alias("organizations_needing_enrichment"),
        (t - F.col("needing")).alias("complete_organizations"))


def role_statistics(users: DataFrame, viewer_role: str) -> DataFrame:
    """Users per role the viewer may see, highest level first."""
    visible = V.ROLES.get(viewer_role, V.ROLES[V.LOWEST_ROLE])["view"]
    return users.filter(F.col("role").isin(*visible)).groupBy("role").agg(
        F.count("*").alias("user_count"), _n(F.col("is_active")).alias("active_count"),
        _n(~F.col("is_active")).alias("inactive_count"),
    ).withColumn("level", role_level(F.col("role"))).orderBy(F.desc("level"), "role")


def role_level(role: Column) -> Column:
    return F.coalesce(*[F.when(role == r, F.lit(v["level"])) for r, v in V.ROLES.items()], F.lit(0))


def crawl_statistics(orgs: DataFrame) -> DataFrame:
    """Whole-table crawl counts (inactive rows included)."""
    return orgs.agg(
        F.count("*").alias("total_organizations"), _n(F.col("ai_crawled")).alias("ai_crawled_count"),
        *[_n(is_filled(f)).alias(f"{f}_count") for f in ("phone", "fax", "homepage", "email")])


def crawl_grades(orgs: DataFrame) -> DataFrame:
    return (
        orgs.filter(F.col("ai_crawled") & F.col("crawling_data").isNotNull())
        .groupBy(S.grade_of_json().alias("grade")).agg(F.count("*").alias("n")).filter(is_filled("grade")))


def crawl_recent_stats(orgs: DataFrame, as_of: Column) -> DataFrame:
    return orgs.filter(
        (F.col("last_crawled_at") >= as_of - F.expr("INTERVAL 1 DAY")) & F.col("crawling_data").isNotNull()
    ).agg(F.count("*").alias("recently_crawled"), F.round(F.avg(S.score_of_json()), 6).alias("avg_validation_score"))


def crawl_tracking_counts(active: DataFrame) -> DataFrame:
    return active.agg(
        F.count("*").alias("total"), _n(F.col("ai_crawled")).alias("crawled"),
        _n(~F.coalesce(F.col("ai_crawled"), F.lit(False))).alias("not_crawled"))


def job_progress(results: DataFrame) -> DataFrame:
    """Per job: total, processed, failed, percent done and whether it still runs."""
    agg = results.groupBy("job_id").agg(
        F.count("*").alias("total_count"), _n(F.col("status") == "COMPLETED").alias("processed_count"),
        _n(F.col("status") == "FAILED").alias("failed_count"), _n(F.col("status") == "PROCESSING").alias("open_count"))
    return agg.select(
        "job_id", "total_count", "processed_count", "failed_count",
        percent(F.col("processed_count"), F.col("total_count"), 6).alias("progress_percentage"),
        (F.col("open_count") > 0).alias("is_running"))


def enrichment_run_summary(results: DataFrame) -> DataFrame:
    """Totals of an enrichment run; ``found_*`` counts per field.

    ``results`` carries array column ``found`` and double ``processing_time``.
    """
    return results.agg(
        F.count("*").alias("processed_count"), _n(F.size("found") > 0).alias("successful_count"),
        F.coalesce(F.sum(F.size("found")), F.lit(0)).cast("long").alias("total_fields_found"),
        F.round(F.avg("processing_time"), 6).alias("avg_processing_time"),
        *[_n(F.array_contains("found", f)).alias(f"found_{f}") for f in V.CONTACT_FIELDS])


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Per source: processed, migrated, duplicate, failed and success rate."""
    wide = outcomes.groupBy("source").pivot("outcome", ["migrated", "duplicate", "failed"]).agg(F.count(F.lit(1))).na.fill(0)
    done = F.col("migrated") + F.col("duplicate") + F.col("failed")
    return wide.select("source", done.alias("processed"), "migrated", "duplicate", "failed",
                       percent(F.col("migrated"), done).alias("success_rate"))


def search_run_summary(results: DataFrame) -> DataFrame:
    agg = results.agg(
        F.count("*").alias("total_processed"), _n(F.col("status") != "FAILED").alias("successful_searches"),
        _n(F.col("status") == "FAILED").alias("failed_searches"), _n(is_filled("phone")).alias("contacts_found"))
    return agg.select("*", percent(F.col("successful_searches"), F.col("total_processed")).alias("success_rate"))


def extraction_result_counts(orgs: DataFrame) -> DataFrame:
    """Totals and shares after a fax extraction run."""
    ok = F.col("ok_strict")
    agg = fax_checks(orgs).agg(
        F.count("*").alias("total_count"), _n(is_filled("fax")).alias("fax_count"),
        _n(is_filled("homepage")).alias("homepage_count"), _n(is_filled("fax") & ok).alias("success_count"),
        _n(is_filled("fax") & ~ok).alias("duplicate_count"))
    return agg.select("*", percent(F.col("fax_count"), F.col("total_count")).alias("fax_rate"),
                      percent(F.col("homepage_count"), F.col("total_count")).alias("homepage_rate"))


def purge_invalid_fax(orgs: DataFrame) -> DataFrame:
    """Blank stored faxes that fail the relaxed check."""
    purged = has_text("fax") & ~F.col("ok_relaxed")
    return fax_checks(orgs).withColumn("fax_purged", purged).withColumn(
        "fax", F.when(F.col("fax_purged"), "").otherwise(F.col("fax"))).drop("ok_strict", "ok_relaxed")


def purge_counts(orgs: DataFrame) -> DataFrame:
    checked = fax_checks(orgs).select("fax", F.col("ok_relaxed").alias("ok"))
    return checked.agg(
        F.count("*").alias("total_count"), _n(is_filled("fax")).alias("fax_count"),
        _n(has_text("fax") & ~F.col("ok")).alias("invalid_fax_count"),
    ).withColumn("valid_fax_count", F.col("fax_count") - F.col("invalid_fax_count"))


def dataset_basic_stats(df: DataFrame) -> DataFrame:
    """Counts over all rows; each number of different values is an aggregate of its own, so no row is repeated."""
    unique = {f: df.select(F.nullif(c, F.lit("")).alias("v")).distinct().select(F.count("v")).scalar() for f, c in (("unique_names", "name"), ("unique_categories", "category"))}
    counts = df.agg(F.count("*").alias("total_records"), *[_n(is_filled(f)).alias(f"has_{f}") for f in ("homepage", "phone", "email")])
    return counts.select("total_records", *[v.alias(f) for f, v in unique.items()], *[f"has_{f}" for f in ("homepage", "phone", "email")])


def dataset_field_fill(df: DataFrame) -> DataFrame:
    """Fill count and rate of every column (text columns by trimmed content)."""
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    agg = df.agg(F.count("*").alias("__n"), *[
        _n(has_text(c) if c in texts else F.col(c).isNotNull()).alias(c) for c in df.columns])
    return _rows(agg, [
        F.struct(F.lit(c).alias("field"), F.col("__n").alias("total_count"), F.col(c).alias("non_empty_count"),
                 F.round(percent(F.col(c), F.col("__n"), None), 6).alias("fill_rate")) for c in df.columns])


def dataset_quality_metrics(df: DataFrame, required: Sequence[str] = ("name", "category"),
                            optional: Sequence[str] = ("phone", "fax", "email", "address")) -> DataFrame:
    agg = df.agg(F.count("*").alias("n"), *[_n(has_text(c)).alias(c) for c in (*required, *optional)])

    def mean(cols: Sequence[str]) -> Column:
        rates = [percent(F.col(c), F.col("n"), None) for c in cols]
        return sum(rates[1:], rates[0]) / len(cols)

    return agg.select(
        F.round(mean(required), 6).alias("required_fields_score"), F.round(mean(optional), 6).alias("optional_fields_score"),
        F.round(mean(required) * 0.7 + mean(optional) * 0.3, 6).alias("overall_score"))


def grade_distribution(graded: DataFrame) -> DataFrame:
    """Per grade: rows, mean confidence and contacts found."""
    return graded.groupBy("grade").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.sum("contacts").cast("long").alias("total_contacts"))


def file_quality_report(nested: DataFrame) -> DataFrame:
    """Category and total coverage over rows that hold parsed contact lists.

    Columns: category, phone, fax, homepage, phones, faxes, emails (arrays).
    Only the first number of a list is validated; e-mail comes from the list.
    """
    c = F.col
    joined = nested.select(
        "category", "homepage",
        F.coalesce(F.nullif("phone", F.lit("")), F.array_join("phones", ", ")).alias("phone"),
        F.coalesce(F.nullif("fax", F.lit("")), F.array_join("faxes", ", ")).alias("fax"),
        F.array_join("emails", ", ").alias("email"))

    def first(col: str) -> Column:
        return F.trim(F.split_part(c(col), F.lit(","), F.lit(1)))

    agg = joined.groupBy("category").agg(
        F.count("*").alias("total"), *[_n(is_filled(f)).alias(f"{f}_count") for f in COVERED],
        _n(complete_contact()).alias("complete_count"),
        _n(is_filled("phone") & P.is_valid(first("phone"))).alias("valid_phones"),
        _n(is_filled("fax") & P.is_valid(first("fax"))).alias("valid_faxes"))
    return agg.select("*", percent(c("phone_count"), c("total")).alias("phone_rate"),
                      percent(c("valid_phones"), c("phone_count")).alias("phone_validity"),
                      percent(c("complete_count"), c("total")).alias("completeness"))


def field_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, non-empty rows, fill percent and a sample (smallest value, 50 characters)."""
    agg = df.agg(
        F.count("*").alias("__n"), *[_n(has_text(c)).alias(f"n_{c}") for c in columns],
        *[F.min(c).alias(f"s_{c}") for c in columns])
    return _rows(agg, [
        F.struct(F.lit(c).alias("field"), F.col("__n").alias("total_records"), F.col(f"n_{c}").alias("non_empty_records"),
                 percent(F.col(f"n_{c}"), F.col("__n")).alias("fill_percent"),
                 F.coalesce(F.substring(F.col(f"s_{c}"), 1, 50), F.lit("")).alias("sample")) for c in columns])


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: filled rows, fill rate, distinct values and five smallest values.

    Values are reduced to distinct (column, value) counts first, so a hot value
    costs one row per map task and no set is ever built in memory.
    """
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.trim(F.col(c)).alias("value")) for c in columns])))
    counts = values.groupBy("field", "value").agg(F.count("*").alias("n"))
    text = F.coalesce(F.col("value"), F.lit("")) != ""
    stats = counts.groupBy("field").agg(
        F.sum("n").alias("total_rows"), F.coalesce(F.sum(F.when(text, F.col("n"))), F.lit(0)).alias("non_empty_count"),
        _n(text).alias("unique_values"))
    # the row_number filter is applied on the map side, five rows per field and task
    w = Window.partitionBy("field").orderBy("value")
    samples = counts.filter(text).withColumn("rn", F.row_number().over(w)).filter("rn <= 5").groupBy("field").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]), "|").alias("samples"))
    return stats.join(F.broadcast(samples), "field", "left").select(
        "field", "total_rows", "non_empty_count", percent(F.col("non_empty_count"), F.col("total_rows")).alias("fill_rate"),
        "unique_values", F.coalesce("samples", F.lit("")).alias("samples"))


def table_profile(df: DataFrame, distinct: Sequence[str], approx: bool = False) -> DataFrame:
    """Null count and percent of every column, distinct counts of the named ones.

    ``approx`` swaps exact distinct counts for sketches on very large tables.
    """
    nulls = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = _rows(nulls, [
        F.struct(F.lit(c).alias("field"), F.col("__n").alias("total_rows"), F.col(c).alias("null_count"),
                 percent(F.col(c), F.col("__n")).alias("null_percent")) for c in df.columns])
    if approx:
        one = df.agg(*[F.approx_count_distinct(c).alias(c) for c in distinct])
        uniq = _rows(one, [F.struct(F.lit(c).alias("field"), F.col(c).alias("unique_count")) for c in distinct])
    else:
        uniq = (
            df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in distinct])))
            .filter("value IS NOT NULL").distinct().groupBy("field").agg(F.count("*").alias("unique_count")))
    return rows.join(F.broadcast(uniq), "field", "left")
