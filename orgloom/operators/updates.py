"""New versions of the organization table after results come in.

Each job is a left join on the unique id (or a union), so it can be run again on
its own output with the same result and used as the body of a stream's batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orgloom.functions import phone as P
from orgloom.functions import web as W
from orgloom.functions.blank import has_text, is_blank, is_filled, is_missing, missing_fields, strip

WRITTEN = ("phone", "fax", "email", "homepage")


def _joined(orgs: DataFrame, found: DataFrame, fields: Sequence[str], extra: Sequence[str] = (), key: str = "id") -> DataFrame:
    new = found.select(key, *[F.col(f).alias(f"new_{f}") for f in (*fields, *extra)], F.lit(True).alias("hit"))
    return orgs.join(new, key, "left")


def _finish(df: DataFrame, orgs: DataFrame, *more: str) -> DataFrame:
    return df.select(*orgs.columns, *more)


def _stamp(hit: Column) -> dict[str, Column]:
    return {
        "ai_crawled": F.col("ai_crawled") | hit,
        "last_crawled_at": F.when(hit, F.col("new_found_at")).otherwise(F.col("last_crawled_at")),
        "updated_at": F.when(hit, F.col("new_found_at")).otherwise(F.col("updated_at")),
    }


def upsert_coalesce(orgs: DataFrame, found: DataFrame, fields: Sequence[str] = WRITTEN) -> DataFrame:
    """Non-empty new values win; crawl flag and times are stamped."""
    j = _joined(orgs, found, fields, ["found_at"])
    hit = F.coalesce("hit", F.lit(False))
    out = j.withColumns({f: F.coalesce(F.nullif(f"new_{f}", F.lit("")), F.col(f)) for f in fields} | _stamp(hit))
    return _finish(out, orgs)


def upsert_overwrite(orgs: DataFrame, found: DataFrame, fields: Sequence[str] = WRITTEN) -> DataFrame:
    """Matched rows take every new value, blanks included."""
    j = _joined(orgs, found, fields, ["found_at"])
    hit = F.coalesce("hit", F.lit(False))
    stamp = _stamp(hit)
    stamp.pop("updated_at")
    return _finish(j.withColumns({f: F.when(hit, F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields} | stamp), orgs)


def upsert_validated(orgs: DataFrame, found: DataFrame) -> DataFrame:
    """Only values that pass their format check are written; changed fields are listed."""
    j = _joined(orgs, found, WRITTEN, ["found_at"])
    t = {f: strip(f"new_{f}") for f in WRITTEN}
    ok = {
        "homepage": t["homepage"].startswith("http://") | t["homepage"].startswith("https://"),
        "phone": P.valid_for_save(t["phone"]), "fax": P.valid_for_save(t["fax"]),
        "email": W.email_valid(t["email"], "strict"),
    }
    take = {f: F.coalesce(has_text(f"new_{f}") & ok[f], F.lit(False)) for f in WRITTEN}
    out = j.withColumn("changes", F.array_compact(F.array(*[F.when(take[f], F.lit(f)) for f in ("homepage", "phone", "fax", "email")])))
    hit = F.coalesce("hit", F.lit(False))
    stamp = _stamp(hit)
    stamp.pop("updated_at")
    return _finish(out.withColumns({f: F.when(take[f], t[f]).otherwise(F.col(f)) for f in WRITTEN} | stamp), orgs, "changes")


def upsert_by_name(orgs: DataFrame, results: DataFrame, fields: Sequence[str] = WRITTEN) -> DataFrame:
    """Newest result per name updates the row of that name with its non-null values; others insert."""
    from .matching import results_to_orgs

    resolved = results_to_orgs(results, orgs)
    updates = resolved.filter("action = 'update'").select(
        F.col("org_id").alias("id"), *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("hit"))
    kept = orgs.join(updates, "id", "left").select(
        "id", "name", *[F.coalesce(f"new_{f}", f).alias(f) for f in fields],
        (F.col("ai_crawled") | F.coalesce("hit", F.lit(False))).alias("ai_crawled"))
    added = resolved.filter((F.col("action") == "insert") & is_filled("name")).select(
        F.lit(None).cast("long").alias("id"), "name", *fields, F.lit(True).alias("ai_crawled"))
    return kept.unionByName(added)


def fill_blank_only(orgs: DataFrame, found: DataFrame, fields: Sequence[str] = WRITTEN) -> DataFrame:
    """Only fields that are empty now take a value; the filled ones are listed."""
    j = _joined(orgs, found, fields)
    take = {f: F.coalesce(is_missing(f) & is_filled(f"new_{f}"), F.lit(False)) for f in fields}
    out = j.withColumn("updated_fields", F.array_compact(F.array(*[F.when(take[f], F.lit(f)) for f in fields])))
    return _finish(out.withColumns({f: F.when(take[f], F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields}), orgs, "updated_fields")


def fill_phone_from_list(orgs: DataFrame, found: DataFrame) -> DataFrame:
    """Named rows without a phone take the first found number; the others are kept beside it.

    ``found``: id and ``phones`` (array).
    """
    j = orgs.join(found.select("id", F.col("phones").alias("__p")), "id", "left")
    take = F.coalesce(has_text("name") & is_blank("phone") & (F.size("__p") > 0), F.lit(False))
    return j.withColumns({
        "phone": F.when(take, F.try_element_at("__p", F.lit(1))).otherwise(F.col("phone")),
        "additional_phones": F.when(take, F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0)))).otherwise(F.array().cast("array<string>")),
    }).select(*orgs.columns, "additional_phones")


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    inner = F.to_json(F.array(text))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def merge_json(stored: Column, added: Column) -> Column:
    """Stored JSON object with the new keys laid over it, every value as it was written; what is no JSON object is replaced.

    ``added`` is map<string,string>; its values are strings.
    """
    typed = F.try_variant_get(F.try_parse_json(stored), "$", "map<string,variant>")
    # numbers, objects, lists as JSON text, strings without their quotes
    texts = F.when(typed.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.from_json(stored, "map<string,string>"))

    def raw(k: Column, v: Column) -> Column:
        return F.when(v.isNull(), "null").when(F.schema_of_variant(F.element_at(typed, k)) == "STRING", _quoted(v)).otherwise(v)

    keep = F.map_filter(F.transform_values(texts, raw), lambda k, v: ~F.map_contains_key(added, k))
    new = F.transform_values(added, lambda k, v: F.when(v.isNull(), "null").otherwise(_quoted(v)))
    items = F.transform(F.map_entries(F.map_concat(keep, new)), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))


def patch_fields(rows: DataFrame, patch: DataFrame, allowed: Sequence[str], key: str = "id", at: Column | None = None) -> DataFrame:
    """Supplied non-null fields from the allow-list replace the stored ones."""
    j = _joined(rows, patch, allowed, (), key)
    changes: dict[str, Column] = {f: F.coalesce(f"new_{f}", f) for f in allowed}
    if at is not None:
        changes["updated_at"] = F.when(F.col("hit"), at).otherwise(F.col("updated_at"))
    return _finish(j.withColumns(changes), rows)


def soft_delete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Listed active rows become inactive; ``deleted`` tells which."""
    marks = ids.select(key).distinct().withColumn("__d", F.lit(True))
    j = rows.join(marks, key, "left").withColumn("deleted", F.coalesce(F.col("__d") & F.col("is_active"), F.lit(False)))
    return j.withColumn("is_active", F.col("is_active") & ~F.col("deleted")).select(*rows.columns, "deleted")


def deletion_activities(deleted: DataFrame, at: Column) -> DataFrame:
    """One note per organization that was deleted."""
    return deleted.filter("deleted").select(
        F.lit(None).cast("long").alias("id"), F.col("id").alias("organization_id"), F.lit("NOTE").alias("activity_type"),
        F.lit("deleted").alias("subject"), at.alias("created_at"), F.lit(True).alias("is_completed"))


def insert_activities(activities: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Append rows, with defaults for what is not given."""
    given = set(new.columns)
    defaults = {"id": F.lit(None).cast("long"), "activity_type": F.lit("NOTE"), "subject": F.lit(""), "created_at": at, "is_completed": F.lit(False)}
    filled = new.select(*[
        (F.coalesce(F.col(c), defaults[c]) if c in given and c in defaults else F.col(c) if c in given else defaults[c]).alias(c)
        for c in activities.columns])
    return activities.unionByName(filled)


def enrichment_result(orgs: DataFrame, found: DataFrame, fields: Sequence[str] = WRITTEN) -> DataFrame:
    """Per organization: fields found, still missing and whether anything was found."""
    j = _joined(orgs, found, fields, ["processing_time"])
    wanted = missing_fields(fields)
    got = F.array_compact(F.array(*[F.when(is_blank(f) & has_text(f"new_{f}"), F.lit(f)) for f in fields]))
    return j.filter("hit").select(
        "id", got.alias("found"), F.array_except(wanted, got).alias("still_missing"), (F.size(got) > 0).alias("success"),
        F.col("new_processing_time").alias("processing_time"))


def enrichment_history_rows(orgs: DataFrame) -> DataFrame:
    """Date, source and found fields out of the stored JSON (rows without JSON give none)."""
    j = "crawling_data"
    return orgs.filter(is_filled(j)).select(
        "id", F.get_json_object(j, "$.last_enrichment").alias("enrichment_date"),
        F.get_json_object(j, "$.enrichment_source").alias("source"),
        F.coalesce(F.array_join(F.from_json(F.get_json_object(j, "$.found_fields"), "array<string>"), ","), F.lit("")).alias("found_fields"))


def supplement_low_confidence(orgs: DataFrame, found: DataFrame, confidence: dict[str, Column], threshold: float = 0.7) -> DataFrame:
    """Blank or low-confidence phone and fax take the candidate, with its source and confidence."""
    j = _joined(orgs, found, list(confidence))
    out: dict[str, Column] = {}
    for f, conf in confidence.items():
        take = F.coalesce((is_missing(f) | (conf < threshold)) & is_filled(f"new_{f}"), F.lit(False))
        out[f] = F.when(take, F.col(f"new_{f}")).otherwise(F.col(f))
        out[f"{f}_source"] = F.when(take, "supplement")
        out[f"{f}_confidence"] = F.when(take, F.lit(0.8)).otherwise(F.round(conf, 6))
    return j.withColumns(out).select(*orgs.columns, *[f"{f}_{x}" for f in confidence for x in ("source", "confidence")])


def merge_contact_pages(orgs: DataFrame, items: DataFrame) -> DataFrame:
    """First phone, fax (other than the phone) and e-mail from contact pages, where the record has none.

    ``items``: id, page_no, pos, kind, value, keyword. The first phone and e-mail
    and the first two distinct fax values per organization are found by ordered
    minimum aggregates, so a record with endless pages is never gathered.
    """
    first = F.min(F.struct("page_no", "pos", "value", "keyword"))
    firsts = items.filter("kind <> 'fax'").groupBy("id", "kind").agg(first.alias("m"))
    one = firsts.groupBy("id").agg(
        F.max(F.when(F.col("kind") == "phone", F.col("m"))).alias("p1"), F.max(F.when(F.col("kind") == "email", F.col("m"))).alias("e1"))
    current = orgs.join(one, "id", "left")
    # the phone known when a page is read: the stored one, or the first found so far
    known = F.when(is_filled("phone"), F.col("phone")).when(F.col("p1.page_no") <= F.col("page_no"), F.col("p1.value")).otherwise("")
    fax = (
        items.filter("kind = 'fax'").join(current.select("id", "phone", "p1"), "id").filter(F.col("value") != known)
        .groupBy("id").agg(first.alias("f1")))
    j = current.join(fax, "id", "left")
    out = []
    for f, p in (("phone", "p1"), ("fax", "f1"), ("email", "e1")):
        take = is_missing(f) & F.col(p).isNotNull()
        out += [F.when(take, F.col(f"{p}.value")).otherwise(F.col(f)).alias(f),
                F.when(take, F.concat(F.lit("contact_page_"), F.col(f"{p}.keyword"))).alias(f"{f}_source")]
    return j.select("id", *out)


def combine_result(orgs: DataFrame, found: DataFrame, fields: Sequence[str] = WRITTEN) -> DataFrame:
    """Extracted values over the stored ones plus a processing record."""
    j = _joined(orgs, found, fields, ["processing_time"])
    meta = F.to_json(F.struct(
        F.coalesce("new_processing_time", F.lit(0.0)).alias("processing_time"),
        F.when(F.col("hit"), "completed").otherwise("pending").alias("final_stage"),
        F.coalesce("hit", F.lit(False)).alias("enhanced")))
    return j.withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).select(*orgs.columns, meta.alias("processing_metadata"))
