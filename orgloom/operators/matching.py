"""Joins, deduplication and comparison of result sets.

Key joins reduce the looked-up side to one row per key first, so a hot key
never multiplies rows, and the probing side may be split by adaptive skew
handling. Nothing here is broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orgloom.functions import phone as P
from orgloom.functions.blank import first_text, has_text, is_blank, is_filled, strip

from .ranking import first_per_key, top_per_key


def name_key(c: Column | str = "name") -> Column:
    return F.lower(F.coalesce(strip(c), F.lit("")))


def merge_with_validation(primary: DataFrame, secondary: DataFrame, fields: Sequence[str], order: str = "seq") -> DataFrame:
    """Fill blank fields of the primary rows from the first secondary row of the same name."""
    second = first_per_key(secondary.withColumn("__key", name_key()), ["__key"], [F.asc(order)]).select(
        "__key", F.lit(True).alias("__hit"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = primary.withColumn("__key", name_key()).join(second, "__key", "left")
    merged = {f: F.when(is_blank(f) & F.col("__hit"), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(merged).withColumn(
        "merge_status", F.when(F.col("__hit"), "matched").otherwise("primary_only")
    ).select(*primary.columns, "merge_status")


def activities_of_org(activities: DataFrame, orgs: DataFrame, limit: int = 10) -> DataFrame:
    """Newest activities per organization with its name."""
    newest = top_per_key(activities, ["organization_id"], [F.desc("created_at"), F.desc("id")], limit)
    return newest.join(orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name")), "organization_id")


def results_to_orgs(results: DataFrame, orgs: DataFrame) -> DataFrame:
    """Newest result per name with the id it updates, or 'insert' when no name matches."""
    latest = first_per_key(results.withColumn("__key", name_key()), ["__key"], [F.desc("found_at"), F.desc("event_id")])
    known = orgs.groupBy(name_key().alias("__key")).agg(F.min("id").alias("org_id"))
    return latest.join(known, "__key", "left").withColumn(
        "action", F.when(F.col("org_id").isNotNull(), "update").otherwise("insert")).drop("__key")


def _last_text(column: str, order: str) -> Column:
    """Last non-empty value by order, as sequential updates would leave it."""
    return F.max_by(F.when(is_filled(column), F.col(column)), F.when(is_filled(column), F.col(order)))


def import_rows(stored: DataFrame, incoming: DataFrame, fields: Sequence[str] = ("phone", "fax", "homepage"), order: str = "seq") -> DataFrame:
    """Upsert by (name, address): non-empty values win, unknown pairs become new rows.

    Incoming rows are folded to one per pair before the join; of several stored
    rows with the same pair the one with the lowest id is updated.
    """
    keys = ["name", "address"]
    folded = incoming.groupBy(*keys).agg(*[_last_text(f, order).alias(f"new_{f}") for f in fields])
    target = stored.filter(F.col("name").isNotNull() & F.col("address").isNotNull()).groupBy(*keys).agg(F.min("id").alias("target_id"))
    matched = folded.join(target, keys, "left")
    updates = matched.filter("target_id IS NOT NULL").select(F.col("target_id").alias("id"), *[f"new_{f}" for f in fields], F.lit(True).alias("__u"))
    kept = stored.join(updates, "id", "left").select(
        "id", *keys, *[F.coalesce(f"new_{f}", f).alias(f) for f in fields],
        F.when(F.col("__u"), "updated").otherwise("unchanged").alias("outcome"))
    added = matched.filter("target_id IS NULL").select(
        F.lit(None).cast("long").alias("id"), *keys, *[F.col(f"new_{f}").alias(f) for f in fields], F.lit("inserted").alias("outcome"))
    return kept.unionByName(added)


def _pair_key() -> Column:
    """(branch, name, value): address when there is one, else phone."""
    name, address, phone = (F.coalesce(strip(x), F.lit("")) for x in ("name", "address", "phone"))
    return F.struct(F.when(address != "", "a").otherwise("p").alias("branch"), name.alias("name"),
                    F.when(address != "", address).otherwise(phone).alias("value"))


def dedupe_against_existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows not yet stored under (name, address), or (name, phone) without an address.

    Both branches share one key, so there is a single anti join; stored keys are
    made distinct on the map side first.
    """
    both = stored.select(F.inline(F.array(
        F.struct(F.lit("a").alias("branch"), F.col("name").alias("name"), F.col("address").alias("value")),
        F.struct(F.lit("p").alias("branch"), F.col("name").alias("name"), F.col("phone").alias("value"))))).dropna().distinct()
    keyed = incoming.withColumn("__k", _pair_key())
    cond = (F.col("__k.branch") == F.col("branch")) & (F.col("__k.name") == both["name"]) & (F.col("__k.value") == F.col("value"))
    return keyed.join(both, cond, "left_anti").drop("__k")


def dedupe_by_name(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return incoming.join(stored.select("name").distinct(), "name", "left_anti")


def dedupe_incoming(incoming: DataFrame, stored: DataFrame, order: str = "seq") -> DataFrame:
    """Sequential insert semantics: first row per key in the batch, then not stored yet."""
    keyed = incoming.withColumn("__b", _pair_key())
    first = first_per_key(keyed.filter(F.trim("name") != ""), ["__b"], [F.asc(order)]).drop("__b")
    return dedupe_against_existing(first, stored)


def combine_datasets(parts: Sequence[DataFrame], order: str = "seq") -> DataFrame:
    """Concatenate in order, then keep the first row per non-blank name."""
    out = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("source_no", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    keyed = out.withColumn("__key", name_key()).filter("__key <> ''")
    return first_per_key(keyed, ["__key"], [F.asc("source_no"), F.asc(order)]).drop("__key")


def dedupe_urls(pages: DataFrame, order: str = "page_id") -> DataFrame:
    return first_per_key(pages.filter(is_filled("url")), ["url"], [F.asc(order)])


def merge_contact_items(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct contact items per key, as rows: no list is ever gathered for a key."""
    return items.select(*keys, "kind", "value").distinct()


def contact_items(lists: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """One row per contact item: key, kind, position and value."""
    def items(kind: str, col: str) -> Column:
        return F.transform(col, lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("pos"), x.alias("value")))

    return lists.select(*keys, F.inline(F.concat(*[items(k, col) for k, col in columns.items()])))


def content_groups(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per content hash: copies and the first key."""
    return texts.groupBy(F.md5(text).alias("content_hash")).agg(F.count("*").alias("copies"), F.min(key).alias("first_key"))


def canonical_json(columns: Sequence[str]) -> Column:
    """Sorted-key JSON text with ', ' and ': ' between parts; strings escaped as JSON."""
    parts: list[Column] = []
    for i, c in enumerate(sorted(columns)):
        # to_json of a one-field struct is {"c":value}; take what follows the colon
        one = F.to_json(F.struct(F.col(c).alias(c)), {"ignoreNullFields": "false"})
        value = F.substr(one, F.lit(len(c) + 5), F.length(one) - (len(c) + 5))
        parts += [F.lit((", " if i else "{") + f'"{c}": '), value]
    return F.concat(*parts, F.lit("}"))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard of lower-cased whitespace tokens, 0 when either side is empty."""
    def tokens(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+"), lambda t: t != ""))

    ta, tb = tokens(a), tokens(b)
    union = F.size(F.array_union(ta, tb))
    return F.when(union > 0, F.size(F.array_intersect(ta, tb)) / union).otherwise(0.0)


def neighbour_similarity(turns: DataFrame) -> DataFrame:
    """Similarity of each turn to the next one of its conversation (an equi-join, not pairs)."""
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(token_similarity(F.col("text"), F.col("next_text")), 6).alias("similarity"))


def normalize_org_name(name: Column, suffix: str = "지역아동센터", ending: str = "센터") -> Column:
    """Trimmed name with the type suffix added when it is missing."""
    t = strip(name)
    return F.when(t.contains(suffix) | t.endswith(ending), t).otherwise(F.concat(t, F.lit(f" {suffix}")))


def org_name_groups(orgs: DataFrame) -> DataFrame:
    """Normalized name -> group size and first id."""
    return orgs.groupBy(F.lower(normalize_org_name(F.col("name"))).alias("block")).agg(
        F.count("*").alias("members"), F.min("id").alias("first_id"))


def write_back(orgs: DataFrame, found: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """Worker results written to their rows; blank values are ignored."""
    new = found.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    out = orgs.join(new, key, "left")
    return out.withColumns({f: F.when(has_text(f"__{f}"), strip(f"__{f}")).otherwise(F.col(f)) for f in fields}).select(*orgs.columns)


PICKED = ("phone", "fax", "email", "homepage")


def hybrid_pick(a: DataFrame, b: DataFrame) -> DataFrame:
    """Better grade is the base (ties: the second), blanks come from the other side."""
    base_a = F.coalesce(F.col("a.grade") < F.col("b.grade"), F.col("b.id").isNull())

    def pick(f: str) -> Column:
        x, y = F.col(f"a.{f}"), F.col(f"b.{f}")
        return F.when(base_a, first_text(x, y)).otherwise(first_text(y, x)).alias(f)

    j = a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id"), "full_outer")
    sa, sb = F.col("a.source"), F.col("b.source")
    return j.select(
        F.coalesce("a.id", "b.id").alias("id"), *[pick(f) for f in PICKED],
        F.when(base_a, F.col("a.grade")).otherwise(F.col("b.grade")).alias("grade"),
        F.greatest("a.confidence", "b.confidence").alias("confidence"),
        (F.coalesce("a.processing_time", F.lit(0.0)) + F.coalesce("b.processing_time", F.lit(0.0))).alias("processing_time"),
        F.when(base_a, F.concat_ws(",", sa, sb)).otherwise(F.concat_ws(",", sb, sa)).alias("sources"))


def fallback_pick(orgs: DataFrame, a: DataFrame, b: DataFrame, min_score: float = 0.7) -> DataFrame:
    """First source if its score is good enough, else the second, else what is stored with grade F."""
    need = orgs.filter(is_filled("name") & is_filled("address"))
    j = (need.alias("o").join(a.alias("a"), F.col("o.id") == F.col("a.id"), "left")
         .join(b.alias("b"), F.col("o.id") == F.col("b.id"), "left"))
    ok_a = F.coalesce(F.col("a.confidence") > min_score, F.lit(False))

    def row(side: str, grade: Column, source: Column) -> Column:
        return F.struct(*[F.col(f"{side}.{f}").alias(f) for f in PICKED], grade.alias("grade"), source.alias("source"))

    chosen = F.coalesce(
        F.when(ok_a, row("a", F.col("a.grade"), F.col("a.source"))),
        F.when(F.col("b.id").isNotNull(), row("b", F.col("b.grade"), F.col("b.source"))),
        row("o", F.lit("F"), F.lit("minimal")))
    return j.select(F.col("o.id").alias("id"), chosen.alias("c")).select("id", "c.*")


def compare_runs(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("AI", "Legacy")) -> DataFrame:
    """Winner per organization for speed, quality, completeness and confidence."""
    share = lambda s: sum((is_filled(f"{s}.{f}").cast("int") for f in PICKED), F.lit(0))
    win = lambda cond, alias: F.when(cond, names[0]).otherwise(names[1]).alias(alias)
    return a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id")).select(
        F.col("a.id").alias("id"),
        win(F.col("a.processing_time") < F.col("b.processing_time"), "speed_winner"),
        win(F.col("a.grade") < F.col("b.grade"), "quality_winner"),
        win(share("a") > share("b"), "completeness_winner"),
        win(F.col("a.confidence") > F.col("b.confidence"), "confidence_winner"))


def compare_original(orgs: DataFrame, extracted: DataFrame) -> DataFrame:
    """Notes where the stored phone or address was not found again; each row's score drops 10 % then."""
    j = orgs.select("id", "phone", "address").join(extracted, "id")
    phone_off = is_filled("phone") & ~F.array_contains("phones", F.col("phone"))
    address_off = is_filled("address") & ~F.exists("addresses", lambda a: a.contains(F.col("address")))
    notes = F.array_compact(F.array(F.when(phone_off, F.lit("phone_mismatch")), F.when(address_off, F.lit("address_unconfirmed"))))
    return j.select("id", notes.alias("notes"), F.round(
        F.when(F.size(notes) > 0, F.col("quality_score") * 0.9).otherwise(F.col("quality_score")), 6).alias("quality_score"))


def best_pair(phones: Column, faxes: Column) -> Column:
    """(phone, fax, relation): first exact match, else last similar pair, else the first pair.

    Both lists belong to one record, so the pairs stay inside the row.
    """
    pairs = F.flatten(F.transform(phones, lambda p, i: F.transform(faxes, lambda f, j: F.struct(
        F.when(P.relation(p, f) == "exact_match", 2).when(P.relation(p, f) == "similar_pattern", 1).otherwise(0).alias("level"),
        F.when(P.relation(p, f) == "similar_pattern", i * 100000 + j).otherwise(-(i * 100000 + j)).alias("order"),
        p.alias("phone"), f.alias("fax")))))
    best = F.array_max(pairs)
    name = F.when(best["level"] == 2, "exact_match").when(best["level"] == 1, "similar_pattern").when(best["level"] == 0, "different").otherwise("no_match")
    return F.struct(best["phone"].alias("phone"), best["fax"].alias("fax"), name.alias("relation"))


def page_batch_status(orgs: DataFrame, pages: DataFrame) -> DataFrame:
    """success / failed / no_homepage / error per organization and its fetched page."""
    text = pages.select("id", F.length("text").alias("n"), F.lit(True).alias("fetched"))
    has_home = is_filled("homepage") & F.coalesce(F.col("homepage").startswith("http"), F.lit(False))
    return orgs.join(text, "id", "left").select(
        "id", F.coalesce(F.col("fetched"), F.lit(False)).alias("homepage_parsed"),
        F.when(~has_home, "no_homepage").when(F.col("fetched").isNull(), "error").when(F.col("n") < 100, "failed").otherwise("success").alias("parsing_status"))
