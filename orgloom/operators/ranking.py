"""Filters, searches, queues and top-k picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from orgloom.functions import address as A
from orgloom.functions import fixed_values as V
from orgloom.functions import phone as P
from orgloom.functions import scoring as S
from orgloom.functions.blank import any_missing, has_text, is_filled, missing_count, missing_fields


def missing_any_contact(orgs: DataFrame) -> DataFrame:
    return orgs.filter(any_missing())


def search_text_columns(df: DataFrame, term: str, limit: int | None = None, order: str = "id") -> DataFrame:
    """Rows where any text column contains the term."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    found = df.filter(reduce(lambda a, b: a | b, [F.col(c).contains(term) for c in texts]))
    return found if limit is None else found.orderBy(order).limit(limit)


def search_filter(
    orgs: DataFrame,
    term: str | None = None,
    equals: Mapping[str, str] | None = None,
    missing_contacts: bool = False,
    created_after: str | None = None,
    created_before: str | None = None,
) -> DataFrame:
    """Optional conditions, all of them ANDed; LIKE characters in the term act as such."""
    out = orgs.filter("is_active")
    if term:
        pattern = f"%{term}%"
        out = out.filter(reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in ("name", "address", "email")]))
    for column, value in (equals or {}).items():
        out = out.filter(F.col(column) == value)
    if missing_contacts:
        out = out.filter(any_missing())
    if created_after:
        out = out.filter(F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{created_after}'"))
    if created_before:
        out = out.filter(F.col("created_at") <= F.expr(f"TIMESTAMP_NTZ '{created_before}'"))
    return out


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """One page; Spark keeps only offset + size rows per task before merging."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence[object] | None, size: int) -> DataFrame:
    """The ``size`` rows after a row with the values ``last`` of the ordering columns (None: from the start).

    ``order`` holds (column, descending); nulls come first and the columns together are unique. However deep
    the page, a task keeps ``size`` rows.
    """
    if last is not None:
        after, equal = F.lit(False), F.lit(True)
        for (name, descending), value in zip(order, last):
            c, v = F.col(name), F.lit(value)
            further = c.isNotNull() if value is None else F.coalesce((c < v) if descending else (c > v), F.lit(False))
            after, equal = after | (equal & further), equal & c.eqNullSafe(v)
        df = df.filter(after)
    return df.orderBy(*[F.desc_nulls_first(c) if d else F.asc_nulls_first(c) for c, d in order]).limit(size)


def page_totals(df: DataFrame, number: int, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total_count")).select(
        F.lit(number).alias("page"), F.lit(size).alias("per_page"), "total_count",
        F.ceil(F.col("total_count") / size).cast("long").alias("total_pages"))


def needs_recrawl(orgs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    stale = F.col("last_crawled_at") < as_of - F.expr(f"INTERVAL {days} DAYS")
    return orgs.filter(
        F.col("is_active") & (~F.col("ai_crawled") | F.col("last_crawled_at").isNull() | stale
                              | any_missing(("phone", "fax", "homepage", "email"))))


def recrawl_queue(orgs: DataFrame, as_of: Column) -> DataFrame:
    return needs_recrawl(orgs, as_of).withColumn("rank", S.priority_rank(F.col("priority"), 4)).orderBy(
        "rank", F.asc_nulls_first("last_crawled_at"), "id")


def recent(df: DataFrame, column: str, as_of: Column, interval: str) -> DataFrame:
    return df.filter(F.col(column) >= as_of - F.expr(f"INTERVAL {interval}"))


def recent_results(active: DataFrame, limit: int = 5) -> DataFrame:
    return active.select(
        "id", "name", "category", "phone", "email", "updated_at",
        (is_filled("phone") & is_filled("email")).alias("has_complete_contact"),
    ).orderBy(F.desc_nulls_first("updated_at"), "id").limit(limit)


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def missing_contacts_list(active: DataFrame, limit: int | None = None) -> DataFrame:
    """Most missing first, then priority as text, then newest; the list also sees blank text."""
    counted = missing_any_contact(active).withColumn("sql_missing", missing_count())
    top = _first(counted.orderBy(
        F.desc("sql_missing"), F.asc_nulls_last("priority"), F.desc_nulls_first("updated_at"), "id"), limit)
    return top.withColumn("missing_fields", missing_fields()).withColumn("missing_count", F.size("missing_fields"))


def enrichment_candidates(active: DataFrame, as_of: Column, limit: int | None = None, priority: str | None = None) -> DataFrame:
    rows = missing_any_contact(active)
    if priority:
        rows = rows.filter(F.col("priority") == priority)
    rank = F.when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2).otherwise(3)
    ranked = rows.withColumn("missing_count", missing_count()).withColumn("rank", rank)
    return (
        _first(ranked.orderBy("rank", F.desc("missing_count"), F.asc_nulls_last("updated_at"), "id"), limit)
        .withColumn("missing_fields", missing_fields())
        .withColumn("enrichment_priority", S.enrichment_priority(F.col("priority"), F.col("missing_count"), F.col("updated_at"), as_of)))


def enrichment_requests(active: DataFrame, limit: int | None = None) -> DataFrame:
    rank = F.when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2).otherwise(3)
    ranked = missing_any_contact(active).withColumn("rank", rank).orderBy("rank", F.desc_nulls_first("updated_at"), "id")
    return (
        _first(ranked, limit)
        .select("id", "name", missing_fields().alias("missing_fields")).filter(F.size("missing_fields") > 0))


def viewable_users(users: DataFrame, viewer_id: int, viewer_role: str) -> DataFrame:
    from .coverage import role_level

    visible = V.ROLES.get(viewer_role, V.ROLES[V.LOWEST_ROLE])["view"]
    rows = users.filter(F.col("role").isin(*visible)) if visible else users.filter(F.col("id") == viewer_id)
    return rows.withColumn("level", role_level(F.col("role"))).orderBy(F.desc("level"), F.desc("rank_value"), "id")


def permission_matrix(users: DataFrame) -> DataFrame:
    """Rights per (actor role, target role, own account) with the number of user pairs.

    Rights depend on the roles alone, so users are reduced to per-role counts
    before any pairing; unknown roles act with the lowest rights.
    """
    known = list(V.ROLES)
    role = F.when(F.col("role").isin(*known), F.col("role")).otherwise("(other)")
    per_role = users.groupBy(role.alias("actor_role")).agg(F.count("*").alias("actors"))  # five rows at most
    as_target = per_role.select(F.col("actor_role").alias("target_role"), F.col("actors").alias("targets"))
    acting = F.when(F.col("actor_role") == "(other)", V.LOWEST_ROLE).otherwise(F.col("actor_role"))

    def allowed(right: str) -> Column:
        return F.coalesce(*[F.when(acting == r, F.col("target_role").isin(*v[right]) if v[right] else F.lit(False))
                            for r, v in V.ROLES.items()])

    top = F.col("actor_role") == V.TOP_ROLE
    named = per_role.withColumn("target_role", F.explode(F.array(*[F.lit(r) for r in (*known, "(other)")])))
    pairs = named.join(F.broadcast(as_target), "target_role")
    cells = pairs.select("actor_role", "target_role", F.explode(F.array(F.lit(False), F.lit(True))).alias("same_id"), "actors", "targets")
    same_role = F.col("actor_role") == F.col("target_role")
    n = (F.when(F.col("same_id"), F.when(same_role, F.col("actors")).otherwise(0))
         .otherwise(F.col("actors") * F.col("targets") - F.when(same_role, F.col("actors")).otherwise(0)))
    return cells.withColumn("n_pairs", n).filter("n_pairs > 0").select(
        "actor_role", "target_role", "same_id", "n_pairs",
        (F.col("same_id") | top | allowed("view")).alias("can_view"),
        (F.col("same_id") | top | allowed("manage")).alias("can_manage"),
        (top | allowed("create")).alias("can_create"),
        F.when(top, F.col("target_role") != V.TOP_ROLE).otherwise(allowed("delete")).alias("can_delete"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key by the given order.

    The ``row_number() = 1`` filter runs before the shuffle too (one row per key
    and map task), so a key that holds a third of the rows stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def best_homepage(candidates: DataFrame) -> DataFrame:
    """Highest confidence candidate per organization, first on ties (org_id, seq, url, confidence)."""
    return first_per_key(candidates, ["org_id"], [F.desc("confidence"), F.asc("seq")])


def best_phone(phones: Column, address: Column) -> Column:
    """First number whose area fits the address, else the first."""
    fitting = F.filter(phones, lambda x: A.phone_fits_region(x, address))
    return F.coalesce(F.try_element_at(fitting, F.lit(1)), F.try_element_at(phones, F.lit(1)))


def best_fax(faxes: Column, phone: Column) -> Column:
    """First fax whose digits differ from the phone's, else NULL."""
    return F.try_element_at(F.filter(faxes, lambda x: ~P.same_digits(x, phone)), F.lit(1))


def first_valid_fax(faxes: Column, phone: Column, address: Column) -> Column:
    return F.try_element_at(F.filter(faxes, lambda x: F.coalesce(P.fax_valid_strict(x, phone, address), F.lit(False))), F.lit(1))


def search_query_plan(orgs: DataFrame) -> DataFrame:
    """Up to five search rows per organization with name and address."""
    name, region = F.col("name"), A.region_short("address")

    def step(text: Column, kind: str, priority: int, cond: Column | None = None) -> Column:
        s = F.struct(text.alias("query"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))
        return s if cond is None else F.when(cond, s)

    steps = F.array_compact(F.array(
        step(F.concat(name, F.lit(" 전화번호")), "phone", 1, is_filled("phone")),
        step(F.concat(name, F.lit(" 팩스번호")), "fax", 2),
        step(F.concat(region, F.lit(" "), name, F.lit(" 전화번호")), "phone", 3, region != ""),
        step(F.concat(name, F.lit(" 홈페이지")), "homepage", 4),
        step(F.concat(name, F.lit(" 이메일")), "email", 5)))
    return orgs.filter(is_filled("name") & is_filled("address")).select("id", F.inline(steps))


def scenario_plan(orgs: DataFrame) -> DataFrame:
    """1: only a name; 2: name and address; 3: name and phone; with the region used."""
    scenario = F.when(is_filled("address"), 2).when(has_text("phone"), 3).otherwise(1)
    return orgs.select(
        "id", scenario.alias("scenario"),
        F.when(scenario == 2, A.region_city("address")).when(scenario == 3, A.region_of_phone("phone", "address")).otherwise("").alias("region"))


def newest(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Bounded history: only the newest n rows are kept."""
    return df.orderBy(*order).limit(n)
