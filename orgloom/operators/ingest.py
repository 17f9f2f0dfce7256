"""Header mapping, schema normalization and row shaping for incoming files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orgloom.functions import fixed_values as V
from orgloom.functions import phone as P
from orgloom.functions import web as W
from orgloom.functions.blank import clean_value, first_nonblank, is_filled, strip


def exact_mapping(columns: Sequence[str], headers: Mapping[str, str] = V.EXACT_HEADERS) -> dict[str, str]:
    """canonical name -> file column; the last matching column wins."""
    return {headers[c.strip()]: c for c in columns if c.strip() in headers}


def keyword_mapping(columns: Sequence[str], rules=V.KEYWORD_HEADERS) -> dict[str, str]:
    """First rule whose keyword occurs in the header; a later column replaces an earlier one."""
    out: dict[str, str] = {}
    for col in columns:
        low = col.lower().strip()
        for target, words, never in rules:
            if any(w in low for w in words) and not any(w in low for w in never):
                out[target] = col
                break
    return out


def map_columns(df: DataFrame, mapping: Mapping[str, str], fields: Sequence[str]) -> DataFrame:
    """The canonical fields in order; unmapped ones are ''."""
    return df.select(*[(F.col(f"`{mapping[f]}`") if f in mapping else F.lit("")).alias(f) for f in fields])


CANONICAL = ["name", "category", "homepage", "phone", "fax", "email", "mobile", "postal_code", "address"]


def clean_rows(df: DataFrame) -> DataFrame:
    """Mapped rows cleaned field by field; rows without a name are skipped."""
    number = lambda c: F.when(P.valid_strict(clean_value(c)), P.format_phone(clean_value(c))).otherwise(clean_value(c))
    rules = {"phone": number, "fax": number, "mobile": number,
             "email": lambda c: F.when(W.email_valid(clean_value(c), "simple"), clean_value(c)).otherwise(""),
             "homepage": lambda c: W.url_with_scheme(clean_value(c))}
    return df.select(*[rules.get(c, clean_value)(F.col(c)).alias(c) for c in df.columns]).filter(is_filled("name"))


def first_nonblank_columns(df: DataFrame, candidates: Mapping[str, Sequence[str]] = V.CANDIDATE_HEADERS) -> DataFrame:
    """Each field from the first of its candidate columns that holds a real value."""
    have = set(df.columns)
    return df.select(*[
        (first_nonblank(*[F.col(f"`{c}`") for c in names if c in have]) if any(c in have for c in names) else F.lit("")).alias(field)
        for field, names in candidates.items()])


def normalize_schema(df: DataFrame, headers: Mapping[str, str] = V.CENTER_HEADERS) -> DataFrame:
    """Headers renamed, missing canonical columns added as ''."""
    out = df.withColumnsRenamed(dict(headers))
    return out.withColumns({c: F.lit("") for c in headers.values() if c not in out.columns})


def add_columns_if_absent(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Schema evolution: only columns that are not there yet."""
    return df.withColumns({c: v for c, v in columns.items() if c not in df.columns})


def _text(c: str) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def shape_organization(df: DataFrame, crawl_fields: Sequence[str] = V.CRAWL_FIELDS, created_by: str = "MIGRATION",
                       category: str = "종교시설") -> DataFrame:
    """Trimmed text, default status columns and the crawl fields as one JSON object."""
    have = set(df.columns)
    text = ["homepage", "phone", "fax", "email", "mobile", "postal_code", "address"]
    kept = [c for c in crawl_fields if c in have]
    return df.select(
        *[c for c in ("id",) if c in have], _text("name").alias("name"), F.lit("CHURCH").alias("type"),
        F.coalesce("category", F.lit(category)).alias("category") if "category" in have else F.lit(category).alias("category"),
        *[(_text(c) if c in have else F.lit("")).alias(c) for c in text],
        F.lit("NEW").alias("contact_status"), F.lit("MEDIUM").alias("priority"), F.lit("DATABASE").alias("lead_source"),
        (F.to_json(F.struct(*kept)) if kept else F.lit("{}")).alias("crawling_data"), F.lit(created_by).alias("created_by"))


def shape_sheet_row(df: DataFrame, source: str = "data_source") -> DataFrame:
    """Type from the source tag; an empty category defaults by that type."""
    academy = F.col(source).contains("ACADEMY")
    default = F.when(academy, "학원").otherwise("종교시설")
    return df.select(
        *[c for c in ("id",) if c in df.columns], _text("name").alias("name"), F.when(academy, "ACADEMY").otherwise("CHURCH").alias("type"),
        F.coalesce(F.nullif(_text("category"), F.lit("")), default).alias("category"),
        *[_text(c).alias(c) for c in ("phone", "fax", "email", "homepage", "address")],
        F.lit("NEW").alias("contact_status"), F.lit("MEDIUM").alias("priority"), F.col(source).alias("data_source"))


def exclude_and_reorder(df: DataFrame, excluded: Sequence[str] = V.EXCLUDED_FIELDS, first: Sequence[str] = V.FIRST_FIELDS) -> DataFrame:
    kept = [c for c in df.columns if c not in excluded]
    head = [c for c in first if c in kept]
    return df.select(*head, *[c for c in kept if c not in head])


def source_profile(sources: Mapping[str, DataFrame], order: str = "id", samples: int = 3) -> DataFrame:
    """Per source: rows, columns and the first rows as JSON."""
    out = None
    for name, df in sources.items():
        row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        picked = df.orderBy(order).limit(samples).select(F.struct(order, row.alias("row")).alias("r"))
        first = picked.agg(F.array_join(F.sort_array(F.collect_list("r"))["row"], "\n").alias("sample"))
        count = df.select(F.count("*")).scalar()
        row = first.select(F.lit(name).alias("source"), count.alias("row_count"), F.lit(",".join(df.columns)).alias("columns"), "sample")
        out = row if out is None else out.unionByName(row)
    return out
