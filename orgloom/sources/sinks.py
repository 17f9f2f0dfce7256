"""CSV exports. Every writer is parallel; one file per task, header in each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orgloom.functions.blank import first_text, is_filled


def write_csv(df: DataFrame, path: str, sort: str | None = None) -> None:
    """Header CSV with RFC quoting; ``sort`` gives range-ordered files without one big task."""
    out = df.repartitionByRange(sort).sortWithinPartitions(sort) if sort else df
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="",
                                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_back(df: DataFrame, path: str) -> DataFrame:
    """What :func:`write_csv` wrote of ``df``, with its types; empty cells are ''."""
    back = df.sparkSession.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return back.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) if t == "string" else F.col(n).cast(t).alias(n) for n, t in df.dtypes])


def contact_flat(nested: DataFrame) -> DataFrame:
    """name, phone, fax, email, url: stored number first, else the joined list; e-mail only from the list."""
    return nested.select(
        "name",
        F.coalesce(first_text("phone"), F.array_join("phones", ", "), F.lit("")).alias("phone"),
        F.coalesce(first_text("fax"), F.array_join("faxes", ", "), F.lit("")).alias("fax"),
        F.coalesce(F.array_join("emails", ", "), F.lit("")).alias("email"), F.coalesce("homepage", F.lit("")).alias("url"))


def sheet_with_flag(flat: DataFrame) -> DataFrame:
    """Review columns: complete (100, high) with a phone or e-mail, else 50 and low."""
    has = is_filled("phone") | is_filled("email")
    return flat.select("*", F.when(has, "검증완료").otherwise("정보부족").alias("review_status"),
                       F.when(has, "100").otherwise("50").alias("review_score"), F.when(has, "높음").otherwise("낮음").alias("confidence"))


def org_snapshot(active: DataFrame) -> DataFrame:
    """Contacts of active rows by id, NULLs as ''."""
    cols = ["name", "type", "category", "homepage", "phone", "fax", "email", "postal_code", "address"]
    have = set(active.columns)
    return active.select("id", *[(F.coalesce(c, F.lit("")) if c in have else F.lit("")).alias(c) for c in cols]).orderBy("id")
