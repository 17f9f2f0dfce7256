"""Coverage reports from stored counts: views of a versioned table that each update changes by old and new rows, so nothing is counted anew.

The counts of :func:`report_view` by category hold what contact coverage, category coverage and the quality report need; the reports
read one row per category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from orgloom.functions import phone as P
from orgloom.functions.blank import is_filled

from . import coverage as C
from .versions import View

ONE_ROW = [*(f"{f}_count" for f in C.COVERED), "complete_count", "valid_phones", "valid_faxes"]


def report_view() -> View:
    """Counts by category over active organizations."""
    counts = {f"{f}_count": is_filled(f) for f in C.COVERED}
    return View(["category"], counts | {"complete_count": C.complete_contact(), "valid_phones": P.is_valid("phone"), "valid_faxes": P.is_valid("fax")}, F.col("is_active"))


def status_view() -> View:
    """Active organizations by contact status."""
    return View(["contact_status"], {}, F.col("is_active"))


def _total(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def contact_coverage(counts: DataFrame) -> DataFrame:
    return C.contact_rates(_total(counts, ONE_ROW[:-2]))


def category_coverage(counts: DataFrame) -> DataFrame:
    return C.category_rates(counts.select("category", F.col("n_rows").alias("total"), *ONE_ROW[:len(C.COVERED)]))


def quality_report(counts: DataFrame) -> DataFrame:
    return C.quality_of(_total(counts, ONE_ROW))


def dashboard_organizations(statuses: DataFrame) -> DataFrame:
    """The organization rows of the dashboard: metric, key, value."""
    per_status = statuses.select(F.lit("status").alias("metric"), F.col("contact_status").alias("key"), F.col("n_rows").alias("value"))
    total = statuses.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("value"))
    return per_status.unionByName(total.select(F.lit("organizations").alias("metric"), F.lit("").alias("key"), "value"))
