"""Registry of named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orgloom.sources.tables import cte

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SECTIONS = ("coverage", "queues", "rules", "matching", "updates", "extraction", "metrics", "ingest", "streams")
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ("org",)) -> Callable[[Query], Query]:
    """Register ``fn`` as ``name``; ``sql`` may refer to the views in ``uses``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            if uses:
                recursive = text.startswith("WITH RECURSIVE ")
                text = "WITH " + text[15:] if recursive else text
                head = cte(*uses).replace("WITH ", "WITH RECURSIVE ", 1) if recursive else cte(*uses)
                text = f"{head},\n{text[5:]}" if text.startswith("WITH ") else f"{head}\n{text}"
            ORACLES[name] = text
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    import importlib

    for section in SECTIONS:
        importlib.import_module(f"orgloom.plans.{section}")

    return QUERIES, ORACLES
