"""All queries of the library outside the optional corpus operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import analytics, casework, graph, history, indexes, ingest, provenance, records, relations, search, statutes, text  # noqa: F401  they register their queries
from tessera.plans.registry import ENTRIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: e.run for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in ENTRIES.items() if e.sql}


def coverage() -> dict[str, list[str]]:
    """Operator id to the queries that cover it."""
    out: dict[str, list[str]] = {}
    for name, e in ENTRIES.items():
        for op in e.covers:
            out.setdefault(op, []).append(name)
    return out
