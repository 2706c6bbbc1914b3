"""All queries of the library proper, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.plans import analytics, corpus, curation, ingest, registers, replies, reports, training

PARTS = (analytics, corpus, curation, ingest, registers, replies, reports, training)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
