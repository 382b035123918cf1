"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return add


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be missing leave a query as text, so that every client reads them alike."""
    return df.withColumns({c: df[c].cast("string") for c in columns})


def text_sql(*columns: str) -> str:
    return ", ".join(f"{c}::VARCHAR AS {c}" for c in columns)
