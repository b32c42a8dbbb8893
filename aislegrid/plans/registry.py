"""Registry of catalog queries. A portable query is one SQL text over the adapter views; others pair a DataFrame function with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aislegrid.sources.adapters import ADAPTERS, BASE_TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _ctes(sql: str) -> dict[str, str]:
    """The adapter views that a SQL text names, with those that they name, in order of use."""
    found: dict[str, str] = {}

    def visit(text: str) -> None:
        for name, body in ADAPTERS.items():
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(body)
                found[name] = body

    visit(sql)
    return found


def with_views(sql: str, sf_dir: str | None = None) -> str:
    """sql with the adapter views it names as common table expressions; with sf_dir also the Parquet tables, for Spark."""
    views = _ctes(sql)
    text = " ".join([sql, *views.values()])
    base = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in BASE_TABLES if sf_dir and re.search(rf"\b{t}\b", text)}
    parts = [f"{name} AS ({body})" for name, body in (base | views).items()]
    sql = sql.strip()
    if not parts:
        return sql
    head = "WITH " + ",\n".join(parts)
    return f"{head},\n{sql[5:]}" if sql.upper().startswith("WITH ") else f"{head}\n{sql}"


def portable(name: str, sql: str) -> None:
    """Registers one SQL text for both engines."""
    QUERIES[name] = lambda spark, sf_dir: spark.sql(with_views(sql, sf_dir))
    ORACLES[name] = with_views(sql)


def query(sql: str | None = None, name: str | None = None):
    """Registers a DataFrame function (spark, sf_dir) under its name, with the SQL that DuckDB runs for it."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return f

    return register
