"""Where queries and their checks are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FINDING_COLUMNS = [
    "repo", "rule_id", "severity", "severity_rank", "file_path", "line", "column", "cwe", "snippet", "category", "fixable",
]


def query(name: str, sql: str | None = None):
    """List a query, with the SQL that gives the same rows where there is one."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def shown(findings: DataFrame, *more: str) -> DataFrame:
    return findings.select(*[F.col(f"`{c}`") for c in [*FINDING_COLUMNS, *more]])
