"""Queries by name, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name, with DuckDB SQL for the same rows."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for a table of literals: columns as "name type, ..."."""

    def lit(v: object, kind: str) -> str:
        if v is None:
            return f"CAST(NULL AS {kind})"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return f"CAST({v!r} AS {kind})"
        if isinstance(v, list):
            return "CAST([" + ", ".join(lit(x, kind.removesuffix("[]")) for x in v) + f"] AS {kind})"
        return "CAST('" + str(v).replace("'", "''") + f"' AS {kind})"

    names, kinds = zip(*(c.rsplit(" ", 1) for c in columns.split(", ")), strict=True)
    body = ", ".join("(" + ", ".join(lit(v, k) for v, k in zip(row, kinds, strict=True)) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(names)})"
