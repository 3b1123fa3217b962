"""Registered queries: each with DuckDB SQL for the same rows where SQL can say it.

A fixture is a small literal table, used by the Spark query and, as VALUES, by its SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Fixture:
    """Rows with a schema such as "a int, b string"."""

    name: str
    schema: str
    rows: list[tuple]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """A common table expression of the rows."""
        kinds = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
        columns = [c.strip().split() for c in self.schema.split(",")]

        def text(v: object, kind: str) -> str:
            s = "NULL" if v is None else "'" + str(v).replace("'", "''") + "'" if kind in ("string", "timestamp") else str(v)
            return f"CAST({s} AS {kinds[kind]})"

        rows = ", ".join("(" + ", ".join(text(v, k) for v, (_, k) in zip(r, columns)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT * FROM (VALUES {rows}) t({', '.join(c for c, _ in columns)}))"
