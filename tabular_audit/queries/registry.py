"""Named queries over the supplied tables, each next to the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Round computed doubles, whose last digits depend on summation order."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) for c in cols})


def columns_sql(template: str, cols: Iterable[str]) -> str:
    """One SELECT per column name, united; ``{c}`` stands for the name."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)
