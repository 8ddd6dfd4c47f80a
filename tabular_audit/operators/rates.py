"""Rates of rows that satisfy a predicate; one read and one aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import column, percentage, quoted


def predicate_rate(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: n (rows satisfying the predicate), total (all rows), percentage."""
    return df.agg(F.count_if(predicate).alias("n"), F.count("*").alias("total")).withColumn(
        "percentage", percentage("n", "total")
    )


def predicate_rate_by(
    df: DataFrame,
    predicate: Column,
    by: Sequence[str | Column],
    base: Column | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """n, total and percentage per group.  ``base`` limits the rows that count
    at all; groups without a hit are left out unless ``keep_empty``."""
    rows = df if base is None else df.where(base)
    out = rows.groupBy(*[column(b) for b in by]).agg(
        F.count_if(predicate).alias("n"), F.count("*").alias("total")
    )
    out = out if keep_empty else out.where("n > 0")
    return out.withColumn("percentage", percentage("n", "total"))


def literal_rate_by(df: DataFrame, col: str, value, by: Sequence[str | Column]) -> DataFrame:
    """How often a populated column equals one value, per group; groups where it
    never does are kept with n = 0."""
    c = F.col(quoted(col))
    return predicate_rate_by(df, c == F.lit(value), by, base=c.isNotNull(), keep_empty=True)


def zero_rate(
    df: DataFrame, col: str, by: Sequence[str] = (), drop_null: bool = True
) -> DataFrame:
    """total_entries, zero_count, percentage_zero, overall or per group.  Null
    amounts leave the total when ``drop_null``, otherwise they stay in it."""
    c = F.col(quoted(col))
    rows = df.where(c.isNotNull()) if drop_null else df
    out = rows.groupBy(*[quoted(b) for b in by]).agg(
        F.count("*").alias("total_entries"), F.count_if(c == 0).alias("zero_count")
    )
    return out.withColumn("percentage_zero", percentage("zero_count", "total_entries"))
