"""Records with at least one (or none) of a set of fields."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import any_populated, indicator, mdy_year, null_if_placeholder, percentage, quoted
from ..functions.fixed_values import PLACEHOLDERS
from .projections import across


def placeholder_to_null(
    df: DataFrame, cols: Sequence[str], values: Iterable[str] = PLACEHOLDERS
) -> DataFrame:
    """Blank out placeholder text in the given columns."""
    values = list(values)
    return across(df, cols, lambda c: null_if_placeholder(c, values))


def flag_any_populated(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Add a 0/1 column: does the row hold a value in at least one column?"""
    return df.withColumn(name, indicator(any_populated(*cols)))


def cohort_by_year(
    df: DataFrame, flag: str, by: Sequence[str], date: str, year: str = "year"
) -> DataFrame:
    """Per group and year of a month-day-year text: n_with_flag, total,
    percentage.  Groups without a flagged row are kept.  Rows are counted by the
    text first, so that each spelling of a group is read once."""
    counted = (
        df.groupBy(
            *[F.col(quoted(b)).alias(f"group{i}") for i, b in enumerate(by)],
            F.col(quoted(date)).alias("text"),
        )
        .agg(
            F.count_if(F.col(quoted(flag)) == 1).alias("n_with_flag"),
            F.count("*").alias("total"),
        )
    )
    return (
        counted.groupBy(
            *[F.col(f"group{i}").alias(b) for i, b in enumerate(by)], mdy_year("text").alias(year)
        )
        .agg(F.sum("n_with_flag").alias("n_with_flag"), F.sum("total").alias("total"))
        .withColumn("percentage", percentage("n_with_flag", "total"))
    )
