"""Row and column selection helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import column, quoted


def distinct_without(df: DataFrame, *dropped: str) -> DataFrame:
    """Distinct rows once the given columns are gone."""
    return df.drop(*dropped).distinct()


def across(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Replace each column by ``fn(column)`` in one projection."""
    return df.withColumns({c: fn(column(c)) for c in cols})


def pull(df: DataFrame, predicate: Column, *cols: str) -> DataFrame:
    """Rows for which the predicate is true, with all or the given columns."""
    rows = df.where(predicate)
    return rows.select(*[quoted(c) for c in cols]) if cols else rows


def first_values(df: DataFrame, col: str, n: int = 6, order_by: Iterable[str] = ()) -> DataFrame:
    """First ``n`` values of a column.  Without ``order_by`` any ``n`` rows may
    come back, since a distributed table has no first row."""
    order = [F.col(quoted(c)).asc_nulls_last() for c in order_by]
    rows = df.orderBy(*order) if order else df
    return rows.limit(n).select(quoted(col))
