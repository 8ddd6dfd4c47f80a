"""Counts and shares of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import column, percentage, quoted
from .joins import at_key, named_keys


def frequency_table(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows per value, null left out."""
    c = F.col(quoted(col))
    return df.where(c.isNotNull()).groupBy(c).agg(F.count("*").alias(name))


def share(
    df: DataFrame,
    cols: Sequence[str | Column],
    within: Sequence[str] = (),
    drop_null: bool = False,
    with_total: bool = False,
) -> DataFrame:
    """n and pct of each combination of values, of the whole table or, with
    ``within``, of the group it lies in.

    ``drop_null`` first removes rows with a null in any of the columns.  Totals
    are summed from the counts: a scalar for the whole table, and for ``within`` a join on
    the group's columns.  A group of many values sends one partial sum per task to its total, and
    the totals have a shuffle of their own, so that its counts can be split in the join.
    """
    groups = [column(w) for w in within]
    values = [column(c) for c in cols]
    rows = df
    if drop_null:
        for c in groups + values:
            rows = rows.where(c.isNotNull())
    counts = rows.groupBy(*groups, *values).agg(F.count("*").alias("n"))
    if within:
        totals = counts.groupBy(*named_keys(within)).agg(F.sum("n").alias("total"))
        out = counts.join(totals, at_key(within), "left").select(*[quoted(c) for c in counts.columns], "total")
    else:
        out = counts.withColumn("total", counts.agg(F.sum("n").alias("n")).scalar())
    out = out.withColumn("pct", percentage("n", "total"))
    return out if with_total else out.drop("total")
