"""How complete are the columns of a table?

All columns of a call are measured in one aggregate, so the table is read once
and only the (group, counts) rows are shuffled; few or uneven groups do no harm
because counts combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import null_if_placeholder, percentage, quoted
from .joins import _KEY, key_struct


def _filled(col: str, placeholders: Iterable[str]) -> Column:
    values = list(placeholders)
    return null_if_placeholder(col, values) if values else F.col(quoted(col))


def _group_names(by: Sequence[str | Column]) -> list[Column]:
    return [F.col(quoted(b)) if isinstance(b, str) else b for b in by]


def _tidy(
    counts: DataFrame, keys: Sequence[str], cols: Sequence[str], value: str, *carried: str
) -> DataFrame:
    """One row per (group, column) from one counter column per measured column."""
    items = [F.struct(F.lit(c).alias("column"), *carried, F.col(f"__c{i}").alias(value))
             for i, c in enumerate(cols)]
    return counts.select(*keys, F.inline(F.array(*items)))


def completeness(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str | Column] = (),
    placeholders: Iterable[str] = (),
) -> DataFrame:
    """Per group and column: total_rows, non_missing_count, percentage.

    ``by`` may hold named expressions such as ``mdy_year("start").alias("year")``.
    A null group is a group.  Values in ``placeholders`` count as missing.
    """
    counts = df.groupBy(*_group_names(by)).agg(
        F.count("*").alias("total_rows"),
        *[F.count(_filled(c, placeholders)).alias(f"__c{i}") for i, c in enumerate(cols)],
    )
    keys = [quoted(k) for k in counts.columns[: len(by)]]
    tidy = _tidy(counts, keys, cols, "non_missing_count", "total_rows")
    return tidy.withColumn("percentage", percentage("non_missing_count", "total_rows"))


def completeness_levels(
    df: DataFrame,
    cols: Sequence[str],
    levels: Sequence[Sequence[str]],
    placeholders: Iterable[str] = (),
) -> DataFrame:
    """Completeness at several grouping levels from one read of the table.

    ``levels`` lists key lists, e.g. ``[(), ("admin",), ("admin", "year")]``.
    Counts are taken once per finest group and summed for the coarser levels;
    ``level`` holds the position in the list.  Keys outside a level are null.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    fine = df.groupBy(*[quoted(k) for k in keys]).agg(
        F.count("*").alias("__n"),
        *[F.count(_filled(c, placeholders)).alias(f"__c{i}") for i, c in enumerate(cols)],
    )
    gids = [sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in level)
            for level in levels]
    level_of = F.expr(
        "CASE " + " ".join(f"WHEN grouping_id() = {g} THEN {i}" for i, g in enumerate(gids)) + " END"
    )
    sums = fine.groupingSets(
        [[F.col(quoted(k)) for k in level] for level in levels], *[F.col(quoted(k)) for k in keys]
    ).agg(
        level_of.alias("level"),
        F.sum("__n").alias("total_rows"),
        *[F.sum(f"__c{i}").alias(f"__c{i}") for i in range(len(cols))],
    )
    out_keys = ["level"] + [quoted(k) for k in keys]
    tidy = _tidy(sums, out_keys, cols, "non_missing_count", "total_rows")
    return tidy.withColumn("percentage", percentage("non_missing_count", "total_rows"))


def breakdown(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str],
    blank: bool = True,
    with_pct: bool = False,
) -> DataFrame:
    """(group, column, n): rows per group where the column is blank, or where it
    is populated when ``blank=False``.  Groups without such rows are absent.
    ``with_pct`` adds the share of all such rows of the column."""
    names = [quoted(b) for b in by]
    counts = df.groupBy(*names).agg(
        *[F.count_if(F.col(quoted(c)).isNull() if blank else F.col(quoted(c)).isNotNull())
          .alias(f"__c{i}") for i, c in enumerate(cols)]
    )
    tidy = _tidy(counts, names, cols, "n").where("n > 0")
    if not with_pct:
        return tidy
    # One total per measured column: as many rows as ``cols`` has entries.
    totals = tidy.groupBy(key_struct(["column"]).alias(_KEY)).agg(F.sum("n").alias("__t"))
    joined = tidy.join(F.broadcast(totals), key_struct(["column"]) == F.col(_KEY), "left")
    return joined.withColumn("pct", percentage("n", "__t")).drop(_KEY, "__t")
