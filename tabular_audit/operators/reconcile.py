"""Agreement of two columns and of funding rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import percentage, populated_nonzero, quoted


def reconcile(
    df: DataFrame, left: str, right: str, keys: Sequence[str], verdict: str = "match"
) -> DataFrame:
    """Detail listing: keys, both columns and whether they are equal (null when
    either is null)."""
    return df.select(
        *[quoted(k) for k in keys], quoted(left), quoted(right),
        (F.col(quoted(left)) == F.col(quoted(right))).alias(verdict),
    )


def rule_check(
    df: DataFrame,
    guards: Sequence[str],
    rule: Column,
    keys: Sequence[str],
    shown: Sequence[str] | None = None,
    verdict: str = "check",
) -> DataFrame:
    """Detail listing of the rows where every guard column is populated and
    non-zero, with the outcome of the rule."""
    rows = df.where(populated_nonzero(*guards))
    cols = guards if shown is None else shown
    return rows.select(*[quoted(c) for c in (*keys, *cols)], rule.alias(verdict))


def verdict_summary(detail: DataFrame, verdict: str) -> DataFrame:
    """One row: total, matches, mismatches, percentage_match.  Rows without a
    verdict count in the total only."""
    v = F.col(quoted(verdict))
    return detail.agg(
        F.count("*").alias("total"),
        F.count_if(v).alias("matches"),
        F.count_if(~v).alias("mismatches"),
    ).withColumn("percentage_match", percentage("matches", "total"))


def within_budget(spent: str, *budgets: str) -> Column:
    """Spent less than the sum of the budgets."""
    return F.col(quoted(spent)) < _total(budgets)


def covers(budgets: Sequence[str], *claims: str) -> Column:
    """The sum of the budgets exceeds each of the claims."""
    total = _total(budgets)
    first, *rest = [total > F.col(quoted(c)) for c in claims]
    for r in rest:
        first = first & r
    return first


def _total(cols: Sequence[str]) -> Column:
    first, *rest = [F.col(quoted(c)) for c in cols]
    for c in rest:
        first = first + c
    return first
