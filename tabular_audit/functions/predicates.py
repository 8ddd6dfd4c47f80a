"""Row predicates.  All of them return Columns and stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from .names import column


def all_populated(*cols: str | Column) -> Column:
    """True where every column holds a value."""
    return reduce(and_, [column(c).isNotNull() for c in cols])


def any_populated(*cols: str | Column) -> Column:
    """True where at least one column holds a value."""
    return reduce(or_, [column(c).isNotNull() for c in cols])


def any_blank(*cols: str | Column) -> Column:
    """True where at least one column is null."""
    return reduce(or_, [column(c).isNull() for c in cols])


def populated_nonzero(*cols: str | Column) -> Column:
    """True where every column holds a value other than zero."""
    return reduce(and_, [column(c).isNotNull() & (column(c) != 0) for c in cols])


def one_of(col: str | Column, values: Iterable) -> Column:
    """Membership in a short list; never null, and null is a member only of a
    list that holds None."""
    values = list(values)
    c = column(col)
    found = F.coalesce(c.isin([v for v in values if v is not None]), F.lit(False))
    return (found | c.isNull()) if None in values else found


def indicator(predicate: Column) -> Column:
    """1 where the predicate is true, otherwise 0 (also for null)."""
    return F.when(predicate, 1).otherwise(0)
