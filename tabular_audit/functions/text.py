"""Text clean-up expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column, functions as F

from .fixed_values import (
    LEAD_NAMES,
    PHASE_MARKERS,
    PLACEHOLDERS,
    PROJECT_TYPE_DEFAULT,
    PROJECT_TYPE_LABELS,
)
from .names import column


def null_if_placeholder(col: str | Column, values: Iterable[str] = PLACEHOLDERS) -> Column:
    """Null where the text is exactly one of the placeholder values."""
    c = column(col)
    return F.when(~c.isin(list(values)), c)


def cut_at(col: str | Column, markers: Iterable[str] = PHASE_MARKERS) -> Column:
    """Text before the first marker, whole text if there is none.  Everything
    behind the marker goes, line breaks included."""
    pattern = "(?s)(?:" + "|".join(re.escape(m) for m in markers) + ").*"
    return F.regexp_replace(column(col), pattern, "")


def recode(col: str | Column, mapping: Mapping[str, str] = LEAD_NAMES) -> Column:
    """Exact-match recode; values outside the mapping stay as they are.  The
    mapping is a literal of the plan, so it costs neither a join nor a shuffle."""
    c = column(col)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, c), c)


def label_codes(
    col: str | Column,
    labels: Mapping[int, str] = PROJECT_TYPE_LABELS,
    default: str = PROJECT_TYPE_DEFAULT,
) -> Column:
    """Label of a code; other codes and null get the default."""
    c = column(col)
    (code, label), *rest = labels.items()
    out = F.when(c == code, label)
    for code, label in rest:
        out = out.when(c == code, label)
    return out.otherwise(default)
