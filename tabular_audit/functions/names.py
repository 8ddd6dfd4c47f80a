"""Column naming helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quoted(name: str) -> str:
    """Column name safe for names holding dots, blanks or back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def column(col: str | Column) -> Column:
    return F.col(quoted(col)) if isinstance(col, str) else col
