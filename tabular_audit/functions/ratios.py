"""Ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .names import column


def percentage(part: str | Column, whole: str | Column) -> Column:
    """part / whole * 100; null when the whole is zero."""
    return F.try_divide(column(part), column(whole)) * 100
