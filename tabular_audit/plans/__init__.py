"""Operators put together into the whole review."""

from .programme import RESULTS, ROW_RESULTS, Portfolio, Review, report_orders, review

__all__ = ["RESULTS", "ROW_RESULTS", "Portfolio", "Review", "report_orders", "review"]
