"""Registered queries and the SQL they are checked against."""

from . import basics, keyed, portfolio, portfolio_rest, transfers
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "basics", "keyed", "portfolio", "portfolio_rest", "transfers"]
