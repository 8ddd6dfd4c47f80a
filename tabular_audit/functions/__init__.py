"""Column expressions used by the operators; no Python UDF among them."""

from .dates import mdy_year, parse_fixed_mdy, parse_mdy, weeks_between
from .names import column, quoted
from .predicates import (
    all_populated,
    any_blank,
    any_populated,
    indicator,
    one_of,
    populated_nonzero,
)
from .ratios import percentage
from .text import cut_at, label_codes, null_if_placeholder, recode

__all__ = [
    "all_populated", "any_blank", "any_populated", "column", "cut_at", "indicator",
    "label_codes", "mdy_year", "null_if_placeholder", "one_of", "parse_fixed_mdy",
    "parse_mdy", "percentage", "populated_nonzero", "quoted", "recode", "weeks_between",
]
