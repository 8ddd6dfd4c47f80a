"""DataFrame-to-DataFrame operators."""

from .cohorts import cohort_by_year, flag_any_populated, placeholder_to_null
from .completeness import breakdown, completeness, completeness_levels
from .joins import (
    Tab,
    check_fan_out,
    enrich,
    fan_out,
    hot_keys,
    key_match_flags,
    left_join,
    membership_flag,
    settled,
    unmatched,
)
from .keys import (
    distinct_counts,
    duplicate_keys,
    duplicate_rows,
    families,
    group_sizes,
    with_group_size,
)
from .projections import across, distinct_without, first_values, pull
from .rates import literal_rate_by, predicate_rate, predicate_rate_by, zero_rate
from .reconcile import covers, reconcile, rule_check, verdict_summary, within_budget
from .shares import frequency_table, share
from .spellings import Spellings
from .stats import describe_numeric, duration_weeks, mean_by

__all__ = [
    "Spellings", "Tab", "across", "breakdown", "check_fan_out", "cohort_by_year", "completeness", "completeness_levels",
    "covers", "describe_numeric", "distinct_counts", "distinct_without", "duplicate_keys",
    "duplicate_rows", "duration_weeks", "enrich", "families", "fan_out", "first_values",
    "flag_any_populated", "frequency_table", "group_sizes", "hot_keys", "key_match_flags",
    "left_join", "literal_rate_by", "mean_by", "membership_flag", "placeholder_to_null",
    "predicate_rate", "predicate_rate_by", "pull", "reconcile", "rule_check", "settled", "share",
    "unmatched", "verdict_summary", "with_group_size", "within_budget", "zero_rate",
]
