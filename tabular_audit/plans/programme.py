"""The whole review as named result tables.

``RESULTS`` maps result names to functions of a ``Review``, which holds the
input tables and widens them on first use.  Building results that join tabs runs
a search for hot keys; with ``keep`` the shared tables are written then.  All
else runs when a result is written or shown.  Results that differ only in the measured column or in the
grouping level come from one aggregate, so the widened tables are read a few
times rather than once per field.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (
    all_populated,
    any_blank,
    any_populated,
    indicator,
    label_codes,
    null_if_placeholder,
    one_of,
    parse_mdy,
    populated_nonzero,
    recode,
)
from ..functions.fixed_values import SOLICITATION_WORD, STATUS_CLOSED, STATUSES_NOT_FINISHED
from ..operators import (
    Spellings,
    Tab,
    breakdown,
    cohort_by_year,
    completeness_levels,
    covers,
    describe_numeric,
    distinct_counts,
    distinct_without,
    duplicate_keys,
    duration_weeks,
    enrich,
    families,
    first_values,
    frequency_table,
    group_sizes,
    check_fan_out,
    hot_keys,
    key_match_flags,
    literal_rate_by,
    mean_by,
    membership_flag,
    placeholder_to_null,
    predicate_rate,
    predicate_rate_by,
    pull,
    reconcile,
    rule_check,
    settled,
    share,
    unmatched,
    verdict_summary,
    within_budget,
    zero_rate,
)
from ..operators.joins import at_key, key_pairs, leads, led_match, named_keys
from ..sources.schemas import (
    BARRIERS,
    CONTACT,
    COORDINATES,
    DETAIL_TEXTS,
    IMPACTS,
    MANAGER_CONTACT,
    METRIC_TEXTS,
    METRIC_TEXTS_BY_YEAR,
)
from ..sources.tables import kept

ADMIN = "ProgramAdminName"
START, END = "ProjectStartDate", "ProjectEndDate"


@dataclass(frozen=True)
class Portfolio:
    """The six input tables."""

    projects: DataFrame
    projects_detail: DataFrame
    finance_detail: DataFrame
    projects_metric: DataFrame
    market_facilitation: DataFrame
    project_type: DataFrame

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame]) -> Portfolio:
        return cls(**tables)


# ---------------------------------------------------------------- tables derived from the input

_BY_PROJECT = {"ProjectId": "Id", "ProjectNo": "ProjectNo"}
_PROJECT_KEY = ["ProjectId", "ProjectNo"]
_IDENTITY = ["Id", "ProjectNo", "ProjectName"]


def overview(p: Portfolio) -> DataFrame:
    """Distinct projects, coordinates aside, with short lead names."""
    return distinct_without(p.projects, *COORDINATES).withColumn(
        "ProjectLead", recode("ProjectLead"))


_TAB_KEY = {"Id": "ProjectId", "ProjectNo": "ProjectNo"}
_TYPE_KEY = {"Id": "PROJECT_ID", "ProjectNo": "PROJECT_NUMBER"}


def wide_tabs(p: Portfolio) -> list[Tab]:
    """What the wide report joins to the projects."""
    return [
        Tab(p.projects_detail, _TAB_KEY, renamed={"IsActive": "IsActive_detail"}),
        Tab(p.projects_metric, _TAB_KEY, renamed={"IsActive": "IsActive_metric"}),
        Tab(p.finance_detail, _TAB_KEY, renamed={"ContractAmount": "ContractAmount_finance"}),
        Tab(p.project_type, _TYPE_KEY, columns=("PROJECT_TYPE_PROJECT_TYPE_ID",)),
    ]


_CODE, _FLAG = "PROJECT_TYPE_PROJECT_TYPE_ID", "market_facilitation_indicator"
_KEYS = ["Id", "ProjectNo"]


def _by_id(tabs: Sequence[Tab]) -> bool:
    """Can these tabs be joined on the project's id, its number compared row by row?"""
    return leads([(tab.df, list(key_pairs(tab.on).values())) for tab in tabs])


def _widened(p: Portfolio, base: DataFrame, keys: DataFrame, tabs: Sequence[Tab], by_id: bool) -> DataFrame:
    """The wide report of the base rows with the given keys.  The flag depends on the number
    alone, so it is set on the keys: base rows are not dealt by number for it."""
    flags = membership_flag(keys, p.market_facilitation, {"ProjectNo": "Agreement Number"}, _FLAG)
    flags = flags.select(*named_keys(_KEYS), _FLAG)
    names = flags.columns[:-1]
    match = led_match(_KEYS, names) if by_id else at_key(_KEYS)
    wide = enrich(base.join(flags, match).drop(*names), *tabs, led=by_id)
    rest = [c for c in wide.columns if c not in (_CODE, _FLAG)]
    return wide.select(*rest, _FLAG, label_codes(_CODE).alias(_CODE))


def _in_parts(
    base: DataFrame, tabs: Sequence[Tab], build: Callable[[DataFrame, Sequence[Tab], bool], DataFrame]
) -> DataFrame:
    """``build`` by id where the tabs allow it; base rows without an id are built apart then,
    with the tabs' rows without one, if there are any."""
    if not _by_id(tabs):
        return build(base, tabs, False)
    out = build(base.where(F.col("Id").isNotNull()), tabs, True)
    nameless = base.where(F.col("Id").isNull())
    if nameless.isEmpty():
        return out
    rests = [replace(tab, df=tab.df.where(F.col(key_pairs(tab.on)["Id"]).isNull())) for tab in tabs]
    return out.unionByName(build(nameless, rests, False))


def wide_report(
    p: Portfolio, projects: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """All tabs side by side, lead names as entered; a project with several rows
    in a tab fans out.  ``projects`` replaces the project table.  With ``limit`` the
    number of rows is worked out first, and more than that raises."""
    distinct = distinct_without(p.projects if projects is None else projects, *COORDINATES)
    tabs = wide_tabs(p)
    if limit is not None:
        check_fan_out(distinct, *tabs, limit=limit)
    return _in_parts(distinct, tabs, lambda base, tabs, by_id: _widened(
        p, base, base.select(*_KEYS).distinct(), tabs, by_id))


def wide_report_duplicates(p: Portfolio) -> DataFrame:
    """Rows of the wide report whose project has several.  Which do is found on the
    keys alone; only these projects are then widened."""
    def build(base: DataFrame, tabs: Sequence[Tab], by_id: bool) -> DataFrame:
        narrow = enrich(base.select(*_KEYS), *[replace(tab, columns=()) for tab in tabs], led=by_id)
        return _widened(p, base, duplicate_keys(narrow, _KEYS).select(*_KEYS), tabs, by_id)

    return _in_parts(distinct_without(p.projects, *COORDINATES), wide_tabs(p), build)


def detail_view(detail: DataFrame, ov: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Detail tab with name, administrator, activity and dates of its project."""
    return enrich(detail, Tab(
        ov, _BY_PROJECT,
        columns=("ProjectName", ADMIN, "IsActive", START, END),
        suffixes=("_details", "_overview"), hot=hot,
    ))


def finance_view(finance: DataFrame, ov: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Finance tab with all columns of its project."""
    return enrich(finance, Tab(ov, _BY_PROJECT, suffixes=("_details", "_overview"), hot=hot))


def metric_view(metric: DataFrame, ov: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Metric tab with all columns of its project."""
    return enrich(metric, Tab(ov, _BY_PROJECT, suffixes=("_metric", "_overview"), hot=hot))


_FILLED = "__filled"


def with_marks(
    view: DataFrame, texts: Sequence[str], flag: str, flag_cols: Sequence[str]
) -> DataFrame:
    """Add what most results ask about the text columns: per column a mark that
    is true or null, and a 0/1 flag for any text other than a placeholder in
    ``flag_cols``.  Written with the view, they spare later results the texts."""
    marks = {c + _FILLED: F.when(F.col(c).isNotNull(), True) for c in texts}
    some = indicator(any_populated(*[null_if_placeholder(c) for c in flag_cols]))
    return view.withColumns({**marks, flag: some})


def _without_marks(table: DataFrame, texts: Sequence[str], flag: str) -> DataFrame:
    return table.drop(flag, *[c + _FILLED for c in texts])


def _only_marks(table: DataFrame, texts: Sequence[str], active: str) -> DataFrame:
    """The marks under the names of their columns, with what rows are grouped by."""
    marks = [F.col(c + _FILLED).alias(c) for c in texts]
    return table.select(ADMIN, active, START, END, *marks)


def _flagged(
    table: DataFrame, cols: Sequence[str], flag: str, *carried: str
) -> DataFrame:
    """Narrow table with placeholders blanked out, and the flag."""
    rows = table.select("ProjectId", "ProjectName", *carried, ADMIN, *cols, START, END, flag)
    return placeholder_to_null(rows, cols)


_BARRIER, _IMPACT = "one_or_more_barrier", "one_or_more_impact"


@dataclass(frozen=True)
class Review:
    """The input tables and what is derived from them, each built on first use.

    With ``keep`` the de-duplicated overview and the widened tabs, which dozens of
    results read, are written to the shared checkpoint folder on first use and read
    back from there.  The wide report, the largest table, is a result only.
    """

    p: Portfolio
    keep: bool = False

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return kept(df, name) if self.keep else df

    @cached_property
    def ov(self) -> DataFrame:
        return self._kept(overview(self.p), "overview")

    @cached_property
    def _spellings(self) -> Spellings:
        return Spellings.of(self.ov, [START, END])

    def dated(self, rows: DataFrame, **cols: str) -> DataFrame:
        """Add dates (new name = text column of the overview)."""
        if self.keep:
            return self._spellings.onto(rows, cols)
        return rows.withColumns({new: parse_mdy(c) for new, c in cols.items()})

    @cached_property
    def _hot(self) -> DataFrame:
        """Hot keys of the overview, looked for once for all tabs."""
        return settled(hot_keys(self.ov, _BY_PROJECT.values()))

    @cached_property
    def _detail_table(self) -> DataFrame:
        view = detail_view(self.p.projects_detail, self.ov, self._hot)
        return self._kept(with_marks(view, DETAIL_TEXTS, _BARRIER, BARRIERS), "detail")

    @cached_property
    def detail(self) -> DataFrame:
        return _without_marks(self._detail_table, DETAIL_TEXTS, _BARRIER)

    @cached_property
    def detail_marks(self) -> DataFrame:
        return _only_marks(self._detail_table, DETAIL_TEXTS, "IsActive_details")

    @cached_property
    def barriers(self) -> DataFrame:
        return _flagged(self._detail_table, BARRIERS, _BARRIER, "DetailedProjectDescription")

    @cached_property
    def finance(self) -> DataFrame:
        return self._kept(finance_view(self.p.finance_detail, self.ov, self._hot), "finance")

    @cached_property
    def _metric_table(self) -> DataFrame:
        view = metric_view(self.p.projects_metric, self.ov, self._hot)
        return self._kept(with_marks(view, METRIC_TEXTS, _IMPACT, IMPACTS), "metric")

    @cached_property
    def metric(self) -> DataFrame:
        return _without_marks(self._metric_table, METRIC_TEXTS, _IMPACT)

    @cached_property
    def metric_marks(self) -> DataFrame:
        return _only_marks(self._metric_table, METRIC_TEXTS, "IsActive_metric")

    @cached_property
    def impacts(self) -> DataFrame:
        return _flagged(self._metric_table, IMPACTS, _IMPACT)

    def result(self, name: str) -> DataFrame:
        return RESULTS[name](self)


Results = dict[str, Callable[[Review], DataFrame]]


def _rate(
    name: str, table: Callable[[Review], DataFrame], test: Callable[[], Column],
    base: Callable[[], Column] | None = None,
) -> Results:
    """Overall rate and rate per administrator.  ``base`` limits the rows of the
    rate per administrator only."""
    return {
        name: lambda r: predicate_rate(table(r), test()),
        f"{name}_by_admin": lambda r: predicate_rate_by(
            table(r), test(), [ADMIN], base=base() if base else None),
    }


# ---------------------------------------------------------------- overview

def _funded(r: Review) -> DataFrame:
    return pull(r.ov, populated_nonzero("ContractAmount"))


def _status_known() -> Column:
    return all_populated("ProjectStatus", "IsActive")


def _active_but_closed() -> Column:
    return _status_known() & F.col("IsActive") & (F.col("ProjectStatus") == STATUS_CLOSED)


def _project_dates(r: Review) -> DataFrame:
    """Projects with both dates, parsed, with their years."""
    rows = pull(r.ov, all_populated(START, END), "ProjectName", ADMIN, START, END)
    dated = r.dated(rows, start_date=START, end_date=END)
    return dated.withColumns({"start_year": F.year("start_date"), "end_year": F.year("end_date")})


def _unfinished(r: Review) -> DataFrame:
    rows = pull(r.ov, one_of("ProjectStatus", STATUSES_NOT_FINISHED))
    return r.dated(rows, start_date=START).withColumn("start_year", F.year("start_date"))


def _durations(r: Review) -> DataFrame:
    return duration_weeks(r.ov, START, END)


def _without_contact(r: Review) -> DataFrame:
    return pull(r.ov, any_blank(*CONTACT))


OVERVIEW: Results = {
    "overview_distinct_populated": lambda r: distinct_counts(r.ov, _IDENTITY),
    "overview_distinct": lambda r: distinct_counts(r.ov, _IDENTITY, count_null=True),
    "phase_families": lambda r: families(r.ov, "ProjectNo", "BaseProjectNo"),
    "contract_amount_mean": lambda r: mean_by(r.ov, "ContractAmount", nonzero=True),
    "contract_amount_summary": lambda r: describe_numeric(_funded(r), "ContractAmount"),
    "contract_amount_by_admin": lambda r: mean_by(
        _funded(r), "ContractAmount", [ADMIN], extremes=True),
    "contract_amount_by_named_admin": lambda r: mean_by(
        _funded(r), "ContractAmount", [ADMIN], keep_null_groups=False),
    "projects_by_lead": lambda r: frequency_table(r.ov, "ProjectLead"),
    "projects_by_admin": lambda r: share(r.ov, [ADMIN], drop_null=True),
    "projects_by_status": lambda r: share(r.ov, ["ProjectStatus"], drop_null=True),
    "status_within_admin": lambda r: share(
        r.ov, ["ProjectStatus"], within=[ADMIN], drop_null=True),
    "unfinished_projects": _unfinished,
    **_rate("active_but_closed", lambda r: r.ov, _active_but_closed, base=_status_known),
    **_rate("dates_populated", lambda r: r.ov, lambda: all_populated(START, END)),
    "project_dates": _project_dates,
    "projects_by_start_year": lambda r: share(_project_dates(r), ["start_year"]),
    "start_year_within_admin": lambda r: share(
        _project_dates(r), ["start_year"], within=[ADMIN], with_total=True),
    "end_year_within_admin": lambda r: share(
        _project_dates(r), ["end_year"], within=[ADMIN], with_total=True),
    "first_start_dates": lambda r: first_values(r.ov, START, order_by=["Id", "ProjectNo", START]),
    "first_end_dates": lambda r: first_values(r.ov, END, order_by=["Id", "ProjectNo", END]),
    "project_durations": _durations,
    "duration_by_admin": lambda r: mean_by(
        _durations(r), "duration_weeks", [ADMIN], keep_null_groups=False),
    **_rate("contact_populated", lambda r: r.ov, lambda: all_populated(*CONTACT)),
    "contact_missing": _without_contact,
    "contact_missing_by_status": lambda r: frequency_table(_without_contact(r), "ProjectStatus"),
    **_rate("manager_contact_populated", lambda r: r.ov, lambda: all_populated(*MANAGER_CONTACT)),
}


# ---------------------------------------------------------------- detail

def _detail_activity(r: Review) -> DataFrame:
    return reconcile(r.detail, "IsActive_overview", "IsActive_details", _PROJECT_KEY,
                     "IsActive_Match")


DETAIL: Results = {
    "detail_duplicate_ids": lambda r: duplicate_keys(r.detail, ["ProjectId"]),
    "detail_key_matches": lambda r: key_match_flags(r.p.projects_detail, r.ov, _BY_PROJECT),
    "detail_distinct_populated": lambda r: distinct_counts(r.p.projects_detail, _PROJECT_KEY),
    "detail_distinct": lambda r: distinct_counts(
        r.p.projects_detail, [*_PROJECT_KEY, "ProjectDetailId"], count_null=True),
    "missing_from_detail": lambda r: unmatched(
        r.ov, r.p.projects_detail, {"Id": "ProjectId"}, "nomatch"),
    "detail_completeness": lambda r: completeness_levels(
        r.detail_marks, DETAIL_TEXTS, [(), (ADMIN,)]),
    "solicitation_word_by_admin": lambda r: literal_rate_by(
        r.detail, "DetailedProjectDescription", SOLICITATION_WORD, [ADMIN]),
    "detail_blanks": lambda r: breakdown(
        r.detail_marks, [c for c in DETAIL_TEXTS if c != "DetailedProjectDescription"],
        [ADMIN, "IsActive_details"], with_pct=True),
    "scale_statements": lambda r: pull(r.detail, all_populated("GettingToScale")),
    "detail_activity": _detail_activity,
    "detail_activity_summary": lambda r: verdict_summary(_detail_activity(r), "IsActive_Match"),
}


# ---------------------------------------------------------------- finance

_COMMITTED, _EXPENDED = "CommitedFundingAmount", "FundsExpendedToDate"
_FUNDS = [_COMMITTED, _EXPENDED, "EncumberedFundingAmount"]


def _budget_check(r: Review) -> DataFrame:
    """Is less spent than committed and encumbered together?"""
    rule = within_budget(_EXPENDED, _COMMITTED, "EncumberedFundingAmount")
    return rule_check(r.finance, _FUNDS, rule, _PROJECT_KEY)


def _match_funding_check(r: Review) -> DataFrame:
    """Do match funding and committed funds exceed what is encumbered and spent?"""
    rule = covers(["MatchFunding", _COMMITTED], "EncumberedFundingAmount", _EXPENDED)
    return rule_check(r.finance, [*_FUNDS, "MatchFunding"], rule, _PROJECT_KEY, shown=_FUNDS)


def _contract_amounts(r: Review) -> DataFrame:
    return reconcile(r.finance, "ContractAmount_overview", "ContractAmount_details", _PROJECT_KEY,
                     "Matched_Amounts")


def _nothing_spent() -> Column:
    return F.col(_EXPENDED) == 0


FINANCE: Results = {
    "finance_distinct": lambda r: distinct_counts(
        r.p.finance_detail, _PROJECT_KEY, count_null=True),
    "committed_mean": lambda r: mean_by(r.finance, _COMMITTED, nonzero=True),
    "committed_mean_by_admin": lambda r: mean_by(r.finance, _COMMITTED, [ADMIN], nonzero=True),
    "committed_zero": lambda r: zero_rate(r.finance, _COMMITTED),
    "committed_zero_by_admin": lambda r: zero_rate(r.finance, _COMMITTED, [ADMIN]),
    "budget_check": _budget_check,
    "budget_check_summary": lambda r: verdict_summary(_budget_check(r), "check"),
    "expended_mean": lambda r: mean_by(r.finance, _EXPENDED, nonzero=True),
    "expended_mean_by_admin": lambda r: mean_by(r.finance, _EXPENDED, [ADMIN], nonzero=True),
    "expended_zero": lambda r: zero_rate(r.finance, _EXPENDED, drop_null=False),
    "expended_zero_by_admin": lambda r: zero_rate(
        r.finance, _EXPENDED, [ADMIN], drop_null=False),
    "nothing_expended": lambda r: pull(r.finance, _nothing_spent()),
    "committed_but_nothing_expended": lambda r: pull(
        r.finance, _nothing_spent() & (F.col(_COMMITTED) > 0)),
    "contract_amounts": _contract_amounts,
    "contract_amounts_summary": lambda r: verdict_summary(_contract_amounts(r), "Matched_Amounts"),
    "match_funding_check": _match_funding_check,
    "match_funding_check_summary": lambda r: verdict_summary(_match_funding_check(r), "check"),
}


# ---------------------------------------------------------------- metric

def _metric_completeness(r: Review) -> DataFrame:
    """Overall, per administrator, and per administrator and start year."""
    dated = r.dated(r.metric_marks, start_year=START).withColumn("start_year", F.year("start_year"))
    out = completeness_levels(dated, METRIC_TEXTS, [(), (ADMIN,), (ADMIN, "start_year")])
    return out.where((F.col("level") < 2) | F.col("column").isin(list(METRIC_TEXTS_BY_YEAR)))


def _metric_activity(r: Review) -> DataFrame:
    return reconcile(r.metric, "IsActive_overview", "IsActive_metric", _PROJECT_KEY,
                     "IsActive_Match")


METRIC: Results = {
    "metric_distinct": lambda r: distinct_counts(
        r.p.projects_metric, _PROJECT_KEY, count_null=True),
    "missing_from_metric": lambda r: unmatched(
        r.ov, r.p.projects_metric, {"Id": "ProjectId"}, "nomatch"),
    "all_impacts": lambda r: pull(r.metric, all_populated(*IMPACTS)),
    "metric_completeness": _metric_completeness,
    "metric_populated": lambda r: breakdown(
        r.metric_marks, METRIC_TEXTS, [ADMIN, "IsActive_metric"], blank=False, with_pct=True),
    "metric_activity": _metric_activity,
    "metric_activity_summary": lambda r: verdict_summary(_metric_activity(r), "IsActive_Match"),
}


# ---------------------------------------------------------------- at least one of several fields

def _cohorts(name: str, table: Callable[[Review], DataFrame], flag: str) -> Results:
    def none() -> Column:
        return F.col(flag) == 0

    return {
        f"{name}_by_start_year": lambda r: cohort_by_year(
            table(r), flag, [ADMIN], START, "start_year"),
        f"{name}_by_end_year": lambda r: cohort_by_year(table(r), flag, [ADMIN], END, "end_year"),
        **_rate(f"with_{name}", table, lambda: F.col(flag) == 1),
        **_rate(f"without_{name}", table, none),
        f"without_{name}_rows": lambda r: pull(table(r), none()),
        f"{name}_rows_by_admin": lambda r: group_sizes(table(r), [ADMIN], "total"),
    }


# ---------------------------------------------------------------- everything

RESULTS: Results = {
    "wide_report": lambda r: wide_report(r.p),
    "wide_report_duplicates": lambda r: wide_report_duplicates(r.p),
    **OVERVIEW,
    **DETAIL,
    **FINANCE,
    **METRIC,
    **_cohorts("barrier", lambda r: r.barriers, _BARRIER),
    **_cohorts("impact", lambda r: r.impacts, _IMPACT),
}


# Results with about as many rows as their input tables.
ROW_RESULTS = (
    "wide_report", "project_dates", "project_durations", "contact_missing", "detail_key_matches",
    "scale_statements", "detail_activity", "budget_check", "contract_amounts",
    "match_funding_check", "metric_activity", "without_barrier_rows", "without_impact_rows",
)


# What results measure; their other columns are what they are grouped by.
MEASURES = {
    "n", "total", "pct", "percentage", "average", "minimum", "maximum", "nrows", "total_rows",
    "non_missing_count", "total_entries", "zero_count", "percentage_zero", "num_distinct",
    "n_with_flag", "matches", "mismatches", "percentage_match", "q1", "median", "mean", "q3",
}
_LISTINGS = {*ROW_RESULTS, "wide_report_duplicates", "unfinished_projects", "missing_from_detail",
             "missing_from_metric", "nothing_expended", "committed_but_nothing_expended", "all_impacts",
             "first_start_dates", "first_end_dates"}


def report_orders(results: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """The columns that grouped results are written in the order of."""
    return {name: [c for c in df.columns if c not in MEASURES]
            for name, df in results.items() if name not in _LISTINGS}


def review(p: Portfolio, keep: bool = True) -> dict[str, DataFrame]:
    """All results; ``keep`` as in ``Review``."""
    r = Review(p, keep)
    return {name: build(r) for name, build in RESULTS.items()}
