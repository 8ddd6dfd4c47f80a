"""The remaining results of the review on the derived portfolio, results read from kept
tables, and tables written and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.programme import ADMIN
from ..sources import read_table, shared_folder, write_report
from ..sources.schemas import FINANCE_DETAIL, PROJECT_TYPE, PROJECTS
from . import portfolio as q
from .registry import ORACLES, columns_sql, query, rounded

DATES = "ProjectStartDate IS NOT NULL AND ProjectEndDate IS NOT NULL"
CONTACT = ("PersonContactFirstName IS NOT NULL AND PersonContactLastName IS NOT NULL "
           "AND PersonContactEmail IS NOT NULL")
CONTACT_MISSING = CONTACT.replace("IS NOT NULL", "IS NULL").replace("AND", "OR")
MANAGER = ("CecMgrContactFirstName IS NOT NULL AND CecMgrContactLastName IS NOT NULL "
           "AND CecMgrEmail IS NOT NULL")


def register(
    name: str, sql: str, *round_cols: str, keep: bool = False, suffix: str = "", dates: tuple[str, ...] = ()
) -> None:
    """A query ``portfolio_<name>`` with its SQL; ``dates`` are returned as text."""
    def build(spark: SparkSession, d: str) -> DataFrame:
        out = q.result(spark, d, name, keep).withColumns({c: F.col(c).cast("string") for c in dates})
        return rounded(out, *round_cols)

    build.__name__ = f"portfolio_{name}{suffix}"
    query(sql)(build)


def distinct_sql(source: str, cols: list[str], with_null: bool) -> str:
    extra = " + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT)" if with_null else ""
    return columns_sql(
        f"SELECT '{{c}}' AS \"column\", count(DISTINCT {{c}}){extra} AS num_distinct FROM {source}", cols)


def zero_sql(col: str, where: str) -> str:
    zero = f"count(*) FILTER ({col} = 0)"
    return q._with(q.FINANCE) + f"""SELECT count(*) AS total_entries, {zero} AS zero_count,
      {q.PCT.format(zero, 'count(*)')} AS percentage_zero FROM finance_view WHERE {where}"""


# ---------------------------------------------------------------- overview

register("contract_amount_mean", q._with() + """SELECT round(avg(ContractAmount), 6) AS average
  FROM projects WHERE ContractAmount <> 0""", "average")
register("contract_amount_by_named_admin", q._with() + """SELECT ProgramAdminName,
    round(avg(ContractAmount), 6) AS average FROM projects
  WHERE ContractAmount <> 0 AND ProgramAdminName IS NOT NULL GROUP BY ProgramAdminName""", "average")
register("projects_by_status", q._with() + f"""SELECT ProjectStatus, count(*) AS n,
    {q.PCT.format('count(*)', 'sum(count(*)) OVER ()')} AS pct
  FROM projects WHERE ProjectStatus IS NOT NULL GROUP BY ProjectStatus""", "pct")
register("dates_populated", q._with() + q._rate_sql("projects", DATES), "percentage")
register("contact_populated", q._with() + q._rate_sql("projects", CONTACT), "percentage")
register("contact_missing", q._with(q.OVERVIEW) + f"SELECT * FROM overview WHERE {CONTACT_MISSING}")
register("manager_contact_populated_by_admin", q._with() + q._rate_sql("projects", MANAGER, ADMIN),
         "percentage")
register("project_dates", q._with() + f"""SELECT *, CAST(start_date[:4] AS INTEGER) AS start_year,
    CAST(end_date[:4] AS INTEGER) AS end_year FROM (
  SELECT ProjectName, ProgramAdminName, ProjectStartDate, ProjectEndDate,
    strftime(try_strptime(ProjectStartDate, '%m/%d/%Y'), '%Y-%m-%d') AS start_date,
    strftime(try_strptime(ProjectEndDate, '%m/%d/%Y'), '%Y-%m-%d') AS end_date
  FROM projects WHERE {DATES})""", dates=("start_date", "end_date"))
for _name, _date in (("first_start_dates", "ProjectStartDate"), ("first_end_dates", "ProjectEndDate")):
    register(_name, q._with() + f"""SELECT {_date} FROM (SELECT * FROM projects
      ORDER BY Id NULLS LAST, ProjectNo NULLS LAST, {_date} NULLS LAST LIMIT 6)""")
register("project_durations", q._with(q.OVERVIEW) + f"""SELECT *, round(date_diff('day',
    try_strptime(ProjectStartDate, '%m/%d/%Y'), try_strptime(ProjectEndDate, '%m/%d/%Y')) / 7.0, 6)
    AS duration_weeks FROM overview WHERE {DATES}""", "duration_weeks")


# ---------------------------------------------------------------- detail

register("detail_duplicate_ids", q._with(q.DETAIL) + """SELECT ProjectId, count(*) AS nrows
  FROM detail_view GROUP BY ProjectId HAVING count(*) > 1""")
register("detail_key_matches", q._with(q.DETAIL) + """SELECT d.*,
    EXISTS (SELECT 1 FROM projects WHERE Id IS NOT DISTINCT FROM d.ProjectId) AS ProjectId_match,
    EXISTS (SELECT 1 FROM projects p WHERE p.ProjectNo IS NOT DISTINCT FROM d.ProjectNo) AS ProjectNo_match,
    EXISTS (SELECT 1 FROM projects p WHERE p.Id IS NOT DISTINCT FROM d.ProjectId
            AND p.ProjectNo IS NOT DISTINCT FROM d.ProjectNo) AS key_match
  FROM detail d""")
register("detail_distinct_populated", q._with(q.DETAIL)
         + distinct_sql("detail", ["ProjectId", "ProjectNo"], False))
register("detail_distinct", q._with(q.DETAIL)
         + distinct_sql("detail", ["ProjectId", "ProjectNo", "ProjectDetailId"], True))
register("scale_statements", q._with(q.DETAIL)
         + "SELECT * EXCLUDE (IsActive) FROM detail_view WHERE GettingToScale IS NOT NULL")
register("detail_activity", q._with(q.DETAIL) + """SELECT ProjectId, ProjectNo, IsActive_overview,
    IsActive_details, IsActive_overview = IsActive_details AS IsActive_Match FROM detail_view""")


# ---------------------------------------------------------------- finance

register("finance_distinct", q._with(q.FINANCE) + distinct_sql("finance", ["ProjectId", "ProjectNo"], True))
register("committed_mean", q._with(q.FINANCE) + """SELECT round(avg(CommitedFundingAmount), 6) AS average
  FROM finance_view WHERE CommitedFundingAmount <> 0""", "average")
register("committed_mean_by_admin", q._with(q.FINANCE) + """SELECT ProgramAdminName,
    round(avg(CommitedFundingAmount), 6) AS average FROM finance_view
  WHERE CommitedFundingAmount <> 0 GROUP BY ProgramAdminName""", "average")
register("expended_mean", q._with(q.FINANCE) + """SELECT round(avg(FundsExpendedToDate), 6) AS average
  FROM finance_view WHERE FundsExpendedToDate <> 0""", "average")
register("committed_zero", zero_sql("CommitedFundingAmount", "CommitedFundingAmount IS NOT NULL"),
         "percentage_zero")
register("expended_zero", zero_sql("FundsExpendedToDate", "TRUE"), "percentage_zero")


def rule_rows_sql(guards: list[str], rule: str) -> str:
    where = " AND ".join(f"{g} <> 0" for g in guards)
    return q._with(q.FINANCE) + f"""SELECT ProjectId, ProjectNo, {', '.join(q._FUNDS)}, ({rule}) AS "check"
      FROM finance_view WHERE {where}"""


register("budget_check", rule_rows_sql(
    q._FUNDS, "FundsExpendedToDate < CommitedFundingAmount + EncumberedFundingAmount"))
register("match_funding_check", rule_rows_sql(
    [*q._FUNDS, "MatchFunding"],
    "MatchFunding + CommitedFundingAmount > EncumberedFundingAmount AND "
    "MatchFunding + CommitedFundingAmount > FundsExpendedToDate"))
register("nothing_expended", q._with(q.OVERVIEW, q.FINANCE, q.FINANCE_FULL)
         + "SELECT * FROM finance_full WHERE FundsExpendedToDate = 0", suffix="_rows")
register("contract_amounts", q._with(q.FINANCE) + """SELECT ProjectId, ProjectNo, ContractAmount_overview,
    ContractAmount_details, ContractAmount_overview = ContractAmount_details AS Matched_Amounts
  FROM finance_view""", suffix="_rows")


# ---------------------------------------------------------------- metric

register("metric_distinct", q._with(q.METRIC) + distinct_sql("metric", ["ProjectId", "ProjectNo"], True))
register("missing_from_metric", q._with(q.OVERVIEW, q.METRIC) + """SELECT *, TRUE AS nomatch FROM overview
  WHERE NOT EXISTS (SELECT 1 FROM metric WHERE ProjectId = Id)""")
register("metric_activity", q._with(q.METRIC) + """SELECT ProjectId, ProjectNo, IsActive_overview,
    IsActive_metric, IsActive_overview = IsActive_metric AS IsActive_Match FROM metric_view""")
register("metric_activity_summary", q._with(q.METRIC)
         + q._summary_sql("metric_view", "IsActive_overview", "IsActive_metric"), "percentage_match")


# ---------------------------------------------------------------- at least one of several fields

DETAIL_FLAGS, METRIC_FLAGS = q._with(q.DETAIL, q._BARRIERS), q._with(q.METRIC, q._IMPACTS)
TOTALS = "SELECT ProgramAdminName, count(*) AS total FROM flagged GROUP BY ProgramAdminName"

register("barrier_by_end_year", DETAIL_FLAGS + q._cohort_sql("y1", "end_year"), "percentage")
register("impact_by_start_year", METRIC_FLAGS + q._cohort_sql("y0", "start_year"), "percentage")
register("with_barrier", DETAIL_FLAGS + q._rate_sql("flagged", "flag = 1"), "percentage")
register("without_barrier_by_admin", DETAIL_FLAGS + q._rate_sql("flagged", "flag = 0", ADMIN), "percentage")
register("with_impact_by_admin", METRIC_FLAGS + q._rate_sql("flagged", "flag = 1", ADMIN), "percentage")
register("without_impact", METRIC_FLAGS + q._rate_sql("flagged", "flag = 0"), "percentage")
register("barrier_rows_by_admin", DETAIL_FLAGS + TOTALS)
register("impact_rows_by_admin", METRIC_FLAGS + TOTALS)


# ---------------------------------------------------------------- results from kept tables

def register_kept(name: str, plain: str, *round_cols: str, dates: tuple[str, ...] = ()) -> None:
    """The result once more, from the tables that a kept review writes and reads back."""
    register(name, ORACLES[plain], *round_cols, keep=True, suffix="_kept", dates=dates)


register_kept("detail_completeness", "portfolio_detail_completeness", "percentage")
register_kept("metric_completeness", "portfolio_metric_completeness", "percentage")
register_kept("detail_blanks", "portfolio_detail_blanks", "pct")
register_kept("barrier_by_start_year", "portfolio_barriers_by_start_year", "percentage")
register_kept("without_impact_rows", "portfolio_without_impact_rows")
register_kept("missing_from_detail", "portfolio_missing_from_detail")
register_kept("wide_report_duplicates", "portfolio_wide_duplicates")
register_kept("project_dates", "portfolio_project_dates", dates=("start_date", "end_date"))


# ---------------------------------------------------------------- written and read back

def round_trip(table: DataFrame, schema, fmt: str) -> DataFrame:
    """The table written as a report to the shared folder and loaded as an input."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/round-trip-{uuid4().hex}"
    write_report(table, path, fmt)
    return read_table(spark, path, schema, fmt)


@query(q._with(q.FINANCE) + "SELECT * FROM finance")
def finance_through_parquet(spark, d):
    return round_trip(q.Derived(spark, d).finance_detail, FINANCE_DETAIL, "parquet")


@query(q._with(q.TYPES) + """SELECT PROJECT_ID, PROJECT_NUMBER, code AS PROJECT_TYPE_PROJECT_TYPE_ID
  FROM types""")
def types_through_csv(spark, d):
    return round_trip(q.Derived(spark, d).project_type, PROJECT_TYPE, "csv")


@query(q._with() + "SELECT * FROM projects")
def overview_through_csv(spark, d):
    loaded = round_trip(q.Derived(spark, d).projects, PROJECTS, "csv")
    return loaded.drop("LongitudeX", "LatitudeY").distinct()
