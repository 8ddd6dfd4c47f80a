"""The whole review on a small hand-made portfolio."""

import re

import pytest

from tabular_audit.plans import RESULTS, ROW_RESULTS, Portfolio, review
from tabular_audit.sources import SCHEMAS, write_reports

P = "projects"
BLANK_CONTACT = (None,) * 3


def project(id, no, name, admin, lead, status, active, start, end, amount, contact, manager, lon):
    return (id, no, name, admin, lead, status, active, start, end, amount, *contact, *manager, lon, 0.0)


FULL = ("Ann", "Lee", "a@x.org")
PROJECTS = [
    project(1, "X-1 Module A", "One", "North", "SCE", "Closed", True, "01/02/2015", "01/16/2015",
            100.0, FULL, FULL, 1.0),
    project(1, "X-1 Module A", "One", "North", "SCE", "Closed", True, "01/02/2015", "01/16/2015",
            100.0, FULL, FULL, 2.0),
    project(2, "X-1 Module B", "Two", "North", "Southern California Edison", "Active", True,
            "3/4/2016", None, 0.0, ("Bo", None, None), BLANK_CONTACT, 1.0),
    project(3, None, "Three", "South", "Someone", "Pending", False, "5/6/16", "5/27/16", None,
            BLANK_CONTACT, FULL, 1.0),
    project(4, "X-4", "Four", None, None, None, None, None, None, 300.0, FULL, BLANK_CONTACT, 1.0),
    project(5, "X-5", "Five", "South", "Someone", "Closed", True, "7/8/2015", "7/8/2016", 500.0,
            FULL, BLANK_CONTACT, 1.0),
]


def texts(schema, **given):
    names = SCHEMAS[schema].fieldNames()
    return tuple(given.get(n) for n in names)


DETAIL = [
    texts("projects_detail", ProjectId=1, ProjectDetailId=11, ProjectNo="X-1 Module A", IsActive=True,
          DetailedProjectDescription="Competitive", ProjectSummary="s", TechnicalBarriers="None",
          MarketBarriers="hard", GettingToScale="yes"),
    texts("projects_detail", ProjectId=2, ProjectDetailId=12, ProjectNo="X-1 Module B", IsActive=False,
          DetailedProjectDescription="words", TechnicalBarriers="TBD.", MarketBarriers="N/A"),
    texts("projects_detail", ProjectId=3, ProjectDetailId=13, ProjectNo=None, IsActive=False,
          ProjectSummary="s"),
    texts("projects_detail", ProjectId=5, ProjectDetailId=15, ProjectNo="X-5", IsActive=None,
          PolicyAndRegulatoryBarriers="rules"),
    texts("projects_detail", ProjectId=5, ProjectDetailId=16, ProjectNo="other", IsActive=True),
]
FINANCE = [
    texts("finance_detail", ProjectId=1, ProjectNo="X-1 Module A", ContractAmount=100.0,
          CommitedFundingAmount=50.0, EncumberedFundingAmount=10.0, FundsExpendedToDate=55.0,
          MatchFunding=4.0),
    texts("finance_detail", ProjectId=3, ProjectNo=None, ContractAmount=7.0,
          CommitedFundingAmount=20.0, EncumberedFundingAmount=10.0, FundsExpendedToDate=40.0,
          MatchFunding=30.0),
    texts("finance_detail", ProjectId=5, ProjectNo="X-5", ContractAmount=400.0,
          CommitedFundingAmount=0.0, EncumberedFundingAmount=10.0, FundsExpendedToDate=0.0),
    texts("finance_detail", ProjectId=2, ProjectNo="X-1 Module B", ContractAmount=0.0,
          CommitedFundingAmount=5.0, FundsExpendedToDate=0.0),
    texts("finance_detail", ProjectId=4, ProjectNo="X-4"),
]
METRIC = [
    texts("projects_metric", ProjectId=1, ProjectNo="X-1 Module A", IsActive=True,
          ElectricitySystemReliabilityImpacts="a", ElectricitySystemSafetyImpacts="b",
          EnviromentalImpactsNonGHG="c", EnergyImpacts="d", OtherImpacts="e"),
    texts("projects_metric", ProjectId=2, ProjectNo="X-1 Module B", IsActive=False,
          OtherImpacts="n/a", CommunityBenefitsDesc="g"),
    texts("projects_metric", ProjectId=3, ProjectNo=None, IsActive=False, EnergyImpacts="x",
          InformationDissemination="i"),
    texts("projects_metric", ProjectId=4, ProjectNo="X-4", IsActive=True),
]
MARKET = [("X-4",), (None,)]
TYPES = [(1, "X-1 Module A", 1), (2, "X-1 Module B", 2), (3, None, 3), (4, "X-4", 9)]
DATA = dict(projects=PROJECTS, projects_detail=DETAIL, finance_detail=FINANCE,
            projects_metric=METRIC, market_facilitation=MARKET, project_type=TYPES)


@pytest.fixture(scope="module", params=[True, False], ids=["kept", "lazy"])
def results(spark, request):
    tables = {n: spark.createDataFrame(DATA[n], s) for n, s in SCHEMAS.items()}
    return review(Portfolio.of(tables), keep=request.param)


def get(results, name, *cols):
    df = results[name]
    got = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(got, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_wide_report(results):
    got = get(results, "wide_report", "Id", "IsActive", "IsActive_detail", "IsActive_metric",
              "ContractAmount_finance", "market_facilitation_indicator",
              "PROJECT_TYPE_PROJECT_TYPE_ID")
    assert got == [
        (1, True, True, True, 100.0, 0, "Applied Research and Development"),
        (2, True, False, False, 0.0, 0, "Technology Demonstration and Deployment"),
        (3, False, False, False, 7.0, 1, "Market Facilitation"),
        (4, None, None, True, None, 1, "other/unknown"),
        (5, True, None, None, 400.0, 0, "other/unknown"),
    ]
    assert get(results, "wide_report_duplicates") == []
    leads = dict(get(results, "wide_report", "Id", "ProjectLead"))
    assert leads[2] == "Southern California Edison"  # recoded later, not in this table


def test_overview_identity(results):
    assert get(results, "overview_distinct_populated") == [
        ("Id", 5), ("ProjectName", 5), ("ProjectNo", 4)]
    assert get(results, "overview_distinct") == [("Id", 5), ("ProjectName", 5), ("ProjectNo", 5)]
    assert get(results, "phase_families") == [("X-1", "X-1 Module A"), ("X-1", "X-1 Module B")]


def test_overview_amounts(results):
    assert get(results, "contract_amount_mean") == [(300.0,)]
    assert get(results, "contract_amount_summary") == [(100.0, 200.0, 300.0, 300.0, 400.0, 500.0)]
    assert get(results, "contract_amount_by_admin") == [
        ("North", 100.0, 100.0, 100.0), ("South", 500.0, 500.0, 500.0), (None, 300.0, 300.0, 300.0)]
    assert get(results, "contract_amount_by_named_admin") == [("North", 100.0), ("South", 500.0)]


def test_overview_shares(results):
    assert get(results, "projects_by_lead") == [("SCE", 2), ("Someone", 2)]
    assert get(results, "projects_by_admin") == [("North", 2, 50.0), ("South", 2, 50.0)]
    assert get(results, "projects_by_status") == [
        ("Active", 1, 25.0), ("Closed", 2, 50.0), ("Pending", 1, 25.0)]
    assert get(results, "status_within_admin") == [
        ("North", "Active", 1, 50.0), ("North", "Closed", 1, 50.0), ("South", "Closed", 1, 50.0),
        ("South", "Pending", 1, 50.0)]


def test_overview_status_and_dates(results):
    assert get(results, "unfinished_projects", "Id", "start_year") == [(2, 2016), (3, 2016)]
    assert get(results, "active_but_closed") == [(2, 5, 40.0)]
    assert get(results, "active_but_closed_by_admin") == [("North", 1, 2, 50.0), ("South", 1, 2, 50.0)]
    assert get(results, "dates_populated") == [(3, 5, 60.0)]
    assert get(results, "dates_populated_by_admin") == [("North", 1, 2, 50.0), ("South", 2, 2, 100.0)]
    assert get(results, "project_dates", "ProjectName", "start_year", "end_year") == [
        ("Five", 2015, 2016), ("One", 2015, 2015), ("Three", 2016, 2016)]
    assert get(results, "projects_by_start_year") == [
        (2015, 2, pytest.approx(200 / 3)), (2016, 1, pytest.approx(100 / 3))]
    assert get(results, "start_year_within_admin") == [
        ("North", 2015, 1, 1, 100.0), ("South", 2015, 1, 2, 50.0), ("South", 2016, 1, 2, 50.0)]
    assert get(results, "end_year_within_admin") == [
        ("North", 2015, 1, 1, 100.0), ("South", 2016, 2, 2, 100.0)]
    assert [r[0] for r in get(results, "first_start_dates")] == [
        "01/02/2015", "3/4/2016", "5/6/16", "7/8/2015", None]
    assert get(results, "project_durations", "Id", "duration_weeks") == [
        (1, 2.0), (3, 3.0), (5, pytest.approx(366 / 7))]
    assert get(results, "duration_by_admin") == [
        ("North", 2.0), ("South", pytest.approx((3 + 366 / 7) / 2))]


def test_overview_contacts(results):
    assert get(results, "contact_populated") == [(3, 5, 60.0)]
    assert get(results, "contact_populated_by_admin") == [
        ("North", 1, 2, 50.0), ("South", 1, 2, 50.0), (None, 1, 1, 100.0)]
    assert get(results, "contact_missing", "Id") == [(2,), (3,)]
    assert get(results, "contact_missing_by_status") == [("Active", 1), ("Pending", 1)]
    assert get(results, "manager_contact_populated") == [(2, 5, 40.0)]


def test_detail(results):
    assert get(results, "detail_duplicate_ids") == [(5, 2)]
    assert get(results, "detail_key_matches", "ProjectDetailId", "ProjectId_match", "ProjectNo_match",
               "key_match") == [(11, True, True, True), (12, True, True, True), (13, True, True, True),
                                (15, True, True, True), (16, True, False, False)]
    assert get(results, "detail_distinct_populated") == [("ProjectId", 4), ("ProjectNo", 4)]
    assert get(results, "detail_distinct") == [
        ("ProjectDetailId", 5), ("ProjectId", 4), ("ProjectNo", 5)]
    assert get(results, "missing_from_detail", "Id", "nomatch") == [(4, True)]
    complete = {r[:3]: r[3:] for r in get(results, "detail_completeness")}
    assert complete[(0, None, "ProjectSummary")] == (5, 2, 40.0)
    assert complete[(1, "North", "ProjectSummary")] == (2, 1, 50.0)
    assert complete[(1, None, "ProjectSummary")] == (1, 0, 0.0)
    assert complete[(1, "North", "TechnicalBarriers")] == (2, 2, 100.0)
    assert len(complete) == 12 * 4
    assert get(results, "solicitation_word_by_admin") == [("North", 1, 2, 50.0)]
    blanks = [r for r in get(results, "detail_blanks") if r[2] == "ProjectSummary"]
    third = pytest.approx(100 / 3)
    assert blanks == [("North", False, "ProjectSummary", 1, third),
                      ("South", None, "ProjectSummary", 1, third),
                      (None, True, "ProjectSummary", 1, third)]
    assert get(results, "scale_statements", "ProjectDetailId") == [(11,)]
    assert get(results, "detail_activity_summary") == [(5, 2, 1, 40.0)]


def test_finance(results):
    assert get(results, "finance_distinct") == [("ProjectId", 5), ("ProjectNo", 5)]
    assert get(results, "committed_mean") == [(25.0,)]
    assert get(results, "committed_mean_by_admin") == [("North", 27.5), ("South", 20.0)]
    assert get(results, "committed_zero") == [(4, 1, 25.0)]
    assert get(results, "committed_zero_by_admin") == [("North", 2, 0, 0.0), ("South", 2, 1, 50.0)]
    assert get(results, "budget_check", "ProjectId", "check") == [(1, True), (3, False)]
    assert get(results, "budget_check_summary") == [(2, 1, 1, 50.0)]
    assert get(results, "expended_mean") == [(47.5,)]
    assert get(results, "expended_mean_by_admin") == [("North", 55.0), ("South", 40.0)]
    assert get(results, "expended_zero") == [(5, 2, 40.0)]
    assert get(results, "expended_zero_by_admin") == [
        ("North", 2, 1, 50.0), ("South", 2, 1, 50.0), (None, 1, 0, 0.0)]
    assert get(results, "nothing_expended", "ProjectId") == [(2,), (5,)]
    assert get(results, "committed_but_nothing_expended", "ProjectId") == [(2,)]
    assert get(results, "contract_amounts_summary") == [(5, 2, 1, 40.0)]
    assert get(results, "match_funding_check", "ProjectId", "check") == [(1, False), (3, True)]
    assert get(results, "match_funding_check_summary") == [(2, 1, 1, 50.0)]


def test_metric(results):
    assert get(results, "metric_distinct") == [("ProjectId", 4), ("ProjectNo", 4)]
    assert get(results, "missing_from_metric", "Id") == [(5,)]
    assert get(results, "all_impacts", "ProjectId") == [(1,)]
    complete = {r[:4]: r[4:] for r in get(results, "metric_completeness")}
    assert complete[(0, None, None, "OtherImpacts")] == (4, 2, 50.0)
    assert complete[(1, "North", None, "OtherImpacts")] == (2, 2, 100.0)
    assert complete[(2, "North", 2016, "CommunityBenefitsDesc")] == (1, 1, 100.0)
    assert (2, "North", 2016, "OtherImpacts") not in complete
    populated = [r for r in get(results, "metric_populated") if r[2] == "OtherImpacts"]
    assert populated == [("North", False, "OtherImpacts", 1, 50.0),
                         ("North", True, "OtherImpacts", 1, 50.0)]
    assert get(results, "metric_activity_summary") == [(4, 2, 1, 50.0)]


def test_barriers_and_impacts(results):
    assert get(results, "with_barrier") == [(2, 5, 40.0)]
    assert get(results, "with_barrier_by_admin") == [("North", 1, 2, 50.0), ("South", 1, 2, 50.0)]
    assert get(results, "without_barrier_by_admin") == [
        ("North", 1, 2, 50.0), ("South", 1, 2, 50.0), (None, 1, 1, 100.0)]
    assert get(results, "without_barrier_rows", "ProjectId") == [(2,), (3,), (5,)]
    assert get(results, "barrier_by_start_year") == [
        ("North", 2015, 1, 1, 100.0), ("North", 2016, 0, 1, 0.0), ("South", 2015, 1, 1, 100.0),
        ("South", 2016, 0, 1, 0.0), (None, None, 0, 1, 0.0)]
    assert get(results, "with_impact") == [(2, 4, 50.0)]
    assert get(results, "without_impact") == [(2, 4, 50.0)]
    assert get(results, "without_impact_by_admin") == [("North", 1, 2, 50.0), (None, 1, 1, 100.0)]
    assert get(results, "impact_by_end_year") == [
        ("North", 2015, 1, 1, 100.0), ("North", None, 0, 1, 0.0), ("South", 2016, 1, 1, 100.0),
        (None, None, 0, 1, 0.0)]
    assert get(results, "impact_rows_by_admin") == [("North", 2), ("South", 1), (None, 1)]


def test_every_result_can_be_computed(results):
    for name, df in results.items():
        df.write.format("noop").mode("overwrite").save()
        assert len(set(c.lower() for c in df.columns)) == len(df.columns), name


def test_results_are_written_by_name(spark, results, tmp_path):
    some = {n: results[n] for n in ("projects_by_admin", "budget_check", "contact_missing")}
    write_reports(some, str(tmp_path), large=ROW_RESULTS, parallel=3)
    for name, df in some.items():
        assert spark.read.parquet(str(tmp_path / name)).count() == df.count()
    assert set(ROW_RESULTS) <= set(RESULTS) == set(results)


def test_job_from_csv_to_reports(spark, tmp_path):
    import run_review

    args = ["--format", "csv", "--out", str(tmp_path / "out"), "--no-keep", "--only",
            "projects_by_lead", "active_but_closed", "budget_check_summary", "status_within_admin"]
    for name, schema in SCHEMAS.items():
        table = spark.createDataFrame(DATA[name], schema)
        table.coalesce(1).write.option("header", True).csv(str(tmp_path / name))
        args += ["--table", f"{name}={tmp_path / name}"]
    run_review.main(args)

    def read(name):
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / name)).collect()))

    ordered = spark.read.parquet(str(tmp_path / "out" / "status_within_admin")).coalesce(1).collect()
    groups = [(r["ProgramAdminName"], r["ProjectStatus"]) for r in ordered]
    assert groups == sorted(groups)
    assert read("projects_by_lead") == [("SCE", 2), ("Someone", 2)]
    assert read("active_but_closed") == [(2, 5, 40.0)]
    assert read("budget_check_summary") == [(2, 1, 1, 50.0)]


def scanned(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    columns = re.findall(r"FileScan parquet \[(.*?)\]", plan)
    return {frozenset(c.split("#")[0] for c in scan.split(",")) for scan in columns}


@pytest.mark.parametrize("results", [True], indirect=True)
def test_kept_marks_spare_the_texts(results):
    assert scanned(results["barrier_by_start_year"]) == {
        frozenset({"ProgramAdminName", "ProjectStartDate", "one_or_more_barrier"})}
    assert scanned(results["with_impact"]) == {frozenset({"one_or_more_impact"})}
    for name in ("detail_completeness", "detail_blanks", "metric_completeness", "metric_populated"):
        (columns,) = scanned(results[name])
        assert all(c.endswith("__filled") or c in KEYS for c in columns), columns


KEYS = {"ProgramAdminName", "IsActive_details", "IsActive_metric", "ProjectStartDate"}
