"""The wide report deals rows by project id alone where it can, and is the same where it cannot."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabular_audit.operators import Tab, duplicate_rows, enrich, membership_flag
from tabular_audit.operators.joins import leads
from tabular_audit.plans import Portfolio
from tabular_audit.plans.programme import _by_id, wide_report, wide_report_duplicates, wide_tabs
from tabular_audit.queries import QUERIES
from tabular_audit.sources import SCHEMAS

SMALL = "/root/testdata/sf0.01"
KEYS = ["Id", "ProjectNo"]
NUMBERS = ["A", "B", None, "A", "C", "A"]
IDS = [1, 1, 1, 2, 3, 4, 5, None, None]


def rows(spark, schema, **columns):
    """One row per place in the columns, the others null."""
    names = SCHEMAS[schema].fieldNames()
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(
        [tuple(columns[c][i] if c in columns else None for c in names) for i in range(n)], SCHEMAS[schema])


def portfolio(spark, ids, tab_ids):
    keys = [(i, no) for i in ids for no in ("A", "B", None)]
    tab_keys = [(i, no) for i in tab_ids for no in NUMBERS]
    id_, no = map(list, zip(*keys))
    tab_id, tab_no = map(list, zip(*tab_keys))
    n = len(tab_id)
    few_id, few_no = map(list, zip(*[(i, no) for i in dict.fromkeys(tab_ids) for no in NUMBERS[1:5]]))
    return Portfolio(
        rows(spark, "projects", Id=id_, ProjectNo=no, ProjectName=[f"n{k % 5}" for k in range(len(id_))],
             LongitudeX=[float(k) for k in range(len(id_))]),
        rows(spark, "projects_detail", ProjectId=tab_id, ProjectNo=tab_no, ProjectDetailId=list(range(n))),
        rows(spark, "finance_detail", ProjectId=few_id, ProjectNo=few_no,
             ContractAmount=[float(k) for k in range(len(few_id))]),
        rows(spark, "projects_metric", ProjectId=few_id[::3], ProjectNo=few_no[::3]),
        spark.createDataFrame([("B",), (None,)], SCHEMAS["market_facilitation"]),
        rows(spark, "project_type", PROJECT_ID=few_id[::2], PROJECT_NUMBER=few_no[::2],
             PROJECT_TYPE_PROJECT_TYPE_ID=[1 + k % 3 for k in range(len(few_id[::2]))]),
    )


def bag(df):
    return Counter(map(tuple, df.collect()))


CASES = {
    "nulls_everywhere": (IDS, IDS, True),
    "null_in_the_projects": (IDS, [1, 2, 3, 3], True),
    "null_in_the_tabs": ([1, 2, 3], IDS, True),
    "no_rows_match": ([1, 2], [7, 8], True),
    "hot_id": ([1, 2, 3], [*range(100), *[1] * 200], False),
}


@pytest.mark.parametrize("ids, tab_ids, by_id", CASES.values(), ids=CASES)
def test_odd_keys_are_matched_as_by_the_whole_key(spark, ids, tab_ids, by_id):
    p = portfolio(spark, ids, tab_ids)
    assert _by_id(wide_tabs(p)) == by_id
    projects = p.projects.drop("LongitudeX", "LatitudeY").distinct()
    flag = "market_facilitation_indicator"
    flagged = membership_flag(projects, p.market_facilitation, {"ProjectNo": "Agreement Number"}, flag)
    want = enrich(flagged, *wide_tabs(p))
    plain = [c for c in want.columns if c != "PROJECT_TYPE_PROJECT_TYPE_ID"]
    assert bag(wide_report(p).select(*plain)) == bag(want.select(*plain))
    assert bag(wide_report_duplicates(p).select(*plain)) == bag(duplicate_rows(want, KEYS).select(*plain))


def test_led_join_is_the_join_on_the_whole_key(spark):
    base = spark.createDataFrame([(1, "a", 0), (1, None, 1), (1, "b", 2), (2, "a", 3), (3, None, 4)],
                                 "id long, no string, v int")
    tab = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (1, None, 7), (2, None, 8), (None, None, 9)],
                                "k long, no string, w int")
    tabs = [Tab(tab, {"id": "k", "no": "no"})]
    assert bag(enrich(base, *tabs, led=True)) == bag(enrich(base, *tabs))


def test_first_column_that_leads(spark):
    lines = spark.range(20_000).selectExpr("id div 4 AS k", "cast(id div 4 AS string) AS no", "cast(id AS string) AS line",
                                           "if(id % 3 = 0, -1, id) AS hot", "if(id % 3 = 0, null, id) AS some")
    assert leads([(lines, ["k", "no"]), (lines, ["some", "no"])], 100)  # null holds a third, and joins nothing
    assert not leads([(lines, ["k", "line"])], 100)  # four keys for each value
    assert not leads([(lines, ["k", "no"]), (lines, ["hot", "no"])], 100)
    assert leads([(lines.limit(0), ["k", "no"])], 100)


def dealt_rows(df):
    """What the rows of each shuffle of a plan are dealt by."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().toString()
    return re.findall(r"Exchange hashpartitioning\((.*), \d+\), ", plan.split("== Physical Plan ==")[1])


@pytest.mark.parametrize("name", [
    "portfolio_wide", "portfolio_wide_duplicates", "portfolio_wide_report_duplicates_kept"])
def test_tables_dealt_by_id_stay(spark, name):
    """No rows are dealt by id and number together, null-safe, as a join on the whole key deals them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by = dealt_rows(QUERIES[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert by and not [b for b in by if b.count("isnull(") > 1], by
