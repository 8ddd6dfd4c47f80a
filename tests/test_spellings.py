"""Texts read once per spelling: same values as row by row, and no reading over the rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabular_audit.functions import mdy_year, parse_fixed_mdy, parse_mdy
from tabular_audit.operators import Spellings, cohort_by_year
from tabular_audit.plans.programme import Review
from tabular_audit.queries import portfolio as q

SF = "/root/testdata/sf0.01"
TEXTS = ["5/1/2020", "05-01-2020", "May 1, 2020", "5/1/20", "13/40/2020", "", " 5.1.2020 ", None, "soon"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    cells = [(i, TEXTS[i % len(TEXTS)], TEXTS[(i * 2 + 1) % len(TEXTS)]) for i in range(90)]
    return spark.createDataFrame(cells, "id long, `start text` string, spelling0 string")


@pytest.mark.parametrize("read", [parse_mdy, parse_fixed_mdy])
@pytest.mark.parametrize("most_bytes", [0, 1 << 20])
def test_same_as_row_by_row(rows, read, most_bytes):
    names = {"began": "start text", "spelling0": "spelling0"}
    got = Spellings.of(rows, list(names.values()), read, most_bytes).onto(rows, names)
    want = rows.withColumns({"began": read(F.col("`start text`")), "spelling0": read(F.col("spelling0"))})
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_long_list_reads_rows(rows):
    few, many = (Spellings.of(rows, ["start text"], parse_mdy, n) for n in (1 << 20, 0))
    assert "Join" in plan_of(few.onto(rows, {"d": "start text"}))
    assert "Join" not in plan_of(many.onto(rows, {"d": "start text"}))
    assert few.table.count() == len(TEXTS) - 1
    assert few.size == sum(len(t) + 48 for t in TEXTS if t is not None)


def test_empty_and_all_null(spark, rows):
    for none in (rows.where("false"), rows.where("`start text` IS NULL")):
        got = Spellings.of(none, ["start text"]).onto(none, {"d": "start text"})
        assert [r["d"] for r in got.collect()] == [None] * none.count()


def test_cohort_counts_texts_first(spark, rows):
    flagged = rows.withColumns({"flag": F.col("id") % 2, "text": F.col("id") % 3})
    got = cohort_by_year(flagged, "flag", ["text"], "start text")
    want = flagged.groupBy("text", mdy_year("start text").alias("year")).agg(
        F.sum("flag").alias("n_with_flag"), F.count("*").alias("total"))
    assert sorted(map(str, got.drop("percentage").collect())) == sorted(map(str, want.collect()))
    # Below the first shuffle rows are read one by one; only the plain way parses there.
    first_stage = [d._jdf.queryExecution().executedPlan().toString().rsplit("Exchange", 1)[1] for d in (got, want)]
    assert ["regexp_replace" in plan for plan in first_stage] == [False, True]
    assert {r["year"] for r in got.collect()} == {2020, None}


def test_kept_review_reads_dates_once(spark):
    kept = Review(q.Derived(spark, SF), keep=True)
    dates = kept.result("project_dates")
    assert "BroadcastHashJoin" in dates._jdf.queryExecution().sparkPlan().toString()
    assert "regexp_replace" not in plan_of(dates)
    assert dates.exceptAll(Review(q.Derived(spark, SF)).result("project_dates")).count() == 0
    metric = kept.result("metric_completeness")
    assert "regexp_replace" not in plan_of(metric)
    assert isinstance(dates.first()["start_date"], dt.date)
