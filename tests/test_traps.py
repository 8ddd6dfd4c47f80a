"""Hand-made rows for every place where null, date or naming rules matter."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabular_audit.functions import (
    all_populated,
    any_blank,
    any_populated,
    cut_at,
    indicator,
    label_codes,
    mdy_year,
    null_if_placeholder,
    one_of,
    parse_fixed_mdy,
    parse_mdy,
    percentage,
    populated_nonzero,
    recode,
)
from tabular_audit.functions.fixed_values import LEAD_NAMES, PLACEHOLDERS
from tabular_audit.operators import (
    Tab,
    breakdown,
    completeness,
    completeness_levels,
    describe_numeric,
    distinct_counts,
    distinct_without,
    duplicate_keys,
    duplicate_rows,
    enrich,
    families,
    flag_any_populated,
    frequency_table,
    key_match_flags,
    left_join,
    mean_by,
    membership_flag,
    placeholder_to_null,
    predicate_rate,
    predicate_rate_by,
    reconcile,
    share,
    unmatched,
    verdict_summary,
    with_group_size,
    zero_rate,
)


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame(
        [(1, "a", True), (2, None, False), (3, "c", True), (None, None, None)],
        "Id long, ProjectNo string, IsActive boolean")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame(
        [(1, "a", False, 1.0), (2, None, True, 2.0), (2, None, True, 3.0), (4, "d", True, 4.0)],
        "ProjectId long, ProjectNo string, IsActive boolean, Amount double")


KEY = {"Id": "ProjectId", "ProjectNo": "ProjectNo"}


# ---------------------------------------------------------------- joins

@pytest.mark.parametrize("options", [{}, {"unique": True}, {"hot_share": 10}, {"hot_share": 3}])
def test_left_join_matches_null_keys_and_names_clashes(left, right, options):
    out = left_join(left, right, KEY, suffixes=("_l", "_r"), **options)
    assert out.columns == ["Id", "ProjectNo", "IsActive_l", "IsActive_r", "Amount"]
    assert rows(out) == [
        (1, "a", True, False, 1.0), (2, None, False, True, 2.0), (2, None, False, True, 3.0),
        (3, "c", True, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("options", [{}, {"unique": True}, {"hot_share": 10}])
def test_left_join_without_null_matches(left, right, options):
    out = left_join(left, right, KEY, match_nulls=False, **options).select("Id", "Amount")
    assert rows(out) == [(1, 1.0), (2, None), (3, None), (None, None)]


def test_join_of_null_with_null_multiplies(spark):
    nothing = spark.createDataFrame([(None, 1), (None, 2)], "k string, v int")
    assert left_join(nothing, nothing, "k").count() == 4
    assert left_join(nothing, nothing, "k", hot_share=1).count() == 4


@pytest.mark.parametrize("hot_share", [1000, 3, 1, None])
def test_tabs_on_the_same_key(spark, left, right, hot_share):
    other = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (3, "c", "z")],
                                  "pid long, no string, word string")
    third = spark.createDataFrame([(3, "c", 7)], "pid long, no string, code int")
    out = enrich(
        left,
        Tab(right, KEY, renamed={"IsActive": "IsActive_detail"}),
        Tab(other, {"Id": "pid", "ProjectNo": "no"}),
        Tab(third, {"Id": "pid", "ProjectNo": "no"}, columns=("code",), unique=True),
        hot_share=hot_share,
    )
    assert out.columns == ["Id", "ProjectNo", "IsActive", "IsActive_detail", "Amount", "word", "code"]
    assert rows(out) == [
        (1, "a", True, False, 1.0, "x", None), (1, "a", True, False, 1.0, "y", None),
        (2, None, False, True, 2.0, None, None), (2, None, False, True, 3.0, None, None),
        (3, "c", True, None, None, "z", 7), (None, None, None, None, None, None, None)]


def test_join_keeps_row_count_for_unique_keys(left, right):
    assert left_join(left, right.dropDuplicates(["ProjectId"]), KEY).count() == left.count()


def test_odd_column_names(spark, left):
    market = spark.createDataFrame([("a",), (None,)], "`Agreement Number` string")
    out = membership_flag(left, market, {"ProjectNo": "Agreement Number"}, "in.market")
    assert rows(out.select("Id", "`in.market`")) == [(1, 1), (2, 1), (3, 0), (None, 1)]


def test_unmatched_is_null_safe_and_complete(left, right):
    out = unmatched(left, right, KEY, flag="nomatch")
    assert rows(out.select("Id", "nomatch")) == [(3, True), (None, True)]
    matched = left.count() - out.count()
    assert matched == 2
    assert unmatched(left, right.limit(0), KEY).count() == left.count()


def test_key_match_flags(left, right):
    out = key_match_flags(left, right, KEY).select("Id", "Id_match", "ProjectNo_match", "key_match")
    assert rows(out) == [(1, True, True, True), (2, True, True, True), (3, False, False, False),
                         (None, False, True, False)]


# ---------------------------------------------------------------- predicates

def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, None, 1.0), (3, None, None)],
                               "i int, t string, v double")
    out = df.select("i", all_populated("t", "v"), any_populated("t", "v"), any_blank("t", "v"),
                    populated_nonzero("v"), one_of("t", ["a"]), one_of("t", ["b", None]),
                    indicator(F.col("v") == 0))
    assert rows(out) == [
        (1, True, True, False, False, True, False, 1),
        (2, False, True, True, True, False, True, 0),
        (3, False, False, True, False, False, True, 0)]


# ---------------------------------------------------------------- counts

def test_distinct_counts(spark):
    df = spark.createDataFrame([("A", 1), ("A", None), (None, None)], "x string, y int")
    assert rows(distinct_counts(df, ["x", "y"])) == [("x", 1), ("y", 1)]
    assert rows(distinct_counts(df, ["x", "y"], count_null=True)) == [("x", 2), ("y", 2)]
    assert rows(distinct_counts(df.limit(0), ["x"], count_null=True)) == [("x", 0)]


def test_distinct_counts_of_many_columns(spark):
    df = spark.range(6).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(13)])
    assert dict(rows(distinct_counts(df, df.columns))) == {f"c{i}": min(i + 1, 6) for i in range(13)}


def test_empty_input(spark):
    empty = spark.createDataFrame([], "a string, v double")
    assert rows(predicate_rate(empty, F.col("v") > 0)) == [(0, 0, None)]
    assert rows(completeness(empty, ["a"])) == [("a", 0, 0, None)]
    assert rows(mean_by(empty, "v")) == [(None,)]
    assert rows(mean_by(empty, "v", ["a"])) == []
    assert rows(zero_rate(empty, "v")) == [(0, 0, None)]
    assert rows(share(empty, ["a"])) == []
    assert rows(describe_numeric(empty, "v")) == [(None,) * 6]
    assert rows(verdict_summary(reconcile(empty, "a", "a", ["a"]), "match")) == [(0, 0, 0, None)]


def test_percentage_of_nothing(spark):
    out = spark.createDataFrame([(1, 0), (0, 0), (1, 4)], "a int, b int").select(percentage("a", "b"))
    assert rows(out) == [(25.0,), (None,), (None,)]


def test_null_groups(spark):
    df = spark.createDataFrame([(None, "x", 1.0), ("p", None, 3.0), ("p", "x", None)],
                               "admin string, t string, v double")
    assert rows(completeness(df, ["t"], ["admin"])) == [
        ("p", "t", 2, 1, 50.0), (None, "t", 1, 1, 100.0)]
    assert rows(mean_by(df, "v", ["admin"], keep_null_groups=False)) == [("p", 3.0)]
    assert rows(mean_by(df, "v", ["admin"])) == [("p", 3.0), (None, 1.0)]
    assert rows(share(df, ["t"], within=["admin"], drop_null=True)) == [("p", "x", 1, 100.0)]
    assert rows(share(df, ["t"], within=["admin"])) == [
        ("p", "x", 1, 50.0), ("p", None, 1, 50.0), (None, "x", 1, 100.0)]
    assert rows(frequency_table(df, "admin")) == [("p", 2)]


def test_groups_without_hits_vanish(spark):
    df = spark.createDataFrame([("p", True), ("p", False), ("q", False), ("q", None)],
                               "admin string, f boolean")
    assert rows(predicate_rate_by(df, F.col("f"), ["admin"])) == [("p", 1, 2, 50.0)]
    assert rows(predicate_rate_by(df, F.col("f"), ["admin"], keep_empty=True)) == [
        ("p", 1, 2, 50.0), ("q", 0, 2, 0.0)]
    assert rows(predicate_rate_by(df, ~F.col("f"), ["admin"], base=F.col("f").isNotNull())) == [
        ("p", 1, 2, 50.0), ("q", 1, 1, 100.0)]


def test_blank_and_populated_breakdown_add_up(spark):
    df = spark.createDataFrame(
        [("p", True, "x", None), ("p", True, None, None), ("q", None, "y", "z")],
        "admin string, active boolean, a string, b string")
    blank = breakdown(df, ["a", "b"], ["admin", "active"])
    assert rows(blank) == [("p", True, "a", 1), ("p", True, "b", 2)]
    populated = breakdown(df, ["a", "b"], ["admin", "active"], blank=False, with_pct=True)
    assert rows(populated) == [
        ("p", True, "a", 1, 50.0), ("q", None, "a", 1, 50.0), ("q", None, "b", 1, 100.0)]
    total = blank.agg(F.sum("n")).first()[0] + populated.agg(F.sum("n")).first()[0]
    assert total == df.count() * 2


def test_completeness_levels_equal_single_levels(spark):
    df = spark.createDataFrame(
        [("p", 1, "x"), ("p", None, None), (None, 1, "TBD"), (None, None, None)],
        "admin string, y int, t string")
    levels = completeness_levels(df, ["t"], [(), ("admin",), ("admin", "y")], PLACEHOLDERS)
    got = rows(levels)
    one = [(0, None, None, *r) for r in rows(completeness(df, ["t"], (), PLACEHOLDERS))]
    two = [(1, r[0], None, *r[1:]) for r in rows(completeness(df, ["t"], ["admin"], PLACEHOLDERS))]
    three = [(2, *r) for r in rows(completeness(df, ["t"], ["admin", "y"], PLACEHOLDERS))]
    assert got == sorted(one + two + three, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_placeholders_count_as_populated_only_on_request(spark):
    df = spark.createDataFrame([("TBD",), ("text",), (None,)], "t string")
    assert rows(completeness(df, ["t"]))[0][2] == 2
    assert rows(completeness(df, ["t"], placeholders=PLACEHOLDERS))[0][2] == 1


def test_zero_rates(spark):
    df = spark.createDataFrame([(None,), (0.0,), (5.0,), (7.0,)], "v double")
    assert rows(zero_rate(df, "v")) == [(3, 1, pytest.approx(100 / 3))]
    assert rows(zero_rate(df, "v", drop_null=False)) == [(4, 1, 25.0)]
    assert rows(mean_by(df, "v", nonzero=True)) == [(6.0,)]
    assert rows(mean_by(df, "v")) == [(4.0,)]


def test_verdicts(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "a", None)],
                               "k int, l string, r string")
    detail = reconcile(df, "l", "r", ["k"])
    assert rows(detail) == [(1, "a", "a", True), (2, "a", "b", False), (3, "a", None, None)]
    assert rows(verdict_summary(detail, "match")) == [(3, 1, 1, pytest.approx(100 / 3))]


def test_quartiles(spark):
    def quartiles(values):
        return rows(describe_numeric(spark.createDataFrame([(v,) for v in values], "v double"), "v"))[0]

    assert quartiles([9.0, 1.0, 4.0, 2.0, None]) == (1.0, 1.75, 3.0, 4.0, 5.25, 9.0)
    assert quartiles([5.0]) == (5.0,) * 6
    assert quartiles([2.0] * 50 + [3.0]) == (2.0, 2.0, 2.0, pytest.approx(103 / 51), 2.0, 3.0)
    many = [float((i * 7919) % 1000) for i in range(999)]
    import numpy as np
    want = [min(many), *np.percentile(many, [25, 50]), np.mean(many), np.percentile(many, 75), max(many)]
    assert quartiles(many) == pytest.approx(want)


# ---------------------------------------------------------------- keys

def test_duplicates(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (1, "x", "c"), (2, None, "d")],
                               "i int, j string, v string")
    assert rows(duplicate_keys(df, ["i", "j"])) == [(1, None, 2)]
    assert rows(duplicate_rows(df, ["i", "j"])) == [(1, None, "a"), (1, None, "b")]
    assert [r[-1] for r in rows(with_group_size(df, ["i", "j"]).select("v", "total"))] == [2, 2, 1, 1]


def test_families(spark):
    ids = ["X-1 Module A", "X-1 Module B", "X-2", None, None, "X-3 Project 1", "Y", "Y"]
    df = spark.createDataFrame([(i,) for i in ids], "no string")
    assert rows(families(df, "no")) == [
        ("X-1", "X-1 Module A"), ("X-1", "X-1 Module B"), ("Y", "Y")]


def test_rows_equal_except_for_coordinates(spark):
    df = spark.createDataFrame([(1, None, 1.0, 2.0), (1, None, 3.0, 4.0)],
                               "i int, t string, x double, y double")
    assert rows(distinct_without(df, "x", "y")) == [(1, None)]


# ---------------------------------------------------------------- dates and text

def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression("x")).first()[0]


@pytest.mark.parametrize("text, want", [
    ("05/01/2020", dt.date(2020, 5, 1)), ("5/1/2020", dt.date(2020, 5, 1)),
    ("5/1/20", dt.date(2020, 5, 1)), ("5/1/68", dt.date(2068, 5, 1)), ("5/1/69", dt.date(1969, 5, 1)),
    ("2/29/72", dt.date(1972, 2, 29)), ("5-1-2020", dt.date(2020, 5, 1)),
    ("5.1.20", dt.date(2020, 5, 1)), ("05012020", dt.date(2020, 5, 1)),
    ("May 1, 2020", dt.date(2020, 5, 1)), ("september 30 2021", dt.date(2021, 9, 30)),
    ("SEP 30, 2021", dt.date(2021, 9, 30)), (" 5/1/2020 ", dt.date(2020, 5, 1)),
    ("\t5/1/2020\n", dt.date(2020, 5, 1)), ("5/1/202", None), ("5/1/12020", None),
    ("2020-05-01", None), ("13/40/2020", None), ("2/30/2020", None), ("05/01/2020 00:00", None),
    ("soon", None), ("", None), (None, None),
])
def test_parse_mdy(spark, text, want):
    assert one(spark, text, parse_mdy) == want
    assert one(spark, text, mdy_year) == (want.year if want else None)


@pytest.mark.parametrize("text, want", [
    ("05/01/2020", dt.date(2020, 5, 1)), ("5/1/2020", dt.date(2020, 5, 1)),
    ("5/1/20", dt.date(20, 5, 1)), ("05/01/2020 00:00", dt.date(2020, 5, 1)),
    (" 5/1/2020 ", dt.date(2020, 5, 1)), ("5/ 1/ 2020", dt.date(2020, 5, 1)), ("5 /1/2020", None),
    ("5/1/20201", dt.date(2020, 5, 1)), ("2020-05-01", None), ("13/40/2020", None),
    ("2/30/2020", None), ("5-1-2020", None), (None, None),
])
def test_parse_fixed_mdy(spark, text, want):
    assert one(spark, text, parse_fixed_mdy) == want


def test_cut_at_marker(spark):
    assert one(spark, "X-1 Module 2\ntail", cut_at) == "X-1"
    assert one(spark, "X-1 Project Module", cut_at) == "X-1"
    assert one(spark, "X-1", cut_at) == "X-1"
    assert one(spark, None, cut_at) is None


def test_placeholders(spark):
    for text in PLACEHOLDERS:
        assert one(spark, text, null_if_placeholder) is None
    for text in ("none", " None", "N/a", "real text", ""):
        assert one(spark, text, null_if_placeholder) == text
    df = spark.createDataFrame([("None", "x"), ("TBD", "N/A"), (None, None)], "a string, b string")
    out = flag_any_populated(placeholder_to_null(df, ["a", "b"]), ["a", "b"], "some")
    assert rows(out) == [(None, "x", 1), (None, None, 0), (None, None, 0)]


def test_recode_and_labels(spark):
    for text in ("SCE", "Southern California Edison Company"):
        assert one(spark, text, recode) == "SCE"
    assert one(spark, "Someone else", recode) == "Someone else"
    assert one(spark, None, recode) is None
    assert len(LEAD_NAMES) == 29
    codes = spark.createDataFrame([(1,), (2,), (3,), (9,), (None,)], "c int").select(label_codes("c"))
    assert [r[0] for r in codes.collect()] == [
        "Applied Research and Development", "Technology Demonstration and Deployment",
        "Market Facilitation", "other/unknown", "other/unknown"]
