"""Invariants that hold for any table, checked on the supplied ones."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tabular_audit.functions import parse_mdy
from tabular_audit.operators import (
    breakdown,
    completeness,
    completeness_levels,
    describe_numeric,
    duplicate_keys,
    duplicate_rows,
    left_join,
    membership_flag,
    reconcile,
    share,
    unmatched,
    verdict_summary,
    with_group_size,
)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").drop("text")
    return left_join(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").cache()


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet").cache()


def test_populated_and_blank_make_the_total(docs):
    cols, by = ["quality", "toxic"], ["lang", "source"]
    total = {tuple(r[:3]): (r[3], r[4]) for r in completeness(docs, cols, by).collect()}
    blank = {tuple(r[:3]): r[3] for r in breakdown(docs, cols, by).collect()}
    populated = {tuple(r[:3]): r[3] for r in breakdown(docs, cols, by, blank=False).collect()}
    for group, (n, filled) in total.items():
        assert populated.get(group, 0) == filled
        assert blank.get(group, 0) + filled == n


def test_levels_add_up(docs):
    out = completeness_levels(docs, ["quality"], [(), ("lang",), ("lang", "source")])
    sums = out.groupBy("level").agg(F.sum("total_rows"), F.sum("non_missing_count")).collect()
    assert len({tuple(r[1:]) for r in sums}) == 1 and len(sums) == 3


def test_shares_sum_to_a_hundred(docs):
    whole = share(docs, ["lang", "quality"]).agg(F.sum("pct")).first()[0]
    assert whole == pytest.approx(100)
    within = share(docs, ["quality"], within=["lang"]).groupBy("lang").agg(F.sum("pct")).collect()
    assert all(r[1] == pytest.approx(100) for r in within)


def test_verdicts_make_the_total(lines):
    frame = lines.withColumn("other", F.nullif("l_linestatus", F.lit("O")))
    detail = reconcile(frame, "l_linestatus", "other", ["l_orderkey"])
    total, matches, mismatches, _ = verdict_summary(detail, "match").first()
    assert matches + mismatches + detail.where("match IS NULL").count() == total == lines.count()


def test_matched_and_unmatched_make_all(spark, lines):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    on = {"o_orderkey": "l_orderkey"}
    flagged = membership_flag(orders, lines, on, "known")
    assert flagged.count() == orders.count()
    assert unmatched(orders, lines, on).count() == flagged.where("known = 0").count()


def test_duplicates_by_two_routes(lines):
    keys = ["l_orderkey", "l_linenumber"]
    n = duplicate_keys(lines, keys).agg(F.sum("nrows")).first()[0]
    assert duplicate_rows(lines, keys).count() == n
    assert with_group_size(lines, keys).where("total > 1").count() == n


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-1e9, 1e9), st.integers(-3, 3).map(float)),
                min_size=1, max_size=60))
def test_quartiles_equal_built_in(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = describe_numeric(df, "v").first()
    want = df.agg(F.min("v"), F.percentile("v", [0.25, 0.5, 0.75]), F.max("v")).first()
    if all(v is None for v in values):
        assert tuple(got) == (None,) * 6
    else:
        flat = [want[0], *want[1], want[2]]
        assert [got[i] for i in (0, 1, 2, 4, 5)] == pytest.approx(flat, rel=1e-9, abs=1e-6)


def test_every_day_reads_back(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1969-01-01', DATE'2068-12-31')) AS day")
    for pattern in ("MM/dd/yyyy", "M/d/yy", "M-d-yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMddyyyy"):
        assert days.where(~parse_mdy(F.date_format("day", pattern)).eqNullSafe(F.col("day"))).count() == 0
