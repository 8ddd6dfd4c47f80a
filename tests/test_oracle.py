"""Every registered query against its SQL on the supplied tables, and its plan."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle import differences
from tabular_audit.queries import ORACLES as SQL, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
UNWANTED = ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "InArrow", "Sample")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert differences(df, SQL[name], FOLDER) is None
    plan = plan_of(df)
    assert not [word for word in UNWANTED if word in plan]


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "column", "total_rows", "non_missing_count", "percentage"]
    assert df.count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["pull_compound"](spark, FOLDER))
    assert "EqualTo(l_tax,0.0), GreaterThan(l_discount,0.0)" in plan
    assert "l_shipdate" not in plan and "l_extendedprice" not in plan
    plan = plan_of(QUERIES["portfolio_detail_activity"](spark, FOLDER))
    assert "text" not in plan and "c_name" in plan  # rows are made distinct on all columns


def test_many_columns_take_one_aggregate(spark):
    from tabular_audit.operators import completeness

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = plan_of(completeness(docs, ["text", "lang", "n_chars"], ["source"]))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_levels_take_one_read(spark):
    from tabular_audit.operators import completeness_levels

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    df = completeness_levels(docs, ["text", "n_chars"], [(), ("lang",), ("lang", "source")])
    assert plan_of(df).count("FileScan") == 1


def test_unique_tabs_shuffle_the_base_once(spark):
    from tabular_audit.operators import Tab, enrich

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
        lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy("l_orderkey")
        tabs = [Tab(lines.agg(F.count("*").alias(n)), {"o_orderkey": "l_orderkey"}, unique=True)
                for n in ("a", "b", "c")]
        plan = plan_of(enrich(orders, *tabs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(coalesce(o_orderkey") == 1
