"""Loading, publishing and joining checked through whole tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators import distinct_counts, fan_out, hot_keys, share
from ..plans.programme import wide_tabs
from ..sources import (
    Shelf, publish_reports, read_lenient, read_published, shared_folder, write_report,
)
from . import portfolio as q
from .registry import query, rounded, table


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


# ---------------------------------------------------------------- cells set aside

# Orders as an export in which every 97th amount and every 89th key is no number.
_ORDERS_AS_TEXT = {
    "key": "CASE WHEN o_orderkey % 89 = 0 THEN concat('#', o_orderkey) ELSE CAST(o_orderkey AS STRING) END",
    "amount": "CASE WHEN o_orderkey % 97 = 0 THEN 'n.a.' WHEN o_orderkey % 101 <> 0 "
              "THEN CAST(o_custkey AS STRING) END",
    "priority": "o_orderpriority",
}
_CELLS = T.StructType([T.StructField("key", T.LongType()), T.StructField("amount", T.DoubleType()),
                       T.StructField("priority", T.StringType())])
_CELLS_SQL = """
  SELECT 'row' AS kind, CASE WHEN o_orderkey % 89 <> 0 THEN o_orderkey END AS key,
         CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey % 101 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS amount,
         o_orderpriority AS priority, NULL AS "column", NULL AS text
  FROM orders
  UNION ALL SELECT 'reject', NULL, NULL, NULL, 'key', '#' || CAST(o_orderkey AS VARCHAR) FROM orders
  WHERE o_orderkey % 89 = 0
  UNION ALL SELECT 'reject', NULL, NULL, NULL, 'amount', 'n.a.' FROM orders WHERE o_orderkey % 97 = 0"""


def cells_set_aside(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    path = scratch(spark, f"cells-{fmt}")
    texts = table(spark, d, "orders").selectExpr(*[f"{sql} AS {name}" for name, sql in _ORDERS_AS_TEXT.items()])
    write_report(texts, path, fmt)
    rows, rejects = read_lenient(spark, path, _CELLS, fmt, most_rejects=texts.count())
    return rows.withColumn("kind", F.lit("row")).unionByName(
        rejects.select("column", "text", F.lit("reject").alias("kind")), allowMissingColumns=True)


@query(_CELLS_SQL)
def csv_cells_set_aside(spark, d):
    return cells_set_aside(spark, d, "csv")


@query(_CELLS_SQL)
def json_cells_set_aside(spark, d):
    return cells_set_aside(spark, d, "json")


# ---------------------------------------------------------------- reports

_YEARS = """
  SELECT nullif(o_orderpriority, '5-LOW') AS priority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n
  FROM orders GROUP BY ALL"""


def order_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.year("o_orderdate").alias("year")
    ).agg(F.count("*").alias("n"))


@query(f"""
    SELECT *, row_number() OVER (ORDER BY priority NULLS LAST, year NULLS LAST) AS position FROM ({_YEARS})""")
def report_in_order(spark, d):
    """The place of every row in the files of an ordered report of several files, told
    by file name and position in the file."""
    path = scratch(spark, "ordered")
    write_report(order_years(spark, d), path, order_by=["priority", "year"])
    read = spark.read.parquet(path).select("*", "_metadata.file_name", "_metadata.row_index")
    # The report has one row per group, however long the table.
    sizes = read.groupBy("file_name").agg(F.count("*").alias("rows"))
    before = sizes.withColumn("before", F.coalesce(F.sum("rows").over(
        Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows")
    return read.join(before, "file_name").select(
        "priority", "year", "n", (F.col("before") + F.col("row_index") + 1).cast("long").alias("position"))


@query(f"""
    SELECT 'years' AS report, priority, CAST(year AS VARCHAR) AS value, n FROM ({_YEARS})
    UNION ALL SELECT 'status', NULL, o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus""")
def reports_published(spark, d):
    """Two reports read through the manifest, after a run of which one report fails."""
    folder = scratch(spark, "published")
    years = order_years(spark, d)
    status = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    publish_reports({"years": years, "status": status}, folder, "first", order_by={"years": ["priority", "year"]})
    broken = status.withColumn("n", F.when(F.col("n") > 0, F.raise_error(F.lit("planted"))).otherwise(F.col("n")))
    try:
        publish_reports({"years": years.limit(1), "status": broken}, folder, "second")
    except Exception as error:
        if "planted" not in str(error):
            raise
    read = {name: read_published(spark, folder, name) for name in ("years", "status")}
    return read["years"].select(
        F.lit("years").alias("report"), "priority", F.col("year").cast("string").alias("value"), "n",
    ).unionByName(read["status"].select(
        F.lit("status").alias("report"), F.lit(None).cast("string").alias("priority"),
        F.col("o_orderstatus").alias("value"), "n"))


@query(f"SELECT *, 1 AS tables FROM ({_YEARS})")
def shelf_shared(spark, d):
    """A table kept by two runs, which find one another's, and gone from the shelf afterwards."""
    shelf, path = Shelf(spark, scratch(spark, "shelf")), scratch(spark, "shelf-result")
    for _ in range(2):
        rows = shelf.keep(order_years(spark, d), "years")
    write_report(rows.withColumn("tables", F.lit(len(shelf.names()))), path)
    shelf.clear()
    return spark.read.parquet(path)


# ---------------------------------------------------------------- joins and counts

@query("""
    WITH t AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey FROM t WHERE n * 1500 > (SELECT sum(n) FROM t)""")
def frequent_parts(spark, d):
    return hot_keys(table(spark, d, "lineitem"), ["l_partkey"], share=1500).select(
        F.col("__key.k0").alias("l_partkey"))


@query(f"SELECT Id, ProjectNo, count(*) AS rows FROM ({q.WIDE}) GROUP BY Id, ProjectNo")
def wide_fan_out(spark, d):
    """How many rows of the wide report each project makes, foretold from the keys."""
    derived = q.Derived(spark, d)
    projects = derived.projects.drop("LongitudeX", "LatitudeY").distinct()
    return fan_out(projects, *wide_tabs(derived)).drop("base_rows")


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _line_columns_sql(c: str) -> str:
    if c == "l_returnflag":
        return f"""SELECT '{c}' AS "column", count(DISTINCT nullif({c}, 'A')) + 1 AS num_distinct FROM lineitem"""
    return f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS num_distinct FROM lineitem"""


@query(" UNION ALL ".join(map(_line_columns_sql, _LINE_COLUMNS)))
def distinct_of_many_columns(spark, d):
    lines = table(spark, d, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("A")))
    return distinct_counts(lines, _LINE_COLUMNS, count_null=True)


@query("""
    WITH c AS (SELECT nullif(o_orderstatus, 'O') AS status, o_custkey, count(*) AS n FROM orders GROUP BY ALL)
    SELECT status, o_custkey, n, CAST(sum(n) OVER (PARTITION BY status) AS BIGINT) AS total,
           round(n / sum(n) OVER (PARTITION BY status) * 100, 6) AS pct FROM c""")
def share_within_crowded(spark, d):
    """Groups of very many values, one of them null and holding half of the rows."""
    orders = table(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("O")))
    return rounded(share(orders, ["o_custkey"], within=["status"], with_total=True), "pct")
