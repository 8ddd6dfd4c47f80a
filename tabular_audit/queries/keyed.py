"""Joins, key checks, duplicates and distinct counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import label_codes
from ..operators import (
    Tab,
    distinct_counts,
    duplicate_keys,
    duplicate_rows,
    enrich,
    families,
    key_match_flags,
    left_join,
    membership_flag,
    unmatched,
    with_group_size,
)
from .registry import query, rounded, table

# ---------------------------------------------------------------- left joins

EVENT_PAIRS = """e AS (SELECT event_id, user_id, nullif(event_type, 'error') AS kind, value FROM events),
pairs AS (SELECT user_id AS uid, kind, round(sum(value), 6) AS value, count(*) AS events
          FROM e GROUP BY ALL)"""


def _events(spark, d):
    return table(spark, d, "events").select(
        "event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("kind"), "value"
    )


def _pairs(spark, d):
    out = _events(spark, d).groupBy(F.col("user_id").alias("uid"), "kind").agg(
        F.sum("value").alias("value"), F.count("*").alias("events")
    )
    return rounded(out, "value")


@query("WITH " + EVENT_PAIRS + """ SELECT event_id, e.user_id, e.kind, e.value AS value_event,
    p.value AS value_pair, p.events FROM e LEFT JOIN pairs p
    ON e.user_id IS NOT DISTINCT FROM p.uid AND e.kind IS NOT DISTINCT FROM p.kind""")
def enrich_null_safe(spark, d):
    pairs = Tab(_pairs(spark, d), {"user_id": "uid", "kind": "kind"},
                suffixes=("_event", "_pair"), unique=True)
    return enrich(_events(spark, d), pairs)


@query("WITH " + EVENT_PAIRS + """ SELECT event_id, e.user_id, e.kind, e.value AS value_event,
    p.value AS value_pair, p.events FROM e LEFT JOIN pairs p
    ON e.user_id = p.uid AND e.kind = p.kind""")
def enrich_plain_keys(spark, d):
    pairs = Tab(_pairs(spark, d), {"user_id": "uid", "kind": "kind"}, suffixes=("_event", "_pair"))
    return enrich(_events(spark, d), pairs, match_nulls=False)


@query("""
    WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders),
    l AS (SELECT l_orderkey, nullif(l_linestatus, 'O') AS status, l_linenumber, l_quantity
          FROM lineitem)
    SELECT o.o_orderkey, o.status, l.status AS status_line, l_linenumber, l_quantity
    FROM o LEFT JOIN l ON o_orderkey IS NOT DISTINCT FROM l_orderkey""")
def join_with_fan_out(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", F.nullif("l_linestatus", F.lit("O")).alias("status"), "l_linenumber",
        "l_quantity")
    return left_join(orders, lines, {"o_orderkey": "l_orderkey"}, suffixes=("", "_line"))


@query("""
    WITH s AS (SELECT p_partkey, nullif(p_brand, 'Brand#1') AS brand FROM part),
    t AS (SELECT nullif(p_brand, 'Brand#1') AS brand, p_type, count(*) AS n FROM part GROUP BY ALL)
    SELECT p_partkey, s.brand, p_type, n FROM s LEFT JOIN t ON s.brand IS NOT DISTINCT FROM t.brand""")
def join_with_hot_keys(spark, d):
    brand = F.nullif("p_brand", F.lit("Brand#1")).alias("brand")
    parts = table(spark, d, "part")
    kinds = parts.groupBy(brand, "p_type").agg(F.count("*").alias("n"))
    # Every brand with six kinds counts as hot here, the others do not.
    return left_join(parts.select("p_partkey", brand), kinds, "brand", hot_share=100)


@query("""
    SELECT o.*, coalesce(c.c_name, NULL) AS c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment,
           n.n_name, n.n_regionkey, r.r_name,
           CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 1 ELSE 0 END
             AS has_lines,
           CASE r.r_regionkey WHEN 1 THEN 'Applied Research and Development'
             WHEN 2 THEN 'Technology Demonstration and Deployment'
             WHEN 3 THEN 'Market Facilitation' ELSE 'other/unknown' END AS kind
    FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey
    LEFT JOIN nation n ON c_nationkey = n_nationkey
    LEFT JOIN region r ON n_regionkey = r_regionkey""")
def wide_report(spark, d):
    wide = enrich(
        table(spark, d, "orders"),
        Tab(table(spark, d, "customer"), {"o_custkey": "c_custkey"}, unique=True),
        Tab(table(spark, d, "nation"), {"c_nationkey": "n_nationkey"}, unique=True),
        Tab(table(spark, d, "region"), {"n_regionkey": "r_regionkey"}, unique=True),
    )
    flagged = membership_flag(
        wide, table(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"}, "has_lines"
    )
    return flagged.withColumn("kind", label_codes("n_regionkey"))


@query("""
    WITH s AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders),
    t AS (SELECT nullif(l_linestatus, 'F') AS status, l_returnflag, count(*) AS lines
          FROM lineitem GROUP BY ALL),
    u AS (SELECT nullif(o_orderstatus, 'O') AS status, o_orderpriority, count(*) AS orders
          FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL)
    SELECT o_orderkey, s.status, l_returnflag, lines, o_orderpriority, u.orders
    FROM s LEFT JOIN t ON s.status IS NOT DISTINCT FROM t.status
    LEFT JOIN u ON s.status IS NOT DISTINCT FROM u.status""")
def tabs_with_hot_keys(spark, d):
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").groupBy(
        F.nullif("l_linestatus", F.lit("F")).alias("status"), "l_returnflag"
    ).agg(F.count("*").alias("lines"))
    kinds = orders.where("o_orderpriority <> '5-LOW'").groupBy(
        F.nullif("o_orderstatus", F.lit("O")).alias("status"), "o_orderpriority"
    ).agg(F.count("*").alias("orders"))
    base = orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    # Hot in one table, in both, or in one and absent from the other.
    return enrich(base, Tab(lines, "status"), Tab(kinds, "status"), hot_share=100)


# ---------------------------------------------------------------- key checks

@query("""
    SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 1 ELSE 0
           END AS is_labelled
    FROM documents d""")
def membership_flags(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return membership_flag(docs, table(spark, d, "labels"), "doc_id", "is_labelled")


@query("""
    WITH known AS (SELECT DISTINCT nullif(l_linestatus, 'O') AS status FROM lineitem)
    SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM known WHERE status IS NOT DISTINCT FROM
           nullif(o_orderstatus, 'P')) THEN 1 ELSE 0 END AS known
    FROM orders""")
def membership_with_nulls(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    lines = table(spark, d, "lineitem").select(
        F.nullif("l_linestatus", F.lit("O")).alias("status"))
    flagged = membership_flag(orders, lines, {"o_orderstatus": "status"}, "known")
    return flagged.drop("o_orderstatus")


@query("""SELECT *, true AS nomatch FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)""")
def unmatched_keys(spark, d):
    return unmatched(
        table(spark, d, "orders"), table(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"},
        flag="nomatch",
    )


@query("""
    WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders),
    l AS (SELECT l_orderkey, nullif(l_linestatus, 'O') AS status FROM lineitem)
    SELECT o_orderkey, status,
      o_orderkey IN (SELECT l_orderkey FROM l) AS o_orderkey_match,
      EXISTS (SELECT 1 FROM l WHERE l.status IS NOT DISTINCT FROM o.status) AS status_match,
      EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = o.o_orderkey
              AND l.status IS NOT DISTINCT FROM o.status) AS key_match
    FROM o""")
def key_matches(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", F.nullif("l_linestatus", F.lit("O")).alias("status"))
    return key_match_flags(orders, lines, {"o_orderkey": "l_orderkey", "status": "status"})


# ---------------------------------------------------------------- duplicates

@query("""SELECT * FROM lineitem
    QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""")
def duplicate_line_rows(spark, d):
    return duplicate_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, count(*) AS nrows FROM lineitem
    GROUP BY ALL HAVING count(*) > 1""")
def duplicate_key_counts(spark, d):
    return duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT event_id, nullif(event_type, 'error') AS kind,
    count(*) OVER (PARTITION BY nullif(event_type, 'error')) AS total FROM events""")
def group_size_per_row(spark, d):
    return with_group_size(_events(spark, d).select("event_id", "kind"), ["kind"])


# ---------------------------------------------------------------- distinct counts

_KINDS = "(SELECT user_id, nullif(event_type, 'error') AS kind, props FROM events)"


@query(f"""SELECT 'user_id' AS "column", count(DISTINCT user_id) AS num_distinct FROM {_KINDS}
    UNION ALL SELECT 'kind', count(DISTINCT kind) FROM {_KINDS}
    UNION ALL SELECT 'props', count(DISTINCT props) FROM {_KINDS}""")
def distinct_non_null(spark, d):
    events = table(spark, d, "events").withColumn("kind", F.nullif("event_type", F.lit("error")))
    return distinct_counts(events, ["user_id", "kind", "props"])


@query(f"""SELECT 'user_id' AS "column", count(DISTINCT user_id) AS num_distinct FROM {_KINDS}
    UNION ALL SELECT 'kind', count(DISTINCT kind) + 1 FROM {_KINDS}
    UNION ALL SELECT 'props', count(DISTINCT props) FROM {_KINDS}""")
def distinct_with_null(spark, d):
    events = table(spark, d, "events").withColumn("kind", F.nullif("event_type", F.lit("error")))
    return distinct_counts(events, ["user_id", "kind", "props"], count_null=True)


@query("""
    WITH x AS (SELECT regexp_replace(p_name, '(?s)( ring| plate).*', '') AS base_id, p_name FROM part)
    SELECT DISTINCT base_id, p_name
    FROM (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY base_id) > 1)
    WHERE p_name IS NOT NULL""")
def id_families(spark, d):
    return families(table(spark, d, "part"), "p_name", markers=[" ring", " plate"])


@query("""
    WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS code,
                      regexp_replace(CAST(p_partkey AS VARCHAR), '(?s)(77|5).*', '') AS base_id
               FROM part)
    SELECT base_id, code FROM x QUALIFY count(*) OVER (PARTITION BY base_id) > 1""")
def id_families_with_singles(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("code"))
    return families(parts, "code", markers=["77", "5"])
