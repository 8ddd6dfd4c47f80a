"""Completeness, rates, shares, averages, funding rules and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import (
    all_populated,
    any_blank,
    cut_at,
    label_codes,
    mdy_year,
    one_of,
    parse_fixed_mdy,
    parse_mdy,
    recode,
)
from ..operators import (
    Spellings,
    breakdown,
    cohort_by_year,
    completeness,
    completeness_levels,
    covers,
    describe_numeric,
    distinct_without,
    duration_weeks,
    first_values,
    flag_any_populated,
    frequency_table,
    left_join,
    literal_rate_by,
    mean_by,
    placeholder_to_null,
    predicate_rate,
    predicate_rate_by,
    pull,
    reconcile,
    rule_check,
    share,
    verdict_summary,
    within_budget,
    zero_rate,
)
from .registry import columns_sql, query, rounded, table

# ---------------------------------------------------------------- inputs

LABELLED = """labelled AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         nullif(l.toxic, 0) AS toxic_raised
  FROM documents d LEFT JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels; the gaps are the documents without any."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return left_join(docs, table(spark, d, "labels"), "doc_id").withColumn(
        "toxic_raised", F.nullif(F.col("toxic"), F.lit(0))
    )


ORDERS_TEXT = """orders_text AS (
  SELECT *, nullif(o_orderpriority, '5-LOW') AS priority,
         strftime(o_orderdate, '%m/%d/%Y') AS start_text FROM orders)"""


def orders_text(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the date as month/day/year text and some priorities missing."""
    return table(spark, d, "orders").withColumns({
        "priority": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")),
        "start_text": F.date_format("o_orderdate", "MM/dd/yyyy"),
    })


# ---------------------------------------------------------------- completeness

COMPLETE = ["quality", "toxic", "toxic_raised"]


@query("WITH " + LABELLED + columns_sql(
    """ SELECT lang, '{c}' AS "column", count(*) AS total_rows, count({c}) AS non_missing_count,
        round(count({c}) * 100.0 / count(*), 6) AS percentage FROM labelled GROUP BY lang""",
    COMPLETE))
def completeness_by_group(spark, d):
    return rounded(completeness(labelled(spark, d), COMPLETE, ["lang"]), "percentage")


@query("WITH " + LABELLED + columns_sql(
    """ SELECT '{c}' AS "column", count(*) AS total_rows, count({c}) AS non_missing_count,
        round(count({c}) * 100.0 / count(*), 6) AS percentage FROM labelled""", COMPLETE))
def completeness_global(spark, d):
    return rounded(completeness(labelled(spark, d), COMPLETE), "percentage")


@query("WITH " + ORDERS_TEXT + """
    SELECT o_orderstatus, CAST(year(try_strptime(start_text, '%m/%d/%Y')) AS INTEGER) AS year,
           'priority' AS "column", count(*) AS total_rows, count(priority) AS non_missing_count,
           round(count(priority) * 100.0 / count(*), 6) AS percentage
    FROM orders_text GROUP BY ALL""")
def completeness_by_group_year(spark, d):
    out = completeness(
        orders_text(spark, d), ["priority"], ["o_orderstatus", mdy_year("start_text").alias("year")]
    )
    return rounded(out, "percentage")


@query("""
    WITH x AS (SELECT o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p FROM orders)
    SELECT o_orderstatus, 'p' AS "column", count(*) AS total_rows,
           count(*) FILTER (p NOT IN ('4-NOT SPECIFIED', '3-MEDIUM')) AS non_missing_count,
           round(count(*) FILTER (p NOT IN ('4-NOT SPECIFIED', '3-MEDIUM')) * 100.0 / count(*), 6)
             AS percentage
    FROM x GROUP BY o_orderstatus""")
def completeness_without_placeholders(spark, d):
    rows = orders_text(spark, d).withColumnRenamed("priority", "p")
    out = completeness(rows, ["p"], ["o_orderstatus"], ["4-NOT SPECIFIED", "3-MEDIUM"])
    return rounded(out, "percentage")


_LEVEL = """ SELECT {lvl} AS level, {lang} AS lang, {src} AS source, '{c}' AS "column",
    count(*) AS total_rows, count({c}) AS non_missing_count,
    round(count({c}) * 100.0 / count(*), 6) AS percentage FROM labelled {grp}"""


def _level(lvl, lang, src, grp):
    one = _LEVEL.replace("{lvl}", lvl).replace("{lang}", lang).replace("{src}", src)
    return columns_sql(one.replace("{grp}", grp), COMPLETE)


@query("WITH " + LABELLED + " UNION ALL ".join([
    _level("0", "NULL", "NULL", ""),
    _level("1", "lang", "NULL", "GROUP BY lang"),
    _level("2", "lang", "source", "GROUP BY lang, source")]))
def completeness_at_levels(spark, d):
    out = completeness_levels(
        labelled(spark, d), COMPLETE, [(), ("lang",), ("lang", "source")]
    )
    return rounded(out, "percentage")


def _breakdown_sql(test: str, pct: bool) -> str:
    share_of_all = ", round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct" if pct else ""
    return "WITH " + LABELLED + columns_sql(
        f""" SELECT lang, source, '{{c}}' AS "column", count(*) AS n{share_of_all}
        FROM labelled WHERE {{c}} {test} GROUP BY lang, source""", COMPLETE)


@query(_breakdown_sql("IS NULL", False))
def blank_breakdown(spark, d):
    return breakdown(labelled(spark, d), COMPLETE, ["lang", "source"])


@query(_breakdown_sql("IS NOT NULL", True))
def populated_breakdown(spark, d):
    out = breakdown(labelled(spark, d), COMPLETE, ["lang", "source"], blank=False, with_pct=True)
    return rounded(out, "pct")


# ---------------------------------------------------------------- rates

@query("""
    SELECT count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS n,
           count(*) AS total,
           round(count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') * 100.0
                 / count(*), 6) AS percentage
    FROM orders""")
def predicate_rate_global(spark, d):
    closed_urgent = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    return rounded(predicate_rate(table(spark, d, "orders"), closed_urgent), "percentage")


@query("""
    WITH x AS (SELECT c_mktsegment, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p
               FROM orders LEFT JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey)
    SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F' AND p = '1-URGENT') AS n,
           count(*) AS total,
           round(count(*) FILTER (o_orderstatus = 'F' AND p = '1-URGENT') * 100.0 / count(*), 6)
             AS percentage
    FROM x WHERE o_orderstatus IS NOT NULL AND p IS NOT NULL GROUP BY c_mktsegment
    HAVING count(*) FILTER (o_orderstatus = 'F' AND p = '1-URGENT') > 0""")
def predicate_rate_by_group(spark, d):
    rows = left_join(
        orders_text(spark, d).select("o_custkey", "o_orderstatus", "priority"),
        table(spark, d, "customer").select("c_custkey", "c_mktsegment"),
        {"o_custkey": "c_custkey"},
    )
    out = predicate_rate_by(
        rows,
        (F.col("o_orderstatus") == "F") & (F.col("priority") == "1-URGENT"),
        ["c_mktsegment"],
        base=all_populated("o_orderstatus", "priority"),
    )
    return rounded(out, "percentage")


@query("""
    SELECT c_nationkey, count(*) FILTER (c_acctbal < -990) AS n, count(*) AS total,
           round(count(*) FILTER (c_acctbal < -990) * 100.0 / count(*), 6) AS percentage
    FROM customer GROUP BY c_nationkey HAVING count(*) FILTER (c_acctbal < -990) > 0""")
def rate_without_empty_groups(spark, d):
    out = predicate_rate_by(table(spark, d, "customer"), F.col("c_acctbal") < -990, ["c_nationkey"])
    return rounded(out, "percentage")


@query("""
    WITH x AS (SELECT user_id, nullif(event_type, 'error') AS e FROM events)
    SELECT user_id, count(*) FILTER (e = 'purchase') AS n, count(*) AS total,
           round(count(*) FILTER (e = 'purchase') * 100.0 / count(*), 6) AS percentage
    FROM x WHERE e IS NOT NULL GROUP BY user_id""")
def literal_rate_by_group(spark, d):
    rows = table(spark, d, "events").withColumn("e", F.nullif("event_type", F.lit("error")))
    return rounded(literal_rate_by(rows, "e", "purchase", ["user_id"]), "percentage")


def _zero_sql(col: str, by: str, where: str) -> str:
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""
    WITH x AS (SELECT l_returnflag, nullif({col}, 0.05) AS {col} FROM lineitem)
    SELECT {lead}count(*) AS total_entries, count(*) FILTER ({col} = 0) AS zero_count,
           round(count(*) FILTER ({col} = 0) * 100.0 / count(*), 6) AS percentage_zero
    FROM x {where}{group}"""


def _gapped(spark, d, col):
    return table(spark, d, "lineitem").withColumn(col, F.nullif(col, F.lit(0.05)))


@query(_zero_sql("l_tax", "", "WHERE l_tax IS NOT NULL"))
def zero_rate_populated(spark, d):
    return rounded(zero_rate(_gapped(spark, d, "l_tax"), "l_tax"), "percentage_zero")


@query(_zero_sql("l_tax", "", ""))
def zero_rate_all(spark, d):
    out = zero_rate(_gapped(spark, d, "l_tax"), "l_tax", drop_null=False)
    return rounded(out, "percentage_zero")


@query(_zero_sql("l_discount", "l_returnflag", "WHERE l_discount IS NOT NULL"))
def zero_rate_by_group_populated(spark, d):
    out = zero_rate(_gapped(spark, d, "l_discount"), "l_discount", ["l_returnflag"])
    return rounded(out, "percentage_zero")


@query(_zero_sql("l_discount", "l_returnflag", ""))
def zero_rate_by_group_all(spark, d):
    out = zero_rate(_gapped(spark, d, "l_discount"), "l_discount", ["l_returnflag"], drop_null=False)
    return rounded(out, "percentage_zero")


# ---------------------------------------------------------------- shares

@query("""SELECT event_type, count(*) AS n,
           round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
    FROM events GROUP BY event_type""")
def share_total(spark, d):
    return rounded(share(table(spark, d, "events"), ["event_type"]), "pct")


@query("""
    WITH x AS (SELECT nullif(o_orderpriority, '5-LOW') AS priority,
                      nullif(o_orderstatus, 'P') AS status FROM orders)
    SELECT priority, status, count(*) AS n,
           round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY priority), 6) AS pct
    FROM x WHERE priority IS NOT NULL AND status IS NOT NULL GROUP BY priority, status""")
def share_within(spark, d):
    rows = orders_text(spark, d).withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return rounded(share(rows, ["status"], within=["priority"], drop_null=True), "pct")


@query("WITH " + ORDERS_TEXT + """
    SELECT priority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
           CAST(sum(count(*)) OVER (PARTITION BY priority) AS BIGINT) AS total,
           round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY priority), 6) AS pct
    FROM orders_text GROUP BY priority, CAST(year(o_orderdate) AS INTEGER)""")
def year_share_by_group(spark, d):
    out = share(
        orders_text(spark, d), [mdy_year("start_text").alias("year")], within=["priority"],
        with_total=True,
    )
    return rounded(out, "pct")


@query("""SELECT nullif(event_type, 'error') AS event_type, count(*) AS n FROM events
          WHERE event_type <> 'error' GROUP BY 1""")
def frequency(spark, d):
    rows = table(spark, d, "events").withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return frequency_table(rows, "event_type")


# ---------------------------------------------------------------- averages

@query("""SELECT l_returnflag, round(avg(l_discount), 6) AS average
    FROM lineitem WHERE l_discount IS NOT NULL AND l_discount <> 0 GROUP BY l_returnflag""")
def mean_by_nonzero(spark, d):
    out = mean_by(table(spark, d, "lineitem"), "l_discount", ["l_returnflag"], nonzero=True)
    return rounded(out, "average")


@query("""SELECT round(avg(l_tax), 6) AS average FROM lineitem WHERE l_tax <> 0""")
def mean_global_nonzero(spark, d):
    return rounded(mean_by(table(spark, d, "lineitem"), "l_tax", nonzero=True), "average")


@query("WITH " + ORDERS_TEXT + """
    SELECT priority, round(avg(o_totalprice), 6) AS average
    FROM orders_text WHERE priority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY priority""")
def mean_by_named_groups(spark, d):
    out = mean_by(orders_text(spark, d), "o_totalprice", ["priority"], keep_null_groups=False)
    return rounded(out, "average")


@query("""SELECT o_orderstatus, round(avg(o_totalprice), 6) AS average,
           min(o_totalprice) AS minimum, max(o_totalprice) AS maximum
    FROM orders WHERE o_totalprice <> 0 GROUP BY o_orderstatus""")
def stats_by(spark, d):
    out = mean_by(
        table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"], nonzero=True, extremes=True
    )
    return rounded(out, "average")


def _summary_sql(col: str, source: str) -> str:
    quartile = "round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6)"
    q1, q2, q3 = (quartile.format(c=col, p=p) for p in (0.25, 0.5, 0.75))
    return f"""SELECT min({col}) AS minimum, {q1} AS q1, {q2} AS median,
        round(avg({col}), 6) AS mean, {q3} AS q3, max({col}) AS maximum FROM {source}"""


@query(_summary_sql("o_totalprice", "orders"))
def describe_amounts(spark, d):
    out = describe_numeric(table(spark, d, "orders"), "o_totalprice")
    return rounded(out, "q1", "median", "mean", "q3")


@query(_summary_sql("l_tax", "(SELECT nullif(l_tax, 0) AS l_tax FROM lineitem)"))
def describe_repeated_amounts(spark, d):
    rows = table(spark, d, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return rounded(describe_numeric(rows, "l_tax"), "q1", "median", "mean", "q3")


# ---------------------------------------------------------------- dates

@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
             THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed_fixed
    FROM orders""")
def parse_date_spellings(spark, d):
    spelling = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format("o_orderdate", "M/d/yyyy"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format("o_orderdate", "M-d-yy"))
        .when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "MMMM d, yyyy"))
        .otherwise(F.date_format("o_orderdate", "MM.dd.yy"))
    )
    rows = table(spark, d, "orders").withColumn("written", spelling)
    return rows.select(
        "o_orderkey",
        parse_mdy("written").cast("string").alias("parsed"),
        parse_fixed_mdy("written").cast("string").alias("parsed_fixed"),
    )


@query("""
    SELECT l_returnflag, round(avg(date_diff('day', o_orderdate, l_shipdate) / 7.0), 6) AS average
    FROM lineitem LEFT JOIN orders ON l_orderkey IS NOT DISTINCT FROM o_orderkey
    WHERE o_orderdate IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY l_returnflag""")
def duration_weeks_by(spark, d):
    rows = left_join(
        table(spark, d, "lineitem").select(
            "l_orderkey", "l_returnflag",
            F.date_format("l_shipdate", "MM/dd/yyyy").alias("ended")),
        table(spark, d, "orders").select(
            "o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("started")),
        {"l_orderkey": "o_orderkey"},
        unique=True,
    )
    out = mean_by(duration_weeks(rows, "started", "ended"), "duration_weeks", ["l_returnflag"])
    return rounded(out, "average")


# ---------------------------------------------------------------- text

@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'INDUSTRY'
           WHEN 'AUTOMOBILE' THEN 'INDUSTRY' WHEN 'FURNITURE' THEN 'HOUSEHOLD'
           ELSE c_mktsegment END AS segment FROM customer""")
def recode_labels(spark, d):
    names = {"MACHINERY": "INDUSTRY", "AUTOMOBILE": "INDUSTRY", "FURNITURE": "HOUSEHOLD"}
    return table(spark, d, "customer").select(
        "c_custkey", recode("c_mktsegment", names).alias("segment")
    )


@query("""SELECT p_partkey, CASE nullif(p_size, 2) WHEN 1 THEN 'Applied Research and Development'
           WHEN 3 THEN 'Market Facilitation' ELSE 'other/unknown' END AS kind FROM part""")
def code_labels(spark, d):
    code = F.nullif(F.col("p_size"), F.lit(2))
    return table(spark, d, "part").select("p_partkey", label_codes(code).alias("kind"))


@query("""SELECT doc_id, regexp_replace(text, '(?s)( the | la |\\n).*', '') AS head
          FROM documents""")
def cut_text(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", cut_at("text", [" the ", " la ", "\n"]).alias("head")
    )


# ---------------------------------------------------------------- selections

@query("""SELECT DISTINCT text, lang, source, n_chars FROM documents""")
def drop_and_distinct(spark, d):
    return distinct_without(table(spark, d, "documents"), "doc_id")


@query("WITH " + LABELLED + """ SELECT doc_id, lang FROM labelled
    WHERE quality IS NOT NULL AND toxic_raised IS NOT NULL""")
def all_fields_populated(spark, d):
    return pull(labelled(spark, d), all_populated("quality", "toxic_raised"), "doc_id", "lang")


@query("WITH " + LABELLED + """ SELECT lang, count(*) AS n FROM labelled
    WHERE quality IS NULL OR toxic_raised IS NULL GROUP BY lang""")
def any_field_blank(spark, d):
    return frequency_table(pull(labelled(spark, d), any_blank("quality", "toxic_raised")), "lang")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_tax, l_discount FROM lineitem
          WHERE l_tax = 0 AND l_discount > 0""")
def pull_compound(spark, d):
    return pull(
        table(spark, d, "lineitem"), (F.col("l_tax") == 0) & (F.col("l_discount") > 0),
        "l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount",
    )


@query("WITH " + ORDERS_TEXT + """ SELECT o_orderkey, priority,
           CAST(year(o_orderdate) AS INTEGER) AS start_year
    FROM orders_text WHERE priority IN ('1-URGENT', '2-HIGH')""")
def pull_members(spark, d):
    rows = pull(orders_text(spark, d), one_of("priority", ["1-URGENT", "2-HIGH"]))
    return rows.select("o_orderkey", "priority", mdy_year("start_text").alias("start_year"))


@query("""
    WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN 'soon'
        WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%-m-%-d-%Y')
        ELSE strftime(o_orderdate, '%B %-d, %Y') END AS written, o_orderdate FROM orders)
    SELECT o_orderkey, written, CASE WHEN written IS NOT NULL AND written <> 'soon'
        THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM x""")
def dates_by_spelling(spark, d):
    """Dates in several spellings, no dates and nulls, each text read once."""
    key = F.col("o_orderkey")
    written = F.when(key % 89 == 0, F.lit(None)).when(key % 83 == 0, F.lit("soon")).when(
        key % 3 == 0, F.date_format("o_orderdate", "M-d-yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    rows = table(spark, d, "orders").select("o_orderkey", written.alias("written"))
    dated = Spellings.of(rows, ["written"]).onto(rows, {"parsed": "written"})
    return dated.withColumn("parsed", F.col("parsed").cast("string"))


@query("""SELECT strftime(o_orderdate, '%m/%d/%Y') AS start_text FROM orders
          ORDER BY o_orderkey LIMIT 6""")
def first_six_values(spark, d):
    return first_values(orders_text(spark, d), "start_text", 6, order_by=["o_orderkey"])


# ---------------------------------------------------------------- agreement and rules

LINES_WITH_ORDERS = """lines AS (
  SELECT l_orderkey, l_linenumber, l_linestatus, nullif(o_orderstatus, 'P') AS o_orderstatus
  FROM lineitem LEFT JOIN orders ON l_orderkey IS NOT DISTINCT FROM o_orderkey)"""


def _lines_with_orders(spark, d):
    return left_join(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"),
        table(spark, d, "orders").select(
            "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus")),
        {"l_orderkey": "o_orderkey"},
    )


@query("WITH " + LINES_WITH_ORDERS + """ SELECT l_orderkey, l_linenumber, l_linestatus,
    o_orderstatus, l_linestatus = o_orderstatus AS agrees FROM lines""")
def reconcile_detail(spark, d):
    return reconcile(_lines_with_orders(spark, d), "l_linestatus", "o_orderstatus",
                     ["l_orderkey", "l_linenumber"], "agrees")


@query("WITH " + LINES_WITH_ORDERS + """ SELECT count(*) AS total,
    count(*) FILTER (l_linestatus = o_orderstatus) AS matches,
    count(*) FILTER (l_linestatus <> o_orderstatus) AS mismatches,
    round(count(*) FILTER (l_linestatus = o_orderstatus) * 100.0 / count(*), 6)
      AS percentage_match FROM lines""")
def reconcile_values(spark, d):
    return rounded(verdict_summary(reconcile_detail(spark, d), "agrees"), "percentage_match")


AMOUNTS = """amounts AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_discount * 250 AS committed,
         l_tax * 250 AS encumbered, nullif(l_quantity, 10) AS matched FROM lineitem)"""
GUARDS = "committed <> 0 AND encumbered <> 0 AND l_quantity <> 0"


def _amounts(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        (F.col("l_discount") * 250).alias("committed"),
        (F.col("l_tax") * 250).alias("encumbered"),
        F.nullif("l_quantity", F.lit(10.0)).alias("matched"),
    )


def _rule_sql(where: str, rule: str) -> str:
    return "WITH " + AMOUNTS + f""" SELECT count(*) AS total, count(*) FILTER ({rule}) AS matches,
        count(*) FILTER (NOT ({rule})) AS mismatches,
        round(count(*) FILTER ({rule}) * 100.0 / count(*), 6) AS percentage_match
        FROM amounts WHERE {where}"""


_GUARD_COLUMNS = ["committed", "encumbered", "l_quantity"]


@query("WITH " + AMOUNTS + f""" SELECT l_orderkey, l_linenumber, committed, encumbered, l_quantity,
    l_quantity < committed + encumbered AS "check" FROM amounts WHERE {GUARDS}""")
def rule_check_detail(spark, d):
    return rule_check(_amounts(spark, d), _GUARD_COLUMNS,
                      within_budget("l_quantity", "committed", "encumbered"),
                      ["l_orderkey", "l_linenumber"])


@query(_rule_sql(GUARDS, "l_quantity < committed + encumbered"))
def rule_check_two(spark, d):
    return rounded(verdict_summary(rule_check_detail(spark, d), "check"), "percentage_match")


@query(_rule_sql(GUARDS + " AND matched <> 0",
                 "matched + committed > encumbered AND matched + committed > l_quantity"))
def rule_check_three(spark, d):
    detail = rule_check(
        _amounts(spark, d), [*_GUARD_COLUMNS, "matched"],
        covers(["matched", "committed"], "encumbered", "l_quantity"),
        ["l_orderkey", "l_linenumber"], shown=_GUARD_COLUMNS,
    )
    return rounded(verdict_summary(detail, "check"), "percentage_match")


# ---------------------------------------------------------------- cohorts

PLACEHELD = """placeheld AS (
  SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority,
         nullif(o_orderstatus, 'P') AS o_orderstatus, o_orderdate,
         CASE WHEN nullif(o_orderpriority, '4-NOT SPECIFIED') IS NOT NULL
                OR nullif(o_orderstatus, 'P') IS NOT NULL THEN 1 ELSE 0 END AS has_any
  FROM orders)"""


def _placeheld(spark, d):
    cols = ["o_orderpriority", "o_orderstatus"]
    rows = placeholder_to_null(orders_text(spark, d), cols, ["4-NOT SPECIFIED", "P"])
    return flag_any_populated(rows, cols, "has_any")


@query("WITH " + PLACEHELD + """ SELECT o_orderkey, o_orderpriority, o_orderstatus, has_any
    FROM placeheld""")
def placeholder_any_populated(spark, d):
    return _placeheld(spark, d).select("o_orderkey", "o_orderpriority", "o_orderstatus", "has_any")


@query("WITH " + PLACEHELD + """ SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year,
    count(*) FILTER (has_any = 1) AS n_with_flag, count(*) AS total,
    round(count(*) FILTER (has_any = 1) * 100.0 / count(*), 6) AS percentage
    FROM placeheld GROUP BY ALL""")
def cohort_years(spark, d):
    out = cohort_by_year(_placeheld(spark, d), "has_any", ["o_orderstatus"], "start_text")
    return rounded(out, "percentage")


@query("WITH " + PLACEHELD + """ SELECT o_orderkey, o_orderdate FROM placeheld
    WHERE has_any = 0""")
def pull_without_any(spark, d):
    return pull(_placeheld(spark, d), F.col("has_any") == 0, "o_orderkey", "o_orderdate")
