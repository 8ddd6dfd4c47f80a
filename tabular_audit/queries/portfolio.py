"""The review on a portfolio that Spark derives from the supplied tables.

Orders stand for projects, documents for the detail tab, order lines for the
finance tab, conversation turns for the metric tab and parts for project types.
Gaps and placeholders come from the values of the tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans import Review
from ..plans.programme import ADMIN
from ..sources.schemas import (
    BARRIERS,
    DETAIL_TEXTS,
    IMPACTS,
    METRIC_TEXTS,
    METRIC_TEXTS_BY_YEAR,
)
from .registry import columns_sql, query, rounded, table

# ---------------------------------------------------------------- the derived tables in SQL

PROJECTS = """ends AS (SELECT l_orderkey, max(l_shipdate) AS ended FROM lineitem GROUP BY l_orderkey),
projects AS (
  SELECT o_orderkey AS Id,
    CASE WHEN o_orderpriority <> '5-LOW' THEN 'P-' || o_custkey ||
      CASE o_orderstatus WHEN 'O' THEN ' Module A' WHEN 'P' THEN ' Project B' ELSE '' END END
      AS ProjectNo,
    c_name AS ProjectName,
    nullif(c_mktsegment, 'FURNITURE') AS ProgramAdminName,
    CASE o_orderstatus WHEN 'O' THEN 'Southern California Edison' WHEN 'P' THEN 'CEC'
      ELSE c_name END AS ProjectLead,
    CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'P' THEN 'Pending' ELSE 'Closed' END
      AS ProjectStatus,
    CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderstatus <> 'F' OR o_totalprice > 250000 END
      AS IsActive,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN strftime(o_orderdate, '%m/%d/%Y') END
      AS ProjectStartDate,
    strftime(ended, '%m/%d/%Y') AS ProjectEndDate,
    CASE WHEN o_totalprice > 20000 THEN o_totalprice WHEN o_totalprice > 10000 THEN 0 END
      AS ContractAmount,
    c_name AS PersonContactFirstName,
    nullif(o_orderpriority, '1-URGENT') AS PersonContactLastName,
    nullif(o_orderstatus, 'P') AS PersonContactEmail,
    nullif(c_mktsegment, 'BUILDING') AS CecMgrContactFirstName,
    c_name AS CecMgrContactLastName,
    nullif(o_orderpriority, '4-NOT SPECIFIED') AS CecMgrEmail
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN ends ON l_orderkey = o_orderkey)"""

#: Projects with the lead's short name, as all results but the wide report have it.
OVERVIEW = """overview AS (SELECT * REPLACE (CASE ProjectLead
  WHEN 'Southern California Edison' THEN 'SCE' ELSE ProjectLead END AS ProjectLead) FROM projects)"""

DETAIL = """detail AS (
  SELECT d.doc_id - d.doc_id % 2 AS ProjectId, d.doc_id AS ProjectDetailId, p.ProjectNo,
    CASE WHEN lang <> 'de' THEN lang = 'en' END AS IsActive,
    CASE WHEN source IN ('src0', 'src1') THEN 'Competitive' WHEN lang = 'en' THEN text END
      AS DetailedProjectDescription,
    CASE WHEN lang <> 'fr' THEN text END AS ProjectSummary,
    CASE WHEN n_chars > 500 THEN text END AS ProjectUpdate,
    CASE WHEN quality = 1 THEN source END AS Deliverables,
    nullif(source, 'src2') AS StatePolicySupportText,
    CASE quality WHEN 0 THEN 'None' WHEN 1 THEN text END AS TechnicalBarriers,
    CASE toxic WHEN 0 THEN 'N/A' WHEN 1 THEN text END AS MarketBarriers,
    CASE source WHEN 'src3' THEN 'TBD' WHEN 'src4' THEN 'None applicable / discussed'
      WHEN 'src5' THEN text END AS PolicyAndRegulatoryBarriers,
    CASE WHEN toxic IS NULL THEN lang END AS GettingToScale,
    lang AS KeyInnovations, nullif(lang, 'en') AS KeyLeanings, nullif(lang, 'es') AS Scalability
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN projects p ON p.Id = d.doc_id - d.doc_id % 2),
detail_view AS (
  SELECT d.*, p.ProjectName, p.ProgramAdminName, p.IsActive AS IsActive_overview,
         d.IsActive AS IsActive_details, p.ProjectStartDate, p.ProjectEndDate
  FROM detail d LEFT JOIN projects p
    ON d.ProjectId = p.Id AND d.ProjectNo IS NOT DISTINCT FROM p.ProjectNo)"""

FINANCE = """finance AS (
  SELECT l_orderkey AS ProjectId, ProjectNo,
    CASE WHEN l_returnflag = 'A' THEN ContractAmount ELSE l_extendedprice END AS ContractAmount,
    CASE WHEN l_linenumber <> 7 THEN l_discount * 1000 END AS CommitedFundingAmount,
    l_tax * 1000 AS EncumberedFundingAmount,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity * 2 WHEN l_linenumber > 2 THEN 0 END
      AS FundsExpendedToDate,
    nullif(l_quantity, 10) AS MatchFunding
  FROM lineitem LEFT JOIN projects ON Id = l_orderkey),
finance_view AS (
  SELECT f.ProjectId, f.ProjectNo, f.ContractAmount AS ContractAmount_details,
         p.ContractAmount AS ContractAmount_overview, CommitedFundingAmount,
         EncumberedFundingAmount, FundsExpendedToDate, MatchFunding, ProgramAdminName
  FROM finance f LEFT JOIN projects p
    ON f.ProjectId = p.Id AND f.ProjectNo IS NOT DISTINCT FROM p.ProjectNo)"""

METRIC = """metric AS (
  SELECT conv_id AS ProjectId, ProjectNo, CASE WHEN role <> 'system' THEN turn < 3 END AS IsActive,
    CASE WHEN role = 'user' THEN text END AS ElectricitySystemReliabilityImpacts,
    CASE turn WHEN 1 THEN 'n/a' WHEN 2 THEN text END AS ElectricitySystemSafetyImpacts,
    CASE role WHEN 'system' THEN 'TBD.' WHEN 'assistant' THEN 'NA'
      ELSE CASE WHEN turn = 2 THEN text END END AS EnviromentalImpactsNonGHG,
    text AS ProjectedProjectBenefits,
    CASE WHEN turn > 1 THEN role END AS RatePayersBenefits,
    nullif(role, 'user') AS CommunityBenefitsDesc,
    CASE WHEN turn = 2 THEN role WHEN turn = 3 THEN text WHEN turn > 3 THEN 'TBD' END AS EnergyImpacts,
    CASE WHEN turn = 0 THEN text END AS InfrastructureCostBenefits,
    CASE WHEN role = 'user' THEN 'none' END AS OtherImpacts,
    nullif(role, 'assistant') AS InformationDissemination
  FROM conversations LEFT JOIN projects ON Id = conv_id),
metric_view AS (
  SELECT m.*, p.ProjectName, p.ProgramAdminName, p.IsActive AS IsActive_overview,
         m.IsActive AS IsActive_metric, p.ProjectStartDate, p.ProjectEndDate,
         CAST(year(try_strptime(p.ProjectStartDate, '%m/%d/%Y')) AS INTEGER) AS start_year,
         CAST(year(try_strptime(p.ProjectEndDate, '%m/%d/%Y')) AS INTEGER) AS end_year
  FROM metric m LEFT JOIN projects p
    ON m.ProjectId = p.Id AND m.ProjectNo IS NOT DISTINCT FROM p.ProjectNo)"""

MARKET = """market AS (SELECT ProjectNo AS agreement FROM projects
  WHERE ContractAmount > 300000 OR ContractAmount IS NULL)"""
TYPES = """types AS (SELECT p_partkey AS PROJECT_ID, ProjectNo AS PROJECT_NUMBER,
  nullif(p_size, 2) AS code FROM part LEFT JOIN projects ON Id = p_partkey)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join((PROJECTS, *parts)) + "\n"


PCT = "round({} * 100.0 / {}, 6)"


# ---------------------------------------------------------------- the derived tables in Spark

def _unless(test: Column, value: Column) -> Column:
    return F.when(~test, value)


class Derived:
    """The six input tables, made from the supplied ones when asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self._table = lambda name: table(spark, d, name)

    @property
    def _number(self) -> Column:
        status = F.col("o_orderstatus")
        phase = F.when(status == "O", " Module A").when(status == "P", " Project B").otherwise("")
        number = F.concat(F.lit("P-"), F.col("o_custkey").cast("string"), phase)
        return _unless(F.col("o_orderpriority") == "5-LOW", number).alias("ProjectNo")

    @property
    def _amount(self) -> Column:
        price = F.col("o_totalprice")
        return F.when(price > 20000, price).when(price > 10000, F.lit(0.0)).alias("ContractAmount")

    @cached_property
    def _numbers(self) -> DataFrame:
        return self._table("orders").select(
            F.col("o_orderkey").alias("Id"), self._number, self._amount)

    @cached_property
    def projects(self) -> DataFrame:
        col = F.col
        priority, status = col("o_orderpriority"), col("o_orderstatus")
        ends = self._table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ended"))
        base = (
            self._table("orders")
            .join(self._table("customer"), col("o_custkey") == col("c_custkey"), "left")
            .join(ends, col("l_orderkey") == col("o_orderkey"), "left")
        )
        rows = base.select(
            col("o_orderkey").alias("Id"),
            self._number,
            col("c_name").alias("ProjectName"),
            F.nullif("c_mktsegment", F.lit("FURNITURE")).alias(ADMIN),
            F.when(status == "O", "Southern California Edison").when(status == "P", "CEC")
            .otherwise(col("c_name")).alias("ProjectLead"),
            F.when(status == "O", "Active").when(status == "P", "Pending").otherwise("Closed")
            .alias("ProjectStatus"),
            _unless(priority == "2-HIGH", (status != "F") | (col("o_totalprice") > 250000))
            .alias("IsActive"),
            _unless(priority == "3-MEDIUM", F.date_format("o_orderdate", "MM/dd/yyyy"))
            .alias("ProjectStartDate"),
            F.date_format("ended", "MM/dd/yyyy").alias("ProjectEndDate"),
            self._amount,
            col("c_name").alias("PersonContactFirstName"),
            F.nullif(priority, F.lit("1-URGENT")).alias("PersonContactLastName"),
            F.nullif(status, F.lit("P")).alias("PersonContactEmail"),
            F.nullif("c_mktsegment", F.lit("BUILDING")).alias("CecMgrContactFirstName"),
            col("c_name").alias("CecMgrContactLastName"),
            F.nullif(priority, F.lit("4-NOT SPECIFIED")).alias("CecMgrEmail"),
            col("c_acctbal").alias("LongitudeX"),
            col("o_totalprice").alias("LatitudeY"),
        )
        # Some projects have a second row that differs in the coordinates alone.
        second = rows.where("Id % 8 = 0").withColumn("LongitudeX", col("LongitudeX") + 1)
        return rows.unionByName(second)

    @cached_property
    def projects_detail(self) -> DataFrame:
        col = F.col
        lang, source, quality, toxic = col("lang"), col("source"), col("quality"), col("toxic")
        text = col("text")
        rows = (
            self._table("documents")
            .join(self._table("labels"), "doc_id", "left")
            .withColumn("project", col("doc_id") - col("doc_id") % 2)
            .join(self._numbers, col("project") == col("Id"), "left")
        )
        return rows.select(
            col("project").alias("ProjectId"),
            col("doc_id").alias("ProjectDetailId"),
            "ProjectNo",
            _unless(lang == "de", lang == "en").alias("IsActive"),
            F.when(source.isin("src0", "src1"), "Competitive").when(lang == "en", text)
            .alias("DetailedProjectDescription"),
            _unless(lang == "fr", text).alias("ProjectSummary"),
            F.when(col("n_chars") > 500, text).alias("ProjectUpdate"),
            F.when(quality == 1, source).alias("Deliverables"),
            F.nullif(source, F.lit("src2")).alias("StatePolicySupportText"),
            F.when(quality == 0, "None").when(quality == 1, text).alias("TechnicalBarriers"),
            F.when(toxic == 0, "N/A").when(toxic == 1, text).alias("MarketBarriers"),
            F.when(source == "src3", "TBD").when(source == "src4", "None applicable / discussed")
            .when(source == "src5", text).alias("PolicyAndRegulatoryBarriers"),
            F.when(toxic.isNull(), lang).alias("GettingToScale"),
            lang.alias("KeyInnovations"),
            F.nullif(lang, F.lit("en")).alias("KeyLeanings"),
            F.nullif(lang, F.lit("es")).alias("Scalability"),
        )

    @cached_property
    def finance_detail(self) -> DataFrame:
        col = F.col
        flag, line = col("l_returnflag"), col("l_linenumber")
        rows = self._table("lineitem").join(self._numbers, col("l_orderkey") == col("Id"), "left")
        return rows.select(
            col("l_orderkey").alias("ProjectId"),
            "ProjectNo",
            F.when(flag == "A", col("ContractAmount")).otherwise(col("l_extendedprice"))
            .alias("ContractAmount"),
            _unless(line == 7, col("l_discount") * 1000).alias("CommitedFundingAmount"),
            (col("l_tax") * 1000).alias("EncumberedFundingAmount"),
            F.when(flag != "R", col("l_quantity") * 2).when(line > 2, F.lit(0.0))
            .alias("FundsExpendedToDate"),
            F.nullif("l_quantity", F.lit(10.0)).alias("MatchFunding"),
        )

    @cached_property
    def projects_metric(self) -> DataFrame:
        col = F.col
        role, turn, text = col("role"), col("turn"), col("text")
        rows = self._table("conversations").join(self._numbers, col("conv_id") == col("Id"), "left")
        return rows.select(
            col("conv_id").alias("ProjectId"),
            "ProjectNo",
            _unless(role == "system", turn < 3).alias("IsActive"),
            F.when(role == "user", text).alias("ElectricitySystemReliabilityImpacts"),
            F.when(turn == 1, "n/a").when(turn == 2, text).alias("ElectricitySystemSafetyImpacts"),
            F.when(role == "system", "TBD.").when(role == "assistant", "NA").when(turn == 2, text)
            .alias("EnviromentalImpactsNonGHG"),
            text.alias("ProjectedProjectBenefits"),
            F.when(turn > 1, role).alias("RatePayersBenefits"),
            F.nullif(role, F.lit("user")).alias("CommunityBenefitsDesc"),
            F.when(turn == 2, role).when(turn == 3, text).when(turn > 3, "TBD").alias("EnergyImpacts"),
            F.when(turn == 0, text).alias("InfrastructureCostBenefits"),
            F.when(role == "user", "none").alias("OtherImpacts"),
            F.nullif(role, F.lit("assistant")).alias("InformationDissemination"),
        )

    @cached_property
    def market_facilitation(self) -> DataFrame:
        amount = F.col("ContractAmount")
        return self._numbers.where((amount > 300000) | amount.isNull()).select(
            F.col("ProjectNo").alias("Agreement Number"))

    @cached_property
    def project_type(self) -> DataFrame:
        rows = self._table("part").join(self._numbers, F.col("p_partkey") == F.col("Id"), "left")
        return rows.select(
            F.col("p_partkey").alias("PROJECT_ID"),
            F.col("ProjectNo").alias("PROJECT_NUMBER"),
            F.nullif("p_size", F.lit(2)).alias("PROJECT_TYPE_PROJECT_TYPE_ID"),
        )


def result(spark: SparkSession, d: str, name: str, keep: bool = False) -> DataFrame:
    """One result of the review of the derived portfolio."""
    return Review(Derived(spark, d), keep).result(name)


# ---------------------------------------------------------------- wide report

WIDE = _with(DETAIL, FINANCE, METRIC, MARKET, TYPES) + """SELECT p.*,
  d.* EXCLUDE (ProjectId, ProjectNo, IsActive), d.IsActive AS IsActive_detail,
  m.* EXCLUDE (ProjectId, ProjectNo, IsActive), m.IsActive AS IsActive_metric,
  f.* EXCLUDE (ProjectId, ProjectNo, ContractAmount), f.ContractAmount AS ContractAmount_finance,
  CASE WHEN EXISTS (SELECT 1 FROM market WHERE agreement IS NOT DISTINCT FROM p.ProjectNo)
    THEN 1 ELSE 0 END AS market_facilitation_indicator,
  CASE t.code WHEN 1 THEN 'Applied Research and Development'
    WHEN 2 THEN 'Technology Demonstration and Deployment' WHEN 3 THEN 'Market Facilitation'
    ELSE 'other/unknown' END AS PROJECT_TYPE_PROJECT_TYPE_ID
FROM projects p
LEFT JOIN detail d ON d.ProjectId = p.Id AND d.ProjectNo IS NOT DISTINCT FROM p.ProjectNo
LEFT JOIN metric m ON m.ProjectId = p.Id AND m.ProjectNo IS NOT DISTINCT FROM p.ProjectNo
LEFT JOIN finance f ON f.ProjectId = p.Id AND f.ProjectNo IS NOT DISTINCT FROM p.ProjectNo
LEFT JOIN types t ON t.PROJECT_ID = p.Id AND t.PROJECT_NUMBER IS NOT DISTINCT FROM p.ProjectNo"""
WIDE_DUPLICATES = f"SELECT * FROM ({WIDE}) QUALIFY count(*) OVER (PARTITION BY Id, ProjectNo) > 1"


@query(WIDE)
def portfolio_wide(spark, d):
    return result(spark, d, "wide_report")


@query(WIDE_DUPLICATES)
def portfolio_wide_duplicates(spark, d):
    return result(spark, d, "wide_report_duplicates")


# ---------------------------------------------------------------- overview

def _distinct_sql(extra: str) -> str:
    return _with() + columns_sql(
        f"""SELECT '{{c}}' AS "column", count(DISTINCT {{c}}){extra} AS num_distinct FROM projects""",
        ["Id", "ProjectNo", "ProjectName"])


@query(_distinct_sql(""))
def portfolio_distinct_populated(spark, d):
    return result(spark, d, "overview_distinct_populated")


@query(_distinct_sql(" + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT)"))
def portfolio_distinct(spark, d):
    return result(spark, d, "overview_distinct")


@query(_with() + """, x AS (SELECT ProjectNo,
    regexp_replace(ProjectNo, '(?s)( Module| Project).*', '') AS BaseProjectNo FROM projects)
  SELECT DISTINCT BaseProjectNo, ProjectNo FROM
    (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY BaseProjectNo) > 1)
  WHERE ProjectNo IS NOT NULL""")
def portfolio_families(spark, d):
    return result(spark, d, "phase_families")


@query(_with() + """SELECT ProgramAdminName, round(avg(ContractAmount), 6) AS average,
    min(ContractAmount) AS minimum, max(ContractAmount) AS maximum
  FROM projects WHERE ContractAmount IS NOT NULL AND ContractAmount <> 0
  GROUP BY ProgramAdminName""")
def portfolio_amounts_by_admin(spark, d):
    return rounded(result(spark, d, "contract_amount_by_admin"), "average")


@query(_with() + """SELECT min(ContractAmount) AS minimum,
    round(quantile_cont(ContractAmount, 0.25), 6) AS q1,
    round(quantile_cont(ContractAmount, 0.5), 6) AS median,
    round(avg(ContractAmount), 6) AS mean,
    round(quantile_cont(ContractAmount, 0.75), 6) AS q3, max(ContractAmount) AS maximum
  FROM projects WHERE ContractAmount <> 0""")
def portfolio_amount_summary(spark, d):
    return rounded(result(spark, d, "contract_amount_summary"), "q1", "median", "mean", "q3")


@query(_with() + """SELECT CASE ProjectLead WHEN 'Southern California Edison' THEN 'SCE'
    ELSE ProjectLead END AS ProjectLead, count(*) AS n
  FROM projects WHERE ProjectLead IS NOT NULL GROUP BY 1""")
def portfolio_leads(spark, d):
    return result(spark, d, "projects_by_lead")


@query(_with() + f"""SELECT ProgramAdminName, count(*) AS n,
    {PCT.format('count(*)', 'sum(count(*)) OVER ()')} AS pct
  FROM projects WHERE ProgramAdminName IS NOT NULL GROUP BY ProgramAdminName""")
def portfolio_admins(spark, d):
    return rounded(result(spark, d, "projects_by_admin"), "pct")


@query(_with() + f"""SELECT ProgramAdminName, ProjectStatus, count(*) AS n,
    {PCT.format('count(*)', 'sum(count(*)) OVER (PARTITION BY ProgramAdminName)')} AS pct
  FROM projects WHERE ProgramAdminName IS NOT NULL AND ProjectStatus IS NOT NULL
  GROUP BY ProgramAdminName, ProjectStatus""")
def portfolio_status_within_admin(spark, d):
    return rounded(result(spark, d, "status_within_admin"), "pct")


def _rate_sql(source: str, test: str, by: str = "", base: str = "TRUE") -> str:
    hits = f"count(*) FILTER ({test})"
    lead, tail = ("", "") if not by else (f"{by}, ", f" GROUP BY {by} HAVING {hits} > 0")
    return f"""SELECT {lead}{hits} AS n, count(*) AS total,
      {PCT.format(hits, 'count(*)')} AS percentage FROM {source} WHERE {base}{tail}"""


_CONTRADICTION = "IsActive AND ProjectStatus = 'Closed'"


@query(_with() + _rate_sql("projects", _CONTRADICTION))
def portfolio_active_but_closed(spark, d):
    return rounded(result(spark, d, "active_but_closed"), "percentage")


@query(_with() + _rate_sql("projects", _CONTRADICTION, ADMIN,
                           "IsActive IS NOT NULL AND ProjectStatus IS NOT NULL"))
def portfolio_active_but_closed_by_admin(spark, d):
    return rounded(result(spark, d, "active_but_closed_by_admin"), "percentage")


@query(_with() + _rate_sql("projects",
                           "ProjectStartDate IS NOT NULL AND ProjectEndDate IS NOT NULL", ADMIN))
def portfolio_dates_by_admin(spark, d):
    return rounded(result(spark, d, "dates_populated_by_admin"), "percentage")


_DATED = """dated AS (SELECT ProgramAdminName,
    try_strptime(ProjectStartDate, '%m/%d/%Y') AS s, try_strptime(ProjectEndDate, '%m/%d/%Y') AS e
  FROM projects WHERE ProjectStartDate IS NOT NULL AND ProjectEndDate IS NOT NULL)
"""


@query(_with(_DATED) + f"""SELECT CAST(year(s) AS INTEGER) AS start_year, count(*) AS n,
    {PCT.format('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM dated GROUP BY year(s)""")
def portfolio_start_years(spark, d):
    return rounded(result(spark, d, "projects_by_start_year"), "pct")


def _year_within_sql(name: str, date: str) -> str:
    total = "sum(count(*)) OVER (PARTITION BY ProgramAdminName)"
    return _with(_DATED) + f"""SELECT ProgramAdminName, CAST(year({date}) AS INTEGER) AS {name},
      count(*) AS n, CAST({total} AS BIGINT) AS total, {PCT.format('count(*)', total)} AS pct
      FROM dated GROUP BY ProgramAdminName, year({date})"""


@query(_year_within_sql("start_year", "s"))
def portfolio_start_years_by_admin(spark, d):
    return rounded(result(spark, d, "start_year_within_admin"), "pct")


@query(_year_within_sql("end_year", "e"))
def portfolio_end_years_by_admin(spark, d):
    return rounded(result(spark, d, "end_year_within_admin"), "pct")


@query(_with(_DATED) + """SELECT ProgramAdminName,
    round(avg(date_diff('day', s, e) / 7.0), 6) AS average
  FROM dated WHERE ProgramAdminName IS NOT NULL GROUP BY ProgramAdminName""")
def portfolio_durations(spark, d):
    return rounded(result(spark, d, "duration_by_admin"), "average")


@query(_with() + _rate_sql("projects", "PersonContactFirstName IS NOT NULL AND "
                           "PersonContactLastName IS NOT NULL AND PersonContactEmail IS NOT NULL",
                           ADMIN))
def portfolio_contacts_by_admin(spark, d):
    return rounded(result(spark, d, "contact_populated_by_admin"), "percentage")


@query(_with() + """SELECT ProjectStatus, count(*) AS n FROM projects
  WHERE (PersonContactFirstName IS NULL OR PersonContactLastName IS NULL
         OR PersonContactEmail IS NULL) AND ProjectStatus IS NOT NULL GROUP BY ProjectStatus""")
def portfolio_contact_gaps(spark, d):
    return result(spark, d, "contact_missing_by_status")


@query(_with() + _rate_sql("projects", "CecMgrContactFirstName IS NOT NULL AND "
                           "CecMgrContactLastName IS NOT NULL AND CecMgrEmail IS NOT NULL"))
def portfolio_manager_contacts(spark, d):
    return rounded(result(spark, d, "manager_contact_populated"), "percentage")


@query(_with(OVERVIEW) + """SELECT overview.*,
    strftime(try_strptime(ProjectStartDate, '%m/%d/%Y'), '%Y-%m-%d') AS start_date, CAST(year(try_strptime(ProjectStartDate, '%m/%d/%Y')) AS INTEGER) AS start_year
  FROM overview WHERE ProjectStatus IN ('Pending', 'Active')""")
def portfolio_unfinished(spark, d):
    rows = result(spark, d, "unfinished_projects")
    return rows.withColumn("start_date", F.col("start_date").cast("string"))


# ---------------------------------------------------------------- detail

def _complete_sql(source: str, level: int, keys: dict[str, str], cols) -> str:
    lead = ", ".join(f"{v} AS {k}" for k, v in keys.items())
    real = [k for k, v in keys.items() if v != "NULL"]
    tail = f" GROUP BY {', '.join(real)}" if real else ""
    return columns_sql(f"""SELECT {level} AS level, {lead}, '{{c}}' AS "column",
        count(*) AS total_rows, count({{c}}) AS non_missing_count,
        {PCT.format('count({c})', 'count(*)')} AS percentage FROM {source}{tail}""", cols)


@query(_with(DETAIL) + " UNION ALL ".join([
    _complete_sql("detail_view", 0, {ADMIN: "NULL"}, DETAIL_TEXTS),
    _complete_sql("detail_view", 1, {ADMIN: ADMIN}, DETAIL_TEXTS)]))
def portfolio_detail_completeness(spark, d):
    return rounded(result(spark, d, "detail_completeness"), "percentage")


def _parts_sql(view: str, flag: str, test: str, cols) -> str:
    return columns_sql(f"""SELECT ProgramAdminName, {flag}, '{{c}}' AS "column", count(*) AS n,
        {PCT.format('count(*)', 'sum(count(*)) OVER ()')} AS pct
        FROM {view} WHERE {{c}} {test} GROUP BY ProgramAdminName, {flag}""", cols)


@query(_with(DETAIL) + _parts_sql("detail_view", "IsActive_details", "IS NULL", DETAIL_TEXTS[1:]))
def portfolio_detail_blanks(spark, d):
    return rounded(result(spark, d, "detail_blanks"), "pct")


@query(_with(DETAIL) + f"""SELECT ProgramAdminName,
    count(*) FILTER (DetailedProjectDescription = 'Competitive') AS n, count(*) AS total,
    {PCT.format("count(*) FILTER (DetailedProjectDescription = 'Competitive')", 'count(*)')}
      AS percentage
  FROM detail_view WHERE DetailedProjectDescription IS NOT NULL GROUP BY ProgramAdminName""")
def portfolio_solicitation_word(spark, d):
    return rounded(result(spark, d, "solicitation_word_by_admin"), "percentage")


MISSING_FROM_DETAIL = _with(OVERVIEW, DETAIL) + """SELECT *, TRUE AS nomatch FROM overview
  WHERE NOT EXISTS (SELECT 1 FROM detail WHERE ProjectId = Id)"""


@query(MISSING_FROM_DETAIL)
def portfolio_missing_from_detail(spark, d):
    return result(spark, d, "missing_from_detail")


def _summary_sql(view: str, left: str, right: str) -> str:
    same = f"count(*) FILTER ({left} = {right})"
    return f"""SELECT count(*) AS total, {same} AS matches,
      count(*) FILTER ({left} <> {right}) AS mismatches,
      {PCT.format(same, 'count(*)')} AS percentage_match FROM {view}"""


@query(_with(DETAIL) + _summary_sql("detail_view", "IsActive_overview", "IsActive_details"))
def portfolio_detail_activity(spark, d):
    return rounded(result(spark, d, "detail_activity_summary"), "percentage_match")


# ---------------------------------------------------------------- finance

def _zero_sql(col: str, where: str) -> str:
    zero = f"count(*) FILTER ({col} = 0)"
    return _with(FINANCE) + f"""SELECT ProgramAdminName, count(*) AS total_entries,
      {zero} AS zero_count, {PCT.format(zero, 'count(*)')} AS percentage_zero
      FROM finance_view WHERE {where} GROUP BY ProgramAdminName"""


@query(_zero_sql("CommitedFundingAmount", "CommitedFundingAmount IS NOT NULL"))
def portfolio_committed_zero(spark, d):
    return rounded(result(spark, d, "committed_zero_by_admin"), "percentage_zero")


@query(_zero_sql("FundsExpendedToDate", "TRUE"))
def portfolio_expended_zero(spark, d):
    return rounded(result(spark, d, "expended_zero_by_admin"), "percentage_zero")


@query(_with(FINANCE) + """SELECT ProgramAdminName, round(avg(FundsExpendedToDate), 6) AS average
  FROM finance_view WHERE FundsExpendedToDate <> 0 GROUP BY ProgramAdminName""")
def portfolio_expended_mean(spark, d):
    return rounded(result(spark, d, "expended_mean_by_admin"), "average")


def _rule_sql(guards: list[str], rule: str) -> str:
    where = " AND ".join(f"{g} <> 0" for g in guards)
    hits = f"count(*) FILTER ({rule})"
    return _with(FINANCE) + f"""SELECT count(*) AS total, {hits} AS matches,
      count(*) FILTER (NOT ({rule})) AS mismatches,
      {PCT.format(hits, 'count(*)')} AS percentage_match FROM finance_view WHERE {where}"""


_FUNDS = ["CommitedFundingAmount", "FundsExpendedToDate", "EncumberedFundingAmount"]


@query(_rule_sql(_FUNDS, "FundsExpendedToDate < CommitedFundingAmount + EncumberedFundingAmount"))
def portfolio_budget(spark, d):
    return rounded(result(spark, d, "budget_check_summary"), "percentage_match")


@query(_rule_sql([*_FUNDS, "MatchFunding"],
                 "MatchFunding + CommitedFundingAmount > EncumberedFundingAmount AND "
                 "MatchFunding + CommitedFundingAmount > FundsExpendedToDate"))
def portfolio_match_funding(spark, d):
    return rounded(result(spark, d, "match_funding_check_summary"), "percentage_match")


@query(_with(FINANCE) + _summary_sql("finance_view", "ContractAmount_overview",
                                     "ContractAmount_details"))
def portfolio_contract_amounts(spark, d):
    return rounded(result(spark, d, "contract_amounts_summary"), "percentage_match")


FINANCE_FULL = """finance_full AS (
  SELECT f.* EXCLUDE (ContractAmount), f.ContractAmount AS ContractAmount_details,
         p.* EXCLUDE (Id, ProjectNo, ContractAmount), p.ContractAmount AS ContractAmount_overview
  FROM finance f LEFT JOIN overview p
    ON f.ProjectId = p.Id AND f.ProjectNo IS NOT DISTINCT FROM p.ProjectNo)
"""


@query(_with(OVERVIEW, FINANCE, FINANCE_FULL) + """SELECT * FROM finance_full
  WHERE FundsExpendedToDate = 0 AND CommitedFundingAmount > 0""")
def portfolio_nothing_expended(spark, d):
    return result(spark, d, "committed_but_nothing_expended")


# ---------------------------------------------------------------- metric

@query(_with(METRIC) + " UNION ALL ".join([
    _complete_sql("metric_view", 0, {ADMIN: "NULL", "start_year": "NULL"}, METRIC_TEXTS),
    _complete_sql("metric_view", 1, {ADMIN: ADMIN, "start_year": "NULL"}, METRIC_TEXTS),
    _complete_sql("metric_view", 2, {ADMIN: ADMIN, "start_year": "start_year"},
                  METRIC_TEXTS_BY_YEAR)]))
def portfolio_metric_completeness(spark, d):
    return rounded(result(spark, d, "metric_completeness"), "percentage")


@query(_with(METRIC) + _parts_sql("metric_view", "IsActive_metric", "IS NOT NULL", METRIC_TEXTS))
def portfolio_metric_populated(spark, d):
    return rounded(result(spark, d, "metric_populated"), "pct")


METRIC_FULL = """metric_full AS (
  SELECT m.* EXCLUDE (IsActive), m.IsActive AS IsActive_metric,
         p.* EXCLUDE (Id, ProjectNo, IsActive), p.IsActive AS IsActive_overview
  FROM metric m LEFT JOIN overview p
    ON m.ProjectId = p.Id AND m.ProjectNo IS NOT DISTINCT FROM p.ProjectNo)
"""


@query(_with(OVERVIEW, METRIC, METRIC_FULL) + """SELECT * FROM metric_full
  WHERE ElectricitySystemReliabilityImpacts IS NOT NULL AND ElectricitySystemSafetyImpacts IS NOT NULL
    AND EnviromentalImpactsNonGHG IS NOT NULL AND EnergyImpacts IS NOT NULL
    AND OtherImpacts IS NOT NULL""")
def portfolio_all_impacts(spark, d):
    return result(spark, d, "all_impacts")


# ---------------------------------------------------------------- at least one of several fields

_BLANKS = "('None', 'N/A', 'NA', 'n/a', 'TBD', 'TBD.', 'None applicable / discussed')"


def _any_sql(view: str, cols) -> str:
    test = " OR ".join(f"{c} NOT IN {_BLANKS}" for c in cols)
    return f"""flagged AS (SELECT *, CASE WHEN {test} THEN 1 ELSE 0 END AS flag,
      CAST(year(try_strptime(ProjectStartDate, '%m/%d/%Y')) AS INTEGER) AS y0,
      CAST(year(try_strptime(ProjectEndDate, '%m/%d/%Y')) AS INTEGER) AS y1 FROM {view})
"""


_BARRIERS = _any_sql("detail_view", BARRIERS)
_IMPACTS = _any_sql("metric_view", IMPACTS)


def _cohort_sql(year: str, name: str) -> str:
    return f"""SELECT ProgramAdminName, {year} AS {name}, count(*) FILTER (flag = 1) AS n_with_flag,
      count(*) AS total, {PCT.format('count(*) FILTER (flag = 1)', 'count(*)')} AS percentage
      FROM flagged GROUP BY ProgramAdminName, {year}"""


@query(_with(DETAIL, _BARRIERS) + _cohort_sql("y0", "start_year"))
def portfolio_barriers_by_start_year(spark, d):
    return rounded(result(spark, d, "barrier_by_start_year"), "percentage")


@query(_with(DETAIL, _BARRIERS) + _rate_sql("flagged", "flag = 1", ADMIN))
def portfolio_with_barrier_by_admin(spark, d):
    return rounded(result(spark, d, "with_barrier_by_admin"), "percentage")


@query(_with(DETAIL, _BARRIERS) + _rate_sql("flagged", "flag = 0"))
def portfolio_without_barrier(spark, d):
    return rounded(result(spark, d, "without_barrier"), "percentage")


def _unflagged_sql(cols, flag: str, carried: str = "") -> str:
    real = ", ".join(f"CASE WHEN {c} NOT IN {_BLANKS} THEN {c} END AS {c}" for c in cols)
    return f"""SELECT ProjectId, ProjectName, {carried}ProgramAdminName, {real},
      ProjectStartDate, ProjectEndDate, flag AS {flag} FROM flagged WHERE flag = 0"""


@query(_with(DETAIL, _BARRIERS)
       + _unflagged_sql(BARRIERS, "one_or_more_barrier", "DetailedProjectDescription, "))
def portfolio_without_barrier_rows(spark, d):
    return result(spark, d, "without_barrier_rows")


@query(_with(METRIC, _IMPACTS) + _cohort_sql("y1", "end_year"))
def portfolio_impacts_by_end_year(spark, d):
    return rounded(result(spark, d, "impact_by_end_year"), "percentage")


@query(_with(METRIC, _IMPACTS) + _rate_sql("flagged", "flag = 1"))
def portfolio_with_impact(spark, d):
    return rounded(result(spark, d, "with_impact"), "percentage")


@query(_with(METRIC, _IMPACTS) + _rate_sql("flagged", "flag = 0", ADMIN))
def portfolio_without_impact_by_admin(spark, d):
    return rounded(result(spark, d, "without_impact_by_admin"), "percentage")


@query(_with(METRIC, _IMPACTS) + _unflagged_sql(IMPACTS, "one_or_more_impact"))
def portfolio_without_impact_rows(spark, d):
    return result(spark, d, "without_impact_rows")
