"""Column types of the six input tables.

Names are fixed values: they are the column names of the reviewed export.
Keys are long, money is double, dates stay month/day/year text until a query
parses them, and every column may be null.
"""

from __future__ import annotations

from pyspark.sql import types as T


LONG, TEXT, FLAG = T.LongType(), T.StringType(), T.BooleanType()
AMOUNT, CODE = T.DoubleType(), T.IntegerType()


def _schema(*columns: tuple[T.DataType, tuple[str, ...]]) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for kind, names in columns for n in names])


# Column names of the export.
DETAIL_TEXTS = (
    "DetailedProjectDescription", "ProjectSummary", "ProjectUpdate", "Deliverables",
    "StatePolicySupportText", "TechnicalBarriers", "MarketBarriers",
    "PolicyAndRegulatoryBarriers", "GettingToScale", "KeyInnovations", "KeyLeanings",
    "Scalability",
)
BARRIERS = ("TechnicalBarriers", "MarketBarriers", "PolicyAndRegulatoryBarriers")
METRIC_TEXTS = (
    "ElectricitySystemReliabilityImpacts", "ElectricitySystemSafetyImpacts",
    "EnviromentalImpactsNonGHG", "ProjectedProjectBenefits", "RatePayersBenefits",
    "CommunityBenefitsDesc", "EnergyImpacts", "InfrastructureCostBenefits", "OtherImpacts",
    "InformationDissemination",
)
IMPACTS = (
    "ElectricitySystemReliabilityImpacts", "ElectricitySystemSafetyImpacts",
    "EnviromentalImpactsNonGHG", "EnergyImpacts", "OtherImpacts",
)
METRIC_TEXTS_BY_YEAR = (
    "ProjectedProjectBenefits", "RatePayersBenefits", "CommunityBenefitsDesc",
    "InfrastructureCostBenefits", "InformationDissemination",
)
CONTACT = ("PersonContactFirstName", "PersonContactLastName", "PersonContactEmail")
MANAGER_CONTACT = ("CecMgrContactFirstName", "CecMgrContactLastName", "CecMgrEmail")
COORDINATES = ("LongitudeX", "LatitudeY")

PROJECTS = _schema(
    (LONG, ("Id",)),
    (TEXT, ("ProjectNo", "ProjectName", "ProgramAdminName", "ProjectLead", "ProjectStatus")),
    (FLAG, ("IsActive",)),
    (TEXT, ("ProjectStartDate", "ProjectEndDate")),
    (AMOUNT, ("ContractAmount",)),
    (TEXT, CONTACT + MANAGER_CONTACT),
    (AMOUNT, COORDINATES),
)
PROJECTS_DETAIL = _schema(
    (LONG, ("ProjectId", "ProjectDetailId")),
    (TEXT, ("ProjectNo",)),
    (FLAG, ("IsActive",)),
    (TEXT, DETAIL_TEXTS),
)
FINANCE_DETAIL = _schema(
    (LONG, ("ProjectId",)),
    (TEXT, ("ProjectNo",)),
    (AMOUNT, ("ContractAmount", "CommitedFundingAmount", "EncumberedFundingAmount",
              "FundsExpendedToDate", "MatchFunding")),
)
PROJECTS_METRIC = _schema(
    (LONG, ("ProjectId",)),
    (TEXT, ("ProjectNo",)),
    (FLAG, ("IsActive",)),
    (TEXT, METRIC_TEXTS),
)
MARKET_FACILITATION = _schema((TEXT, ("Agreement Number",)))
PROJECT_TYPE = _schema(
    (LONG, ("PROJECT_ID",)),
    (TEXT, ("PROJECT_NUMBER",)),
    (CODE, ("PROJECT_TYPE_PROJECT_TYPE_ID",)),
)

SCHEMAS = {
    "projects": PROJECTS,
    "projects_detail": PROJECTS_DETAIL,
    "finance_detail": FINANCE_DETAIL,
    "projects_metric": PROJECTS_METRIC,
    "market_facilitation": MARKET_FACILITATION,
    "project_type": PROJECT_TYPE,
}
