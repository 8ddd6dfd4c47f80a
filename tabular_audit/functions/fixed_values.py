"""Fixed values of the review.

Everything in this file is data that has to be equal to the reviewed
programme's own values for the results to be right: word lists, lookup tables,
codes and patterns.  Callers may pass their own values to every operator.
"""

# Text that stands for "nothing was entered".
PLACEHOLDERS = (
    "None",
    "N/A",
    "NA",
    "n/a",
    "TBD",
    "TBD.",
    "None applicable / discussed",
)

# Project type codes and their labels.
PROJECT_TYPE_LABELS = {
    1: "Applied Research and Development",
    2: "Technology Demonstration and Deployment",
    3: "Market Facilitation",
}
PROJECT_TYPE_DEFAULT = "other/unknown"

# Spellings of lead organisations and the short name of each.
LEAD_NAMES = {
    "Pacific Gas and Electric Company": "PG&E",
    "PG&E": "PG&E",
    "PACIFIC GAS AND ELECTRIC COMPANY": "PG&E",
    "San Diego Gas & Electric": "SDG&E",
    "SDG&E": "SDG&E",
    "San Diego Gas & Electric Company": "SDG&E",
    "Southern California Edison": "SCE",
    "SCE": "SCE",
    "Southern California Edison Company": "SCE",
    "California Energy Commission": "CEC",
    "CEC": "CEC",
    "Lawrence Berkeley National Laboratory": "LBNL",
    "Electric Power Research Institute": "EPRI",
    "Electric Power Research Institute, Inc.": "EPRI",
    "University of California, Los Angeles": "UCLA",
    "University of California - Davis": "UC Davis",
    "The Regents of the University of California, Berkeley": "UC Berkeley",
    "The Regents of the University of California, Merced": "UC Merced",
    "The Regents of the University of California, on behalf of the Irvine Campus": "UC Irvine",
    "The Regents of the University of California, Los Angeles": "UCLA",
    "The Regents of the University of California, San Diego": "UC San Diego",
    "Regents of the University of California, Davis": "UC Davis",
    "Regents of the University of California, Los Angeles": "UCLA",
    "The Regents of the University of California on behalf of the Berkeley campus": "UC Berkeley",
    "The Regents of the University of California, Santa Barbara": "UC Santa Barbara",
    "The Regents of the University of California, Riverside": "UC Riverside",
    "The Regents of the University of California, Irvine": "UC Irvine",
    "The Regents of the University of California, Santa Cruz": "UC Santa Cruz",
    "RCAM Technologies, Inc.": "RCAM Technologies",
}

# Where a phase name starts inside a project number.
PHASE_MARKERS = (" Module", " Project")

# Statuses and literals the review asks for by name.
STATUS_CLOSED = "Closed"
STATUSES_NOT_FINISHED = ("Pending", "Active")
SOLICITATION_WORD = "Competitive"
