"""Month-day-year text to dates.

Both parsers give null for text they cannot read; neither fails under ANSI.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .names import column

# Formats read by parse_mdy once separators have become "/".
FOUR_DIGIT_YEAR = "M/d/yyyy"
TWO_DIGIT_YEAR = "M/d/yy"
NAMED_MONTH_FORMATS = ("MMMM d yyyy", "MMM d yyyy")
# Fixed value: two-digit years up to this one belong to the 2000s.
LAST_TWO_DIGIT_YEAR = 2068


def parse_mdy(col: str | Column) -> Column:
    """Date from month, day, year text in any of the usual spellings.

    Reads ``5/1/2020``, ``05-01-2020``, ``5.1.20``, ``5 1 2020``,
    ``05012020``, ``May 1, 2020`` and ``may 1 2020``; outer blanks are ignored.
    Year-first text, impossible dates and trailing text give null.
    """
    text = F.btrim(column(col), F.lit(" \t\r\n"))
    digits = F.regexp_replace(text, r"^(\d{1,2})[-/.,\s]+(\d{1,2})[-/.,\s]+(\d{2}|\d{4})$", "$1/$2/$3")
    digits = F.regexp_replace(digits, r"^(\d{2})(\d{2})(\d{2}|\d{4})$", "$1/$2/$3")
    short = F.try_to_date(digits, TWO_DIGIT_YEAR)
    short = F.when(F.year(short) > LAST_TWO_DIGIT_YEAR, F.add_months(short, -1200)).otherwise(short)
    words = F.initcap(F.regexp_replace(text, r"[-/.,\s]+", " "))
    return F.coalesce(
        F.try_to_date(digits, FOUR_DIGIT_YEAR),
        short,
        *[F.try_to_date(words, f) for f in NAMED_MONTH_FORMATS],
    )


def parse_fixed_mdy(col: str | Column) -> Column:
    """Date from strictly ``month/day/year`` text.

    Blanks before a number and anything after the year are ignored, and the
    year is taken as written: ``5/1/20`` is the year 20.
    """
    head = F.regexp_extract(column(col), r"^ *(\d{1,2}/ *\d{1,2}/ *\d{1,4})", 1)
    return F.try_to_date(F.translate(head, " ", ""), "M/d/y")


def mdy_year(col: str | Column) -> Column:
    """Year of a month-day-year text."""
    return F.year(parse_mdy(col))


def weeks_between(start: Column, end: Column) -> Column:
    """Weeks from start to end, as a double."""
    return F.datediff(end, start).cast("double") / 7
