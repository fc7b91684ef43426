"""Identifiers, periods and missing values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: texts that mean "missing" besides NULL
MISSING = ("", "NA")
_BLANKS = " \t\r\n"


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(_BLANKS))


def present(column: Column) -> Column:
    """The column with NULL for values that mean missing."""
    for text in MISSING:
        column = F.nullif(column, F.lit(text))
    return column


def plain_id(column: Column) -> Column:
    """A decimal id of any length without blanks and leading zeros; NULL unless it is a positive whole number."""
    text = trimmed(column)
    digits = F.ltrim(text, F.lit("0"))
    return F.when(text.rlike("^[0-9]+$") & (digits != ""), digits)


def magnitude(column: Column) -> Column:
    """A struct that orders plain ids as numbers: by digits, then byte-wise. NULL ids come first."""
    return F.struct(F.coalesce(F.length(column), F.lit(0)).alias("digits"), F.coalesce(column, F.lit("")).alias("text"))


def period(column: Column) -> Column:
    """Number of a calendar quarter (year * 4 + quarter - 1) written in any usual way; NULL for anything else.

    Year first with two or four digits and the quarter after a Q, a sign or a blank (``2022Q3``, ``22-q3``,
    ``2022.3``), or the quarter first (``Q3 2022``).
    """
    text = F.upper(trimmed(column))
    first, second = r"^([0-9]{4}|[0-9]{2})[-_ ./]?Q?[-_ ]?([1-4])$", r"^Q([1-4])[-_ ./]*([0-9]{4}|[0-9]{2})$"
    year = F.when(text.rlike(first), F.regexp_extract(text, first, 1)).when(text.rlike(second), F.regexp_extract(text, second, 2))
    quarter = F.when(text.rlike(first), F.regexp_extract(text, first, 2)).when(text.rlike(second), F.regexp_extract(text, second, 1))
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return full.cast("int") * 4 + quarter.cast("int") - 1
