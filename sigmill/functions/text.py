"""Text rules of the report tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigmill.functions.ids import present, trimmed

#: fixed values: role of each role code
ROLES = {"PS": "primary_suspect", "SS": "secondary_suspect", "C": "concomitant", "I": "interacting"}
#: fixed values: roles that a role also counts for
SUSPECT_ROLES = ("primary_suspect", "secondary_suspect")
ALL_ROLES = ("primary_suspect", "secondary_suspect", "concomitant", "interacting", "suspect", "all")
#: fixed values: first signs that a spreadsheet takes for a formula
FORMULA_START = "^[=+@-]"
#: fixed values: white space of Unicode
WHITE_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def normalize_text(column: Column) -> Column:
    """Upper case, outer white space off, inner runs of white space as one blank; NULL stays."""
    return F.upper(F.regexp_replace(trimmed(column), WHITE_SPACE, " "))


def role_name(column: Column) -> Column:
    """Name of a role code; NULL for a missing or unknown code (see ``unknown_role``)."""
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.try_element_at(names, F.upper(trimmed(column)))


def unknown_role(column: Column) -> Column:
    """Whether a role code is there but not known."""
    code = present(F.upper(trimmed(column)))
    return F.coalesce(code.isNotNull() & ~code.isin(*ROLES), F.lit(False))


def drug_text(prod_ai: Column, drugname: Column) -> Column:
    """Normalised ingredient, or the product name where there is none."""
    return F.coalesce(present(normalize_text(prod_ai)), present(normalize_text(drugname)))


def drug_text_source(prod_ai: Column, drugname: Column) -> Column:
    """Which field the drug text comes from; NULL where both are missing."""
    there = lambda c: present(F.upper(trimmed(c))).isNotNull()
    return F.when(there(prod_ai), "PROD_AI").when(there(drugname), "DRUGNAME")


def is_formula(column: Column) -> Column:
    return F.coalesce(column.rlike(FORMULA_START), F.lit(False))


def spreadsheet_safe(column: Column) -> Column:
    """The text with an apostrophe before a first sign that a spreadsheet would take for a formula."""
    return F.when(is_formula(F.regexp_replace(column, r"^[ \t\r\n]+", "")), F.concat(F.lit("'"), column)).otherwise(column)
