"""Results in the shapes callers get: metric arrays, long rows, review flags, spreadsheet rows."""

from __future__ import annotations

import decimal
import math
import operator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sigmill.functions.stats import ZERO_CELL
from sigmill.functions.text import spreadsheet_safe

#: fixed values: measure of each method, in the order in which methods are listed
MEASURES = {"fisher_exact": "two_sided_probability_ordering", "prr": "reporting_ratio", "ror": "reporting_odds_ratio"}
CORRECTION = "haldane_anscombe"


def _number(name: str) -> Column:
    return F.col(name).cast("double")


def _metric(method: str) -> Column:
    none = F.lit(None).cast("double")
    if method == "fisher_exact":
        values = [_number("fisher_p"), none, none, _number("fisher_p"), _number("fdr_q"), F.lit("observed"), F.lit(False), F.lit("none"), F.lit(0.0)]
    else:
        shift = F.col("zero_corrected")
        values = [_number(method), _number(f"{method}_low"), _number(f"{method}_high"), none, none, F.when(shift, "corrected").otherwise("observed"), shift, F.when(shift, CORRECTION).otherwise("none"), F.when(shift, ZERO_CELL).otherwise(0.0)]
    names = ["estimate", "lower_95", "upper_95", "p_value", "q_value", "input_cells", "correction_applied", "correction_method", "added_to_each_cell"]
    return F.struct(F.lit(method).alias("method"), F.lit(MEASURES[method]).alias("measure"), *(v.alias(n) for v, n in zip(values, names)))


def with_metrics(results: DataFrame, methods: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """``results`` with ``metrics``: one struct for each asked method in order; an exact test that wasn't computed is left out."""
    listed = F.array(*(_metric(m) for m in sorted(methods)))
    if "fisher_exact" in methods:  # the other methods always have an estimate
        # a filter has no compiled form, nor has what it filters: only where something is to be left out
        complete = reduce(operator.and_, (F.col("fisher_p" if m == "fisher_exact" else m).isNotNull() for m in methods))
        listed = F.when(complete, listed).otherwise(F.filter(listed, lambda m: m["estimate"].isNotNull()))
    return results.withColumn("metrics", listed)


def metrics_long(results: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """A row for each metric of each result."""
    # the outer form: for the inner one the optimiser infers a filter that builds all arrays a second time
    return results.select(*keep, F.explode_outer("metrics").alias("m")).select(*keep, "m.*").where("method is not null")


def review_flags(results: DataFrame, profile: str = "evans_educational") -> DataFrame:
    """``results`` with ``profile_id``, ``flag`` (the label) and ``reason`` (the numbers behind it)."""
    reason = F.format_string("a=%d; PRR=%s; Yates chi-square=%s", "a", F.round("prr", 6).cast("decimal(24,6)").cast("string"), F.round("chi2", 6).cast("decimal(24,6)").cast("string"))
    return results.withColumns({"profile_id": F.lit(profile), "flag": F.col("outcome"), "reason": reason})


def shortest(number: Column) -> Column:
    """Shortest text that reads back as the same number, in the form of ``%g``: with an exponent below 1e-4 and from 1e6 on."""
    return F.when(F.isnan(number), "NaN").when(number.isNotNull(), _shortest_texts(number))


@F.pandas_udf(T.StringType())
def _shortest_texts(values: pd.Series) -> pd.Series:
    return pd.Series([None if x != x else _shortest(x) for x in values.tolist()], dtype=object)


def _shortest(x: float) -> str:
    if not math.isfinite(x) or x == 0:
        return "0" if x == 0 else "+Inf" if x > 0 else "-Inf"
    sign, digits, last = decimal.Decimal(repr(float(x))).normalize().as_tuple()
    text, power = "".join(map(str, digits)), len(digits) + last - 1
    if power < -4 or power >= 6:
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'-' if power < 0 else '+'}{abs(power):02d}"
    elif power < 0:
        body = "0." + "0" * (-power - 1) + text
    else:
        body = text[: power + 1].ljust(power + 1, "0") + ("." + text[power + 1 :] if len(text) > power + 1 else "")
    return "-" * sign + body


#: fixed values: columns of an export
EXPORT = (
    "analysis_id result_digest result_family_id result_row_count result_row_number drug_concept_id event_concept_id event_term event_category a b c d n "
    "method measure estimate lower_95 upper_95 p_value q_value input_cells zero_cell_correction_applied zero_cell_correction_method added_to_each_cell"
).split()


def export_rows(results: DataFrame, analysis_id: str, digest: str, family: str, drug_concept: str, event_concept: str, category: str) -> DataFrame:
    """A result as the 25 text columns of an export, a row for each metric, safe to open in a spreadsheet.

    ``results`` has the event, the cells and ``metrics``. Rows are numbered in canonical order by event; a result is
    bounded, so its numbers come from one sort. Missing numbers are empty texts.
    """
    count = results.count()
    numbered = results.withColumn("result_row_number", F.row_number().over(Window.orderBy("event_pt")))
    named = {
        "analysis_id": F.lit(analysis_id), "result_digest": F.lit(digest), "result_family_id": F.lit(family), "result_row_count": F.lit(count),
        "drug_concept_id": F.lit(drug_concept), "event_concept_id": F.concat(F.lit(f"{event_concept}:"), "event_pt"), "event_term": F.col("event_pt"),
        "event_category": F.lit(category), "n": F.col("a") + F.col("b") + F.col("c") + F.col("d"),
    }
    kept = [*named, "result_row_number", "a", "b", "c", "d"]
    long = metrics_long(numbered.withColumns(named), tuple(kept)).withColumnsRenamed({"correction_applied": "zero_cell_correction_applied", "correction_method": "zero_cell_correction_method"})
    numbers = ("estimate", "lower_95", "upper_95", "p_value", "q_value", "added_to_each_cell")
    texts = {c: F.coalesce(shortest(F.col(c)), F.lit("")) for c in numbers} | {c: F.col(c).cast("string") for c in EXPORT if c not in numbers}
    return spreadsheet_rows(long.withColumns({c: v for c, v in texts.items() if c not in numbers})).withColumns({c: texts[c] for c in numbers}).select(*EXPORT)


def write_export(rows: DataFrame, path: str) -> None:
    """An export as quoted CSV with a header; refuses to overwrite."""
    rows.write.mode("errorifexists").options(header=True, quote='"', escape='"', lineSep="\n", emptyValue="").csv(path)


def spreadsheet_rows(long: DataFrame) -> DataFrame:
    """``long`` with every text column safe to open in a spreadsheet."""
    texts = [c for c, kind in long.dtypes if kind == "string"]
    return long.withColumns({c: spreadsheet_safe(F.col(c)) for c in texts})
