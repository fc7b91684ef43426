"""Feeds of delimited files whose columns change: one table per kind, and every change of a field.

Every file of a feed has its own header. Columns are tied to fields by their normalised header names; what a field's
values look like is kept per file as counts by type branch (a tagged union), from which the file's type of the field
follows. Values are counted per column position before the header is joined, so that only a few rows per file move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigmill.functions.ids import period, trimmed

#: fixed values: separator by feed kind, as a regular expression
SEPARATORS = {"demo": "[$]", "cells": "\t"}
BRANCHES = ("integer", "decimal", "date", "text")


def normalised(name: Column) -> Column:
    """A header name in lower case with one underscore for each run of other signs than letters and digits."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def branch(value: Column) -> Column:
    """Type branch of a value: integer, decimal, date or text; NULL for a missing value."""
    text = trimmed(value)
    return (
        F.when(text.isNull() | text.isin("", "NA"), None)
        .when(text.rlike("^[0-9]+$"), "integer")
        .when(text.rlike("^[0-9]+([.][0-9]+)?$"), "decimal")
        .when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .otherwise("text")
    )


def _parts(lines: DataFrame) -> Column:
    """The line's parts; a line of a kind without a known separator is an error, as it can't be read."""
    found = F.raise_error(F.concat(F.lit("no separator is known for feeds of the kind "), F.coalesce("feed_kind", F.lit("NULL")))).cast("array<string>")
    for kind, separator in SEPARATORS.items():
        found = F.when(F.col("feed_kind") == kind, F.split("raw_line", separator, -1)).otherwise(found)
    return found


def headers(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``feed``, ``feed_kind``, ``file_no``, ``pos``, ``name`` (normalised) and ``field`` of every column of every file.

    A name that isn't listed for the feed's kind is its own field; columns with an empty name are none. Of two columns
    of a file with one field the first is taken.
    """
    first = lines.where("line_no = 0").select("feed", "feed_kind", "file_no", F.posexplode(_parts(lines)).alias("pos", "name")).withColumn("name", normalised(F.col("name")))
    listed = names.select("feed_kind", F.col("seen_as").alias("name"), "field_name").groupBy("feed_kind", "name").agg(F.min("field_name").alias("field_name"))
    tied = first.where("name <> ''").join(listed, ["feed_kind", "name"], "left").withColumn("field", F.coalesce("field_name", "name"))
    return tied.groupBy("feed", "feed_kind", "file_no", "field").agg(F.min(F.struct("pos", "name")).alias("column")).select("feed", "feed_kind", "file_no", "column.pos", "column.name", "field")


def branches(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """``columns`` with the number of values of each type branch and the file's ``type`` of the field.

    The type is integer if all values are; else decimal if all are integers or decimals; else date if all are; else
    text; NULL without values.
    """
    values = lines.where("line_no > 0").select("feed", "file_no", F.posexplode(_parts(lines)).alias("pos", "value")).withColumn("branch", branch(F.col("value")))
    counts = values.where("branch is not null").groupBy("feed", "file_no", "pos").agg(*(F.count_if(F.col("branch") == b).alias(b) for b in BRANCHES))
    total = sum((F.col(b) for b in BRANCHES), F.lit(0))
    kind = (
        F.when(F.col("integer") == total, "integer")
        .when(F.col("integer") + F.col("decimal") == total, "decimal")
        .when(F.col("date") == total, "date")
        .when(total > 0, "text")
    )
    return columns.join(counts, ["feed", "file_no", "pos"], "left").withColumn("type", kind)


def changes(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``feed``, ``file_no``, ``field_name``, ``change_kind`` of every change of a file against the file before it.

    ``added`` and ``removed``: the field is only in this or only in the previous file; ``renamed``: in both under
    different names; ``retyped``: another type than in the nearest earlier file in which the field has a value. The
    first file of a feed has no changes; a field may have two. Repeated lines change nothing; a file without a header
    has no fields; lines with a NULL feed or file number are no lines; an empty table gives an empty result.
    """
    lines = lines.where("feed is not null and file_no is not null")
    order = Window.partitionBy("feed").orderBy("file_no")
    files = lines.select("feed", "file_no").distinct().withColumns({"previous": F.lag("file_no").over(order), "next": F.lead("file_no").over(order)})
    fields = branches(lines, headers(lines, names)).join(files, ["feed", "file_no"])
    along = Window.partitionBy("feed", "field").orderBy("file_no")
    seen = fields.withColumns(
        {
            "last_file": F.lag("file_no").over(along),
            "last_name": F.lag("name").over(along),
            "then_file": F.lead("file_no").over(along),
            "last_type": F.last("type", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    both = F.col("last_file") == F.col("previous")
    found = F.array(
        F.when(F.col("previous").isNotNull() & ~F.coalesce(both, F.lit(False)), F.struct(F.col("file_no"), F.lit("added").alias("change_kind"))),
        F.when(F.col("next").isNotNull() & ~F.coalesce(F.col("then_file") == F.col("next"), F.lit(False)), F.struct(F.col("next").alias("file_no"), F.lit("removed").alias("change_kind"))),
        F.when(both & (F.col("name") != F.col("last_name")), F.struct(F.col("file_no"), F.lit("renamed").alias("change_kind"))),
        F.when(F.col("type") != F.col("last_type"), F.struct(F.col("file_no"), F.lit("retyped").alias("change_kind"))),
    )
    return seen.select("feed", F.col("field").alias("field_name"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("change")).select("feed", "change.file_no", "field_name", "change.change_kind").distinct()


def alternatives(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``feed``, ``file_no``, ``field_name``, ``branch``, ``n_values``: type branches that appear in a field for the first time.

    A branch appears in a file if no earlier file of the feed has a value of it in the field but one has values of
    other branches; several files may be between. Lines with a NULL feed or file number are no lines.
    """
    lines = lines.where("feed is not null and file_no is not null")
    counted = branches(lines, headers(lines, names))
    listed = F.explode(F.array(*(F.struct(F.lit(b).alias("branch"), F.coalesce(b, F.lit(0)).alias("n_values")) for b in BRANCHES)))
    held = counted.select("feed", "field", "file_no", listed.alias("b")).select("feed", "field", "file_no", "b.*").where("n_values > 0")
    begun = held.groupBy("feed", "field").agg(F.min("file_no").alias("begun"))
    first = held.groupBy("feed", "field", "branch").agg(F.min(F.struct("file_no", "n_values")).alias("first"))
    return first.join(begun, ["feed", "field"]).where("first.file_no > begun").select("feed", "first.file_no", F.col("field").alias("field_name"), "branch", "first.n_values")


def values(lines: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """The filled values of ``unified`` as rows: ``feed``, ``file_no``, ``line_no``, ``field_name``, ``value``."""
    whole = unified(lines, names, kind)
    listed = [c for c in whole.columns if f"{c}_number" in whole.columns]
    pairs = F.map_concat(F.map_from_arrays(F.array(*(F.lit(c) for c in listed)), F.array(*(F.col(c) for c in listed))), "other")
    long = whole.select("feed", "file_no", "line_no", F.explode(pairs).alias("field_name", "value"))
    return long.where("value is not null and value not in ('', 'NA')")


#: fixed values: spellings of a drug text's source, as letters in upper case; other codes can't be told
SOURCES = {"PRODAI": "PROD_AI", "AI": "PROD_AI", "DRUGNAME": "DRUGNAME", "DN": "DRUGNAME"}


def canonical_source(value: Column) -> Column:
    """``PROD_AI`` or ``DRUGNAME`` for a known spelling of a drug text's source, else NULL."""
    names = F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair))
    return F.try_element_at(names, F.upper(F.regexp_replace(value, "[^A-Za-z]+", "")))


def unified(lines: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """All files of one kind as one table: a column for each listed field of the kind, the rest in the map ``other``.

    Values are trimmed, missing ones NULL. A field whose values conflict keeps them as text; beside it stand the typed
    branches ``<field>_number`` and ``<field>_date``, and canonical forms: for ``quarter`` ``quarter_period``
    (``2024Q1``), for ``drug_text_source`` ``drug_text_source_code`` (see ``canonical_source``). The
    key is ``feed``, ``file_no``, ``line_no``; repeated lines stay.
    """
    own = lines.where((F.col("feed_kind") == kind) & F.col("feed").isNotNull() & F.col("file_no").isNotNull())
    columns = headers(own, names).groupBy("feed", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "pos"))).alias("places"))
    rows = own.where("line_no > 0").select("feed", "file_no", "line_no", _parts(own).alias("parts")).join(columns, ["feed", "file_no"])
    fields = sorted(r[0] for r in names.where(F.col("feed_kind") == kind).select("field_name").distinct().collect())
    out = []
    for field in fields:
        text = trimmed(F.try_element_at("parts", F.try_element_at("places", F.lit(field)) + 1))
        value = F.when(~text.isin("", "NA"), text)
        out.append(value.alias(field))
        if field == "quarter":
            number = period(value)
            out.append(F.concat((number / 4).cast("int").cast("string"), F.lit("Q"), (number % 4 + 1).cast("string")).alias("quarter_period"))
        if field == "drug_text_source":
            out.append(canonical_source(value).alias("drug_text_source_code"))
        out.append(F.when(branch(value).isin("integer", "decimal"), value.cast("double")).alias(f"{field}_number"))
        out.append(F.when(branch(value) == "date", F.try_to_date(value)).alias(f"{field}_date"))
    other = F.map_filter("places", lambda k, _: ~k.isin(fields))
    other = F.transform_values(other, lambda _, p: trimmed(F.try_element_at("parts", p + 1)))
    return rows.select("feed", "file_no", "line_no", *out, other.alias("other"))
