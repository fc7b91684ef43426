"""Populations, completeness and duplicate counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.errors import PopulationError
from sigmill.functions.ids import present, trimmed
from sigmill.operators.cases import integrity_counters, require_subset, with_plain_ids
from sigmill.operators.pairs import join_load

#: fixed values: counts of a build
SUMMARY = (
    "source_quarters source_demo_rows current_case_reports superseded_demo_rows duplicate_caseversion_rows drug_rows_raw reaction_rows_raw eligible_reports "
    "drug_event_pairs distinct_drug_role_groups distinct_event_pts aggregate_rows demo_duplicate_primaryids drug_orphan_rows drug_caseid_mismatches "
    "reaction_orphan_rows reaction_caseid_mismatches eligible_drug_component_rows unique_drug_components duplicate_drug_components_removed "
    "eligible_reaction_component_rows unique_reaction_components duplicate_reaction_components_removed max_projected_pairs_per_report "
    "reports_with_joinable_components drug_rows_for_superseded_reports reaction_rows_for_superseded_reports"
).split()
COMPLETENESS_FIELDS = ("age", "sex", "occr_country", "serious")


def population_counts(source: DataFrame, current: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: source rows, current reports, eligible reports (with a pair) and pairs."""
    return (
        source.agg(F.count("*").alias("source_demo_rows"))
        .crossJoin(current.agg(F.count("*").alias("current_case_reports")))
        .crossJoin(pairs.agg(F.count_distinct("primaryid").alias("eligible_reports"), F.count("*").alias("drug_event_pairs")))
    )  # one row each


def require_populations(source: DataFrame, current: DataFrame, pairs: DataFrame) -> None:
    """Raises unless eligible reports are current and current ones are in the source (plain ids)."""
    require_subset(current, source, "primaryid", "current reports")
    require_subset(pairs, current, "primaryid", "eligible reports")


def eligible_reports(current: DataFrame, pairs: DataFrame) -> DataFrame:
    """The current reports that have a pair; raises unless they are as many as the reports of the pairs."""
    eligible = current.join(pairs.select("primaryid"), "primaryid", "left_semi")
    found, wanted = eligible.count(), pairs.select("primaryid").distinct().count()
    if found != wanted:
        raise PopulationError(f"{found} current reports for {wanted} reports with pairs")
    return eligible


def summary(demo: DataFrame, raw_drug: DataFrame, raw_reac: DataFrame, current: DataFrame, drugs: DataFrame, events: DataFrame, pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The 27 counts of a build as rows of ``metric`` and ``value``.

    ``demo``: the received reports; ``raw_drug``, ``raw_reac``: all child rows; ``current``; ``drugs``, ``events``: the
    eligible components; ``pairs``; ``cells``. Child rows that are no part of the build (without their parent, of
    another case, with unusable ids) are counted as such, and those of reports that are not current as superseded.
    """
    whole = integrity_counters(demo, raw_drug, raw_reac)
    made = {r["component"]: (r["n_rows"], r["n_unique"], r["n_repeated"]) for r in duplicate_components(drugs, events).collect()}  # two rows
    load = join_load(drugs, events).agg(F.coalesce(F.max("pairs"), F.lit(0)).alias("max_projected_pairs_per_report"), F.count("*").alias("reports_with_joinable_components"))
    held = pairs.agg(F.count_distinct("primaryid").alias("eligible_reports"), F.count("*").alias("drug_event_pairs"), F.count_distinct("event_pt").alias("distinct_event_pts"))
    groups = pairs.select("drug_text", "drug_text_source", "drug_role").distinct().agg(F.count("*").alias("distinct_drug_role_groups"))
    source = demo.agg(F.count_distinct("quarter").alias("source_quarters"), F.count("*").alias("source_demo_rows"), (F.count("*") - F.count_distinct("caseid", "caseversion")).alias("duplicate_caseversion_rows"))
    wide = source.crossJoin(current.agg(F.count("*").alias("current_case_reports"))).crossJoin(held).crossJoin(groups).crossJoin(load).crossJoin(cells.agg(F.count("*").alias("aggregate_rows")))
    children = (("drug", raw_drug), ("reaction", raw_reac))
    for name, child in children:
        known = with_plain_ids(child.select("primaryid"), ("primaryid",)).groupBy("primaryid").agg(F.count("*").alias("n")).join(current.select("primaryid", F.lit(1).alias("there")), "primaryid", "left")
        wide = wide.crossJoin(known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_rows_raw"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias(f"{name}_rows_for_superseded_reports")))
    wide = wide.crossJoin(whole)  # all of one row
    named = {
        "superseded_demo_rows": F.col("source_demo_rows") - F.col("current_case_reports"),
        "demo_duplicate_primaryids": F.col("duplicate_primaryids"),
        **{f"{name}_{what}": value for name, short in (("drug", "drug"), ("reaction", "reac")) for what, value in (("orphan_rows", F.col(f"{short}_orphans") + F.col(f"{short}_unusable")), ("caseid_mismatches", F.col(f"{short}_mismatches")))},
        **{text: F.lit(made[part][n]) for name, part in (("drug", "drug"), ("reaction", "event")) for n, text in enumerate((f"eligible_{name}_component_rows", f"unique_{name}_components", f"duplicate_{name}_components_removed"))},
    }
    return long_format(wide.withColumns(named).select(*SUMMARY))


def field_completeness(reports: DataFrame, fields: tuple[str, ...] = COMPLETENESS_FIELDS) -> DataFrame:
    """A row for each field: ``field_name``, ``n_reports``, ``n_missing`` (NULL, blank or NA), ``missing_percent``.

    One pass over the reports, whatever the number of fields.
    """
    missing = [F.count_if(F.coalesce(present(trimmed(F.col(f).cast("string"))), F.lit("")) == "").alias(f) for f in fields]
    wide = reports.agg(F.count("*").alias("n_reports"), *missing)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("n_missing")) for f in fields)))
    percent = F.when(F.col("n_reports") > 0, F.round(F.lit(100.0) * F.col("n_missing") / F.col("n_reports"), 6)).otherwise(0.0)
    return wide.select("n_reports", rows.alias("f")).select("f.field_name", "n_reports", "f.n_missing").withColumn("missing_percent", percent)


def duplicate_components(drugs: DataFrame, events: DataFrame) -> DataFrame:
    """Rows before and after components are made unique: ``component``, ``n_rows``, ``n_unique``, ``n_repeated``."""
    out = None
    for name, df in (("drug", drugs), ("event", events)):
        grouped = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
        row = grouped.agg(F.lit(name).alias("component"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_unique"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("n_repeated", F.col("n_rows") - F.col("n_unique"))


def long_format(wide: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """A one-row frame of counts as rows of name and value."""
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias(key), F.col(c).cast("long").alias(value)) for c in wide.columns))).alias("m")).select("m.*")
