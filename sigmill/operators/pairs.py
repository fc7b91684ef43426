"""Report x drug x event pairs under a join budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigmill.errors import JoinBudgetExceeded, UnsupportedRole
from sigmill.functions.ids import present
from sigmill.functions.text import drug_text, drug_text_source, normalize_text, role_name, unknown_role
from sigmill.operators.cases import usable
from sigmill.runtime import cut

#: fixed values: pairs that one report may yield; category of every event
PAIRS_PER_REPORT = 10_000
EVENT_CATEGORY = "UNCLASSIFIED_SOURCE_PT"
DEMOGRAPHICS = "event_dt fda_dt age age_cod sex occr_country reporter_country serious seriousnessdeath seriousnesslifethreatening seriousnesshospitalization seriousnessdisabling seriousnesscongenitalanomali seriousnessother".split()


_ELIGIBLE = "drug_text is not null and drug_role is not null"


def _named_drugs(drug: DataFrame, current: DataFrame) -> DataFrame:
    """Drug rows of the current reports in normal form, with a role code that isn't known as ``strange``."""
    own = usable(drug, ("primaryid",)).join(current.select("primaryid"), "primaryid", "left_semi")
    text, source = drug_text(F.col("prod_ai"), F.col("drugname")), drug_text_source(F.col("prod_ai"), F.col("drugname"))
    strange = F.when(unknown_role(F.col("role_cod")), F.col("role_cod"))
    return own.select("primaryid", text.alias("drug_text"), source.alias("drug_text_source"), role_name(F.col("role_cod")).alias("drug_role"), strange.alias("strange"))


def drug_components(drug: DataFrame, current: DataFrame) -> DataFrame:
    """Eligible drug rows of the current reports: ``primaryid``, ``drug_text``, ``drug_text_source``, ``drug_role``."""
    return _named_drugs(drug, current).where(_ELIGIBLE).drop("strange")


def _require_known_roles(named: DataFrame) -> None:
    """Raises if a drug row of a current report has a role code outside the known ones."""
    unknown = [r[0] for r in named.where("strange is not null").select("strange").distinct().limit(5).collect()]
    if unknown:
        raise UnsupportedRole(f"unsupported role codes: {sorted(unknown)}")


def event_components(reac: DataFrame, current: DataFrame) -> DataFrame:
    """Eligible reaction rows of the current reports: ``primaryid``, ``event_pt``."""
    own = usable(reac, ("primaryid",)).join(current.select("primaryid"), "primaryid", "left_semi")
    return own.select("primaryid", present(normalize_text(F.col("pt"))).alias("event_pt")).where("event_pt is not null")


def join_load(drugs: DataFrame, events: DataFrame) -> DataFrame:
    """``primaryid`` and the ``pairs`` that joining its distinct components yields; only reports with both."""
    left = drugs.distinct().groupBy("primaryid").agg(F.count("*").alias("n_drugs"))
    right = events.distinct().groupBy("primaryid").agg(F.count("*").alias("n_events"))
    return left.join(right, "primaryid").withColumn("pairs", F.col("n_drugs") * F.col("n_events"))


def require_join_budget(drugs: DataFrame, events: DataFrame, limit: int = PAIRS_PER_REPORT) -> dict:
    """Largest and total load; raises with the heaviest report if it is over the limit, before anything is joined."""
    row = join_load(drugs, events).agg(F.max("pairs").alias("largest"), F.sum("pairs").alias("total"), F.count("*").alias("joinable"), F.max_by("primaryid", F.struct("pairs", "primaryid")).alias("heaviest")).first()
    if (row["largest"] or 0) > limit:
        raise JoinBudgetExceeded(f"report {row['heaviest']} yields {row['largest']} pairs; the limit is {limit}")
    return {k: row[k] or 0 for k in ("largest", "total", "joinable")}


def build_guards(current: DataFrame, drug: DataFrame, reac: DataFrame, limit: int = PAIRS_PER_REPORT) -> DataFrame:
    """One row of what a build is refused for, and of its load: ``max_pairs``, ``heaviest_report`` (the largest id of
    several, as text), ``joinable_reports``, ``over_budget`` (reports over the limit), ``unknown_roles`` (rows)."""
    load = join_load(drug_components(drug, current), event_components(reac, current))
    heaviest = F.max_by("primaryid", F.struct("pairs", "primaryid")).alias("heaviest_report")
    row = load.agg(F.coalesce(F.max("pairs"), F.lit(0)).alias("max_pairs"), heaviest, F.count("*").alias("joinable_reports"), F.count_if(F.col("pairs") > limit).alias("over_budget"))
    own = usable(drug, ("primaryid",)).join(current.select("primaryid"), "primaryid", "left_semi")
    return row.crossJoin(own.agg(F.count_if(unknown_role(F.col("role_cod"))).alias("unknown_roles")))  # one row each


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs in canonical order (report as text, drug, role, event), with their ``place`` within the report."""
    order = ("drug_text", "drug_role", "event_pt", "drug_text_source")
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("primaryid").orderBy(*order))).orderBy("primaryid", *order)


def report_pairs(current: DataFrame, drug: DataFrame, reac: DataFrame, limit: int | None = PAIRS_PER_REPORT) -> DataFrame:
    """Unique (primaryid, drug_text, drug_text_source, drug_role, event_pt) of the current reports with their demographics.

    ``current`` has plain ids, one row a report. Both sides are reduced to the current reports and made unique before
    they are joined, so the join's result is unique as it is. ``limit`` None leaves the budget to the caller. A report
    without a drug or without an event has no pairs; components with NULL or blank texts and drugs without a role are
    not eligible.
    """
    named, events = _named_drugs(drug, current).distinct(), event_components(reac, current).distinct()
    if limit is not None:
        named, events = cut(named), cut(events)  # looked through first, joined then
        _require_known_roles(named)
    drugs = named.where(_ELIGIBLE).drop("strange")
    if limit is not None:
        require_join_budget(drugs, events, limit)
    known = [c for c in DEMOGRAPHICS if c in current.columns]
    facts = current.select("primaryid", "caseid", "quarter", *(present(F.col(c)).alias(c) for c in known))
    joined = drugs.join(events, "primaryid").join(facts, "primaryid")
    return joined.withColumn("event_category", F.lit(EVENT_CATEGORY))
