"""Scan of one drug over a report table: its most reported events against their background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigmill.errors import InvalidProtocol, NoMatchingRows
from sigmill.functions.stats import LIVE_LABELS, with_statistics
from sigmill.operators.cells import from_margins
from sigmill.operators.ranking import SCAN_EVENTS
from sigmill.runtime import cut, lookup

#: fixed values: longest drug query
QUERY_LETTERS = 120


def drug_query(drug: str, fields: tuple[str, ...] = ("drug_text",)) -> Column:
    """Rows with the drug in any of the fields, letter case aside. A column comparison needs no escaping."""
    text = drug.strip()
    if not text or len(text) > QUERY_LETTERS or "\n" in text or "\r" in text:
        raise InvalidProtocol("a drug query has 1 to 120 letters on one line")
    match = F.lit(False)
    for field in fields:
        match = match | (F.upper(F.col(field)) == text.upper())
    return F.coalesce(match, F.lit(False))


def _scored(tables: DataFrame) -> DataFrame:
    label = F.lit(None).cast("string")
    for inner, outer in LIVE_LABELS.items():
        label = F.when(F.col("outcome") == inner, outer).otherwise(label)
    return with_statistics(from_margins(tables)).withColumn("label", label)


def scan(reports: DataFrame, drug: str, k: int = SCAN_EVENTS) -> DataFrame:
    """The drug's ``k`` most reported events with statistics and label, by term; roles pooled, reports counted once.

    ``reports`` has primaryid, drug_text, event_pt. Raises if the drug has no reports or a background is missing; it
    never returns part of a scan.
    """
    found = reports.where(drug_query(drug))
    totals = found.agg(F.count_distinct("primaryid").alias("n")).first()["n"]
    if not totals:
        raise NoMatchingRows(f"no reports of {drug!r}")
    top = found.where("event_pt is not null").select("event_pt", "primaryid").distinct().groupBy("event_pt").agg(F.count("*").alias("a")).orderBy(F.col("a").desc(), "event_pt").limit(k)
    background = reports.join(F.broadcast(top.select("event_pt")), "event_pt", "left_semi").groupBy("event_pt").agg(F.count_distinct("primaryid").alias("event_reports"))
    universe = reports.agg(F.count_distinct("primaryid").alias("universe_reports"))
    joined = cut(top.join(background, "event_pt", "left").crossJoin(F.broadcast(universe)).withColumn("drug_reports", F.lit(totals)))
    if joined.where("event_reports is null or event_reports = 0").limit(1).count():
        raise NoMatchingRows("an event has no background count; the scan is not complete")
    return _scored(joined).orderBy("event_pt")


def scan_all(reports: DataFrame, k: int = SCAN_EVENTS) -> DataFrame:
    """``scan`` of every drug at once (``drug_text`` added): margins are counted once and joined, not drug by drug."""
    seen = reports.select("primaryid", "drug_text", "event_pt").where("drug_text is not null and event_pt is not null").distinct()
    counts = seen.groupBy("drug_text", "event_pt").agg(F.count("*").alias("a"))
    place = F.row_number().over(Window.partitionBy("drug_text").orderBy(F.col("a").desc(), "event_pt"))
    top = counts.withColumn("place", place).where(F.col("place") <= k)
    drugs = seen.select("drug_text", "primaryid").distinct().groupBy("drug_text").agg(F.count("*").alias("drug_reports"))
    events = cut(reports.where("event_pt is not null").select("event_pt", "primaryid").distinct().groupBy("event_pt").agg(F.count("*").alias("event_reports")))
    universe = reports.agg(F.count_distinct("primaryid").alias("universe_reports"))
    # the commonest event is a row of almost every drug, so it is looked up and not met in one task
    return _scored(cut(lookup(top.join(drugs, "drug_text"), events, ["event_pt"]).crossJoin(F.broadcast(universe))))
