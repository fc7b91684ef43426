"""The driver's report tables as the stages of a snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators import cases, cells, pairs
from sigmill.runtime import cut, table

DATASET = "sigmill-all"


@dataclass(frozen=True)
class Stages:
    demo: DataFrame
    drug: DataFrame
    reac: DataFrame
    current: DataFrame


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    """The received tables; children that don't belong to a received report of their case are set aside.

    The received and the current reports are read several times by what follows, so they are written once.
    """
    raw = {n: table(spark, sf_dir, n) for n in ("demo_all", "drug_all", "reac_all")}
    demo = cut(cases.received_once(raw["demo_all"]))
    index = demo.select("primaryid", "caseid")
    children = [cases.usable(raw[n], ("primaryid", "caseid")).join(index, ["primaryid", "caseid"], "left_semi") for n in ("drug_all", "reac_all")]
    return Stages(demo, children[0], children[1], cut(cases.latest_versions(demo)))


def built_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(stages(spark, sf_dir))


def pairs_of(s: Stages) -> DataFrame:
    """The pairs of the stages, under the join budget and with known roles only, or an error."""
    return pairs.report_pairs(s.current, s.drug, s.reac).withColumn("dataset_id", F.lit(DATASET))


def built_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.cells(cut(built_pairs(spark, sf_dir).select("dataset_id", "primaryid", *cells.GROUP, "event_pt")))


def given_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's cell table without its repeated rows."""
    return table(spark, sf_dir, "disproportionality_cells").distinct()
