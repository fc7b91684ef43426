"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import bpe, canonical, contamination, cooccurrence, encoding, residue, survivor
from sigmill.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canonical.typed_names(table(spark, sf_dir, "disproportionality_cells"), table(spark, sf_dir, "drug_reference"))
    return found.select("dataset_id", "drug_text", "ref_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, drugs, events = (table(spark, sf_dir, t) for t in ("disproportionality_cells", "drug_reference", "event_terms"))
    return encoding.restored_values(cells, drugs, events).select("dataset_id", "field_name", "stored_text", "ref_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(table(spark, sf_dir, "current_demo"))


def p4_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.fused(table(spark, sf_dir, "current_demo"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.frequent_pairs(table(spark, sf_dir, "report_pairs")).select("dataset_id", "drug_text", "event_pt")


def p6_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with their counts, ratio to chance and odds ratio."""
    found = cooccurrence.pair_counts(table(spark, sf_dir, "report_pairs"))
    return found.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("ratio", "odds_ratio")})


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_fused": p4_fused,
    "p6_found": p6_found,
    "p6_ratios": p6_ratios,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
}
