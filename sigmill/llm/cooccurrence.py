"""Items that appear together in a report, counted over any number of reports.

Items get dense numbers, so that a pair is one packed 64-bit code. The codes are sorted outside memory (Spark's sort
spills sorted runs and merges them) and counted by run length as they stream by. An item with many rows, such as one with
a third of all, lies in parts by its reports, as many as its rows ask for; the partial counts are summed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.operators import incidence
from sigmill.runtime import bounded, lookup

#: Least reports of a pair, and least ratio to chance.
LEAST_REPORTS, LEAST_RATIO = 4, 4


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct reports of each code in a stream sorted by code and report; the last, open run is carried along."""
    code, report, count = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("code").to_numpy(zero_copy_only=False)
        reports = batch.column("report")
        fresh = np.ones(len(codes), bool)
        if len(codes) > 1:
            same = pc.equal(reports.slice(1), reports.slice(0, len(codes) - 1)).to_numpy(zero_copy_only=False)
            fresh[1:] = (codes[1:] != codes[:-1]) | ~same.astype(bool)
        fresh[0] = not (code == codes[0] and report == reports[0].as_py())
        edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        counts = np.add.reduceat(fresh.astype(np.int64), edges)
        found = codes[edges]
        if code is not None and code == found[0]:
            counts[0] += count
        elif code is not None:
            found, counts = np.append(code, found), np.append(count, counts)
        code, report, count = found[-1], reports[-1].as_py(), counts[-1]
        yield pa.RecordBatch.from_arrays([pa.array(found[:-1], pa.int64()), pa.array(counts[:-1], pa.int64())], names=["code", "n"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([count], pa.int64())], names=["code", "n"])


def distinct_reports(coded: DataFrame) -> DataFrame:
    """``code`` and ``n``, the number of its distinct reports, of rows (``code``, ``report``) that lie together by code.

    The rows of a code may lie in several partitions if no report does; the partial counts are summed.
    """
    partial = coded.sortWithinPartitions("code", "report").mapInArrow(run_lengths, "code long, n long")
    return partial.groupBy("code").agg(F.sum("n").alias("n"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """Reports of each pair of texts that stand in one row, with those of its parts and of the data set.

    ``rows`` has dataset_id, primaryid, drug_text, event_pt. Result: ``dataset_id``, ``drug_text``, ``event_pt``, ``n``,
    ``drug_n``, ``event_n``, ``universe``, ``ratio`` (n * universe / (drug_n * event_n)) and ``odds_ratio`` (of the 2x2
    table with 0.5 added to each cell). Texts count as stored. A row with a NULL text is in no pair, but its report
    counts for what the row has; rows with a NULL report or data set don't count; repeated rows count once.

    Rows are shuffled once, as numbers, by drug and part (see ``incidence``): pairs are counted there by sorting their
    codes, and the reports of each drug from the same shuffle. The reports of events and data sets are few after they
    are made distinct in the map tasks.
    """
    base = rows.select("dataset_id", F.col("primaryid").alias("report"), "drug_text", "event_pt").where("dataset_id is not null and primaryid is not null")
    drug_key, event_key = ["dataset_id", "drug_text"], ["dataset_id", "event_pt"]
    drugs, events = incidence.numbered(base, drug_key, "drug"), incidence.numbered(base, event_key, "event").drop("n_rows")
    few_drugs, few_events = bounded(drugs), bounded(events)
    seen = lookup(base, events, event_key, few_events)
    wide = lookup(seen, drugs, drug_key, few_drugs).where("drug is not null")
    code = F.shiftleft(F.col("drug").cast("long"), 32).bitwiseOR(F.coalesce("event", F.lit(0)).cast("long"))  # event 0: none
    placed = wide.select("drug", incidence.part().alias("part"), "report", code.alias("code")).repartition("drug", "part")
    coded = distinct_reports(placed.select("code", "report"))
    # each report's least code is asked for only so that this reads what the pairs read, and shares their shuffle
    margin = placed.groupBy("drug", "part", "report").agg(F.min("code").alias("least")).where("least > 0").groupBy("drug", "part").agg(F.count("*").alias("n")).groupBy("drug").agg(F.sum("n").alias("drug_n"))
    of_drug = drugs.drop("n_rows").join(margin, "drug")
    of_event = events.drop("dataset_id").join(seen.where("event is not null").select("event", "report").distinct().groupBy("event").agg(F.count("*").alias("event_n")), "event")
    universe = base.select("dataset_id", "report").distinct().groupBy("dataset_id").agg(F.count("*").alias("universe"))
    event = F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    pairs = coded.select(F.shiftright("code", 32).cast("int").alias("drug"), event.alias("event"), "n").where("event > 0")
    # with their margins the items have a row each as before, and a number more in it
    joined = lookup(lookup(pairs, of_drug, ["drug"], few_drugs), of_event, ["event"], few_events).join(universe, "dataset_id")
    a, b, c = F.col("n"), F.col("drug_n") - F.col("n"), F.col("event_n") - F.col("n")
    d = F.col("universe") - F.col("drug_n") - F.col("event_n") + F.col("n")
    return joined.select(
        "dataset_id",
        "drug_text",
        "event_pt",
        "n",
        "drug_n",
        "event_n",
        "universe",
        (F.col("n").cast("double") * F.col("universe") / (F.col("drug_n").cast("double") * F.col("event_n"))).alias("ratio"),
        ((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))).alias("odds_ratio"),
    )


def _exact(*columns: str) -> Column:
    """Product of counts without overflow."""
    product = F.lit(1).cast("decimal(38,0)")
    for c in columns:
        product = (product * F.col(c).cast("decimal(19,0)")).cast("decimal(38,0)")
    return product


def frequent_pairs(rows: DataFrame, reports: int = LEAST_REPORTS, ratio: int = LEAST_RATIO) -> DataFrame:
    """The pairs of ``pair_counts`` with at least so many reports and so many times what chance would give."""
    counted = pair_counts(rows)
    return counted.where((F.col("n") >= reports) & (_exact("n", "universe") >= _exact("drug_n", "event_n") * F.lit(ratio)))
