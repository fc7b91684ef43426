"""References to reports that are missing, come later or are withdrawn, kept as pending-orphan state.

The state is made of increments: the parents, the withdrawals and the settled references that each batch brought. Only
the pending references and the withdrawn reports, both few, are written anew. A batch probes the parents with its new references, lets
its new parents resolve references that wait, and reopens settled ones whose report it withdraws. Settled references
are read again only if their periods can concern the batch. Each batch leaves counts by table, quarter and standing.

Rows are reduced to distinct keys before they are shuffled, so that a key with a third of all rows is as small as any.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.functions.ids import period, plain_id
from sigmill.runtime import bounded, cut, small

#: Calendar quarters that one batch takes; the outcome is the same for any number.
BATCH_PERIODS = 4
PARENTS, WITHDRAWN, GONE = "primaryid string, caseid string, first int", "caseid string, first int", "primaryid string, gone int"
REFERENCES = "table_name string, period int, primaryid string"
#: ``first``: first period of the report, NULL while it is missing; ``gone``: period from which it is withdrawn.
PENDING = f"{REFERENCES}, first int, gone int, standing string"
COUNTS = "table_name string, period int, standing string, n_references long"


@dataclass
class Increment:
    """Settled references of a batch with the least and the largest period in it, and whether a period is NULL."""

    rows: DataFrame
    low: int | None = -(1 << 31)
    high: int | None = (1 << 31) - 1
    unknown: bool = True


@dataclass
class OrphanState:
    """Increments of parents, withdrawals and settled references; the withdrawn reports; the pending references; counts."""

    pending: Increment
    counts: DataFrame
    gone: DataFrame
    parents: list[DataFrame] = field(default_factory=list)
    withdrawn: list[DataFrame] = field(default_factory=list)
    settled: list[Increment] = field(default_factory=list)
    snapshots: list[tuple[int, DataFrame]] = field(default_factory=list)


def empty_state(spark: SparkSession) -> OrphanState:
    return OrphanState(Increment(spark.createDataFrame([], PENDING), None, None, False), spark.createDataFrame([], COUNTS), spark.createDataFrame([], GONE))


def parents_of(demo: DataFrame) -> DataFrame:
    return demo.select(plain_id(F.col("primaryid")).alias("primaryid"), plain_id(F.col("caseid")).alias("caseid"), period(F.col("quarter")).alias("first")).where("primaryid is not null").groupBy("primaryid", "caseid").agg(F.min("first").alias("first"))


def withdrawals_of(deleted: DataFrame) -> DataFrame:
    return deleted.select(plain_id(F.col("caseid")).alias("caseid"), period(F.col("quarter")).alias("first")).where("caseid is not null").groupBy("caseid").agg(F.min("first").alias("first"))


def references_of(child: DataFrame, name: str) -> DataFrame:
    """Distinct references of a child table; ids that are missing or no numbers are none."""
    return child.select(F.lit(name).alias("table_name"), period(F.col("quarter")).alias("period"), plain_id(F.col("primaryid")).alias("primaryid")).where("primaryid is not null").distinct()


def _together(spark: SparkSession, frames: list[DataFrame], schema: str) -> DataFrame:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return spark.createDataFrame([], schema) if out is None else out


def _first(parents: DataFrame) -> DataFrame:
    """One row a report: its first period (NULL if unknown), and the mark that it is there."""
    return parents.groupBy("primaryid").agg(F.min("first").alias("came"), F.lit(True).alias("there"))


def _meet(references: DataFrame, parents: DataFrame) -> DataFrame:
    """``references`` with what ``parents`` (see ``_first``) add to ``first`` and ``known``."""
    met = references.join(parents, "primaryid", "left")
    return met.withColumns({"first": F.least("first", "came"), "known": F.col("known") | F.coalesce("there", F.lit(False))}).drop("came", "there")


def _standing() -> Column:
    """Missing, late, deleted or held, the first that applies."""
    return F.when(~F.col("known"), "missing").when(F.col("first") > F.col("period"), "late").when(F.col("gone") <= F.col("period"), "deleted").otherwise("held")


def _span(references: DataFrame) -> tuple[int | None, int | None, bool]:
    row = references.agg(F.min("period"), F.max("period"), F.count_if(F.col("period").isNull()) > 0).first()
    return row[0], row[1], row[2]


def _without(fresh: DataFrame, span: tuple, known: list[Increment]) -> DataFrame:
    """``fresh`` references (of these periods) without those that the increments have; only increments that may have any are read."""
    low, high, unknown = span
    for own in known:
        overlap = low is not None and own.low is not None and own.low <= high and own.high >= low
        if overlap or unknown and own.unknown:
            inside = F.lit(False) if low is None else F.col("period").between(low, high)
            there = own.rows.where(inside | F.col("period").isNull()).select(*(F.col(c).alias(f"_{c}") for c in ("table_name", "period", "primaryid")))
            same = (F.col("primaryid") == F.col("_primaryid")) & (F.col("table_name") == F.col("_table_name")) & F.col("period").eqNullSafe(F.col("_period"))
            fresh = fresh.join(there, same, "left_anti")
    return fresh


def advance(state: OrphanState, references: DataFrame, parents: DataFrame, withdrawn: DataFrame, as_of: int = 0) -> OrphanState:
    """The state after a batch of new references, parents and withdrawals (as the ``*_of`` functions make them, written once).

    Only the batch and the pending references are judged. New references meet the batch's own parents first; only those
    that stay open then probe the earlier parents, which are reduced to the asked reports before anything is shuffled
    where these are few. References that were brought before are left out. ``as_of`` names the batch's counts.
    """
    spark = references.sparkSession
    # reports that the batch withdraws: its withdrawals meet all parents, earlier withdrawals its new parents
    marked = lambda old, new, schema: new.withColumn("new", F.lit(True)).unionByName(_together(spark, old, schema).withColumn("new", F.lit(False)))
    all_withdrawn = marked(state.withdrawn, withdrawn, WITHDRAWN).select("caseid", F.col("first").alias("gone"), F.col("new").alias("new_gone"))
    hit = marked(state.parents, parents, PARENTS).join(small(all_withdrawn), "caseid").where("(new or new_gone) and gone is not null")
    merged = state.gone.select("primaryid", F.col("gone").alias("before"), "gone").unionByName(hit.select("primaryid", F.lit(None).cast("int").alias("before"), "gone"))
    gone = cut(merged.groupBy("primaryid").agg(F.min("before").alias("before"), F.min("gone").alias("gone")))
    few_gone = bounded(gone)
    all_gone = F.broadcast(gone) if few_gone else gone

    fresh = references
    if state.settled or state.pending.low is not None or state.pending.unknown:
        fresh = _without(references, _span(references), [*state.settled, state.pending])
    fresh = fresh.withColumns({"first": F.lit(None).cast("int"), "known": F.lit(False), "new": F.lit(True)})
    waiting = state.pending.rows.select("table_name", "period", "primaryid", "first", (F.col("standing") != "missing").alias("known"), F.lit(False).alias("new"))
    met = _meet(fresh.unionByName(waiting), _first(parents))
    if state.parents:
        met = cut(met)
        asked = met.where(F.col("new") & (~F.col("known") | F.coalesce(F.col("first") > F.col("period"), F.lit(True)))).select("primaryid")
        few = bounded(asked)
        earlier = _first(_together(spark, state.parents, PARENTS).join(F.broadcast(asked) if few else asked, "primaryid", "left_semi"))
        met = _meet(met, F.broadcast(earlier) if few else earlier)  # no more reports than were asked for
    judged = cut(met.join(all_gone.drop("before"), "primaryid", "left").select("table_name", "period", "primaryid", "first", "gone", _standing().alias("standing")))
    settled, pending = judged.where("standing = 'held'").drop("standing"), judged.where("standing <> 'held'")

    # settled references of reports that are withdrawn from an earlier period than before wait again
    held = state.counts.where("standing = 'held'")
    low = gone.where("before is null or gone < before").agg(F.min("gone")).first()[0] if state.settled else None
    concerned = [own.rows for own in state.settled if low is not None and own.high is not None and own.high >= low]
    if concerned:
        rows = _together(spark, concerned, PENDING).where(F.col("period") >= low).drop("gone")
        back = cut(rows.join(all_gone, "primaryid").where("gone <= period and (before is null or before > period)").drop("before"))
        pending = pending.unionByName(back.withColumn("standing", F.lit("deleted")))
        held = held.unionByName(back.groupBy("table_name", "period").agg((-F.count("*")).alias("n_references")).withColumn("standing", F.lit("held")))
    own = judged.where("standing = 'held'").unionByName(pending).groupBy("table_name", "period", "standing").agg(F.count("*").alias("n_references"))
    counts = held.unionByName(own).groupBy("table_name", "period", "standing").agg(F.sum("n_references").alias("n_references"))
    counts = cut(counts.where("n_references > 0"))
    return OrphanState(
        Increment(pending, *_span(counts.where("standing <> 'held'"))),
        counts,
        gone.select("primaryid", "gone"),
        [*state.parents, parents],
        [*state.withdrawn, withdrawn],
        [*state.settled, Increment(settled, *_span(settled))],
        [*state.snapshots, (as_of, counts)],
    )


def quarter_name(column: str | Column) -> Column:
    number = F.col(column) if isinstance(column, str) else column
    return F.concat(F.floor(number / 4).cast("string"), F.lit("Q"), (number % 4 + 1).cast("string"))


def broken(state: OrphanState) -> DataFrame:
    """``table_name``, ``quarter``, ``primaryid``, ``orphan_kind`` of the references that don't hold."""
    return state.pending.rows.select("table_name", quarter_name("period").alias("quarter"), "primaryid", F.col("standing").alias("orphan_kind"))


def snapshot(state: OrphanState) -> DataFrame:
    """References by table, quarter and standing, after the last batch."""
    return state.counts.select("table_name", quarter_name("period").alias("quarter"), "standing", "n_references")


def snapshots(state: OrphanState) -> DataFrame:
    """``snapshot`` after every batch, with the last quarter of the batch as ``as_of``."""
    kept = [df.select(quarter_name(F.lit(at)).alias("as_of"), "table_name", quarter_name("period").alias("quarter"), "standing", "n_references") for at, df in state.snapshots]
    return _together(state.counts.sparkSession, kept, "as_of string, table_name string, quarter string, standing string, n_references long")


def replay(demo: DataFrame, children: dict[str, DataFrame], deleted: DataFrame, batch_periods: int = BATCH_PERIODS) -> OrphanState:
    """The state after all deliveries in calendar order, ``batch_periods`` quarters a batch from the earliest one.

    Batches are made only of quarters that occur; a stretch without deliveries is no batch. Rows with a quarter that
    can't be read come in the first batch: a reference of this kind can be missing, but neither late nor of a withdrawn
    case. NULL and unusable ids, ids with blanks or leading zeros, repeated rows and empty tables have the results that
    the ``*_of`` functions state; columns besides the named ones are not read.
    """
    parents, withdrawn = cut(parents_of(demo)), cut(withdrawals_of(deleted))
    references = cut(_together(demo.sparkSession, [references_of(child, name) for name, child in children.items()], REFERENCES))
    when = [df.select(F.col(c).alias("at")).distinct() for df, c in ((parents, "first"), (withdrawn, "first"), (references, "period"))]
    occur = sorted(r["at"] for r in when[0].unionByName(when[1]).unionByName(when[2]).distinct().where("at is not null").collect())  # quarters
    begins = sorted({occur[0] + (at - occur[0]) // batch_periods * batch_periods for at in occur}) or [0]
    state = empty_state(demo.sparkSession)
    for low in begins:
        def of(df: DataFrame, column: str, low: int = low) -> DataFrame:
            inside = F.col(column).between(low, low + batch_periods - 1)
            return df.where(inside | F.col(column).isNull()) if low == begins[0] else df.where(inside)

        state = advance(state, of(references, "period"), of(parents, "first"), of(withdrawn, "first"), low + batch_periods - 1)
    return state
