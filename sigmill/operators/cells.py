"""2x2 cells of drug, role and event from unique report pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.errors import InvalidTable
from sigmill.functions.stats import EXACT_COUNT
from sigmill.functions.text import SUSPECT_ROLES
from sigmill.operators import incidence
from sigmill.runtime import bounded, lookup

#: fixed values: constant columns of the cell table
COMPARATOR, EVENT_SCOPE, DEDUPLICATION = "all_other_eligible_reports", "all_recorded_source_pts", "MAX_CASEVERSION_PER_CASEID_THEN_MAX_PRIMARYID"
CELL_KEY = ("dataset_id", "drug_text", "drug_text_source", "drug_role", "event_pt")
COUNTS = ("a", "b", "c", "d", "drug_reports", "event_reports", "universe_reports")
GROUP = ("drug_text", "drug_text_source", "drug_role")


#: Bit of each recorded role; a rolled-up role is there if one of its bits is.
_BITS = {role: 1 << n for n, role in enumerate(("primary_suspect", "secondary_suspect", "concomitant", "interacting"))}
_SUSPECT = sum(_BITS[r] for r in SUSPECT_ROLES)


def _one_row_each(pairs: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with ``drug_role`` exploded to the recorded and the rolled-up roles.

    The roles of a key travel as bits of one number, so a key is one row in the shuffle and the roles are unfolded
    only after it; what comes out is distinct without another pass.
    """
    bit = F.lit(0)
    for role, value in _BITS.items():
        bit = F.when(F.col("drug_role") == role, value).otherwise(bit)
    held = pairs.groupBy(*keys).agg(F.bit_or(bit).alias("bits"))
    has = lambda bits: F.col("bits").bitwiseAND(F.lit(bits)) != 0
    roles = F.array(*(F.when(has(value), F.lit(role)) for role, value in _BITS.items()), F.when(has(_SUSPECT), F.lit("suspect")), F.lit("all"))
    return held.select(*keys, F.explode(F.array_compact(roles)).alias("drug_role"))


def with_rollups(pairs: DataFrame) -> DataFrame:
    """Distinct (dataset, report, drug, source, role, event) with the roles ``suspect`` (primary or secondary) and ``all``.

    The rolled-up roles overlap the others, so a report with one drug in two roles counts once in each of them. A role
    other than the four recorded ones counts in ``all`` only.
    """
    return _one_row_each(pairs, "dataset_id", "primaryid", "drug_text", "drug_text_source", "event_pt")


def event_margins(pairs: DataFrame) -> DataFrame:
    """Distinct reports of each event of a data set, over all roles."""
    return pairs.select("dataset_id", "event_pt", "primaryid").distinct().groupBy("dataset_id", "event_pt").agg(F.count("*").alias("event_reports"))


def drug_margins(pairs: DataFrame) -> DataFrame:
    """Distinct reports of each drug, source and role, rolled-up roles included."""
    return _one_row_each(pairs, "dataset_id", "primaryid", "drug_text", "drug_text_source").groupBy("dataset_id", *GROUP).agg(F.count("*").alias("drug_reports"))


def universe(pairs: DataFrame) -> DataFrame:
    """Distinct reports of each data set."""
    return pairs.select("dataset_id", "primaryid").distinct().groupBy("dataset_id").agg(F.count("*").alias("universe_reports"))


def _role_counts() -> list[Column]:
    """Numbers of rows by role, recorded or rolled up, of rows with the roles as ``bits``."""
    has = lambda bits: F.count_if(F.col("bits").bitwiseAND(F.lit(bits)) != 0)
    return [*(has(value).alias(role) for role, value in _BITS.items()), has(_SUSPECT).alias("suspect"), F.count("*").alias("all")]


def cells(pairs: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Every seen (drug, source, role, event) of a data set with its reports ``a``, margins, and ``b``, ``c``, ``d``.

    ``pairs`` has ``dataset_id`` or is all of the named data set. Texts are numbered, and the rows are shuffled once, by
    drug and part (see ``incidence``); there each report's roles are brought together as bits, and pairs and drug margins
    are counted from that one shuffle. Roles become rows only at the end. Pairs with a NULL key part are no pairs;
    repeated pairs count once; a role other than the four recorded ones counts in ``all`` only. Empty pairs give no
    cells.
    """
    if dataset_id is not None:
        pairs = pairs.withColumn("dataset_id", F.lit(dataset_id))
    drug_key, event_key = ["dataset_id", "drug_text", "drug_text_source"], ["dataset_id", "event_pt"]
    needed = ("dataset_id", "primaryid", *GROUP, "event_pt")
    known = pairs.where(" and ".join(f"{c} is not null" for c in needed)).select("dataset_id", F.col("primaryid").alias("report"), *GROUP, "event_pt")
    drugs, events = incidence.numbered(known, drug_key, "drug"), incidence.numbered(known, event_key, "event").drop("n_rows")
    few_drugs, few_events = bounded(drugs), bounded(events)
    seen = lookup(known, events, event_key, few_events).where("event is not null")  # all are: said here, the shuffle below is one for both groupings
    wide = lookup(seen, drugs, drug_key, few_drugs).where("drug is not null")
    bit = F.lit(0)
    for role, value in _BITS.items():
        bit = F.when(F.col("drug_role") == role, value).otherwise(bit)
    rest = F.shiftleft(F.col("event").cast("long"), 4).bitwiseOR(bit.cast("long"))
    placed = wide.select("drug", incidence.part().alias("part"), "report", rest.alias("rest")).repartition("drug", "part")
    bits = F.bit_or(F.col("rest").bitwiseAND(F.lit(15))).alias("bits")
    names = [*_BITS, "suspect", "all"]
    sums = [F.sum(n).alias(n) for n in names]
    # both groupings read the same columns, so that they share the shuffle
    a = placed.groupBy("drug", "part", F.shiftright("rest", 4).cast("int").alias("event"), "report").agg(bits).groupBy("drug", "part", "event").agg(*_role_counts()).groupBy("drug", "event").agg(*sums)
    margins = placed.groupBy("drug", "part", "report").agg(bits).groupBy("drug", "part").agg(*_role_counts()).groupBy("drug").agg(*sums)
    of_drug = drugs.drop("n_rows").join(margins.select("drug", *(F.col(n).alias(f"of_{n}") for n in names)), "drug")
    of_event = events.drop("dataset_id").join(seen.select("event", "report").distinct().groupBy("event").agg(F.count("*").alias("event_reports")), "event")
    # with their margins these have a row an item as before, and a few numbers more in each
    joined = lookup(lookup(a, of_drug, ["drug"], few_drugs), of_event, ["event"], few_events)
    joined = joined.join(universe(known.withColumnRenamed("report", "primaryid")), "dataset_id")
    roles = F.array(*(F.struct(F.lit(n).alias("drug_role"), F.col(n).alias("a"), F.col(f"of_{n}").alias("drug_reports")) for n in names))
    full = joined.select("dataset_id", "drug_text", "drug_text_source", "event_pt", "event_reports", "universe_reports", F.explode(F.filter(roles, lambda r: r["a"] > 0)).alias("r")).select("*", "r.*")
    full = full.withColumns({"b": F.col("drug_reports") - F.col("a"), "c": F.col("event_reports") - F.col("a")})
    full = full.withColumn("d", F.col("universe_reports") - F.col("a") - F.col("b") - F.col("c"))
    constants = {"comparator": F.lit(COMPARATOR), "event_scope": F.lit(EVENT_SCOPE), "deduplication_policy": F.lit(DEDUPLICATION)}
    return full.withColumns(constants).select(*CELL_KEY, *COUNTS, *constants)


def ordered(cells: DataFrame) -> DataFrame:
    """The cells in canonical order."""
    return cells.orderBy("drug_text", "drug_role", "event_pt", "drug_text_source")


def violations(cells: DataFrame) -> DataFrame:
    """``cells`` with ``violation``: the first rule that a row breaks, NULL if none.

    Negative or missing counts, sums that don't meet the margins (without overflow), counts beyond 2^53, empty key
    texts, unknown constants.
    """
    total = lambda *c: sum((F.col(x).cast("decimal(20,0)") for x in c), F.lit(0).cast("decimal(20,0)"))
    missing = " or ".join(f"{c} is null" for c in COUNTS)
    rules = [
        (F.expr(missing), "missing count"),
        (F.least(*COUNTS) < 0, "negative count"),
        (total("a", "b", "c", "d") > EXACT_COUNT, "count beyond exact range"),
        (total("a", "b") != F.col("drug_reports"), "drug margin"),
        (total("a", "c") != F.col("event_reports"), "event margin"),
        (total("a", "b", "c", "d") != F.col("universe_reports"), "universe"),
        (F.expr(" or ".join(f"coalesce(trim({c}), '') = ''" for c in ("dataset_id", "drug_text", "event_pt", "drug_role"))), "empty key"),
        (F.coalesce(F.col("comparator"), F.lit("")) != COMPARATOR, "comparator"),
        (F.coalesce(F.col("event_scope"), F.lit("")) != EVENT_SCOPE, "event scope"),
        (F.coalesce(F.col("deduplication_policy"), F.lit("")) != DEDUPLICATION, "deduplication policy"),
    ]
    found = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        found = F.when(rule, name).otherwise(found)
    return cells.withColumn("violation", found)


def require_valid(cells: DataFrame) -> DataFrame:
    """``cells`` if there is at least one, all are valid, the key is unique and there is one universe; else raises."""
    row = violations(cells).agg(F.count("*").alias("n"), F.count("violation").alias("bad"), F.min("violation").alias("first"), F.min("universe_reports").alias("low"), F.max("universe_reports").alias("high"), F.count_distinct("dataset_id").alias("datasets")).first()
    if not row["n"]:
        raise InvalidTable("no cells")
    if row["bad"]:
        raise InvalidTable(f"{row['bad']} invalid cells, such as: {row['first']}")
    if row["datasets"] != 1 or row["low"] != row["high"]:
        raise InvalidTable("cells of several data sets or universes")
    if cells.groupBy(*CELL_KEY).count().where("count > 1").limit(1).count():
        raise InvalidTable("a cell occurs twice")
    return cells


def from_margins(margins: DataFrame) -> DataFrame:
    """``a``, ``drug_reports``, ``event_reports``, ``universe_reports`` completed to a table; raises if they don't fit."""
    full = margins.withColumns({"b": F.col("drug_reports") - F.col("a"), "c": F.col("event_reports") - F.col("a")}).withColumn("d", F.col("universe_reports") - F.col("a") - F.col("b") - F.col("c"))
    if full.where(f"a is null or b is null or c is null or d is null or least(a, b, c, d) < 0 or universe_reports > {EXACT_COUNT}").limit(1).count():
        raise InvalidTable("margins don't form a table")
    return full
