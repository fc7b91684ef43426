"""The surviving record of each group of duplicates, by currency of values.

Rows of a case are partially ordered by what tells their age: a higher version is later, then a higher report number;
among rows of one version and report, a later date. Rows without a usable date are not comparable by it. What orders
them is learned: from consecutive dated rows of all cases it is counted which value of a field follows which, and the
transitions that are clearly seen more often one way form an order without cycles. Of values that the stamps leave
level, the topologically latest are those that no other of the group follows.

A group is never built as a list of pairs: the stamps are aggregates, and the learned order meets the distinct values
of a group in an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigmill.functions.ids import period, plain_id, present, trimmed
from sigmill.runtime import bounded, cut, small

DEMO_FIELDS = (
    "primaryid caseid caseversion event_dt fda_dt age age_cod sex occr_country reporter_country serious seriousnessdeath "
    "seriousnesslifethreatening seriousnesshospitalization seriousnessdisabling seriousnesscongenitalanomali seriousnessother quarter"
).split()
#: Fields whose transitions are learned: those with codes as values.
CODED = [f for f in DEMO_FIELDS if f in ("age_cod", "sex", "serious") or f.startswith("seriousness")]
#: How much more often a transition must be seen than its reverse to count.
LEAD = 1.25
_NONE, _DATE = "(none)", "^[0-9]{8}$"


def filled(field: str) -> Column:
    """1 if the field holds a value that is neither missing nor blank."""
    return F.coalesce((present(trimmed(F.col(field))).isNotNull()).cast("int"), F.lit(0))


def _value(field: str) -> Column:
    return F.coalesce(present(trimmed(F.col(field))), F.lit(_NONE))


def _date() -> Column:
    """The complete date (YYYYMMDD) at which a row was received; empty for a row without one."""
    return F.when(F.col("fda_dt").rlike(_DATE), F.col("fda_dt")).otherwise("")


def _as_text(number: Column) -> Column:
    """A plain id as a text that sorts as its number does; a missing one comes first."""
    text = F.coalesce(number, F.lit(""))
    return F.concat(F.lpad(F.length(text).cast("string"), 10, "0"), text)


def _version() -> Column:
    """Version and report number as one text that sorts as the numbers do."""
    return F.concat(_as_text(plain_id(F.col("caseversion"))), _as_text(plain_id(F.col("primaryid"))))


# --- the learned order ----------------------------------------------------------------------------------------------
def transitions(rows: DataFrame, key: Column, fields: list[str] = CODED) -> DataFrame:
    """``field``, ``earlier``, ``later``, ``n``: value changes between consecutive dated rows of a case.

    Only a case's complete dates (``fda_dt`` as YYYYMMDD) order its rows here. Rows are reduced to one a date and case
    first; what is left of a case is at most one row a day.
    """
    dated = rows.select(key.alias("key"), "fda_dt", *(_value(f).alias(f) for f in fields)).where(F.col("key").isNotNull() & F.col("fda_dt").rlike(_DATE))
    daily = dated.groupBy("key", "fda_dt").agg(*(F.max(f).alias(f) for f in fields))
    following = Window.partitionBy("key").orderBy("fda_dt")
    paired = daily.select(*(F.struct(F.lag(f).over(following).alias("earlier"), F.col(f).alias("later")).alias(f) for f in fields))
    steps = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}.earlier").alias("earlier"), F.col(f"{f}.later").alias("later")) for f in fields)))
    changes = paired.select(steps.alias("s")).select("s.*").where("earlier is not null and earlier <> later")
    return changes.groupBy("field", "earlier", "later").agg(F.count("*").alias("n"))


def precedence(seen: DataFrame, lead: float = LEAD) -> DataFrame:
    """``field``, ``earlier``, ``later``: the learned order of values, with all that follows from it; it has no cycles.

    A transition counts if it is seen ``lead`` times as often as its reverse and goes up in net direction, which is how
    much more often a value is come to than left, as a share of both. Nothing is collected, and a field may have any
    number of values. The closure doubles the reach of the order until nothing is added.
    """
    seen = cut(seen)
    ends = seen.select("field", F.col("later").alias("value"), F.col("n").alias("way")).unionByName(seen.select("field", F.col("earlier").alias("value"), (-F.col("n")).alias("way")))
    net = ends.groupBy("field", "value").agg((F.sum("way") / F.sum(F.abs("way"))).alias("net"))
    reverse = seen.select("field", F.col("later").alias("earlier"), F.col("earlier").alias("later"), F.col("n").alias("back"))
    strong = seen.join(reverse, ["field", "earlier", "later"], "left").where(F.col("n") >= F.lit(lead) * F.greatest(F.coalesce("back", F.lit(0)), F.lit(1)))
    up = strong.join(net.select("field", F.col("value").alias("earlier"), F.col("net").alias("low")), ["field", "earlier"])
    up = up.join(net.select("field", F.col("value").alias("later"), F.col("net").alias("high")), ["field", "later"]).where("low < high")
    order = cut(up.select("field", "earlier", "later"))
    size = order.count()
    while size:
        further = order.alias("x").join(order.alias("y"), (F.col("x.field") == F.col("y.field")) & (F.col("x.later") == F.col("y.earlier"))).select("x.field", "x.earlier", "y.later")
        order = cut(order.unionByName(further).distinct())
        before, size = size, order.count()
        if size == before:
            break
    return order


def overtaken(values: DataFrame, order: DataFrame) -> DataFrame:
    """Distinct (``case``, ``field``, ``value``) of a group that another value of the group follows in the learned order.

    ``values`` has ``case``, ``field``, ``value``. Each value is joined with what comes before it in the order, and what
    is met there in the same group is overtaken; values are not compared with each other.
    """
    held = values.select("case", "field", "value").distinct()
    before = small(order.select("field", F.col("later").alias("value"), "earlier"))
    passed = held.join(before, ["field", "value"]).select("case", "field", F.col("earlier").alias("value")).distinct()
    return passed.join(held, ["case", "field", "value"], "left_semi")


def _members(rows: DataFrame, cases: DataFrame) -> DataFrame:
    return rows.join(small(cases), "case", "left_semi")


def _long(rows: DataFrame, *kept: str) -> DataFrame:
    """Coded fields of ``rows`` as rows of ``field`` and ``value``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), _value(f).alias("value")) for f in CODED)))
    return rows.select(*kept, pairs.alias("p")).select(*kept, "p.*")


def _several(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The cases (``case``, ``rows``) of two or more rows, and whether they are few enough to be broadcast."""
    several = cut(rows.groupBy("case").agg(F.count("*").alias("rows")).where("rows >= 2"))
    return several, bounded(several)


# --- survivors ------------------------------------------------------------------------------------------------------
def survivors(rows: DataFrame) -> DataFrame:
    """``caseid``, ``primaryid`` (plain) and ``quarter`` (as stored) of the latest row of each case with two or more rows.

    Stamps order the rows: version, report number, fields filled, period. Of rows that are level in all of these the
    latest dated ones and the undated ones are left; of them the row with the fewest values that the learned order
    overtakes in its group, then a dated one, then the largest by its quarter's text. Repeated rows count as rows. A
    version or report number that is missing or not a number is below all others, a quarter that can't be read below all
    periods. Rows whose caseid is no number belong to no case. An empty table gives an empty result; columns besides the
    18 known ones are not read.
    """
    case = plain_id(F.col("caseid"))
    fill = sum((filled(f) for f in DEMO_FIELDS), F.lit(0))
    when = F.lpad((F.coalesce(period(F.col("quarter")), F.lit(-1)) + 1).cast("string"), 6, "0")
    stamp = F.concat(_version(), F.lpad(fill.cast("string"), 2, "0"), when)
    content = F.xxhash64("fda_dt", "quarter", *(_value(f) for f in CODED))
    named = rows.withColumn("case", case).where("case is not null")
    several, few = _several(named)
    grouped = named.join(F.broadcast(several), "case", "left_semi") if few else named
    own = grouped.select("case", stamp.alias("stamp"), content.alias("content"), plain_id(F.col("primaryid")).alias("primaryid"), "quarter")
    # the least and the largest content at the top stamp: where they differ, several rows are level
    top = own.groupBy("case").agg(
        F.count("*").alias("rows"),
        F.max(F.struct("stamp", "content", "primaryid", "quarter")).alias("top"),
        F.max(F.struct("stamp", F.bitwise_not("content").alias("turned"))).alias("other"),
    )
    top = cut(top.where("rows >= 2").select("case", "top.*", (F.bitwise_not("other.turned") != F.col("top.content")).alias("level")))
    settled = top.where("not level").select(F.col("case").alias("caseid"), "primaryid", "quarter")

    order = precedence(transitions(grouped, F.col("case")))
    groups = small(top.where("level").select("case", "stamp"))
    level = rows.withColumns({"case": case, "stamp": stamp}).join(groups, ["case", "stamp"], "left_semi").select("case", "quarter", "primaryid", _date().alias("date"), *CODED)
    level = cut(level.distinct())
    newest = level.groupBy("case").agg(F.max("date").alias("newest"))
    left = level.join(newest, "case").where("date = '' or date = newest").withColumn("row", F.struct((F.col("date") != "").alias("dated"), F.coalesce("quarter", F.lit("")).alias("q"), *(_value(f).alias(f) for f in CODED)))
    values = _long(left, "case", "row", "quarter", "primaryid")
    behind = values.join(overtaken(values, order).withColumn("behind", F.lit(1)), ["case", "field", "value"], "left")
    weighed = behind.groupBy("case", "row", "quarter", "primaryid").agg(F.count("behind").alias("behind"))
    picked = weighed.groupBy("case").agg(F.max_by(F.struct("primaryid", "quarter"), F.struct(-F.col("behind"), "row")).alias("pick"))
    return settled.unionByName(picked.select(F.col("case").alias("caseid"), plain_id(F.col("pick.primaryid")).alias("primaryid"), "pick.quarter"))


def fused(rows: DataFrame, fields: list[str] = DEMO_FIELDS) -> DataFrame:
    """One record for each case (``case``, with its ``rows``): in every field the latest of its filled values, else NULL.

    Of the rows that fill a field those with the highest version and report number count; of these the value of the
    latest date (of equal dates the largest), unless the learned order says that a value of an undated row comes after
    it. Then, and where all are undated, it is a value that no other of them follows, the largest of several. Values are
    trimmed; rows whose caseid is no number belong to no case; an empty table gives an empty result.
    """
    own = rows.withColumn("case", plain_id(F.col("caseid"))).where("case is not null")
    several, few = _several(own)
    values = [F.when(filled(f) == 1, trimmed(F.col(f))).alias(f) for f in fields]
    # a case of one row is its own record; it need not be shuffled where the others are few enough to be told apart
    alone = own.join(F.broadcast(several), "case", "left_anti").select("case", F.lit(1).cast("long").alias("rows"), *values) if few else None
    grouped = own.join(F.broadcast(several), "case", "left_semi") if few else own

    # stamps are digits whose lengths stand before them, so a stamp and its value sort as one text
    stamped = grouped.select("case", F.concat(_version(), F.rpad(_date(), 8, "0"), F.lit("|")).alias("stamp"), *values)
    latest = stamped.groupBy("case").agg(F.count("*").alias("rows"), *(F.max(F.concat("stamp", f)).alias(f) for f in fields))
    record = latest.select("case", "rows", *(F.expr(f"substring({f}, instr({f}, '|') + 1)").alias(f) for f in fields))

    # the learned order speaks only where rows have no date
    undated = cut(grouped.where(_date() == "").select("case").distinct())
    order = precedence(transitions(grouped, F.col("case")))
    some = _long(_members(grouped, undated).withColumns({"version": _version(), "date": _date()}), "case", "version", "date").where(F.col("value") != _NONE)
    some = cut(some.groupBy("case", "field", "version", "value").agg(F.max("date").alias("date"), F.max(F.col("date") == "").alias("open")))
    newest = some.groupBy("case", "field").agg(F.max("version").alias("version"))
    level = some.join(newest, ["case", "field", "version"])
    dated = level.where("date <> ''").groupBy("case", "field").agg(F.max(F.struct("date", "value")).alias("last"))
    level = level.join(dated, ["case", "field"], "left").withColumn("stands", F.coalesce(F.col("last.value") == F.col("value"), F.lit(False))).where("stands or open")
    left = level.join(overtaken(level, order), ["case", "field", "value"], "left_anti")
    picked = left.groupBy("case", "field").agg(F.max(F.struct("stands", "value")).alias("pick"))
    patch = picked.groupBy("case").agg(*(F.max(F.when(F.col("field") == f, F.col("pick.value"))).alias(f"_{f}") for f in CODED))
    record = record.join(small(cut(patch)), "case", "left").select("case", "rows", *(F.coalesce(f"_{f}", f).alias(f) if f in CODED else F.col(f) for f in fields))
    return record if alone is None else record.unionByName(alone)
