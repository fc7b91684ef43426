"""Ordered, paged and plotted views of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed values: rows of a page; rows of a forest plot; events of a live scan, and of a plain request
PAGE_ROWS, FOREST_ROWS, SCAN_EVENTS, REQUEST_EVENTS = 50, 30, 25, 30


def _down(column: Column, turned: bool) -> Column:
    return column.asc_nulls_first() if turned else column.desc_nulls_last()


def _up(column: Column, turned: bool) -> Column:
    return column.desc_nulls_last() if turned else column.asc_nulls_first()


def prr_order(turned: bool = False) -> list[Column]:
    """PRR downwards, missing ones last, then by term. ``turned`` is the opposite order, here and in the others."""
    usable = F.when(F.col("prr").isNotNull() & ~F.isnan("prr"), F.col("prr"))
    return [_down(usable, turned), _up(F.col("event_pt"), turned)]


def count_order(turned: bool = False) -> list[Column]:
    """Reports downwards, then by term."""
    return [_down(F.col("a"), turned), _up(F.col("event_pt"), turned)]


def name_order(turned: bool = False) -> list[Column]:
    """By term, then by source."""
    return [_up(F.col("event_pt"), turned)]


#: Orders of results by name.
ORDERS = {"prr": prr_order, "count": count_order, "name": name_order}


def page(results: DataFrame, number: int, partition: tuple[str, ...] = (), rows: int = PAGE_ROWS, order: str = "prr", outcome: str | None = None) -> DataFrame:
    """Page ``number`` (from 1; beyond the last page the last one) of the rows in an order of ``ORDERS``, with their ``place``.

    With ``partition`` each group is paged by itself; with ``outcome`` only rows of that label are shown. Ranks have a
    known bound, so that a map task keeps no more rows of a group than the page can need; a group that ends before the
    page is ranked from its end. Without groups the page is a top-k.
    """
    shown, number = results if outcome is None else results.where(F.col("outcome") == outcome), max(1, number)
    sort = ORDERS[order]
    if not partition:
        at = min(number, max(1, -(-shown.count() // rows)))
        first = shown.orderBy(*sort()).limit(at * rows)
        return first.withColumn("place", F.row_number().over(Window.orderBy(*sort()))).where(F.col("place") > (at - 1) * rows)
    group, before = Window.partitionBy(*partition), (number - 1) * rows
    placed = shown.withColumn("place", F.row_number().over(group.orderBy(*sort()))).where(F.col("place") <= number * rows).where(F.col("place") > before)
    if number == 1:
        return placed
    short = shown.groupBy(*(F.col(p).alias(f"_{p}") for p in partition)).agg(F.count("*").alias("_rows")).where(F.col("_rows") <= before)
    same = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in partition]
    last = shown.withColumn("place", F.row_number().over(group.orderBy(*sort(True)))).where(F.col("place") <= rows)
    last = last.join(short, same).withColumn("place", F.col("_rows").cast("int") - F.col("place") + 1).where(F.col("place") > (F.ceil(F.col("_rows") / rows) - 1) * rows)
    return placed.unionByName(last.select(*placed.columns))


def forest_points(page_rows: DataFrame, partition: tuple[str, ...] = (), most: int = FOREST_ROWS) -> DataFrame:
    """The rows of a page (few in each group, or few in all) with ``plot``: ``shown`` (the first ``most`` that can be drawn on a log axis), ``deferred``
    (drawable but beyond) or ``unplottable``."""
    ok = F.lit(True)
    for c in ("prr", "prr_low", "prr_high"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    ok = F.coalesce(ok, F.lit(False))
    group = Window.partitionBy(*partition, "_ok") if partition else Window.partitionBy("_ok")
    marked = page_rows.withColumn("_ok", ok).withColumn("_n", F.row_number().over(group.orderBy("place")))
    plot = F.when(~F.col("_ok"), "unplottable").when(F.col("_n") <= most, "shown").otherwise("deferred")
    return marked.withColumn("plot", plot).drop("_ok", "_n")


def map_coordinates(results: DataFrame) -> DataFrame:
    """``results`` with ``map_x`` = log2 of the PRR (at least 0.01) and ``map_y`` = log10 of the reports (at least 1)."""
    return results.withColumns({"map_x": F.log2(F.greatest("prr", F.lit(0.01))), "map_y": F.log10(F.greatest(F.col("a"), F.lit(1)).cast("double"))})


def top_events(pairs: DataFrame, k: int = REQUEST_EVENTS) -> DataFrame:
    """The ``k`` events with the most reports of each drug, ties by term. ``k`` outside 1..100 is the default."""
    k = k if 1 <= k <= 100 else REQUEST_EVENTS
    counts = pairs.select("drug_text", "event_pt", "primaryid").distinct().groupBy("drug_text", "event_pt").agg(F.count("*").alias("n_reports"))
    place = F.row_number().over(Window.partitionBy("drug_text").orderBy(F.col("n_reports").desc(), "event_pt"))
    return counts.withColumn("place", place).where(F.col("place") <= k)
