"""Items of reports as dense numbers, and reports placed by item, so that distinct reports are counted where they lie.

Counting the distinct reports of items and of pairs of items needs the rows of an item together. Here they are shuffled
once, as numbers, by the first item of a pair; an item with many rows is cut into parts by the report's hash, in
proportion to its rows. All that is then counted by (item, part, ...) needs no further shuffle, and only sums by item or
pair do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigmill.runtime import cut

#: Rows of an item for which it gets one more part.
ROWS_PER_PART = 1 << 20
#: Items that can be numbered; two numbers and four bits fit a code of 64 bits.
MOST_ITEMS = 1 << 30


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct ``keys`` of ``rows`` with a dense number from 1 as ``name``, and the ``n_rows`` that have them.

    Keys with a NULL part are left out. Raises beyond ``MOST_ITEMS``.
    """
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    found = cut(known.groupBy(*keys).agg(F.count("*").alias("n_rows")).withColumn("_at", F.monotonically_increasing_id()))
    low = (1 << 33) - 1
    sizes = found.groupBy(F.shiftright("_at", 33).alias("_of")).agg(F.count("*").alias("_size"))
    starts = sizes.select("_of", (F.sum("_size").over(Window.orderBy("_of")) - F.col("_size")).alias("_start"))  # a row a partition
    placed = found.withColumn("_of", F.shiftright("_at", 33)).join(F.broadcast(starts), "_of")
    number = F.col("_start") + F.col("_at").bitwiseAND(F.lit(low)) + 1
    fits = F.when(number < MOST_ITEMS, number).otherwise(F.raise_error(F.lit(f"more than {MOST_ITEMS} items; a pair of them does not fit a 64-bit code")))
    return cut(placed.select(*keys, "n_rows", fits.cast("int").alias(name)))


def part(report: str = "report", n_rows: str = "n_rows", rows_per_part: int | None = None) -> Column:
    """Part of an item that a report falls into, by its hash; the number of parts follows from the item's rows."""
    return F.pmod(F.xxhash64(report), 1 + F.floor(F.col(n_rows) / (rows_per_part or ROWS_PER_PART))).cast("int")
