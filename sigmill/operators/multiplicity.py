"""False discovery rate within families of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigmill.runtime import cut, lookup

FAMILY = ("dataset_id", "drug_text", "drug_text_source", "drug_role")
#: Rows beyond which a family is ranked by several tasks.
ROWS_PER_TASK = 1 << 20
#: Rows in a partition of families that are brought together, so that a task sorts them in memory.
ROWS_PER_PARTITION = 1 << 18
#: Blocks into which each halving of p is cut in a family of that size.
BLOCKS = 16
_LAST = 1 << 20  # the block of p = 0
_BEGIN, _HERE, _END = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def _within(tests: DataFrame, p: str, family: tuple[str, ...], into: str) -> DataFrame:
    """``tests`` with their q; a family is sorted once, downwards, and its size and running minimum go along that order."""
    down = Window.partitionBy(*family).orderBy(F.col(p).desc_nulls_last())
    sized = tests.withColumns({"_size": F.count(p).over(down.rowsBetween(_BEGIN, _END)), "_row": F.row_number().over(down)})
    raw = sized.withColumn("_q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("_size") / (F.col("_size") - F.col("_row") + 1))))
    return raw.withColumn(into, F.when(F.col(p).isNotNull(), F.min("_q").over(down.rowsBetween(_BEGIN, _HERE)))).drop("_size", "_row", "_q")


def _by_blocks(tests: DataFrame, p: str, into: str) -> DataFrame:
    """The q of each distinct ``_family`` and p.

    Equal p of a family are one row with their number before anything is ranked. Each family lies in blocks by the size
    of p; ranks and running minima are taken within a block and carried over the blocks, which are few.
    """
    key, whole, inside = ["_family", "_block"], Window.partitionBy("_family"), Window.partitionBy("_family", "_block")
    block = F.coalesce(F.floor(F.log2(p) * -BLOCKS), F.lit(_LAST)).cast("int")
    counts = cut(tests.where(F.col(p).isNotNull()).groupBy("_family", p).agg(F.count("*").alias("_n")).withColumn("_block", block))
    sizes = counts.groupBy(*key).agg(F.sum("_n").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(whole.orderBy(F.desc("_block")).rowsBetween(_BEGIN, -1)), F.lit(0))
    places = sizes.select(*key, before.alias("_before"), F.sum("_rows").over(whole).alias("_size"))
    rank = F.col("_before") + F.sum("_n").over(inside.orderBy(p).rowsBetween(_BEGIN, _HERE))
    ranked = cut(counts.join(places, key).withColumn("_q", F.least(F.lit(1.0), F.col(p) * F.col("_size") / rank)))
    lowest = ranked.groupBy(*key).agg(F.min("_q").alias("_low"))
    later = lowest.select(*key, F.min("_low").over(whole.orderBy("_block").rowsBetween(_BEGIN, -1)).alias("_later"))
    rest = F.min("_q").over(inside.orderBy(F.desc(p)).rowsBetween(_BEGIN, _HERE))
    return ranked.join(later, key).select("_family", p, F.least("_later", rest).alias(into))


def gathered(rows: DataFrame, counted: DataFrame, family: tuple[str, ...] = FAMILY) -> tuple[DataFrame, bool]:
    """``rows`` with each family in one partition, and True; as they are, and False, if a family has more than ``ROWS_PER_TASK``.

    What then goes by family, such as removing repeated rows and ranking, needs no further shuffle. ``counted`` is a table
    of the same rows that is cheaper to read.
    """
    n_rows, largest = counted.groupBy(*family).agg(F.count("*").alias("_rows")).agg(F.sum("_rows"), F.max("_rows")).first()
    if (largest or 0) > ROWS_PER_TASK:
        return rows, False
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-(n_rows or 0) // ROWS_PER_PARTITION)), *family), True


def benjamini_hochberg(tests: DataFrame, p: str = "fisher_p", family: tuple[str, ...] = FAMILY, into: str = "fdr_q", counted: DataFrame | None = None, within: bool = False) -> DataFrame:
    """``tests`` with the Benjamini-Hochberg q of each p within its family.

    The family size counts the rows with a p; rows without one get no q. Equal p get equal q whatever their order. A NULL
    in a family column is a value of its own. Families of more than ``ROWS_PER_TASK`` rows, such as one with a third of
    all, are not brought together: they are ranked in blocks (with the same result), and their rows look up the q of
    their p. ``counted`` is a table of the same rows, or of more, that is cheaper to read, for the families' sizes: a family
    that is taken for a large one gets the same q. ``within``: no family is large, and that isn't measured again.
    """
    if within:
        return _within(tests, p, family, into)
    family_key = F.struct(*family)  # a struct with a NULL field equals another such
    sizes = (tests if counted is None else counted).groupBy(family_key.alias("_family")).agg(F.count("*").alias("_rows"))
    large = cut(sizes.where(F.col("_rows") > ROWS_PER_TASK))
    if large.isEmpty():
        return _within(tests, p, family, into)
    marked = cut(lookup(tests.withColumn("_family", family_key), large, ["_family"]))
    hot = marked.where("_rows is not null")
    found = lookup(hot, cut(_by_blocks(hot, p, into)), ["_family", p])
    rest = _within(marked.where("_rows is null"), p, family, into)
    return rest.select(*tests.columns, into).unionByName(found.select(*tests.columns, into))
