"""Check of stored results against a recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions.stats import near

#: fixed values: relative tolerances of effects, exact tests and q-values
TOLERANCE = {"prr": 1e-10, "prr_low": 1e-10, "prr_high": 1e-10, "ror": 1e-10, "ror_low": 1e-10, "ror_high": 1e-10, "chi2": 1e-10, "fisher_p": 2e-6, "fdr_q": 1e-12}


def mismatches(stored: DataFrame, computed: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of either side that the other lacks, and values that differ: ``key``, ``field``, ``stored_value``, ``computed_value``.

    Empty if the stored results hold. Both sides have a unique key.
    """
    fields = [c for c in TOLERANCE if c in stored.columns and c in computed.columns]
    left = stored.select(*key, F.lit(True).alias("_s"), *(F.col(c).alias(f"s_{c}") for c in fields), F.col("outcome").alias("s_outcome"))
    right = computed.select(*key, F.lit(True).alias("_c"), *(F.col(c).alias(f"c_{c}") for c in fields), F.col("outcome").alias("c_outcome"))
    same = None
    l, r = left.alias("l"), right.alias("r")
    for c in key:
        condition = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        same = condition if same is None else same & condition
    both = l.join(r, same, "full_outer").select(*(F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in key), *(c for c in left.columns + right.columns if c not in key))
    text = lambda c: F.col(c).cast("string")
    checks = [F.when(F.col("_s").isNull() | F.col("_c").isNull(), F.struct(F.lit("row").alias("field"), text("_s").alias("stored_value"), text("_c").alias("computed_value")))]
    matched = F.col("_s") & F.col("_c")
    for c in fields:
        checks.append(F.when(matched & ~near(F.col(f"s_{c}"), F.col(f"c_{c}"), TOLERANCE[c]), F.struct(F.lit(c).alias("field"), text(f"s_{c}").alias("stored_value"), text(f"c_{c}").alias("computed_value"))))
    checks.append(F.when(matched & ~F.col("s_outcome").eqNullSafe(F.col("c_outcome")), F.struct(F.lit("outcome").alias("field"), F.col("s_outcome").alias("stored_value"), F.col("c_outcome").alias("computed_value"))))
    return both.select(*key, F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("x")).select(*key, "x.*")


def out_of_order(results: DataFrame, number: str, first: str = "event_pt", second: str = "drug_text") -> DataFrame:
    """Rows that don't come strictly after the row before them, by their stored number (1, 2, ...).

    Each row meets the one with the number before its own in an equality join. A row other than number 1 without one
    before it is out of order too.
    """
    before = results.select((F.col(number) + 1).alias("_number"), F.struct(F.col(first).alias("x"), F.col(second).alias("y")).alias("_before"))
    now = F.struct(F.col(first).alias("x"), F.col(second).alias("y"))
    met = results.join(before, F.col(number) == F.col("_number"), "left")
    wrong = F.when(F.col("_before").isNull(), F.col(number) != 1).otherwise(F.col("_before") >= now)
    return met.where(wrong).select(*results.columns).distinct()


def text_checks(cells: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """By data set: rows, rows with a text that isn't valid UTF-8, and rows that repeat a key."""
    texts = [c for c, kind in cells.dtypes if kind == "string"]
    invalid = F.lit(False)
    for c in texts:
        invalid = invalid | ~F.coalesce(F.is_valid_utf8(F.col(c)), F.lit(True))
    keyed = cells.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(invalid).alias("bad"))
    return keyed.groupBy("dataset_id").agg(F.sum("n").alias("n_rows"), F.sum("bad").alias("n_invalid_texts"), F.sum(F.col("n") - 1).alias("n_repeated_keys"))
