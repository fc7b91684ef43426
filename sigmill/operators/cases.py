"""Report tables: usable rows, integrity against the parent table, and the latest version of each case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigmill.errors import IntegrityError, InvalidIdentifier, PopulationError
from sigmill.functions.ids import magnitude, plain_id

DEMO_REQUIRED = ("primaryid", "caseid", "caseversion")


def with_plain_ids(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: plain_id(F.col(c)) for c in columns})


def usable(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows whose ids are all positive numbers, with plain ids; the rest is counted by ``integrity_counters``."""
    return with_plain_ids(df, columns).where(" and ".join(f"{c} is not null" for c in columns))


def require_ids(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``usable``, but raises if any id is missing or no positive number."""
    bad = df.agg(*(F.count_if(plain_id(F.col(c)).isNull()).alias(c) for c in columns)).first().asDict()
    if any(bad.values()):
        raise InvalidIdentifier(f"unusable ids: {bad}")
    return with_plain_ids(df, columns)


def received_once(demo: DataFrame) -> DataFrame:
    """One row for each primaryid of usable rows: of reports received again the last delivery (then by content).

    The rank filter is applied within the map tasks first, so a report of any number of rows sends one row a task.
    """
    others = [F.coalesce(F.col(c).cast("string"), F.lit("")).desc() for c in ("quarter", *(c for c in demo.columns if c not in ("primaryid", "quarter"))) if c in demo.columns]
    order = Window.partitionBy("primaryid").orderBy(*others)
    return usable(demo, DEMO_REQUIRED).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def latest_versions(demo: DataFrame) -> DataFrame:
    """The current report of each case: highest version, then highest primaryid, as numbers; then the earliest quarter.

    ``demo`` has plain ids. The rank filter is applied within the map tasks first, so a case of any number of versions
    sends one row a task.
    """
    order = Window.partitionBy("caseid").orderBy(magnitude(F.col("caseversion")).desc(), magnitude(F.col("primaryid")).desc(), F.col("quarter").asc())
    return demo.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def current_reports(demo: DataFrame) -> DataFrame:
    """``latest_versions`` of the usable rows, each report once; raises if a report is kept for two cases."""
    current = latest_versions(usable(demo, DEMO_REQUIRED))
    if current.groupBy("primaryid").count().where("count > 1").limit(1).count():
        raise PopulationError("a primaryid is current for several cases")
    return current


@dataclass(frozen=True)
class Integrity:
    duplicate_primaryids: int
    duplicate_versions: int
    drug_orphans: int
    reac_orphans: int
    case_mismatches: int

    def require(self) -> None:
        broken = {k: v for k, v in vars(self).items() if v and k not in ("duplicate_versions",)}
        if broken:
            raise IntegrityError(f"relational integrity: {broken}")


def integrity_counters(demo: DataFrame, drug: DataFrame, reac: DataFrame) -> DataFrame:
    """One row: duplicates of the parents, children without a parent, children that name another case, unusable ids."""
    parents = usable(demo, DEMO_REQUIRED)
    twice = parents.agg(
        (F.count("*") - F.count_distinct("primaryid")).alias("duplicate_primaryids"),
        (F.count("*") - F.count_distinct("caseid", "caseversion")).alias("duplicate_versions"),
    )
    index = parents.groupBy("primaryid").agg(F.min("caseid").alias("parent_case"))
    counted = []
    for name, child in (("drug", drug), ("reac", reac)):
        own = with_plain_ids(child.select("primaryid", "caseid"), ("primaryid", "caseid")).groupBy("primaryid", "caseid").agg(F.count("*").alias("n"))
        judged = own.join(index, "primaryid", "left")
        usable_id = F.col("primaryid").isNotNull()
        counted.append(
            judged.agg(
                F.coalesce(F.sum(F.when(~usable_id, F.col("n"))), F.lit(0)).alias(f"{name}_unusable"),
                F.coalesce(F.sum(F.when(usable_id & F.col("parent_case").isNull(), F.col("n"))), F.lit(0)).alias(f"{name}_orphans"),
                F.coalesce(F.sum(F.when(F.col("parent_case") != F.col("caseid"), F.col("n"))), F.lit(0)).alias(f"{name}_mismatches"),
            )
        )
    return twice.crossJoin(counted[0]).crossJoin(counted[1])  # one row each


def require_integrity(demo: DataFrame, drug: DataFrame, reac: DataFrame) -> Integrity:
    """Counts as an object; raises unless parents are unique and every child has its parent of the same case."""
    row = integrity_counters(demo, drug, reac).first()
    found = Integrity(row["duplicate_primaryids"], row["duplicate_versions"], row["drug_orphans"] + row["drug_unusable"], row["reac_orphans"] + row["reac_unusable"], row["drug_mismatches"] + row["reac_mismatches"])
    found.require()
    return found


def superseded_children(child: DataFrame, current: DataFrame) -> DataFrame:
    """Child rows (usable ids) of reports that are not current."""
    return usable(child, ("primaryid",)).join(current.select("primaryid"), "primaryid", "left_anti")


def require_subset(part: DataFrame, whole: DataFrame, key: str, what: str) -> None:
    if part.select(key).join(whole.select(key), key, "left_anti").limit(1).count():
        raise PopulationError(f"{what}: {key} outside the larger population")


