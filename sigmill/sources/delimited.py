"""Delimited report files: scan, header rules, and text sinks."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmill.errors import HeaderCollision, InvalidTable, MissingColumns, UnsafeText
from sigmill.functions.ids import present, trimmed
from sigmill.functions.text import is_formula
from sigmill.operators.cells import CELL_KEY, COUNTS, violations

#: fixed values: columns of the report tables, and those that a file must have
COLUMNS = {
    "demo": (
        "primaryid caseid caseversion event_dt fda_dt age age_cod sex occr_country reporter_country serious seriousnessdeath seriousnesslifethreatening "
        "seriousnesshospitalization seriousnessdisabling seriousnesscongenitalanomali seriousnessother"
    ).split(),
    "drug": "primaryid caseid role_cod drugname prod_ai route dose_vbm".split(),
    "reac": "primaryid caseid pt".split(),
}
REQUIRED = {"demo": ("primaryid", "caseid", "caseversion"), "drug": ("primaryid", "role_cod", "drugname"), "reac": ("primaryid", "pt")}
CELL_CONSTANTS = ("comparator", "event_scope", "deduplication_policy")


def normalised_names(names: list[str]) -> list[str]:
    """Header names in lower case with single underscores; raises if two become one."""
    out = [re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", n.lower())) for n in names]
    twice = sorted({n for n in out if out.count(n) > 1})
    if twice:
        raise HeaderCollision(f"header names that are equal after normalisation: {twice}")
    return out


def complete(df: DataFrame, kind: str) -> DataFrame:
    """The kind's columns in order; missing optional ones NULL, missing required ones an error, others dropped."""
    missing = [c for c in REQUIRED[kind] if c not in df.columns]
    if missing:
        raise MissingColumns(f"{kind}: missing {missing}")
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS[kind]))


def scan(spark: SparkSession, path: str | list[str], kind: str, encoding: str = "UTF-8", separator: str = "$") -> DataFrame:
    """A report table from files with one header layout: all columns text, no quoting, blanks off, ``NA`` and empty NULL.

    Rows with too many or too few fields fail the scan. Only the kind's columns are read.
    """
    raw = spark.read.options(sep=separator, quote="", escape="", header=True, encoding=encoding, mode="FAILFAST", inferSchema=False, enforceSchema=False).csv(path)
    named = raw.toDF(*normalised_names(raw.columns))
    return complete(named, kind).select(*(present(trimmed(F.col(c))).alias(c) for c in COLUMNS[kind]))


def scan_quarters(spark: SparkSession, files: dict[str, str], kind: str, encoding: str = "UTF-8") -> DataFrame:
    """The files of several quarters as one table with ``quarter``."""
    out = None
    for quarter, path in sorted(files.items()):
        one = scan(spark, path, kind, encoding).withColumn("quarter", F.lit(quarter))
        out = one if out is None else out.unionByName(one)
    return out


def require_formula_safe(df: DataFrame) -> DataFrame:
    """``df``, or an error if a text starts with a sign that a spreadsheet takes for a formula."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    unsafe = None
    for c in texts:
        unsafe = is_formula(F.col(c)) if unsafe is None else unsafe | is_formula(F.col(c))
    if texts and df.where(unsafe).limit(1).count():
        raise UnsafeText("a text starts with a formula sign")
    return df


CELL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CELL_KEY] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.StringType()) for c in CELL_CONSTANTS])


def write_cells_text(cells: DataFrame, path: str) -> None:
    """Cells as tab-separated text without quotes, in canonical order across the part files; refuses to overwrite."""
    require_formula_safe(cells)
    ordered = cells.orderBy("drug_text", "drug_role", "event_pt", "drug_text_source")
    ordered.write.mode("errorifexists").options(sep="\t", quote="", header=True, lineSep="\n", emptyValue="").csv(path)


def read_cells_text(spark: SparkSession, path: str) -> DataFrame:
    """Cells from tab-separated text with exactly the known header and whole numbers."""
    return spark.read.schema(CELL_SCHEMA).options(sep="\t", quote="", escape="", header=True, enforceSchema=False, mode="FAILFAST").csv(path)


def write_by_quarter(df: DataFrame, path: str) -> None:
    """Parquet by quarter; refuses to overwrite. Rows are first brought together by quarter in salted parts, so that
    neither many small files nor one task a quarter comes out."""
    df.repartition("quarter", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("errorifexists").partitionBy("quarter").parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and paths on it."""
    named = spark._jvm.org.apache.hadoop.fs.Path
    return named(path).getFileSystem(spark._jsc.hadoopConfiguration()), named


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells as a checked store: whole at ``path``, or not there.

    They are written aside as Parquet by data set, sorted by drug within the files, so that a request reads few row
    groups; what was written is read again and checked (valid cells, each once, one universe a data set, at least one),
    and the folder is then renamed. A store that fails is removed. Refuses to overwrite.
    """
    files, named = _files(cells.sparkSession, path)
    if files.exists(named(path)):
        raise FileExistsError(f"{path} does exist")
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        _write_sorted(cells, staged)
        require_store(cells.sparkSession.read.schema(cells.schema).parquet(staged))
        if not files.rename(named(staged), named(path)):
            raise OSError(f"{staged} could not be renamed")
    finally:
        files.delete(named(staged), True)


def require_store(cells: DataFrame) -> None:
    """Raises unless there is a cell, all are valid, each occurs once and every data set has one universe."""
    row = violations(cells).agg(F.count("*").alias("n"), F.count("violation").alias("bad"), F.min("violation").alias("first")).first()
    if not row["n"] or row["bad"]:
        raise InvalidTable(f"{row['bad']} invalid cells, such as: {row['first']}" if row["n"] else "no cells")
    if cells.groupBy("dataset_id").agg(F.min("universe_reports").alias("low"), F.max("universe_reports").alias("high")).where("low <> high").limit(1).count():
        raise InvalidTable("a data set of several universes")
    if cells.groupBy(*CELL_KEY).count().where("count > 1").limit(1).count():
        raise InvalidTable("a cell occurs twice")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a store; a filter by data set reads its folder only, one by drug few row groups of it."""
    return spark.read.schema(CELL_SCHEMA).parquet(path).select(*CELL_SCHEMA.names)


def _write_sorted(cells: DataFrame, path: str) -> None:
    placed = cells.repartitionByRange("dataset_id", "drug_text", "drug_text_source", "drug_role")
    placed.sortWithinPartitions("dataset_id", "drug_text", "drug_text_source", "drug_role", "event_pt").write.mode("errorifexists").partitionBy("dataset_id").parquet(path)
