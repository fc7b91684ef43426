"""Orphan references of report tables that arrive as a stream.

Each micro-batch advances the state of ``operators.orphans``. What it brings is written under its number, so that a
batch that is run again after a failure gives the same state once: it reads only what earlier batches wrote. Increments
are kept; of the pending references and the withdrawn reports only those of the last two batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigmill.operators import orphans

#: Kinds of rows that aren't references; any other kind is the name of the child table.
PARENT, WITHDRAWAL = "demo_all", "deleted_cases"
SCHEMA = "kind string, primaryid string, caseid string, quarter string"
_INCREMENTS = {"parents": orphans.PARENTS, "withdrawn": orphans.WITHDRAWN, "settled": orphans.PENDING.removesuffix(", standing string")}


def event_rows(df: DataFrame, kind: str) -> DataFrame:
    """Rows of one table as rows of the stream; columns that the table lacks are NULL."""
    return df.select(F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("primaryid", "caseid", "quarter")))


def load_state(spark: SparkSession, folder: str, batch: int) -> orphans.OrphanState:
    """State after a batch; the empty state before the first one. The increments of all batches are one scan each."""
    if batch < 0:
        return orphans.empty_state(spark)
    rows = {n: spark.read.schema(f"{s}, batch int").parquet(f"{folder}/{n}").where(F.col("batch") <= batch).drop("batch") for n, s in _INCREMENTS.items()}
    pending, counts = spark.read.schema(orphans.PENDING).parquet(f"{folder}/pending/batch={batch}"), spark.read.schema(orphans.COUNTS).parquet(f"{folder}/snapshots/batch={batch}")
    gone = spark.read.schema(orphans.GONE).parquet(f"{folder}/gone/batch={batch}")
    return orphans.OrphanState(orphans.Increment(pending), counts, gone, [rows["parents"]], [rows["withdrawn"]], [orphans.Increment(rows["settled"])])


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def advance_batch(rows: DataFrame, batch: int, folder: str) -> None:
    """Take one micro-batch of rows (``SCHEMA``) into the state under ``folder`` (shared by all executors)."""
    spark = rows.sparkSession
    rows = rows.persist()
    names = [r[0] for r in rows.select("kind").where(~F.col("kind").isin(PARENT, WITHDRAWAL)).distinct().collect()]
    references = spark.createDataFrame([], orphans.REFERENCES)
    for name in sorted(names):
        references = references.unionByName(orphans.references_of(rows.where(F.col("kind") == name), name))
    parents, withdrawn = orphans.parents_of(rows.where(F.col("kind") == PARENT)), orphans.withdrawals_of(rows.where(F.col("kind") == WITHDRAWAL))
    state = orphans.advance(load_state(spark, folder, batch - 1), references, parents, withdrawn, batch)
    brought = {"parents": state.parents[-1], "withdrawn": state.withdrawn[-1], "gone": state.gone, "settled": state.settled[-1].rows, "pending": state.pending.rows, "snapshots": state.counts}
    for name, df in brought.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    for name in ("pending", "gone"):
        _remove(spark, f"{folder}/{name}/batch={batch - 2}")
    rows.unpersist()


def start(stream: DataFrame, folder: str) -> StreamingQuery:
    """Start the query that takes all that is there now, batch by batch, and then ends."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: advance_batch(rows, batch, folder))
    return writer.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
