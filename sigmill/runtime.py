"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest size of a side that is broadcast after it was measured.
BROADCAST_BYTES = 32 << 20
#: Copies of each row of a table that is looked up but too large to be broadcast.
LOOKUP_PARTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` of the session; only where it is unset (local tests), make one.

    A folder on the driver's disk is no shared folder, so outside local mode the setting is required.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="sigmill-checkpoint-")
        sc.setCheckpointDir(shared)
    _remove_at_exit(spark, sc.getCheckpointDir())


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the session's own folder of written stages removed when the session's process ends.

    Before that Spark removes the stages that nothing refers to any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set when the session starts.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that several readers don't compute it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most: int | None = None) -> bool:
    """Whether ``df`` may be broadcast: whether its rows, written as text, have at most ``most`` bytes.

    All rows are measured, where they lie; only their number and size come to the driver. ``most`` is
    ``BROADCAST_BYTES`` unless given.
    """
    written = F.octet_length(F.to_json(F.struct("*"))) if df.columns else F.lit(0)
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(written), F.lit(0)).alias("bytes")).first()
    return row["bytes"] + 16 * row["n"] <= (BROADCAST_BYTES if most is None else most)


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if it is ``bounded``; a join then needs no other change."""
    return F.broadcast(df) if bounded(df) else df


def lookup(rows: DataFrame, table: DataFrame, on: list[str], fits: bool | None = None, parts: int = LOOKUP_PARTS) -> DataFrame:
    """``rows`` with the columns of ``table``, whose keys ``on`` are unique; NULL where it lacks the key (or the key is NULL).

    The table is broadcast if it was measured to be small (``fits``, if the caller has measured it). Else each of its rows is copied for ``parts`` parts, over
    which the rows of a key are spread by their content and map task, so that a key of a third of all rows is no
    single task's burden. That join is a merge join by hint: the optimiser guesses the size from the files, which can be
    a hundredth of the rows', and would have the driver build a broadcast of all copies.
    """
    if bounded(table) if fits is None else fits:
        return rows.join(F.broadcast(table), on, "left")
    spread_out = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns) + F.spark_partition_id(), F.lit(parts)).cast("int"))
    copies = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread_out.join(copies.hint("merge"), [*on, "_part"], "left").drop("_part")


def widened(df: DataFrame) -> DataFrame:
    """``df`` with at least as many partitions as there are cores, for costly work on rows of a small input.

    A large input has more partitions than that by itself and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over the session's shuffle partitions, for costly work on rows that an aggregation left in few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
