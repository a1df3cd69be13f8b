"""Helpers of the graph operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a session of this machine alone may leave that unset; a temporary folder then takes its place."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame, partitioned: bool = False) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage.

    df becomes a Parquet table and is read again. A checkpoint would carry the constraints of
    its plan along, which double in each round of some loops; it is taken only where the
    partitioning has to stay (partitioned).
    """
    folder = shared_folder(df.sparkSession)
    if partitioned:
        return df.checkpoint()
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df plus rank, its rows' place from 0 in the order of the columns: rows are dealt by ranges and numbered there, so that no task gets all."""
    dealt = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_run", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_run", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(before, "_run").select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"))


def together(*parts: Callable[[], DataFrame]) -> list[DataFrame]:
    """Results of independent driver loops, run side by side so that the small jobs of one fill the waits of another."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return [f.result() for f in [pool.submit(p) for p in parts]]
