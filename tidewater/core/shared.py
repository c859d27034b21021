"""Tables in the folder that all executors share, and broadcasts of counted size."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have, counted at run time, before it may be broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local session without one gets its own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints', 'tidewater')}"
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder that goes when the driver's JVM ends."""
    top = f"{shared_dir(spark)}/tidewater-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(top)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    stem, dot, suffix = name.partition(".")
    return f"{top}/{stem}-{uuid.uuid4().hex}{dot}{suffix}"


#: Spark's setting for removing a query's shuffle files when it ends, not when the driver's memory is next collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    Once written, the shuffles behind it are of no more use, and their files are removed.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only once ``df`` (best a stored table) is counted to be within ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
