"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ._text import small_batches


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and all runs in one process (tests), a temporary one."""
    small_batches(spark)
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sheetwise-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Bytes of input for a partition of what is dealt by ranges or keys.
PART_BYTES = 64 << 20


def parts_for(df: DataFrame) -> int:
    """Partitions for a shuffle of df: as many as its session has, or more if the planner knows df to be large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # a plan without statistics counts as endless
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PART_BYTES))


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of tables that are no longer in use: it learns of them only
    when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept where a lost executor can't take it along; partitions and row order stay."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Like cut(), as Parquet: its size is then known to the planner, which broadcasts it only if it is small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
