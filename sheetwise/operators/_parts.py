"""Prefix sums and places over a whole table without a window over one partition."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where all runs in one process."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sheetwise-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df computed once, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its size is then known to the planner."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input for a partition of what is dealt by ranges.
PART_BYTES = 64 << 20


def parts_for(df: DataFrame) -> int:
    """Partitions for a shuffle of df: as many as its session has, or more if the planner knows df to be large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # a plan without statistics counts as endless
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PART_BYTES))


def in_order(df: DataFrame, *keys: Column) -> DataFrame:
    """df sorted by ranges, with _part and _row (the place in the part)."""
    ordered = cut(df.repartitionByRange(parts_for(df), *keys).sortWithinPartitions(*keys))
    place = F.monotonically_increasing_id()
    return ordered.withColumns({"_part": F.shiftright(place, 33), "_row": place.bitwiseAND(F.lit((1 << 33) - 1))})


def before(ordered: DataFrame, total: Column, name: str) -> DataFrame:
    """ordered (of in_order) with the total of all earlier parts: a row for each part is added up and joined."""
    sums = ordered.groupBy("_part").agg(total.alias("_t"))
    ahead = F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.join(F.broadcast(sums.select("_part", ahead.alias(name))), "_part")  # as many rows as parts


def positions(df: DataFrame, *keys: Column, name: str = "_pos") -> DataFrame:
    """df with each row's place, from 0, in the order of the keys."""
    placed = before(in_order(df, *keys), F.count("*"), "_ahead")
    return placed.withColumn(name, (F.col("_ahead") + F.col("_row")).cast("bigint")).drop("_part", "_row", "_ahead")


def running(df: DataFrame, value: str, *keys: Column, name: str = "running") -> DataFrame:
    """df with the running sum of `value` in the order of the keys."""
    placed = before(in_order(df, *keys), F.sum(value), "_ahead")
    upto = F.sum(value).over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, F.col("_ahead") + upto).drop("_part", "_row", "_ahead")
