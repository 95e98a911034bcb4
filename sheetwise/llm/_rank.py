"""Dense global ranks without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut, parts_for


def global_rank(df: DataFrame, *keys: Column, name: str = "rank") -> DataFrame:
    """df with the row's place (from 0) in the order of the keys. Rows are sorted by ranges, so equal first keys may
    spread over many tasks; then each partition adds the number of rows before it."""
    ordered = cut(df.repartitionByRange(parts_for(df), *keys).sortWithinPartitions(*keys))
    place = F.monotonically_increasing_id()  # partition << 33 | row
    placed = ordered.withColumn("_p", place)
    counts = sorted((r.p, r.n) for r in placed.groupBy(F.shiftright("_p", 33).alias("p")).agg(F.count("*").alias("n")).collect())  # one for each partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    joined = placed.withColumn("_part", F.shiftright("_p", 33)).join(F.broadcast(offsets), "_part")  # as many rows as partitions
    return joined.withColumn(name, F.col("_before") + F.col("_p").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_part", "_before")
