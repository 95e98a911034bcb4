"""Operators of order: ranks, k-th values, running folds, shifted references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._parts import before, in_order, positions, running


def rank(df: DataFrame, value: str, by: list[str] | None = None, ascending: bool = False, name: str = "rank") -> DataFrame:
    """RANK.EQ: ties share the best rank. Without groups, different values are counted first and ranked by ranges."""
    side = F.col(value).asc() if ascending else F.col(value).desc()
    if by:
        return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(side)).cast("double"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    key = F.col("_v").asc() if ascending else F.col("_v").desc()
    placed = before(in_order(counts, key), F.sum("_n"), "_ahead")
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    ranks = placed.select("_v", (F.col("_ahead") + upto - F.col("_n") + 1).cast("double").alias(name))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def kth(df: DataFrame, value: str, k: int, by: list[str] | None = None, largest: bool = True, name: str = "kth") -> DataFrame:
    """LARGE and SMALL: the k-th value; groups with fewer have none."""
    side = F.col(value).desc() if largest else F.col(value).asc()
    full = df.filter(F.col(value).isNotNull())
    if not by:
        top = full.select(F.col(value).alias(name)).orderBy(F.col(name).desc() if largest else F.col(name).asc()).limit(k)
        worst = F.min if largest else F.max
        return top.agg(F.when(F.count("*") == k, worst(name)).alias(name))
    ranked = full.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(side)))
    return ranked.filter(F.col("_n") == k).select(*by, F.col(value).alias(name))


def accumulate(df: DataFrame, value: str, *order: Column, by: list[str] | None = None, name: str = "running") -> DataFrame:
    """SCAN with a sum: the running total."""
    if not by:
        return running(df, value, *order, name=name)
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def offset(df: DataFrame, value: str, rows: int, *order: Column, by: list[str] | None = None, name: str = "moved") -> DataFrame:
    """OFFSET by a fixed number of rows: the cell so many rows below (negative: above)."""
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(name, F.lead(value, rows).over(w) if rows >= 0 else F.lag(value, -rows).over(w))
    placed = positions(df, *order)
    other = placed.select((F.col("_pos") - rows).alias("_pos"), F.col(value).alias(name))
    return placed.join(other, "_pos", "left").drop("_pos")
