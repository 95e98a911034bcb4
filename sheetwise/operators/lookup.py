"""Lookups as joins.

The searched table is reduced to one row per key before the join, so rows never multiply, and the join's strategy is
left to Spark, which broadcasts what it knows to be small. Texts match without case; a blank key matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.library import wildcard_of
from ._parts import cut, in_order


def _folded(df: DataFrame, column: str) -> Column:
    return F.lower(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)


def _returned(out: DataFrame, df: DataFrame, returns: dict[str, str], missing: dict, errors: bool) -> DataFrame:
    """df's columns, those that were looked up (in _v), and with errors #N/A beside them where nothing was found."""
    cols = []
    for n in returns:
        cols.append(F.when(F.col("_v").isNull(), F.lit(missing[n])).otherwise(F.col(f"_v.{n}")).alias(n) if n in missing else F.col(f"_v.{n}").alias(n))
        if errors:
            cols.append(F.when(F.col("_v").isNull(), None if n in missing else "#N/A").cast("string").alias(f"{n}_error"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *cols)


def exact(df: DataFrame, key: str, table: DataFrame, table_key: str, returns: dict[str, str], order: str, last: bool = False, missing: dict | None = None, errors: bool = False, wild: bool = False) -> DataFrame:
    """VLOOKUP(.., FALSE), XLOOKUP and INDEX + MATCH: df with the columns `returns` (new name -> table's) of the first
    (or last) row of equal key in `order`. Rows without one get null, or `missing` (new name -> value); with errors,
    <name>_error is #N/A there. wild (VLOOKUP and MATCH, not XLOOKUP): keys of df with * ? or ~ are patterns; each
    different pattern is held against the table's different keys, so they should be few."""
    pick = F.max_by if last else F.min_by
    values = F.struct(*[F.col(c).alias(n) for n, c in returns.items()])
    once = table.filter(F.col(table_key).isNotNull()).groupBy(_folded(table, table_key).alias("_k")).agg(pick(values, F.col(order)).alias("_v"), *([pick(F.col(order), F.col(order)).alias("_o")] if wild else []))
    if wild:
        found = df.select(_folded(df, key).alias("_p")).filter(F.col("_p").rlike(r"[*?~]")).distinct()
        met = found.join(once, F.rlike(F.col("_k"), F.concat(F.lit("(?s)^"), wildcard_of(F.col("_p")), F.lit("$"))))
        best = met.groupBy(F.col("_p").alias("_k")).agg(pick("_v", "_o").alias("_v"))
        once = once.filter(~F.col("_k").rlike(r"[*?~]")).select("_k", "_v").unionByName(best)
    out = df.join(once.select("_k", "_v"), _folded(df, key) == F.col("_k"), "left")
    return _returned(out, df, returns, missing or {}, errors)


def position(df: DataFrame, key: str, table: DataFrame, table_key: str, order: str, name: str = "position", last: bool = False, errors: bool = False, wild: bool = False) -> DataFrame:
    """MATCH(.., 0) and XMATCH: the place, from 1, of the first (or last) equal key; order is the place from 0."""
    out = exact(df, key, table, table_key, {name: order}, order, last, errors=errors, wild=wild)
    return out.withColumn(name, (F.col(name) + 1).cast("double"))


def approximate(df: DataFrame, key: str, table: DataFrame, table_key: str, returns: dict[str, str], descending: bool = False, order: str | None = None, errors: bool = False) -> DataFrame:
    """VLOOKUP(.., TRUE), LOOKUP and MATCH(.., 1 or -1) over sorted keys: the row of the greatest key up to the sought
    one (descending: the least from it on); of equal keys the last in `order` (without one, any). Numbers and texts
    alike. Each different key is sought once; keys of both sides are laid out by ranges, filled forward within a part,
    and across parts by the last row of each. With errors, <name>_error is #N/A where no key lies that far."""
    values = F.struct(*[F.col(c).alias(n) for n, c in returns.items()])
    pick = F.max_by(values, F.col(order)) if order else F.first(values)
    once = table.filter(F.col(table_key).isNotNull()).groupBy(_folded(table, table_key).alias("_k")).agg(pick.alias("_v"))
    sought = df.select(_folded(df, key).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    both = once.select("_k", F.lit(0).alias("_side"), "_v").unionByName(sought.select("_k", F.lit(1).alias("_side")), allowMissingColumns=True)
    ordered = in_order(both, F.col("_k").desc() if descending else F.col("_k").asc(), F.col("_side"))
    fill = F.last("_v", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    tails = ordered.filter("_side = 0").groupBy("_part").agg(F.max_by("_v", "_row").alias("_t"))
    parts = ordered.select("_part").distinct().join(tails, "_part", "left")
    carry = parts.select("_part", F.last("_t", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    found = ordered.withColumn("_f", fill).filter("_side = 1").join(F.broadcast(carry), "_part", "left")  # a row for each part
    found = cut(found.select("_k", F.coalesce("_f", "_c").alias("_v")))
    out = df.withColumn("_q", _folded(df, key)).join(found, F.col("_q") == F.col("_k"), "left")
    return _returned(out, df, returns, {}, errors)
