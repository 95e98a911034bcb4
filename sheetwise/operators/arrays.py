"""Dynamic arrays over tables: rows are the array's rows, an explicit order gives them their places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..table import Table
from ._parts import positions


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """FILTER(table, condition)."""
    marked = Table(df).select(*df.columns, _keep=condition)
    return marked.filter(F.col("_keep").cast("boolean")).select(*df.columns)


def _folded(df: DataFrame, column: str) -> Column:
    return F.lower(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)


def sort(df: DataFrame, *keys: tuple[str, int], order: str | None = None, place: str | None = None) -> DataFrame:
    """SORT and SORTBY: by columns, each with 1 (ascending) or -1. Texts sort without case, blank cells come last, ties
    keep the order of the column `order`. place: a column with each row's place, from 0."""
    sides = [_folded(df, c).asc_nulls_last() if way >= 0 else _folded(df, c).desc_nulls_last() for c, way in keys]
    sides += [F.col(order).asc()] if order else []
    return positions(df, *sides, name=place) if place else df.orderBy(*sides)


def unique(df: DataFrame, columns: list[str], order: str | None = None, exactly_once: bool = False) -> DataFrame:
    """UNIQUE: different rows of the columns, with the place of the first (`order`) if asked; or those that occur once.
    Rows that differ in the case of texts only leave open which one stands for them: such a table is refused when it
    is computed."""
    texts = [c for c in columns if dict(df.dtypes)[c] == "string"]
    row = F.struct(*columns)
    keys = [_folded(df, c).alias(c) for c in columns]
    seen = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(row).alias("_lo"), F.max(row).alias("_hi"), *([F.min(order).alias(order)] if order else []))
    clash = F.col("_lo") != F.col("_hi")
    out = seen.filter("_n = 1") if exactly_once else seen
    got = lambda c: F.when(clash, F.raise_error(F.lit("#UNSUPPORTED! rows differ in case only")).cast("string")).otherwise(F.col(f"_lo.{c}")) if texts and c in texts else F.col(f"_lo.{c}")
    return out.select(*[got(c).alias(c) for c in columns], *([order] if order else []))


def take(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """TAKE: the first n rows in order, or the last -n."""
    if n >= 0:
        return df.orderBy(*order).limit(n)
    placed = positions(df, *order)
    return placed.filter(F.col("_pos") >= placed.count() + n).drop("_pos")


def drop(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """DROP: all but the first n rows in order, or the last -n."""
    placed = positions(df, *order)
    return placed.filter(F.col("_pos") >= n if n >= 0 else F.col("_pos") < placed.count() + n).drop("_pos")


def choose_columns(df: DataFrame, *numbers: int) -> DataFrame:
    """CHOOSECOLS: by number from 1, negative from the end."""
    return df.select(*[df.columns[n - 1 if n > 0 else n] for n in numbers])


def choose_rows(df: DataFrame, numbers: list[int], *order: Column) -> DataFrame:
    """CHOOSEROWS: the rows of these numbers (from 1, negative from the end), in the order of the list (column _at)."""
    placed = positions(df, *order)
    size = placed.count() if min(numbers) < 0 else 0
    wanted = df.sparkSession.createDataFrame([(i, n - 1 if n > 0 else size + n) for i, n in enumerate(numbers)], "_at int, _pos long")
    return placed.join(F.broadcast(wanted), "_pos").drop("_pos")  # the formula's own list


def vstack(*dfs: DataFrame, errors: bool = False) -> DataFrame:
    """VSTACK: rows after rows, by place of the column. Short rows are padded: null, and with errors #N/A in <name>_error."""
    width = max(len(d.columns) for d in dfs)
    named = [d.toDF(*[f"c{i + 1}" for i in range(len(d.columns))]) for d in dfs]
    names = [f"c{i + 1}" for i in range(width)]
    if errors:
        named = [d.select("*", *[F.lit(None if c in d.columns else "#N/A").cast("string").alias(f"{c}_error") for c in names]) for d in named]
        names += [f"{c}_error" for c in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).select(*names)


def hstack(left: DataFrame, left_order: list[Column], right: DataFrame, right_order: list[Column], errors: bool = False) -> DataFrame:
    """HSTACK: row beside row by place (_pos). The shorter side is padded: null, and with errors #N/A in left_error or
    right_error."""
    a, b = (positions(d, *o).withColumn(k, F.lit(True)) for d, o, k in ((left, left_order, "_l"), (right, right_order, "_r")))
    out = a.join(b, "_pos", "full")
    if errors:
        out = out.withColumns({n: F.when(F.col(k).isNull(), "#N/A") for n, k in (("left_error", "_l"), ("right_error", "_r"))})
    return out.drop("_l", "_r")


def expand(df: DataFrame, rows: int, pad: dict, *order: Column) -> DataFrame:
    """EXPAND to a number of rows: rows beyond the table's hold `pad`."""
    grid = df.sparkSession.range(rows).select(F.col("id").alias("_pos"), F.lit(True).alias("_in"))
    placed = positions(df, *order).withColumn("_own", F.lit(True))
    out = grid.join(placed, "_pos", "left")
    return out.select("_pos", *[F.when(F.col("_own"), F.col(c)).otherwise(F.lit(pad.get(c))).alias(c) for c in df.columns])


def wrap_rows(df: DataFrame, value: str, n: int, *order: Column) -> DataFrame:
    """WRAPROWS: a column as rows of n cells (columns c1..cn, _row). WRAPCOLS has the same cells: there _row numbers the
    columns and c1..cn go down."""
    placed = positions(df.select(value, *[k.alias(f"_k{i}") for i, k in enumerate(order)]), *[F.col(f"_k{i}") for i in range(len(order))])
    row, at = F.floor(F.col("_pos") / n).alias("_row"), (F.col("_pos") % n).alias("_at")
    cells = placed.select(row, at, value)
    return cells.groupBy("_row").agg(*[F.max(F.when(F.col("_at") == i, F.col(value))).alias(f"c{i + 1}") for i in range(n)])


def to_column(df: DataFrame, columns: list[str], order: str, ignore_blanks: bool = False) -> DataFrame:
    """TOCOL and TOROW: cells as rows (order, _c, value), to be read by (order, _c), or (_c, order) by column."""
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).alias("value")) for i, c in enumerate(columns)])
    out = df.select(order, F.explode(cells).alias("x")).select(order, "x._c", "x.value")
    return out.filter("value is not null") if ignore_blanks else out


def sequence(spark, n: int, start: float = 1, step: float = 1) -> DataFrame:
    """SEQUENCE(n): a column of numbers."""
    return spark.range(n).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("value"))


def rollup(df: DataFrame, by: list[str], **formulas: str) -> DataFrame:
    """Subtotals at every level of `by` and a grand total, each from the rows themselves."""
    from ..functions.values import result
    from ..plans.compiler import Compiler

    c = Compiler(df, ranges=True)
    return df.rollup(*by).agg(*[result(c.formula(f)).alias(n) for n, f in formulas.items()], F.grouping_id().alias("level"))
