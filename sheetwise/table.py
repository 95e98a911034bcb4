"""Formulas over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import Val, error_of, result
from .plans.compiler import Arr, Compiler, Grid, RowCompiler, grid_of, packed
from .plans.parser import parse


def _named(formulas: dict[str, str], vals: dict[str, Val], errors: bool, typed: bool) -> list[Column]:
    out = []
    for name in formulas:
        out.append((packed(vals[name]) if typed else result(vals[name])).alias(name))
        if errors:
            out.append(error_of(vals[name]).alias(f"{name}_error"))
    return out


class Table:
    """A DataFrame as a sheet: columns are ranges, a row's cells are read by column name."""

    def __init__(self, df: DataFrame, tables: dict[str, DataFrame] | None = None, names: dict[str, str] | None = None):
        self.df, self.tables, self.names = df, tables or {}, names or {}

    def select(self, *keep: str, errors: bool = False, typed: bool = False, **formulas: str) -> DataFrame:
        """The columns `keep` and a column for each formula, row by row. With errors, <name>_error beside each. A formula
        whose values are of several kinds gives them as text; with typed, each column is a struct with a field for each
        kind (n, s, b, err), of which one at most is set."""
        c = RowCompiler(self.df, self.tables, self.names)
        vals = {k: c.formula(f) for k, f in formulas.items()}
        if c.reduced:  # what a row's columns hold can't be named where other tables are reduced
            c = Compiler(self.df, self.tables, self.names)
            vals = {k: c.formula(f) for k, f in formulas.items()}
        return c.joined(self.df).select(*keep, *_named(formulas, vals, errors, typed))

    def summarise(self, by: list[str] | None = None, errors: bool = False, typed: bool = False, **formulas: str) -> DataFrame:
        """One row per group: all formulas in one aggregation."""
        c = Compiler(self.df, self.tables, self.names, ranges=True)
        vals = {k: c.formula(f) for k, f in formulas.items()}
        if c.reduced:
            raise NotImplementedError("ranges of other tables in a summary")
        return self.df.groupBy(*(by or [])).agg(*_named(formulas, vals, errors, typed))


def evaluate(spark: SparkSession, formula: str, names: dict[str, str] | None = None):
    """A formula's value in Python: a number, text, logical, error text, None for blank; an array as rows."""
    c = Compiler(names=names or {})
    got = c.compile(parse(formula), {})
    whole = isinstance(got, (Arr, Grid))
    g = grid_of(got if whole else c.scalar(got))
    size = lambda x: x if isinstance(x, Column) else F.lit(x)
    row = spark.range(1).select(F.transform(g.cells, lambda x: F.struct(*[x[k].alias(k) for k in ("n", "s", "b", "err")])).alias("cells"), size(g.height).alias("h"), size(g.width).alias("w")).first()
    flat = [next((x[k] for k in ("err", "n", "s", "b") if x[k] is not None), 0) for x in row.cells]
    flat += [0] * (row.h * row.w - len(flat))
    rows = [flat[i : i + row.w] for i in range(0, len(flat), row.w)]
    return rows if whole else rows[0][0]
