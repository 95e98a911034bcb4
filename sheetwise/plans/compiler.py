"""Trees to columns.

A name is a column of the table: the same row's cell where one value is wanted, the whole column (a range) where an
aggregate of `summarise` wants many. `other!column` is a column of another table: a range, reduced once and joined as
a single row. Array constants and what is made of them have a shape known in advance and are unrolled, LET and LAMBDA
are substituted, so nothing is left to interpret when Spark runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import GENUINE, SENTINELS, Unsupported, Val, bind, choose, compare, error, first_error, guarded, lit, num, of_column, text, to_number, to_text
from .parser import parse

MOST_CELLS = 1 << 20


@dataclass(frozen=True)
class Arr:
    """A rectangle of values."""

    rows: list[list[Val]]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rows), len(self.rows[0])

    def cells(self) -> list[Val]:
        return [v for r in self.rows for v in r]


@dataclass(frozen=True)
class Area(Arr):
    """A rectangle of a sheet's cells, by its reference."""

    need: object = None


@dataclass(frozen=True)
class Grid:
    """A rectangle of values whose size is known when it runs: an array of structs with the lanes, row by row. lanes: of
    n, s, b, e (errors) those that may hold something; cells may be blank. blank cells at the end may be left out of
    `cells`, so the height is a number of its own."""

    cells: Column
    height: Column | int
    width: Column | int
    lanes: str = "nsbe"
    flagged: bool = False  # have the structs h (a hidden row) and t (a subtotal), too
    full: tuple | None = None  # rows and columns of an area that goes on beyond what is used
    need: object = None  # the reference that it comes from

    def val(self, x: Column) -> Val:
        """One of the cells."""
        return Val(*[x[k] if k in self.lanes else None for k in "nsb"], x["err"] if "e" in self.lanes else None, True)

    def each(self, fn: Callable[[Val], Column]) -> Column:
        return F.transform(self.cells, lambda x: fn(self.val(x)))

    def at(self, i: Column) -> Val:
        """The i-th cell, from 0; blank beyond the last."""
        return self.val(F.get(self.cells, i.cast("int")))


LANES = "struct<n:double,s:string,b:boolean,err:string>"


def packed(v: Val) -> Column:
    """A value as a struct of its lanes."""
    none = {"n": "double", "s": "string", "b": "boolean", "err": "string"}
    return F.struct(*[(getattr(v, k) if getattr(v, k) is not None else F.lit(None).cast(t)).cast(t).alias(k) for k, t in none.items()])


def grid_of(x) -> Grid:
    """A rectangle of known size as a Grid."""
    if isinstance(x, Grid):
        return x
    rows = x.rows if isinstance(x, Arr) else [[x]]
    flat = [v for r in rows for v in r]
    lanes = "".join(k for k in "nsb" if any(getattr(v, k) is not None for v in flat)) + ("e" if any(v.err is not None for v in flat) else "")
    return Grid(F.array(*[packed(v) for v in flat]), len(rows), len(rows[0]), lanes)


@dataclass(frozen=True)
class Rng:
    """A whole column (or an expression of columns) of a table; table None is the compiled one."""

    val: Val
    table: str | None = None


@dataclass(frozen=True)
class Lambda:
    names: list[str]
    body: tuple
    env: dict


@dataclass
class Compiler:
    df: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    ranges: bool = False  # are names of the own table ranges
    anchored: bool = False  # are areas parts of a sheet
    #: Reductions of other tables: (table, column) in order; their results are joined as one row.
    reduced: list[tuple[str, Column]] = field(default_factory=list)

    def formula(self, source: str) -> Val:
        return self.scalar(self.compile(parse(source), {}))

    # -- nodes

    def compile(self, node: tuple, env: dict):
        return getattr(self, f"_{node[0]}")(node, env)

    def value(self, node: tuple, env: dict) -> Val:
        return self.scalar(self.compile(node, env))

    def scalar(self, x) -> Val:
        if isinstance(x, Val):
            return x
        if isinstance(x, Arr):
            return x.rows[0][0]  # implicit intersection of a computed array
        if isinstance(x, Lambda):
            return error("#CALC!")
        if isinstance(x, Grid):
            return x.at(F.lit(0))
        if x.table is None and not self.ranges:
            return x.val
        raise Unsupported("a range where one value is wanted")

    def _num(self, node, env):
        return lit(node[1])

    _str = _bool = _err = _num

    def _omit(self, node, env):
        return Val(blank=True)

    def _name(self, node, env):
        _, table, name = node
        if table is None and name.upper() in env:
            return env[name.upper()]
        if table is None and name in self.names:
            return self.compile(parse(self.names[name]), {})
        df = self.df if table is None else self.tables.get(table)
        kinds = dict(df.dtypes) if df is not None else {}
        if name not in kinds:
            return error("#NAME?" if table is None else "#REF!")
        val = of_column(F.col(f"`{name}`"), kinds[name])
        return Rng(val, table) if table is not None or self.ranges else val

    def _range(self, node, env):
        raise Unsupported("cell ranges belong to workbooks")

    def _array(self, node, env):
        return Arr([[self.value(x, env) for x in row] for row in node[1]])

    def _un(self, node, env):
        _, op, x = node
        if op == "@":
            return self.scalar(self.compile(x, env))
        if op == "+":
            return self.compile(x, env)
        return self.lift(lambda v: (lambda c, e: num(-c, e, False))(*to_number(v)), [self.compile(x, env)])

    def _post(self, node, env):
        if node[1] == "#":
            raise Unsupported("spilled regions belong to workbooks")
        return self.lift(lambda v: (lambda c, e: num(c / 100, e, False))(*to_number(v)), [self.compile(node[2], env)])

    def _bin(self, node, env):
        _, op, a, b = node
        return self.lift(lambda x, y: binary(op, x, y), [self.compile(a, env), self.compile(b, env)])

    def _call(self, node, env):
        from ..functions.library import FUNCTIONS

        _, name, args = node
        if isinstance(env.get(name), Lambda):
            return self.apply(env[name], [self.compile(a, env) for a in args])
        if name in self.names:
            made = self.compile(parse(self.names[name]), {})
            if isinstance(made, Lambda):
                return self.apply(made, [self.compile(a, env) for a in args])
        if name not in FUNCTIONS:
            return error("#NAME?")
        low, high, how, fn = FUNCTIONS[name]
        if not low <= len(args) <= (high or 10**6):
            return error("#VALUE!")
        if how == "tree":
            return self.keep(fn(self, args, env))
        return self.lift(fn, [self.compile(a, env) for a in args])

    def _apply(self, node, env):
        fn = self.compile(node[1], env)
        if not isinstance(fn, Lambda):
            return error("#VALUE!")
        return self.apply(fn, [self.compile(a, env) for a in node[2]])

    def apply(self, fn: Lambda, args: list):
        if len(args) != len(fn.names):
            return error("#VALUE!")
        return self.compile(fn.body, fn.env | dict(zip(fn.names, args, strict=True)))

    def keep(self, x):
        """A step's result, as later steps should see it: a compiler that has columns of its own for steps puts it there,
        as an expression would otherwise hold those that it is made of many times over."""
        return x

    def once(self, fn: Callable[..., Column], *cols: Column) -> Column:
        """fn of columns that are computed once a row; not for those inside of arrays."""
        return bind(fn, *cols)

    def lift(self, fn: Callable[..., Val], args: list):
        """A function of single values over arrays and ranges."""
        ranges = [a for a in args if isinstance(a, Rng)]
        if ranges and (self.ranges or any(r.table is not None for r in ranges)):
            tables = {r.table for r in ranges}
            if len(tables) > 1 or any(isinstance(a, Arr) for a in args):
                raise Unsupported("ranges of different tables side by side")
            return Rng(fn(*[a.val if isinstance(a, Rng) else a for a in args]), tables.pop())
        if any(isinstance(a, Grid) for a in args):
            return self.lift_grids(fn, args)
        arrays = [a for a in args if isinstance(a, Arr)]
        args = [a if isinstance(a, Arr) else self.scalar(a) for a in args]
        if not arrays:
            return self.keep(fn(*args))
        height, width = (max(a.shape[i] for a in arrays) for i in (0, 1))
        if any(s not in (1, m) for a in arrays for s, m in zip(a.shape, (height, width), strict=True)):
            if not all(a.shape[1] == 1 for a in arrays):
                return error("#UNSUPPORTED!")

        def cell(a, i, j):
            if isinstance(a, Val):
                return a
            h, w = a.shape
            if (i >= h and h > 1) or (j >= w and w > 1):
                return error("#N/A")
            return a.rows[0 if h == 1 else i][0 if w == 1 else j]

        return Arr([[fn(*[cell(a, i, j) for a in args]) for j in range(width)] for i in range(height)])

    def lift_grids(self, fn: Callable[..., Val], args: list):
        """fn over grids of one shape and single values."""
        args = [grid_of(a) if isinstance(a, Arr) and a.shape != (1, 1) else a if isinstance(a, Grid) else self.scalar(a) for a in args]
        grids = [a for a in args if isinstance(a, Grid)]
        first = grids[0]
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        if len(grids) == 1:
            one = lambda x: packed(fn(*[first.val(x) if a is first else a for a in args]))
            return self.keep(Grid(F.transform(first.cells, one), first.height, first.width))
        differ = F.lit(False)
        for g in grids[1:]:
            differ = differ | (as_col(g.height) != as_col(first.height)) | (as_col(g.width) != as_col(first.width))
        zipped = F.arrays_zip(*[g.cells.alias(f"g{i}") for i, g in enumerate(grids)])

        def one(x):
            vals = iter(grids[i].val(x[f"g{i}"]) for i in range(len(grids)))
            v = fn(*[next(vals) if isinstance(a, Grid) else a for a in args])
            return F.when(differ, packed(error("#UNSUPPORTED!"))).otherwise(packed(v))

        return self.keep(Grid(F.transform(zipped, one), first.height, first.width))

    # -- ranges of other tables

    def reduce(self, table: str | None, col: Column) -> Column:
        """An aggregate of a range: as it stands within `summarise`, or a value of the joined row of another table."""
        if table is None:
            return col
        name = f"_r{len(self.reduced)}"
        self.reduced.append((table, col.alias(name)))
        return F.col(name)

    def joined(self, df: DataFrame) -> DataFrame:
        """df beside the one row of reductions."""
        by_table: dict[str, list[Column]] = {}
        for table, col in self.reduced:
            by_table.setdefault(table, []).append(col)
        for table, cols in by_table.items():
            df = df.crossJoin(F.broadcast(self.tables[table].agg(*cols)))  # one row
        return df


@dataclass
class RowCompiler(Compiler):
    """Formulas of one table's rows: what `once` computes are columns, made one after the other, so that Spark's generated
    code does it; `bind` is interpreted, with all that it is made of."""

    steps: list[dict[str, Column]] = field(default_factory=list)

    def once(self, fn, *cols):
        made = {f"_once{len(self.steps)}_{i}": c for i, c in enumerate(cols)}
        self.steps.append(made)
        return fn(*[F.col(name) for name in made])

    def joined(self, df: DataFrame) -> DataFrame:
        for made in self.steps:
            df = df.withColumns(made)
        return df


def binary(op: str, a: Val, b: Val) -> Val:
    if op in ("=", "<>", "<", "<=", ">", ">="):
        return compare(op, a, b)
    if op == "&":
        (x, e), (y, f) = to_text(a), to_text(b)
        return text(F.concat(x, y), first_error(e, f))
    if op in (" ", ","):
        return error("#UNSUPPORTED!")
    (x, e), (y, f) = to_number(a), to_number(b)
    err = first_error(e, f)
    if op == "/":
        return num(F.try_divide(x, y), first_error(err, F.when(y == 0, F.lit("#DIV/0!"))))
    if op == "^":
        return power(x, y, err)
    return num({"+": x + y, "-": x - y, "*": x * y}[op], err)


def power(x: Column, y: Column, err: Column | None) -> Val:
    """0^0 is #NUM!, 0 to a negative power #DIV/0!; a negative base takes the reciprocal of an odd number."""
    root = F.try_divide(F.lit(1.0), y)
    odd = (F.abs(root) < 1e9) & (F.abs(root - F.round(root)) < 1e-9 * F.abs(root)) & (F.abs(F.round(root)) % 2 == 1) & (y != F.floor(y))
    bad = F.when((x == 0) & (y == 0), F.lit("#NUM!")).when((x == 0) & (y < 0), F.lit("#DIV/0!"))
    return num(F.when((x < 0) & odd, -F.pow(-x, y)).otherwise(F.pow(x, y)), first_error(err, bad))


__all__ = ["GENUINE", "LANES", "SENTINELS", "Arr", "Compiler", "Grid", "Lambda", "Rng", "RowCompiler", "binary", "choose", "grid_of", "guarded", "packed"]
