"""Formulas of cells as columns.

A row of the compiled table is a formula's cell: r and c, and `slots`, a map from the slots of its references to what they
hold: the cells of the area as an array of structs (n, s, b, err, h, t), row by row, its height and width, and those
that the reference names. All cells that share a relative formula are one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import Unsupported, Val, error, lit, text
from .compiler import Arr, Area, Compiler, Grid, Lambda, grid_of
from .references import Need, Program

#: Areas of up to so many cells whose size doesn't depend on the cell are unrolled.
SMALL = 64

SLOT = "struct<cells:array<struct<n:double,s:string,b:boolean,err:string,h:boolean,t:boolean>>,height:bigint,width:bigint,rows:bigint,columns:bigint>"
RESULT = "array<struct<i:int,j:int,n:double,s:string,b:boolean,err:string>>"


@dataclass
class CellCompiler(Compiler):
    needs: list[Need] = field(default_factory=list)
    #: For each slot, the lanes that hold something in some cell.
    held: dict[int, str] = field(default_factory=dict)
    #: Columns that hold the steps of this formula, in the order in which they are made, and the start of their names.
    steps: list[dict[str, Column]] = field(default_factory=list)
    name: str = "_x"

    def keep(self, x):
        if isinstance(x, Val):
            lanes = {k: getattr(x, k) for k in ("n", "s", "b", "err") if getattr(x, k) is not None}
        elif isinstance(x, Grid):
            lanes = {"cells": x.cells} | {k: getattr(x, k) for k in ("height", "width") if isinstance(getattr(x, k), Column)}
        else:
            return x
        if not lanes:
            return x
        at = f"{self.name}_{len(self.steps)}_"
        self.steps.append({at + k: v for k, v in lanes.items()})
        return replace(x, **{k: F.col(at + k) for k in lanes})

    def slot(self, k: int) -> Column:
        return F.try_element_at(F.col("slots"), F.lit(k))

    def _cell(self, node, env):
        k = node[1]
        return self.keep(self.grid(k).at(F.lit(0)))

    def grid(self, k: int) -> Grid:
        s = self.slot(k)
        return Grid(s["cells"], s["height"], s["width"], self.held.get(k, ""), True, (s["rows"], s["columns"]), self.needs[k])

    def _area(self, node, env):
        k = node[1]
        g, shape = self.grid(k), self.needs[k].fixed_shape
        if shape is None or shape[0] * shape[1] > SMALL:
            return self.keep(g)
        return Area([[g.at(F.lit(i * shape[1] + j)) for j in range(shape[1])] for i in range(shape[0])], self.needs[k])

    def scalar(self, x) -> Val:
        """An area where one value is wanted: the cell in the formula's own row or column."""
        need = getattr(x, "need", None)
        if need is None or need.spill:
            return super().scalar(x)
        g = grid_of(x)
        r, c = (F.col(a) for a in ("r", "c"))
        row = F.lit(-need.r0) if need.rel_r0 else r - need.r0
        col = F.lit(-need.c0) if need.rel_c0 else c - need.c0
        full = (F.lit(x.shape[0]), F.lit(x.shape[1])) if isinstance(x, Arr) else g.full
        width = g.width if isinstance(g.width, Column) else F.lit(g.width)
        at = F.when((full[0] == 1) & (full[1] == 1), 0).when((full[1] == 1) & (row >= 0) & (row < full[0]), row * width).when((full[0] == 1) & (col >= 0) & (col < full[1]), col)
        v = g.at(at)
        err = F.when(at.isNull(), F.lit("#VALUE!"))
        keep = lambda x: None if x is None else F.when(at.isNotNull(), x)
        return Val(keep(v.n), keep(v.s), keep(v.b), err if v.err is None else F.coalesce(err, v.err), True)

    def _call(self, node, env):
        _, name, args = node
        if name in ("ROW", "COLUMN") and len(args) <= 1:
            return self.place(name, args)
        if name in ("ROWS", "COLUMNS") and len(args) == 1 and args[0][0] == "cell":
            return lit(1)
        if name == "SUBTOTAL" and len(args) > 1 and args[0][0] != "num":
            return error("#UNSUPPORTED!")
        if name == "SUBTOTAL":
            return super()._call((node[0], name, [args[0], *[("flagged", a[1]) if a[0] in ("cell", "area") else a for a in args[1:]]]), env)
        if name == "CELL" and len(args) == 2 and args[0][0] == "str" and args[1][0] in ("cell", "area"):
            what = args[0][1].lower()
            if what in ("row", "col"):
                return self.place("ROW" if what == "row" else "COLUMN", args[1:])
            if what == "contents":
                return self.grid(args[1][1]).at(F.lit(0))
            if what == "type":
                v = self.grid(args[1][1]).at(F.lit(0))
                return text(F.when(v.is_blank(), F.lit("b")).when(v.s.isNotNull() if v.s is not None else F.lit(False), F.lit("l")).otherwise(F.lit("v")))
            return error("#UNSUPPORTED!")
        return super()._call(node, env)

    def _flagged(self, node, env):
        """An area whose cells' hidden rows and subtotals matter."""
        return self.keep(self.grid(node[1]))

    def place(self, name: str, args: list):
        axis = 0 if name == "ROW" else 1
        own = F.col("rc"[axis])
        if not args:
            return Val(n=(own + 1).cast("double"))
        if args[0][0] not in ("cell", "area"):
            return error("#UNSUPPORTED!")
        need = self.needs[args[0][1]]
        first, relative = ((need.r0, need.rel_r0), (need.c0, need.rel_c0))[axis]
        return Val(n=((own + first if relative else F.lit(first)) + 1).cast("double"))


def compiled(program: Program, array: bool, held: dict[int, str], name: str = "_x") -> tuple[Column, bool, list[dict[str, Column]]]:
    """The cells that a formula gives, as RESULT, whether they may be more than one, and the columns (their names begin
    with `name`) that have to be made before, one step after the other. array: it was entered as an array formula, so an
    area at its top gives all its cells."""
    c = CellCompiler(needs=program.needs, held=held, anchored=True, name=name)
    try:
        got = c.compile(program.tree, {})
    except (Unsupported, NotImplementedError, RecursionError):
        got = error("#UNSUPPORTED!")
    if isinstance(got, Lambda):
        got = error("#CALC!")
    if not isinstance(got, (Arr, Grid)) or (getattr(got, "need", None) is not None and not array and not got.need.spill):
        v = c.keep(c.scalar(got))
        return F.array(_result(F.lit(0), F.lit(0), v)), False, c.steps
    if isinstance(got, Arr) and got.shape == (1, 1):
        return F.array(_result(F.lit(0), F.lit(0), c.keep(got.rows[0][0]))), False, c.steps
    g = c.keep(grid_of(got))
    w = g.width if isinstance(g.width, Column) else F.lit(g.width)
    return F.transform(g.cells, lambda x, i: _result(F.floor(i / w), i % w, g.val(x))), True, c.steps


def _result(i: Column, j: Column, v: Val) -> Column:
    """A blank result is 0."""
    lanes = {k: getattr(v, k) if getattr(v, k) is not None else F.lit(None).cast(t) for k, t in (("n", "double"), ("s", "string"), ("b", "boolean"), ("err", "string"))}
    lanes["n"] = F.when(F.coalesce(*[x.cast("string") for x in lanes.values()]).isNull(), 0.0).otherwise(lanes["n"])
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), *[x.alias(k) for k, x in lanes.items()])
