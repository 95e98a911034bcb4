"""One workbook: open, recalculate, edit, look."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.values import GENUINE, SENTINELS
from .operators.sheets import recalculate
from .operators._parts import stored
from .plans.references import FormulaError, a1, compile_text, parse_a1
from .sources.xlsx import CELLS, Caps, cell_rows, read_book

_NAME = "book"


class Workbook:
    """A workbook's cells as a table, and their values after recalc(). An edit is kept until the next recalc(), which
    then computes only what depends on the edited cells."""

    def __init__(self, spark: SparkSession, data: bytes, caps: Caps | None = None):
        self.spark = spark
        self._book = read_book(data, caps)
        rows = [r for r in cell_rows(_NAME, self._book) if r[9] != "book"]
        self.cells = stored(spark.createDataFrame(rows, CELLS))
        self.values: DataFrame | None = None
        self._edits: dict[tuple[str, int, int], tuple] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, caps: Caps | None = None) -> Workbook:
        """From a path that Spark can read."""
        return cls(spark, bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), caps)

    @classmethod
    def open_bytes(cls, spark: SparkSession, data: bytes, caps: Caps | None = None) -> Workbook:
        return cls(spark, data, caps)

    @property
    def sheet_names(self) -> list[str]:
        return [s.name for s in self._book.sheets]

    def _place(self, sheet: str, ref: str) -> tuple[str, int, int]:
        at = parse_a1(ref.replace("$", ""))
        if at is None:
            raise ValueError(f"no cell reference: {ref!r}")
        known = {s.lower(): s for s in self.sheet_names}
        if sheet.lower() not in known:
            raise KeyError(sheet)
        return known[sheet.lower()], *at

    def edit(self, sheet: str, ref: str, value) -> None:
        """A constant (None: blank) or, as text that begins with =, a formula."""
        name, r, c = self._place(sheet, ref)
        n = s = b = err = formula = key = problem = None
        kind = "value"
        if isinstance(value, bool):
            b = value
        elif isinstance(value, (int, float)):
            n = float(value)
        elif isinstance(value, str) and value.startswith("="):
            kind, formula = "normal", value[1:]
            try:
                key = compile_text(formula, r, c, self._book.names, name).key
            except FormulaError:
                problem = "parse"
        elif value in GENUINE + SENTINELS:
            err = value
        else:
            s = value
        number = self.sheet_names.index(name)
        self._edits[name, r, c] = (_NAME, name, number, r, c, n, s, b, err, kind, formula, key, problem, r in self._book.sheets[number].hidden)

    def recalc(self) -> Workbook:
        edited = None
        if self._edits:
            fresh = self.spark.createDataFrame(list(self._edits.values()), CELLS)
            gone = F.broadcast(fresh.select("sheet", "r", "c"))  # what was edited by hand
            self.cells = stored(self.cells.join(gone, ["sheet", "r", "c"], "left_anti").select(self.cells.columns).unionByName(fresh))
            edited = fresh.select("book", F.lower("sheet").alias("sheet"), "r", "c")
            self._edits = {}
        elif self.values is not None:
            return self
        self.values = stored(recalculate(self.cells, edited if self.values is not None else None, self.values))
        return self

    def _found(self, sheet: str, ref: str) -> tuple[tuple[str, int, int], Row | None]:
        if self.values is None or self._edits:
            self.recalc()
        name, r, c = self._place(sheet, ref)
        return (name, r, c), self.values.filter((F.col("sheet") == name.lower()) & (F.col("r") == r) & (F.col("c") == c)).first()

    def value(self, sheet: str, ref: str):
        """A number, text, logical, error text, or None for a blank cell."""
        return _plain(self._found(sheet, ref)[1])

    def cell(self, sheet: str, ref: str) -> dict:
        (name, r, c), row = self._found(sheet, ref)
        own = self.cells.filter((F.col("sheet") == name) & (F.col("r") == r) & (F.col("c") == c)).first()
        return {"sheet": name, "ref": a1(r, c), "value": _plain(row), "formula": own.formula if own else None, "stored": _plain(own), "spilled_from": a1(row.owner_r, row.owner_c) if row is not None and row.owner_r is not None and not row.formula else None}

    def spill_region(self, sheet: str, ref: str) -> str | None:
        """The area that the array of a cell fills, or None."""
        (name, r, c), _ = self._found(sheet, ref)
        got = self.values.filter((F.col("sheet") == name.lower()) & (F.col("owner_r") == r) & (F.col("owner_c") == c)).agg(F.max("r"), F.max("c")).first()
        return None if got[0] is None else f"{a1(r, c)}:{a1(got[0], got[1])}"

    def diagnostics(self) -> DataFrame:
        """(sheet, r, c, formula, problem): formulas that the engine declines, and why."""
        if self.values is None or self._edits:
            self.recalc()
        return diagnostics(self.cells, self.values)


def diagnostics(cells: DataFrame, values: DataFrame) -> DataFrame:
    """(book, sheet, r, c, formula, problem) of formulas without a value of their own: parse, unsupported, blocked,
    resource."""
    own = cells.filter("kind in ('normal', 'shared', 'array', 'table')").select("book", "sheet", F.lower("sheet").alias("low"), "r", "c", "formula", "problem")
    refused = values.filter(F.col("formula") & F.col("err").isin(*SENTINELS)).select("book", F.col("sheet").alias("low"), "r", "c", "err")
    why = F.coalesce("problem", F.when(F.col("err") == "#BLOCKED!", "blocked").when(F.col("err") == "#RESOURCE!", "resource").otherwise("unsupported"))
    return own.join(refused, ["book", "low", "r", "c"]).select("book", "sheet", "r", "c", "formula", why.alias("problem"))


def _plain(row):
    if row is None:
        return None
    return next((row[k] for k in ("err", "n", "s", "b") if row[k] is not None), None)
