"""Workbooks in the OOXML format as rows of cells.

Every package counts as hostile: sizes, parts, compression and nesting are bounded by what is really unpacked, not by
what the package says; a document type is refused, so no entity can expand; what is malformed raises LoadError with its
kind and part. Nothing in a package is run. Many packages are read by Spark, one in a task at a time, as rows of
CELLS; a package that can't be read gives one row with the error, so that the others go on.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession

from ..functions.values import GENUINE, SENTINELS
from ..plans.references import FormulaError, Program, compile_text, parse_a1


@dataclass(frozen=True)
class Caps:
    """What a package may hold at most."""

    total: int = 512 << 20
    part: int = 256 << 20
    parts: int = 10_000
    ratio: int = 200
    depth: int = 256


class LoadError(ValueError):
    """A package that can't be read. kind: zip, xml, structure, doctype, io, or the cap that it breaks (cap_parts,
    cap_part, cap_total, cap_ratio, cap_depth)."""

    def __init__(self, kind: str, part: str | None, message: str):
        super().__init__(f"{kind}{f' in {part}' if part else ''}: {message}")
        self.kind, self.part = kind, part


@dataclass
class Cell:
    """One lane holds the stored value (none: blank or no value). array: the area of an array formula."""

    n: float | None = None
    s: str | None = None
    b: bool | None = None
    err: str | None = None
    formula: str | None = None
    kind: str = "value"  # or normal, shared, array, table
    key: str | None = None  # of the formula's Program
    problem: str | None = None  # why it has none
    format: int = 0


@dataclass
class Sheet:
    name: str
    cells: dict[tuple[int, int], Cell] = field(default_factory=dict)
    hidden: set[int] = field(default_factory=set)


@dataclass
class Book:
    sheets: list[Sheet]
    names: dict[str, str]
    date1904: bool = False
    iterate: bool = False
    calc_mode: str = "auto"
    has_macros: bool = False
    external: bool = False


class _Package:
    def __init__(self, data: bytes, caps: Caps):
        self.caps, self.unpacked = caps, 0
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            entries = self.zip.infolist()
        except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError, EOFError) as x:
            raise LoadError("zip", None, str(x)) from None
        if len(entries) > caps.parts:
            raise LoadError("cap_parts", None, f"limit {caps.parts}, got {len(entries)}")
        self.parts = {e.filename.lstrip("/"): e for e in entries}

    def read(self, name: str) -> bytes:
        entry = self.parts.get(name)
        if entry is None:
            raise LoadError("structure", name, "the part is missing")
        if entry.flag_bits & 1:
            raise LoadError("zip", name, "the part is encrypted")
        if entry.file_size > self.caps.part:
            raise LoadError("cap_part", name, f"limit {self.caps.part}, got {entry.file_size}")
        if entry.file_size > self.caps.ratio * max(1, entry.compress_size):
            raise LoadError("cap_ratio", name, f"limit {self.caps.ratio}, got {entry.file_size // max(1, entry.compress_size)}")
        out, size = [], 0
        try:
            with self.zip.open(entry) as f:
                while chunk := f.read(1 << 20):  # what the package says of its sizes isn't trusted
                    size += len(chunk)
                    self.unpacked += len(chunk)
                    if size > self.caps.part:
                        raise LoadError("cap_part", name, f"limit {self.caps.part}, got {size} or more")
                    if self.unpacked > self.caps.total:
                        raise LoadError("cap_total", name, f"limit {self.caps.total}, got {self.unpacked} or more")
                    out.append(chunk)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, OSError, EOFError, RuntimeError) as x:
            raise LoadError("zip", name, str(x)) from None
        return b"".join(out)


def _scan(part: str, data: bytes, caps: Caps, start, end=None, text=None) -> None:
    """Events of one part: start(name, attributes), end(name), text(chars), names without prefix."""
    p = expat.ParserCreate()
    depth = 0

    def local(name: str) -> str:
        return name.rpartition(":")[2]

    def on_start(name, attrs):
        nonlocal depth
        depth += 1
        if depth > caps.depth:
            raise LoadError("cap_depth", part, f"limit {caps.depth}, got {depth}")
        start(local(name), {local(k): v for k, v in attrs.items()})

    def on_end(name):
        nonlocal depth
        depth -= 1
        if end:
            end(local(name))

    def on_doctype(*_):
        raise LoadError("doctype", part, f"a document type at byte {p.CurrentByteIndex}")

    p.StartElementHandler, p.EndElementHandler, p.StartDoctypeDeclHandler = on_start, on_end, on_doctype
    p.buffer_text = True
    if text:
        p.CharacterDataHandler = text
    try:
        p.Parse(data, True)
    except expat.ExpatError as x:
        raise LoadError("xml", part, str(x)) from None
    except ValueError as x:
        if isinstance(x, LoadError):
            raise
        raise LoadError("xml", part, str(x)) from None


def _relations(pkg: _Package, part: str) -> dict[str, tuple[str, str]]:
    """id -> (kind, target part) of a part's relationships."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels".lstrip("/")
    out: dict[str, tuple[str, str]] = {}
    if path not in pkg.parts:
        return out

    def start(tag, a):
        if tag == "Relationship" and "Id" in a:
            target = a.get("Target", "")
            if a.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[a["Id"]] = (a.get("Type", "").rpartition("/")[2], target)

    _scan(path, pkg.read(path), pkg.caps, start)
    return out


def _strings(pkg: _Package, part: str) -> list[str]:
    """The shared strings: of rich text its runs, without phonetic ones."""
    out: list[str] = []
    state = {"own": [], "text": False, "phonetic": 0}

    def start(tag, _):
        if tag == "si":
            state["own"] = []
        elif tag == "rPh":
            state["phonetic"] += 1
        state["text"] = tag == "t" and not state["phonetic"]

    def end(tag):
        if tag == "si":
            out.append(_unescaped("".join(state["own"])))
        elif tag == "rPh":
            state["phonetic"] -= 1
        state["text"] = False

    _scan(part, pkg.read(part), pkg.caps, start, end, lambda x: state["own"].append(x) if state["text"] else None)
    return out


def _unescaped(s: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), s) if "_x" in s else s


def _true(x: str | None) -> bool:
    return x in ("1", "true")


class _SheetReader:
    """One worksheet part."""

    def __init__(self, pkg: _Package, part: str, sheet: Sheet, strings: list[str]):
        self.pkg, self.part, self.sheet, self.strings = pkg, part, sheet, strings
        self.row = self.col = -1
        self.inside: list[str] = []
        self.cell: dict | None = None
        self.raw: list[tuple[tuple[int, int], dict]] = []
        self.chars: list[str] | None = None
        self.phonetic = 0

    def wrong(self, message: str) -> LoadError:
        return LoadError("structure", self.part, message)

    def start(self, tag, a):
        self.inside.append(tag)
        if tag == "row" and "sheetData" in self.inside:
            at = a.get("r")
            if at is not None and not re.fullmatch(r"[1-9]\d{0,6}", at):
                raise self.wrong(f"row {at!r}")
            self.row = int(at) - 1 if at is not None else self.row + 1
            self.col = -1
            if _true(a.get("hidden")):
                self.sheet.hidden.add(self.row)
        elif tag == "c" and "sheetData" in self.inside:
            if "r" in a:
                place = parse_a1(a["r"])
                if place is None or "$" in a["r"]:
                    raise self.wrong(f"cell reference {a['r']!r}")
            else:
                place = (self.row, self.col + 1)
            self.row, self.col = place
            if place in self.sheet.cells:
                raise self.wrong(f"cell {a.get('r', place)} twice")
            style = a.get("s", "0")
            if not style.isdigit():
                raise self.wrong(f"style {style!r}")
            self.sheet.cells[place] = Cell(format=int(style))
            self.cell = {"t": a.get("t", "n"), "v": None, "f": None, "is": [], "fa": {}}
            self.raw.append((place, self.cell))
        elif self.cell is not None and tag in ("v", "f"):
            self.chars = []
            if tag == "f":
                self.cell["fa"], self.cell["f"] = a, ""
        elif self.cell is not None and tag == "rPh":
            self.phonetic += 1
        elif self.cell is not None and tag == "t" and "is" in self.inside and not self.phonetic:
            self.chars = []

    def text(self, x):
        if self.chars is not None:
            self.chars.append(x)

    def end(self, tag):
        self.inside.pop()
        if self.cell is None:
            return
        if tag in ("v", "f") and self.chars is not None:
            self.cell[tag], self.chars = "".join(self.chars), None
        elif tag == "t" and self.chars is not None:
            self.cell["is"].append("".join(self.chars))
            self.chars = None
        elif tag == "rPh":
            self.phonetic -= 1
        elif tag == "c":
            self.cell = None

    def value(self, cell: Cell, raw: dict) -> None:
        t, v = raw["t"], raw["v"]
        if t == "inlineStr":
            cell.s = _unescaped("".join(raw["is"]))
        elif v is None:
            pass
        elif t == "s":
            if not v.strip().isdigit() or int(v) >= len(self.strings):
                raise self.wrong(f"shared string {v!r}")
            cell.s = self.strings[int(v)]
        elif t == "str":
            cell.s = _unescaped(v)
        elif t == "b":
            if v.strip() not in ("0", "1", "true", "false"):
                raise self.wrong(f"logical {v!r}")
            cell.b = _true(v.strip())
        elif t == "e":
            cell.err = v if v in GENUINE + SENTINELS else "#UNSUPPORTED!"
        elif t == "d":
            cell.err = "#UNSUPPORTED!"  # a date as text has no serial of its own
        elif t == "n":
            try:
                x = float(v)
            except ValueError:
                raise self.wrong(f"number {v!r}") from None
            if x != x or abs(x) == float("inf"):
                cell.err = "#NUM!"
            else:
                cell.n = x
        else:
            raise self.wrong(f"cell type {t!r}")


def _workbook(pkg: _Package) -> Book:
    target = next((t for kind, t in _relations(pkg, "").values() if kind == "officeDocument"), "xl/workbook.xml")
    found: list[tuple[str, str]] = []
    book = Book([], {})
    names: list[tuple[str, int | None, list[str]]] = []
    state = {"name": False}

    def start(tag, a):
        if tag == "sheet":
            if "name" not in a or "id" not in a:
                raise LoadError("structure", target, "a sheet without name or relationship")
            found.append((a["name"], a["id"]))
        elif tag == "workbookPr":
            book.date1904 = _true(a.get("date1904"))
        elif tag == "calcPr":
            book.iterate, book.calc_mode = _true(a.get("iterate")), a.get("calcMode", "auto")
        elif tag == "definedName" and "name" in a:
            local = a.get("localSheetId")
            if local is not None and not local.isdigit():
                raise LoadError("structure", target, f"sheet {local!r} of a name")
            names.append((a["name"], None if local is None else int(local), []))
            state["name"] = True
        elif tag == "externalReference":
            book.external = True

    def text(x):
        if state["name"]:
            names[-1][2].append(x)

    def end(tag):
        if tag == "definedName":
            state["name"] = False

    _scan(target, pkg.read(target), pkg.caps, start, end, text)
    relations = _relations(pkg, target)
    strings_part = next((t for kind, t in relations.values() if kind == "sharedStrings"), None)
    strings = _strings(pkg, strings_part) if strings_part and strings_part in pkg.parts else []
    for name, local, value in names:
        if local is not None and local >= len(found):
            raise LoadError("structure", target, f"name {name!r} of a sheet that isn't there")
        key = name.lower() if local is None else f"{found[local][0].lower()}!{name.lower()}"
        book.names[key] = "".join(value)
    book.has_macros = any(p.lower().endswith("vbaproject.bin") for p in pkg.parts)
    for name, rid in found:
        if rid not in relations:
            raise LoadError("structure", target, f"no relationship {rid!r}")
        kind, part = relations[rid]
        if kind != "worksheet":
            continue  # a chart has no cells
        sheet = Sheet(name)
        reader = _SheetReader(pkg, part, sheet, strings)
        _scan(part, pkg.read(part), pkg.caps, reader.start, reader.end, reader.text)
        shared: dict[str, Program | str] = {}
        for place, raw in reader.raw:
            _fill(reader, book, sheet, place, raw, shared)
        book.sheets.append(sheet)
    return book


def _fill(reader: _SheetReader, book: Book, sheet: Sheet, place: tuple[int, int], raw: dict, shared: dict) -> None:
    cell = sheet.cells[place]
    reader.value(cell, raw)
    if raw["f"] is None:
        return
    a = raw["fa"]
    t = a.get("t", "normal")
    if t not in ("normal", "shared", "array", "dataTable"):
        raise reader.wrong(f"formula type {t!r}")
    cell.kind = "table" if t == "dataTable" else t
    cell.formula = raw["f"]
    if t == "dataTable":
        cell.problem = "unsupported"
        return
    try:
        if t == "shared" and not raw["f"]:
            found = shared.get(a.get("si", ""))
            if found is None:
                raise FormulaError("a shared formula without its first cell")
            program, cell.formula = found
        else:
            program = compile_text(raw["f"], *place, book.names, sheet.name)
            if t == "shared":
                shared[a.get("si", "")] = (program, raw["f"])
        cell.key = program.key
    except (FormulaError, RecursionError):
        cell.problem = "parse"


def read_book(data: bytes, caps: Caps | None = None) -> Book:
    """The workbook in a package. Raises LoadError."""
    return _workbook(_Package(data, caps or Caps()))


#: kind: value, normal, shared, array, table (of formulas), or "book" for a row about the book as a whole, whose `formula`
#: says what it has, and `error` for one that can't be read.
CELLS = "book string, sheet string, sheet_no int, r int, c int, n double, s string, b boolean, err string, kind string, formula string, key string, problem string, hidden boolean"


def cell_rows(name: str, book: Book) -> Iterator[tuple]:
    flags = [f for f, on in (("date1904", book.date1904), ("iterate", book.iterate), ("macros", book.has_macros), ("external", book.external), ("manual", book.calc_mode == "manual")) if on]
    yield (name, None, None, None, None, None, None, None, None, "book", ",".join(flags), None, None, False)
    for i, sheet in enumerate(book.sheets):
        for (r, c), x in sorted(sheet.cells.items()):
            yield (name, sheet.name, i, r, c, x.n, x.s, x.b, x.err, x.kind, x.formula, x.key, x.problem, r in sheet.hidden)


def read_cells(packages: DataFrame, caps: Caps | None = None, name: str = "path", content: str = "content") -> DataFrame:
    """CELLS of a table of packages, such as spark.read.format("binaryFile") gives. A package that can't be read has one
    row: kind "error", the error's kind in `problem`, its text in `formula`."""
    import pandas as pd

    names = [f.split()[0] for f in CELLS.split(", ")]
    kinds = {"n": "float64", "sheet_no": "Int32", "r": "Int32", "c": "Int32", "b": "boolean", "hidden": "boolean"}

    def frame(rows):
        out = pd.DataFrame(rows, columns=names)
        return out.astype(kinds)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch[name], batch[content], strict=True):
                try:
                    rows = cell_rows(path, read_book(bytes(data if data is not None else b""), caps))
                except LoadError as x:
                    rows = iter([(path, None, None, None, None, None, None, None, None, "error", str(x), None, x.kind, False)])
                held = []
                for row in rows:
                    held.append(row)
                    if len(held) == 20_000:
                        yield frame(held)
                        held = []
                if held:
                    yield frame(held)

    return packages.select(name, content).mapInPandas(run, CELLS)


def read_folder(spark: SparkSession, path: str, caps: Caps | None = None) -> DataFrame:
    """CELLS of all packages in a folder that Spark can read."""
    return read_cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path), caps)
