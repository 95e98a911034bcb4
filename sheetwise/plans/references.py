"""Cell references: A1 texts, trees with references relative to their cell, and what a tree needs.

A formula's references become nodes ("cell", slot) and ("area", slot); the slots list them as Need, relative where the
formula says so. Formulas that were filled down or across so have one and the same tree, whatever their cells: their
`key` is equal, and they are one column expression.
"""

from __future__ import annotations

import json
import re
from dataclasses import astuple, dataclass

from .parser import FormulaError, parse

# The size of a sheet.
ROWS, COLUMNS = 1_048_576, 16_384
_CELL = re.compile(r"^(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d{0,6})$")
_COLUMN = re.compile(r"^(\$?)([A-Za-z]{1,3})$")
_ROW = re.compile(r"^(\$?)([1-9]\d{0,6})$")
_R1C1 = re.compile(r"^R(?:(\d+)|\[(-?\d+)\])?C(?:(\d+)|\[(-?\d+)\])?$", re.I)


def column_number(letters: str) -> int:
    """From 0."""
    n = 0
    for x in letters.upper():
        n = n * 26 + ord(x) - 64
    return n - 1


def column_letters(c: int) -> str:
    out = ""
    c += 1
    while c:
        c, rest = divmod(c - 1, 26)
        out = chr(65 + rest) + out
    return out


def a1(r: int, c: int) -> str:
    return f"{column_letters(c)}{r + 1}"


def parse_a1(text: str) -> tuple[int, int] | None:
    """Row and column from 0, or None."""
    m = _CELL.match(text)
    if not m:
        return None
    r, c = int(m[4]) - 1, column_number(m[2])
    return (r, c) if r < ROWS and c < COLUMNS else None


def parse_area(text: str) -> tuple[int, int, int, int] | None:
    """First row and column, last row and column of "B2" or "B2:C4", or None."""
    ends = [parse_a1(x) for x in text.split(":")]
    if len(ends) > 2 or None in ends:
        return None
    (a, b), (c, d) = ends[0], ends[-1]
    return min(a, c), min(b, d), max(a, c), max(b, d)


@dataclass(frozen=True)
class Need:
    """A reference: a sheet ("" for the formula's own), the four edges, and of each whether it is relative. spill: the
    region that the cell's array fills."""

    sheet: str
    r0: int
    c0: int
    r1: int
    c1: int
    rel_r0: bool = False
    rel_c0: bool = False
    rel_r1: bool = False
    rel_c1: bool = False
    spill: bool = False

    def at(self, r: int, c: int) -> tuple[int, int, int, int]:
        """The edges as seen from a cell. What leaves the sheet comes in again on the other side."""
        e = ((self.r0 + r) % ROWS if self.rel_r0 else self.r0, (self.c0 + c) % COLUMNS if self.rel_c0 else self.c0, (self.r1 + r) % ROWS if self.rel_r1 else self.r1, (self.c1 + c) % COLUMNS if self.rel_c1 else self.c1)
        return min(e[0], e[2]), min(e[1], e[3]), max(e[0], e[2]), max(e[1], e[3])

    @property
    def fixed_shape(self) -> tuple[int, int] | None:
        """Rows and columns, if they are the same from everywhere."""
        if self.spill or self.rel_r0 != self.rel_r1 or self.rel_c0 != self.rel_c1:
            return None
        return abs(self.r1 - self.r0) + 1, abs(self.c1 - self.c0) + 1


@dataclass
class Program:
    """A formula as a tree with slots."""

    tree: tuple
    needs: list[Need]

    @property
    def key(self) -> str:
        return json.dumps([self.tree, [astuple(n) for n in self.needs]])

    @staticmethod
    def of_key(key: str) -> Program:
        tree, needs = json.loads(key)
        return Program(_tuples(tree), [Need(*n) for n in needs])

    def calls(self) -> set[str]:
        found: set[str] = set()

        def walk(x):
            if isinstance(x, tuple):
                if x and x[0] == "call":
                    found.add(x[1])
                for y in x:
                    walk(y)
            elif isinstance(x, list):
                for y in x:
                    walk(y)

        walk(self.tree)
        return found


def _tuples(x):
    """JSON's lists back into nodes: a list that begins with a node's kind is one."""
    if not isinstance(x, list):
        return x
    if x and isinstance(x[0], str) and x[0] in _KINDS:
        return tuple(_tuples(y) for y in x)
    return [_tuples(y) for y in x]


_KINDS = frozenset("num str bool err omit name range array call bin un post cell area apply".split())


class _Reader:
    def __init__(self, r: int, c: int, names: dict[str, str], sheet: str):
        self.r, self.c, self.names, self.sheet = r, c, names, sheet
        self.needs: list[Need] = []

    def slot(self, need: Need, kind: str) -> tuple:
        if need not in self.needs:
            self.needs.append(need)
        return (kind, self.needs.index(need))

    def end(self, node) -> tuple | None:
        """(sheet, row or None, relative, column or None, relative) of one end of a reference."""
        if node[0] == "num":
            text, sheet = f"{node[1]:g}", None
        elif node[0] == "name":
            text, sheet = node[2], node[1]
        else:
            return None
        if m := _CELL.match(text):
            r, c = int(m[4]) - 1, column_number(m[2])
            if r >= ROWS or c >= COLUMNS:
                return None
            return sheet, r if m[3] else r - self.r, not m[3], c if m[1] else c - self.c, not m[1]
        return None

    def line(self, node, axis: int) -> tuple | None:
        """(sheet, number, relative) of one end of whole columns (axis 1) or rows (axis 0)."""
        if node[0] == "num":
            node = ("name", None, f"{node[1]:g}")
        if node[0] != "name":
            return None
        m = (_COLUMN if axis else _ROW).match(node[2])
        if not m:
            return None
        n = column_number(m[2]) if axis else int(m[2]) - 1
        if n >= (COLUMNS if axis else ROWS):
            return None
        return node[1], n if m[1] else n - (self.c if axis else self.r), not m[1]

    def area(self, a, b) -> tuple | None:
        x, y = self.end(a), self.end(b)
        if x and y:
            return self.slot(Need(self.own(x[0]), x[1], x[3], y[1], y[3], x[2], x[4], y[2], y[4]), "area")
        for axis in (1, 0):
            x, y = self.line(a, axis), self.line(b, axis)
            if x and y:
                if axis:
                    return self.slot(Need(self.own(x[0]), 0, x[1], ROWS - 1, y[1], False, x[2], False, y[2]), "area")
                return self.slot(Need(self.own(x[0]), x[1], 0, y[1], COLUMNS - 1, x[2], False, y[2], False), "area")
        return None

    def own(self, sheet: str | None) -> str:
        return "" if sheet is None else sheet.lower()

    def walk(self, node, bound: frozenset[str]):
        kind = node[0]
        if kind == "name":
            _, sheet, name = node
            if sheet is None and name.upper() in bound:
                return node
            if x := self.end(node):
                return self.slot(Need(self.own(x[0]), x[1], x[3], x[1], x[3], x[2], x[4], x[2], x[4]), "cell")
            known = self.names.get(f"{(sheet or self.sheet).lower()}!{name.lower()}", self.names.get(name.lower()))
            if known is not None:
                # a name's relative references count from the cell that uses it, as if it stood in A1
                inner = _Reader(0, 0, {k: v for k, v in self.names.items() if k.rpartition("!")[2] != name.lower()}, self.sheet)
                inner.needs = self.needs
                return inner.walk(parse(known), frozenset())
            return node
        if kind == "range":
            got = self.area(node[1], node[2])
            return got if got else ("err", "#REF!")
        if kind == "post" and node[1] == "#":
            x = self.end(node[2])
            if x:
                return self.slot(Need(self.own(x[0]), x[1], x[3], x[1], x[3], x[2], x[4], x[2], x[4], True), "area")
            return ("err", "#REF!")
        if kind == "call":
            return self.call(node, bound)
        if kind == "apply":
            return ("apply", self.walk(node[1], bound), [self.walk(a, bound) for a in node[2]])
        if kind == "array":
            return ("array", [[self.walk(x, bound) for x in row] for row in node[1]])
        if kind in ("un", "post"):
            return (kind, node[1], self.walk(node[2], bound))
        if kind == "bin":
            return (kind, node[1], self.walk(node[2], bound), self.walk(node[3], bound))
        return node

    def call(self, node, bound: frozenset[str]):
        _, name, args = node
        if name == "ANCHORARRAY" and len(args) == 1:
            return self.walk(("post", "#", args[0]), bound)
        if name == "LET" and len(args) % 2:
            out = []
            for k, v in zip(args[:-1:2], args[1::2], strict=True):
                if k[0] != "name":
                    return ("err", "#VALUE!")
                out += [k, self.walk(v, bound)]
                bound = bound | {k[2].upper()}
            return ("call", name, [*out, self.walk(args[-1], bound)])
        if name == "LAMBDA" and args:
            if any(a[0] != "name" for a in args[:-1]):
                return ("err", "#VALUE!")
            return ("call", name, [*args[:-1], self.walk(args[-1], bound | {a[2].upper() for a in args[:-1]})])
        if name == "INDIRECT" and args:
            return self.indirect(args, bound)
        if name == "OFFSET" and 3 <= len(args) <= 5:
            return self.offset([self.walk(a, bound) for a in args])
        known = self.names.get(name.lower())
        if known is not None and name.lower() not in bound:
            fn = _Reader(0, 0, {k: v for k, v in self.names.items() if k != name.lower()}, self.sheet)
            fn.needs = self.needs
            return ("apply", fn.walk(parse(known), frozenset()), [self.walk(a, bound) for a in args])
        return ("call", name, [self.walk(a, bound) for a in args])

    def indirect(self, args, bound):
        """A constant text is a reference at once; another workbook's is #REF!; a text that depends on data is refused."""
        if args[0][0] != "str":
            return ("err", "#UNSUPPORTED!")
        text = args[0][1]
        if "[" in text.split("!")[0] and "!" in text:
            return ("err", "#REF!")
        sheet, _, place = text.rpartition("!")
        sheet = sheet.strip("'").replace("''", "'") or None
        if len(args) > 1 and args[1][0] in ("bool", "num") and not args[1][1]:
            m = _R1C1.match(place)
            if not m:
                return ("err", "#REF!")
            r = int(m[1]) - 1 if m[1] else self.r + int(m[2] or 0)
            c = int(m[3]) - 1 if m[3] else self.c + int(m[4] or 0)
            if not (0 <= r < ROWS and 0 <= c < COLUMNS):
                return ("err", "#REF!")
            relative = not m[1], not m[3]
            rr, cc = r - self.r if relative[0] else r, c - self.c if relative[1] else c
            return self.slot(Need(self.own(sheet), rr, cc, rr, cc, relative[0], relative[1], relative[0], relative[1]), "cell")
        got = parse_area(place.replace("$", ""))
        if got is None:
            known = self.names.get(text.lower())
            return self.walk(parse(known), bound) if known else ("err", "#REF!")
        r0, c0, r1, c1 = got
        return self.slot(Need(self.own(sheet), r0, c0, r1, c1), "cell" if ":" not in place else "area")

    def offset(self, args):
        """A reference moved and resized by constants; amounts that depend on data are refused."""
        if args[0][0] not in ("cell", "area") or self.needs[args[0][1]].spill:
            return ("err", "#UNSUPPORTED!") if args[0][0] == "call" else ("err", "#VALUE!") if args[0][0] in ("num", "str", "bool") else ("err", "#UNSUPPORTED!")
        amounts = []
        for a in args[1:]:
            sign = 1
            while a[0] == "un" and a[1] in "+-":
                sign, a = -sign if a[1] == "-" else sign, a[2]
            if a[0] == "omit":
                amounts.append(None)
            elif a[0] in ("num", "bool"):
                amounts.append(int(sign * float(a[1])))
            else:
                return ("err", "#UNSUPPORTED!")
        n = self.needs[args[0][1]]
        shape = n.fixed_shape
        if shape is None:
            return ("err", "#UNSUPPORTED!")
        dr, dc = (x or 0 for x in amounts[:2])
        h, w = (amounts[i] if len(amounts) > i and amounts[i] is not None else shape[i - 2] for i in (2, 3))
        if not h or not w:
            return ("err", "#REF!")
        r0, c0 = min(n.r0, n.r1) + dr, min(n.c0, n.c1) + dc
        r1, c1 = r0 + h - (1 if h > 0 else -1), c0 + w - (1 if w > 0 else -1)
        seen = [(r + self.r if n.rel_r0 else r, c + self.c if n.rel_c0 else c) for r, c in ((r0, c0), (r1, c1))]
        if any(not (0 <= r < ROWS and 0 <= c < COLUMNS) for r, c in seen):
            return ("err", "#REF!")
        moved = Need(n.sheet, min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1), n.rel_r0, n.rel_c0, n.rel_r1, n.rel_c1)
        return self.slot(moved, "cell" if (abs(h), abs(w)) == (1, 1) else "area")


def compile_text(text: str, r: int = 0, c: int = 0, names: dict[str, str] | None = None, sheet: str = "") -> Program:
    """The program of a formula that stands in row r, column c (from 0). names: defined names in lower case, those of
    one sheet as "sheet!name". Raises FormulaError."""
    if re.search(r"\[\d+\]", re.sub(r'"[^"]*"', "", text)):
        return Program(("err", "#UNSUPPORTED!"), [])  # another workbook
    reader = _Reader(r, c, names or {}, sheet)
    tree = reader.walk(parse(text), frozenset())
    used: list[int] = []

    def seen(x):
        if isinstance(x, tuple) and x and x[0] in ("cell", "area"):
            used.append(x[1])
        elif isinstance(x, (tuple, list)):
            for y in x:
                seen(y)

    seen(tree)
    place = {old: new for new, old in enumerate(dict.fromkeys(used))}

    def numbered(x):
        if isinstance(x, tuple) and x and x[0] in ("cell", "area"):
            return (x[0], place[x[1]])
        if isinstance(x, (tuple, list)):
            return type(x)(numbered(y) for y in x)
        return x

    return Program(numbered(tree), [reader.needs[i] for i in place])


__all__ = ["COLUMNS", "ROWS", "FormulaError", "Need", "Program", "a1", "column_letters", "column_number", "compile_text", "parse_a1", "parse_area"]
