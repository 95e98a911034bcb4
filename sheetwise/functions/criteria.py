"""The criteria language of the *IF functions: `>5`, `<>x`, `a*c`, text, dates and amounts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Val, parse_number, to_number

_NUMBER = re.compile(r"^\s*[+-]?\$?(\d{1,3}(,\d{3})+|\d+)?(\.\d*)?([eE][+-]?\d+)?%?\s*$")


def _as_number(text: str) -> float | None:
    if not _NUMBER.match(text) or not re.search(r"\d", text):
        return None
    bare = text.strip().replace("$", "").replace(",", "")
    return float(bare[:-1]) / 100 if bare.endswith("%") else float(bare)


def _as_serial(text: str) -> float | None:
    import datetime as dt

    for form in ("%m/%d/%Y", "%Y-%m-%d"):
        try:
            days = (dt.datetime.strptime(text.strip(), form).date() - dt.date(1899, 12, 30)).days
            return float(days if days > 60 else days - 1)
        except ValueError:
            pass
    clock = re.fullmatch(r"\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*", text)
    return (int(clock[1]) * 3600 + int(clock[2]) * 60 + int(clock[3] or 0)) / 86400 if clock else None


def wildcard(pattern: str) -> str:
    """`*`, `?` and `~` as an anchored regular expression without case."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "~" and at + 1 < len(pattern) and pattern[at + 1] in "*?~":
            at += 1
            out += re.escape(pattern[at])
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        at += 1
    return f"(?is)^{out}$"


def matches(cell: Val, criterion) -> Column:
    """Does a cell meet a criterion (a Python value; a Val for one that differs by row means equality). Error cells and
    blank ones meet none, but for "" and "=", which blank cells meet, and "<>"."""
    no = F.lit(False)
    full = ~cell.is_blank()
    ok = full if cell.err is None else full & cell.err.isNull()
    if isinstance(criterion, Val):
        hits = [no]
        if cell.n is not None and criterion.lanes != "s":
            hits.append(F.coalesce(cell.n == to_number(criterion)[0], no))
        if cell.s is not None and criterion.s is not None:
            hits.append(F.coalesce(F.lower(cell.s) == F.lower(criterion.s), no))
        return ok & _any(hits)
    if criterion is None:
        criterion = 0
    if isinstance(criterion, bool):
        return ok & F.coalesce(cell.b == F.lit(criterion), no) if cell.b is not None else no
    if isinstance(criterion, (int, float)):
        return ok & _equal(cell, float(criterion))
    op, operand = re.fullmatch(r"(?s)(<=|>=|<>|=|<|>)?(.*)", criterion).groups()
    if operand == "":
        blank = cell.is_blank()
        if op in (None,):
            return blank if cell.s is None else blank | F.coalesce(cell.s == "", no)
        return blank if op == "=" else ~blank if op == "<>" else no
    x = _as_number(operand)
    if x is None:
        x = _as_serial(operand)
    if op in ("<", "<=", ">", ">="):
        compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
        if x is not None:
            return ok & F.coalesce(compare(cell.n, F.lit(x)), no) if cell.n is not None else no
        return ok & F.coalesce(compare(F.lower(cell.s), F.lit(operand.lower())), no) if cell.s is not None else no
    if x is not None:
        same = _equal(cell, x)
    elif operand.upper() in ("TRUE", "FALSE"):
        same = F.coalesce(cell.b == F.lit(operand.upper() == "TRUE"), no) if cell.b is not None else no
    elif cell.s is None:
        same = no
    elif re.search(r"[*?~]", operand):
        same = F.coalesce(cell.s.rlike(wildcard(operand)), no)
    else:
        same = F.coalesce(F.lower(cell.s) == F.lit(operand.lower()), no)
    if op == "<>":
        return ~same if cell.err is None else cell.err.isNull() & ~same
    return ok & same


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _equal(cell: Val, x: float) -> Column:
    """By value: a number, or a text that stands for it."""
    hits = [F.lit(False)]
    if cell.n is not None:
        hits.append(F.coalesce(cell.n == F.lit(x), F.lit(False)))
    if cell.s is not None:
        digits = cell.s.rlike(r"^\s*[-+$(]?[\d.,$]+%?\)?\s*$")
        hits.append(F.coalesce(F.when(digits, parse_number(cell.s) == F.lit(x)), F.lit(False)))
    return _any(hits)
