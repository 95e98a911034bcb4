"""Values as Spark columns.

A value has up to three lanes - number, text, logical - of which one at most holds something in a row, and an error
lane. All lanes empty is a blank cell. Lanes that can't occur are absent, so a plain numeric column costs what it
costs in Spark. Errors are data: they travel leftmost first and are never raised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The genuine errors, and the engine's own refusals, which IFERROR and its kin must not catch.
GENUINE = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA", "#SPILL!", "#CALC!")
SENTINELS = ("#UNSUPPORTED!", "#BLOCKED!", "#RESOURCE!")
LARGEST = 9.99999999999999e307


class Unsupported(NotImplementedError):
    """A formula that the engine declines as a whole."""


@dataclass(frozen=True)
class Val:
    n: Column | None = None
    s: Column | None = None
    b: Column | None = None
    err: Column | None = None
    blank: bool = False  # may the value be blank

    @property
    def lanes(self) -> str:
        return "".join(k for k in "nsb" if getattr(self, k) is not None)

    def present(self, lane: str) -> Column:
        """Does this lane hold the value; to be asked of lanes that exist."""
        col = getattr(self, lane)
        return col.isNotNull()

    def is_blank(self) -> Column:
        if not self.blank:
            return F.lit(False)
        gone = F.lit(True)
        for col in (self.n, self.s, self.b, self.err):
            if col is not None:
                gone = gone & col.isNull()
        return gone


def first_error(*errs: Column | None) -> Column | None:
    some = [e for e in errs if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def guarded(col: Column, err: Column | None) -> Column:
    return col if err is None else F.when(err.isNull(), col)


def num(col: Column, err: Column | None = None, finite: bool = True) -> Val:
    """A number; one that isn't finite is #NUM!."""
    if finite:
        odd = F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit("#NUM!"))
        err = odd if err is None else F.coalesce(err, odd)
    return Val(n=guarded(col, err), err=err)


def text(col: Column, err: Column | None = None) -> Val:
    return Val(s=guarded(col, err), err=err)


def logical(col: Column, err: Column | None = None) -> Val:
    return Val(b=guarded(col, err), err=err)


def error(kind: str) -> Val:
    return Val(err=F.lit(kind))


def lit(x) -> Val:
    if x is None:
        return Val(blank=True)
    if isinstance(x, bool):
        return Val(b=F.lit(x))
    if isinstance(x, (int, float)):
        return Val(n=F.lit(float(x)))
    return error(x) if x in GENUINE + SENTINELS else Val(s=F.lit(x))


def of_column(col: Column, kind: str) -> Val:
    """A table's column. Dates become day serials; null is a blank cell."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return Val(n=col.cast("double"), blank=True)
    if kind == "boolean":
        return Val(b=col, blank=True)
    if kind == "date" or kind.startswith("timestamp"):
        days = F.datediff(col.cast("date"), F.lit("1899-12-30").cast("date")).cast("double")
        days = days - F.when(col.cast("date") < F.lit("1900-03-01").cast("date"), 1).otherwise(0)  # the calendar has a 29 February 1900
        if kind != "date":
            at = col.cast("timestamp_ntz")
            days = days + (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)) / 86400.0
        return Val(n=days, blank=True)
    if kind == "string":
        return Val(s=col, blank=True)
    raise Unsupported(f"a column of type {kind}")


def bind(fn: Callable[..., Column], *cols: Column) -> Column:
    """fn of values that are computed once, however often fn and its inner loops name them."""
    one = F.struct(*[c.alias(f"b{i}") for i, c in enumerate(cols)])
    return F.get(F.transform(F.array(one), lambda s: fn(*[s[f"b{i}"] for i in range(len(cols))])), F.lit(0))


# -- coercions -------------------------------------------------------------------------------------------------------

_NUMBER = r"^[+-]?(\d{1,3}(,\d{3})+|\d+)?(\.\d*)?([eE][+-]?\d+)?$"


def parse_date(s: Column, once: Callable[..., Column] = bind) -> Column:
    """A serial from date text in one of the pinned forms, else null."""
    return once(lambda at: of_column(at, "timestamp").n, once(_parse_date, s))


def _parse_date(s: Column) -> Column:
    tries = [F.try_to_timestamp(s, F.lit(p)) for p in ("M/d/yyyy", "yyyy-M-d", "d-MMM-yyyy", "MMM d, yyyy", "M/d/yyyy H:m", "yyyy-M-d H:m:s")]
    return F.when(s.rlike(r"^\d{1,4}[-/]|^\d{1,2}-[A-Za-z]{3}-|^[A-Za-z]{3} \d"), F.coalesce(*tries)).cast("timestamp_ntz")


def parse_number(s: Column) -> Column:
    return bind(_parse_number, s)


def _parse_number(s: Column) -> Column:
    """The number that a text stands for (grouping, $, %, parentheses, dates, times), else null."""
    t = F.trim(s)
    inside = F.regexp_extract(t, r"^\((.*)\)$", 1)
    negative = inside != ""
    body = F.when(negative, inside).otherwise(t)
    percent = body.endswith("%")
    body = F.when(percent, F.trim(F.regexp_replace(body, "%$", ""))).otherwise(body)
    body = F.regexp_replace(body, r"^([+-]?)\$", "$1")
    x = bind(lambda body: F.when(body.rlike(_NUMBER) & body.rlike(r"\d"), F.regexp_replace(body, ",", "").try_cast("double")), body)
    x = F.when(percent, x / 100).otherwise(x)
    x = F.when(negative, -x).otherwise(x)
    x = bind(lambda x: F.when(F.abs(x) <= LARGEST, x), x)
    clock = F.when(t.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), (F.get(F.split(t, ":"), F.lit(0)).try_cast("int") * 3600 + F.get(F.split(t, ":"), F.lit(1)).try_cast("int") * 60 + F.coalesce(F.get(F.split(t, ":"), F.lit(2)).try_cast("int"), F.lit(0))) / 86400.0)
    return F.coalesce(x, clock, parse_date(t))


def to_number(v: Val) -> tuple[Column, Column | None]:
    parts, err = [], v.err
    if v.n is not None:
        parts.append(v.n)
    if v.b is not None:
        parts.append(v.b.cast("double"))
    if v.s is not None:
        parsed = parse_number(v.s)
        parts.append(parsed)
        err = first_error(v.err, F.when(v.s.isNotNull() & parsed.isNull(), F.lit("#VALUE!")))
    if v.blank or not parts:
        parts.append(F.lit(0.0))
    return (F.coalesce(*parts) if len(parts) > 1 else parts[0]), err


def general(x: Column) -> Column:
    return bind(_general, x)


def _general(x: Column) -> Column:
    """General format: 15 significant digits, plain where all of them lie between 10^19 and 10^-18."""
    short = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.try_cast("bigint").cast("string"))
    return F.coalesce(short, _general_long(x))


def _general_long(x: Column) -> Column:
    sci = F.format_string("%.14e", F.abs(x))
    digits = F.regexp_replace(F.concat(F.substring(sci, 1, 1), F.substring(sci, 3, 14)), "0+$", "")
    e = F.substring(sci, 18, 5).try_cast("int")
    return bind(_general_of, x, digits, e)


def _general_of(x: Column, digits: Column, e: Column) -> Column:
    k = F.length(digits)
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, F.lit("0")))
    plain = F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)).when(k <= e + 1, whole).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, k)))
    science = F.concat(F.substring(digits, 1, 1), F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise(""), F.lit("E"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    body = F.when((e <= 19) & (e - k + 1 >= -18), plain).otherwise(science)
    return F.concat(F.when(x < 0, "-").otherwise(""), body)


def to_text(v: Val) -> tuple[Column, Column | None]:
    parts = []
    if v.s is not None:
        parts.append(v.s)
    if v.n is not None:
        parts.append(F.when(v.n.isNotNull(), general(v.n)))
    if v.b is not None:
        parts.append(F.when(v.b, F.lit("TRUE")).when(~v.b, F.lit("FALSE")))
    if v.blank or not parts:
        parts.append(F.lit(""))
    return F.coalesce(*parts), v.err


def to_bool(v: Val) -> tuple[Column, Column | None]:
    parts, err = [], v.err
    if v.b is not None:
        parts.append(v.b)
    if v.n is not None:
        parts.append(v.n != 0)
    if v.s is not None:
        word = F.upper(F.trim(v.s))
        got = F.when(word == "TRUE", True).when(word == "FALSE", False)
        parts.append(got)
        err = first_error(v.err, F.when(v.s.isNotNull() & got.isNull(), F.lit("#VALUE!")))
    parts.append(F.lit(False))
    return F.coalesce(*parts), err


def fuzzy(x: Column) -> Column:
    """A number as its 15 significant digits, for comparing."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x).otherwise(F.format_string("%.14e", x).try_cast("double"))


def compare(op: str, a: Val, b: Val, exact: bool = False) -> Val:
    """The comparison operators: 15 digits, texts without case, numbers before texts before logicals; a blank takes the
    other side's kind."""
    err = first_error(a.err, b.err)
    near = (lambda x: x) if exact else fuzzy

    def rank(v: Val, other: Val) -> tuple[Column, Column, Column, Column]:
        n = near(v.n) if v.n is not None else F.lit(None).cast("double")
        s = F.lower(v.s) if v.s is not None else F.lit(None).cast("string")
        l_ = v.b if v.b is not None else F.lit(None).cast("boolean")
        if v.blank:
            gone = v.is_blank()
            s = F.when(gone & other.present("s"), "").otherwise(s) if other.s is not None else s
            l_ = F.when(gone & other.present("b"), False).otherwise(l_) if other.b is not None else l_
            n = F.when(gone & s.isNull() & l_.isNull(), 0.0).otherwise(n)
        return F.when(n.isNotNull(), 0).when(s.isNotNull(), 1).otherwise(2), n, s, l_

    if a.lanes == b.lanes == "n" and not a.blank and not b.blank:
        x, y = near(a.n), near(b.n)
    else:
        x, y = (F.struct(*[c.alias(k) for c, k in zip(rank(v, o), "knsb", strict=True)]) for v, o in ((a, b), (b, a)))
        if op in ("=", "<>"):
            same = x.eqNullSafe(y)
            return logical(same if op == "=" else ~same, err)
    return logical({"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], err)


def choose(branches: list[tuple[Column, Val]], default: Val, err: Column | None = None) -> Val:
    """The value of the first branch whose condition holds, lane by lane; err, where set, wins."""

    def lane(get):
        cols = [get(v) for _, v in branches] + [get(default)]
        if all(c is None for c in cols):
            return None
        out = None
        for (cond, _), c in zip(branches, cols, strict=False):
            out = (F.when if out is None else out.when)(cond, c if c is not None else F.lit(None))
        return out.otherwise(cols[-1] if cols[-1] is not None else F.lit(None))

    picked = first_error(err, lane(lambda v: v.err))
    fix = (lambda c: c) if err is None else (lambda c: None if c is None else F.when(err.isNull(), c))
    return Val(fix(lane(lambda v: v.n)), fix(lane(lambda v: v.s)), fix(lane(lambda v: v.b)), picked, any(v.blank or not (v.lanes or v.err is not None) for _, v in branches) or default.blank)


def result(v: Val) -> Column:
    """One column: the value itself if it has one lane, else its text; errors as null. A blank result is 0."""
    if v.lanes == "n":
        return F.when(v.err.isNotNull(), None).otherwise(F.coalesce(v.n, F.lit(0.0))) if v.err is not None else F.coalesce(v.n, F.lit(0.0)) if v.blank else v.n
    if v.lanes in ("s", "b"):
        return v.s if v.s is not None else v.b
    if not v.lanes:
        return F.lit(None).cast("double") if v.err is not None else F.lit(0.0)
    return guarded(to_text(v)[0], v.err)


def error_of(v: Val) -> Column:
    return v.err if v.err is not None else F.lit(None).cast("string")
