"""Functions of single values: logic, mathematics, text, dates, finance, statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import GENUINE, LARGEST, Val, bind, choose, compare, error, first_error, general, guarded, lit, logical, num, parse_date, parse_number, text, to_bool, to_number, to_text

VALUES: dict[str, tuple[int, int, Callable[..., Val]]] = {}


def value(name: str, low: int, high: int | None = None):
    def add(fn):
        for n in name.split():
            VALUES[n] = (low, low if high is None else high, fn)
        return fn

    return add


def bad(cond: Column, kind: str = "#NUM!") -> Column:
    return F.when(cond, F.lit(kind))


def numbers(*vals: Val) -> tuple[list[Column], Column | None]:
    got = [to_number(v) for v in vals]
    return [c for c, _ in got], first_error(*[e for _, e in got])


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def whole(x: Column) -> Column:
    """Toward zero, as an int."""
    return trunc(x).try_cast("int")


# -- logic -----------------------------------------------------------------------------------------------------------

value("TRUE", 0)(lambda: lit(True))
value("FALSE", 0)(lambda: lit(False))
value("NA", 0)(lambda: error("#N/A"))
value("PI", 0)(lambda: Val(n=F.lit(math.pi)))


@value("NOT", 1)
def _not(v):
    b, e = to_bool(v)
    return logical(~b, e)


def _sentinel(v: Val) -> Column:
    return F.lit(False) if v.err is None else v.err.isNotNull() & ~v.err.isin(*GENUINE)


def _asks(v: Val, found: Column) -> Val:
    """A question that answers about genuine errors, too; the engine's refusals travel on."""
    return logical(found, None if v.err is None else F.when(_sentinel(v), v.err))


value("ISBLANK", 1)(lambda v: logical(v.is_blank()))
value("ISNUMBER", 1)(lambda v: _asks(v, v.n.isNotNull() if v.n is not None else F.lit(False)))
value("ISTEXT", 1)(lambda v: _asks(v, v.s.isNotNull() if v.s is not None else F.lit(False)))
value("ISERROR", 1)(lambda v: _asks(v, v.err.isNotNull() if v.err is not None else F.lit(False)))
value("ISERR", 1)(lambda v: _asks(v, F.coalesce(v.err != "#N/A", F.lit(False)) if v.err is not None else F.lit(False)))
value("ISNA", 1)(lambda v: _asks(v, F.coalesce(v.err == "#N/A", F.lit(False)) if v.err is not None else F.lit(False)))


@value("IFERROR", 2)
def _iferror(v, other):
    return v if v.err is None else choose([(v.err.isNotNull() & ~_sentinel(v), other)], v)


@value("IFNA", 2)
def _ifna(v, other):
    return v if v.err is None else choose([(F.coalesce(v.err == "#N/A", F.lit(False)), other)], v)


@value("IF", 2, 3)
def _if(test, yes, no=None):
    b, e = to_bool(test)
    return choose([(b, yes)], lit(False) if no is None else no, e)


@value("IFS", 2, 254)
def _ifs(*args):
    out = error("#N/A")
    for test, then in reversed(list(zip(args[::2], args[1::2], strict=False))):
        b, e = to_bool(test)
        out = choose([(b, then)], out, e)
    return out if len(args) % 2 == 0 else error("#VALUE!")


@value("SWITCH", 3, 254)
def _switch(subject, *args):
    default = args[-1] if len(args) % 2 else error("#N/A")
    out = default
    for case, then in reversed(list(zip(args[::2], args[1::2], strict=False))):
        same = compare("=", subject, case)
        out = choose([(same.b, then)], out, same.err)
    return out


@value("CHOOSE", 2, 255)
def _choose(index, *options):
    i, e = to_number(index)
    k = F.floor(i)
    e = first_error(e, bad((k < 1) | (k > len(options)), "#VALUE!"))
    return choose([(k == j + 1, v) for j, v in enumerate(options)], lit(None), e)


# -- mathematics -----------------------------------------------------------------------------------------------------


def _plain(name: str, fn: Callable[[Column], Column], refuse: Callable[[Column], Column] | None = None, finite: bool = True):
    @value(name, 1)
    def call(v):
        x, e = to_number(v)
        return num(fn(x), first_error(e, bad(refuse(x)) if refuse else None), finite)


_plain("ABS", F.abs, finite=False)
_plain("INT", lambda x: F.floor(x).cast("double"), finite=False)
_plain("EXP", F.exp)
_plain("LN", F.ln, lambda x: x <= 0)
_plain("SQRT", F.sqrt, lambda x: x < 0)
_plain("SIN", F.sin)
_plain("COS", F.cos)
_plain("ACOS", F.acos, lambda x: F.abs(x) > 1)
_plain("ASIN", F.asin, lambda x: F.abs(x) > 1)
_plain("ATAN", F.atan, finite=False)


@value("LOG", 1, 2)
def _log(v, base=None):
    (x, b), e = numbers(v, lit(10.0) if base is None else base)
    e = first_error(e, bad((x <= 0) | (b <= 0)), bad(b == 1, "#DIV/0!"))
    return num(F.log10(x) if base is None else F.ln(x) / F.nullif(F.ln(b), F.lit(0.0)), e)


@value("POWER", 2)
def _power(a, b):
    (x, y), e = numbers(a, b)
    return num(F.pow(x, y), first_error(e, bad((x == 0) & (y < 0), "#DIV/0!"), bad((x == 0) & (y == 0))))


@value("MOD", 2)
def _mod(a, b):
    (x, y), e = numbers(a, b)
    return num(x - y * F.floor(F.try_divide(x, y)), first_error(e, bad(y == 0, "#DIV/0!")))


@value("QUOTIENT", 2)
def _quotient(a, b):
    (x, y), e = numbers(a, b)
    return num(trunc(F.try_divide(x, y)), first_error(e, bad(y == 0, "#DIV/0!")))


def decimal_places(x: Column, d: Column, how: str) -> Column:
    return bind(lambda x, d: _decimal_places(x, d, how), x, d)


def _decimal_places(x: Column, d: Column, how: str) -> Column:
    """Rounding of the displayed decimal: the scaled number is first read to 15 digits, so 1.005 is 1.005."""
    scale = F.pow(F.lit(10.0), F.abs(d))
    y = F.when(d >= 0, F.abs(x) * scale).otherwise(F.abs(x) / scale)
    y = F.format_string("%.14e", y).try_cast("double")
    k = {"half": F.floor(y + 0.5), "up": F.ceil(y), "down": F.floor(y)}[how].cast("double")
    out = F.when(d >= 0, k / scale).otherwise(k * scale)
    return F.signum(x) * F.when(y < 1e15, out).otherwise(F.abs(x))


def _rounding(name: str, how: str, low: int = 2):
    @value(name, low, 2)
    def call(v, digits=None):
        (x, d), e = numbers(v, lit(0) if digits is None else digits)
        return num(decimal_places(x, trunc(d), how), e)


_rounding("ROUND", "half")
_rounding("ROUNDUP", "up")
_rounding("ROUNDDOWN", "down")
_rounding("TRUNC", "down", 1)


@value("CEILING", 2)
def _ceiling(a, b):
    (x, s), e = numbers(a, b)
    return num(F.coalesce(F.ceil(F.try_divide(x, s)) * s, F.lit(0.0)), first_error(e, bad((x > 0) & (s < 0))))


@value("FLOOR", 2)
def _floor(a, b):
    (x, s), e = numbers(a, b)
    e = first_error(e, bad((s == 0) & (x != 0), "#DIV/0!"), bad((x > 0) & (s < 0)))
    return num(F.coalesce(F.floor(F.try_divide(x, s)) * s, F.lit(0.0)), e)


# -- statistics ------------------------------------------------------------------------------------------------------


def erfc(x: Column) -> Column:
    return bind(_erfc_of, x)


def _erfc_of(x: Column) -> Column:
    """By the positive series exp(-x^2) sum (2x^2)^n x / (2n+1)!! below 3, by its continued fraction beyond."""
    a = F.abs(x)
    fold = lambda n, start, step: F.aggregate(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), start, step)
    series = fold(60, F.lit(1.0), lambda acc, k: 1 + acc * (2 * a * a / (2 * k + 1)))
    near = 1 - 2 / math.sqrt(math.pi) * a * F.exp(-a * a) * series
    tail = fold(60, a, lambda acc, k: a + (k / 2.0) / F.when(acc == 0, 1.0).otherwise(acc))
    far = F.exp(-a * a) / math.sqrt(math.pi) / F.when(tail == 0, 1.0).otherwise(tail)
    pos = F.when(a < 1.5, near).otherwise(far)
    return F.when(x < 0, 2 - pos).otherwise(pos)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / math.sqrt(2))


def probit(p: Column) -> Column:
    return bind(_probit_of, p)


def _probit_of(p: Column) -> Column:
    """A rational first guess and two steps of Halley's method on the normal distribution."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(q))
    guess = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))

    def step(z, _):
        return bind(halley, z)

    def halley(z):
        u = (0.5 * erfc(z / math.sqrt(2)) - q) * -math.sqrt(2 * math.pi) * F.exp(z * z / 2)
        return z - u / (1 + z * u / 2)

    return F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), guess, step, lambda z: F.when(p < 0.5, -z).otherwise(z))


@value("ERFC", 1)
def _erfc(v):
    x, e = to_number(v)
    return num(erfc(x), e)


@value("NORMDIST NORM.DIST", 4)
def _normdist(v, mean, sd, cumulative):
    (x, m, s), e = numbers(v, mean, sd)
    c, ce = to_bool(cumulative)
    z = F.try_divide(x - m, s)
    return num(F.when(c, normal_cdf(z)).otherwise(F.exp(-z * z / 2) / (s * math.sqrt(2 * math.pi))), first_error(e, ce, bad(s <= 0)))


@value("NORMSINV", 1)
def _normsinv(v):
    p, e = to_number(v)
    return num(probit(p), first_error(e, bad((p <= 0) | (p >= 1))))


@value("NORMINV", 3)
def _norminv(v, mean, sd):
    (p, m, s), e = numbers(v, mean, sd)
    return num(m + s * probit(p), first_error(e, bad((p <= 0) | (p >= 1) | (s <= 0))))


# -- finance ---------------------------------------------------------------------------------------------------------


def _zero(v):
    return lit(0) if v is None else v


def _annuity(rate, nper, kind):
    """(1+r)^n, (1+r*type) * ((1+r)^n - 1) / r, both as they are at r = 0."""
    g = F.pow(1 + rate, nper)
    due = F.when(kind != 0, 1.0).otherwise(0.0)
    return g, F.when(rate == 0, nper).otherwise((1 + rate * due) * (g - 1) / F.when(rate == 0, 1.0).otherwise(rate))


@value("PMT", 3, 5)
def _pmt(rate, nper, pv, fv=None, kind=None):
    (r, n, p, f, k), e = numbers(rate, nper, pv, _zero(fv), _zero(kind))
    g, a = _annuity(r, n, k)
    return num(F.try_divide(-(p * g + f), a), first_error(e, bad((n == 0) | (a == 0))))


@value("FV", 3, 5)
def _fv(rate, nper, pmt, pv=None, kind=None):
    (r, n, m, p, k), e = numbers(rate, nper, pmt, _zero(pv), _zero(kind))
    g, a = _annuity(r, n, k)
    return num(-(p * g + m * a), e)


@value("PV", 3, 5)
def _pv(rate, nper, pmt, fv=None, kind=None):
    (r, n, m, f, k), e = numbers(rate, nper, pmt, _zero(fv), _zero(kind))
    g, a = _annuity(r, n, k)
    return num(F.try_divide(-(f + m * a), g), first_error(e, bad(g == 0)))


def _interest(r, per, n, p, f, k):
    g, a = _annuity(r, n, k)
    pmt = F.try_divide(-(p * g + f), a)
    h, b = _annuity(r, per - 1, k)
    due = p * h + pmt * b
    return F.when(r == 0, 0.0).when(k == 0, -due * r).when(per == 1, 0.0).otherwise(F.try_divide(-due * r, 1 + r)), pmt, a


@value("IPMT", 4, 6)
def _ipmt(rate, per, nper, pv, fv=None, kind=None):
    (r, i, n, p, f, k), e = numbers(rate, per, nper, pv, _zero(fv), _zero(kind))
    got, _, a = _interest(r, i, n, p, f, k)
    return num(got, first_error(e, bad((i < 1) | (i > n) | (a == 0))))


@value("PPMT", 4, 6)
def _ppmt(rate, per, nper, pv, fv=None, kind=None):
    (r, i, n, p, f, k), e = numbers(rate, per, nper, pv, _zero(fv), _zero(kind))
    got, pmt, a = _interest(r, i, n, p, f, k)
    return num(pmt - got, first_error(e, bad((i < 1) | (i > n) | (a == 0) | (r == -1)), bad((k != 0) & (i != F.floor(i)), "#UNSUPPORTED!")))


@value("SLN", 3)
def _sln(cost, salvage, life):
    (c, s, n), e = numbers(cost, salvage, life)
    return num(F.try_divide(c - s, n), first_error(e, bad(n == 0, "#DIV/0!")))


@value("VDB", 5, 7)
def _vdb(cost, salvage, life, start, end, factor=None, no_switch=None):
    (c, s, n, a, b, f, w), e = numbers(cost, salvage, life, start, end, lit(2) if factor is None else factor, _zero(no_switch))
    e = first_error(e, bad((c < 0) | (s < 0) | (n <= 0) | (a < 0) | (b < a) | (b > n) | (f < 0)))
    state = F.struct(F.lit(0.0).alias("sum"), c.alias("book"), F.lit(False).alias("linear"))

    def step(acc, i):
        balance = acc["book"] * F.least(F.lit(1.0), F.try_divide(f, n))
        straight = F.when(n - i > 0, (acc["book"] - s) / F.when(n - i > 0, n - i).otherwise(1.0)).otherwise(acc["book"] - s)
        linear = (w == 0) & (acc["linear"] | (straight > balance))
        dep = F.greatest(F.lit(0.0), F.least(F.when(linear, straight).otherwise(balance), acc["book"] - s))
        part = F.greatest(F.lit(0.0), F.least(b, i + 1) - F.greatest(a, i.cast("double")))
        return F.struct((acc["sum"] + dep * part).alias("sum"), (acc["book"] - dep).alias("book"), linear.alias("linear"))

    periods = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.ceil(b) - 1, F.lit(100_000))).cast("int"))
    return num(F.aggregate(periods, state, step, lambda acc: acc["sum"]), e)


# -- dates -----------------------------------------------------------------------------------------------------------

LAST_DAY = 2_958_465  # 9999-12-31


def date_of(serial: Column) -> Column:
    """The calendar day of a whole serial; the day 60 that never was is 1 March."""
    k = serial.try_cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(k < 60, k + 1).when(k == 60, F.lit(61)).otherwise(F.when(k <= LAST_DAY, k)))


def serial_of(day: Column) -> Column:
    return bind(lambda n: F.when(n < 61, n - 1).otherwise(n), F.datediff(day, F.lit("1899-12-30").cast("date")).cast("double"))


def _day(v: Val) -> tuple[Column, Column | None]:
    x, e = to_number(v)
    k = F.floor(x)
    return k.cast("double"), first_error(e, bad((k < 0) | (k > LAST_DAY)))


def _part(name: str, fn: Callable[[Column], Column], zero: int, leap: int):
    @value(name, 1)
    def call(v):
        k, e = _day(v)
        return num(bind(lambda k: F.when(k == 0, float(zero)).when(k == 60, float(leap)).otherwise(fn(date_of(k)).cast("double")), k), e, False)


_part("YEAR", F.year, 1900, 1900)
_part("MONTH", F.month, 1, 2)
_part("DAY", F.dayofmonth, 0, 29)


@value("DATE", 3)
def _date(year, month, day):
    (y, m, d), e = numbers(year, month, day)
    s = bind(lambda y, m, d: _serial_of_parts(trunc(y), trunc(m), trunc(d)), y, m, d)
    return bound(s, e, lambda s: bad(F.coalesce((s < 0) | (s > LAST_DAY), F.lit(True))))


def bound(col: Column, err: Column | None, refuse: Callable[[Column], Column], once: Callable[..., Column] = bind) -> Val:
    """A number and what refuses it, from one evaluation of the number."""
    both = once(lambda x: F.struct(x.alias("x"), refuse(x).alias("e")), col)
    return num(both["x"], first_error(err, both["e"]), False)


def _serial_of_parts(y: Column, m: Column, d: Column) -> Column:
    def of(months, d):
        far = (months < 1899 * 12) | (months > 10_000 * 12) | (F.abs(d) > 4_000_000)
        safe = F.when(~far, months)
        first = F.make_date(F.floor(safe / 12).cast("int"), (safe % 12).cast("int") + 1, F.lit(1))
        return serial_of(F.when(~far, F.date_add(first, F.when(~far, d.try_cast("int")) - 1)))

    return bind(of, F.when((y >= 0) & (y < 1900), y + 1900).otherwise(y) * 12 + m - 1, d)


def datevalue(v, once: Callable[..., Column] = bind):
    s, e = to_text(v)
    return bound(F.floor(parse_date(F.trim(s), once)).cast("double"), e, lambda x: bad(x.isNull(), "#VALUE!"), once)


@value("HOUR", 1)
def _hour(v):
    x, e = to_number(v)
    seconds = F.round((x - F.floor(x)) * 86400)
    return num(F.floor(seconds / 3600).cast("double") % 24, first_error(e, bad(x < 0)), False)


@value("WEEKDAY", 1, 2)
def _weekday(v, kind=None):
    k, e = _day(v)
    t, te = to_number(lit(1) if kind is None else kind)
    t = trunc(t)
    sunday = (k + 6) % 7  # serial 1 is a Sunday
    out = F.when(t == 1, sunday + 1).when(t == 2, (sunday + 6) % 7 + 1).when(t == 3, (sunday + 6) % 7)
    return num(out, first_error(e, te, bad(t.between(11, 17), "#UNSUPPORTED!"), bad(~t.isin(1.0, 2.0, 3.0))), False)


def _moved(v, months):
    k, e = _day(v)
    m, me = to_number(months)
    m = trunc(m)
    day = F.add_months(date_of(k), F.when(F.abs(m) < 100_000, m.cast("int")))
    return day, k, first_error(e, me)


@value("EDATE", 2)
def _edate(v, months):
    day, _, e = _moved(v, months)
    return bound(serial_of(day), e, lambda s: bad(F.coalesce((s < 1) | (s > LAST_DAY), F.lit(True))))


@value("EOMONTH", 2)
def _eomonth(v, months):
    day, _, e = _moved(v, months)
    return bound(serial_of(F.last_day(day)), e, lambda s: bad(F.coalesce((s < 1) | (s > LAST_DAY), F.lit(True))))


def days360(a: Column, b: Column, european: Column) -> tuple[Column, Column]:
    """30/360 days, and whether the American rule is unsettled: an end on the last day of February after a start that
    is one, too."""
    p, q = date_of(a), date_of(b)
    d1, d2 = F.dayofmonth(p), F.dayofmonth(q)
    february = lambda x: (F.month(x) == 2) & (x == F.last_day(x))
    us1 = F.when((d1 == 31) | february(p), 30).otherwise(d1)
    us2 = F.when((d2 == 31) & (us1 >= 30), 30).otherwise(d2)
    f1 = F.when(european, F.least(d1, F.lit(30))).otherwise(us1)
    f2 = F.when(european, F.least(d2, F.lit(30))).otherwise(us2)
    days = (F.year(q) - F.year(p)) * 360 + (F.month(q) - F.month(p)) * 30 + f2 - f1
    return days.cast("double"), ~european & february(q) & february(p)


@value("DAYS360", 2, 3)
def _days360(start, end, method=None):
    (a, e), (b, f) = _day(start), _day(end)
    m, me = to_bool(lit(False) if method is None else method)
    both = bind(lambda a, b, m: F.struct(*[x.alias(n) for x, n in zip(days360(a, b, m), ("days", "odd"), strict=True)]), a, b, m)
    return num(both["days"], first_error(e, f, me, bad(both["odd"], "#UNSUPPORTED!")), False)


@value("YEARFRAC", 2, 3)
def _yearfrac(start, end, basis=None):
    (a, e), (b, f) = _day(start), _day(end)
    k, ke = to_number(lit(0) if basis is None else basis)
    k = trunc(k)
    both = bind(lambda a, b, m: F.struct(*[x.alias(n) for x, n in zip(days360(a, b, m), ("days", "odd"), strict=True)]), a, b, k == 4)
    days, odd = both["days"], both["odd"]
    out = F.when(k.isin(0.0, 4.0), days / 360).when(k == 2, (b - a) / 360).otherwise((b - a) / 365)
    return num(out, first_error(e, f, ke, bad((k < 0) | (k > 4)), bad((k == 1) | (b < a) | (odd & (k == 0)), "#UNSUPPORTED!")), False)


def weekdays_between(a: Column, b: Column) -> Column:
    """Mondays to Fridays from serial a to serial b, both counted: complete weeks before each, then the rest."""
    upto = lambda k: F.floor((k + 5) / 7) * 5 + F.least((k + 5) % 7, F.lit(5.0))  # noqa: E731  serial 2 is a Monday
    return upto(b + 1) - upto(a)


# -- text ------------------------------------------------------------------------------------------------------------


def utf16(s: Column) -> Column:
    return F.length(F.encode(s, "UTF-16BE")) / 2


_WIDE = r"[\x{10000}-\x{10FFFF}]"


@value("LEN", 1)
def _len(v):
    s, e = to_text(v)
    return num(utf16(s), e, False)


@value("LEFT", 1, 2)
def _left(v, count=None):
    s, e = to_text(v)
    n, ne = to_number(lit(1) if count is None else count)
    return text(F.substring(s, F.lit(1), F.coalesce(whole(n), F.lit(2**31 - 1))), first_error(e, ne, bad(n < 0, "#VALUE!")))


@value("RIGHT", 1, 2)
def _right(v, count=None):
    s, e = to_text(v)
    n, ne = to_number(lit(1) if count is None else count)
    k = F.least(F.coalesce(whole(n), F.lit(2**31 - 1)), F.length(s))
    return text(F.substring(s, F.length(s) - k + 1, k), first_error(e, ne, bad(n < 0, "#VALUE!")))


@value("MID", 3)
def _mid(v, start, count):
    s, e = to_text(v)
    (a, n), ne = numbers(start, count)
    odd = bad(s.rlike(_WIDE), "#UNSUPPORTED!")  # positions count UTF-16 units
    return text(F.substring(s, F.coalesce(whole(a), F.lit(2**31 - 1)), F.coalesce(whole(n), F.lit(2**31 - 1))), first_error(e, ne, bad((trunc(a) < 1) | (n < 0), "#VALUE!"), odd))


def _cased(name: str, fn: Callable[[Column], Column]):
    @value(name, 1)
    def call(v):
        s, e = to_text(v)
        return text(fn(s), first_error(e, bad(s.rlike(r"[^\x00-\x7F]") & s.rlike(r"(?U)(?=[^\x00-\x7F])\p{L}"), "#UNSUPPORTED!")))


_cased("UPPER", F.upper)
_cased("LOWER", F.lower)
_cased("PROPER", lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), ""))


@value("TRIM", 1)
def _trim(v):
    s, e = to_text(v)
    return text(F.trim(F.regexp_replace(s, " +", " ")), e)


@value("CONCATENATE", 1, 255)
def _concatenate(*vals):
    got = [to_text(v) for v in vals]
    return text(F.concat(*[c for c, _ in got]), first_error(*[e for _, e in got]))


@value("REPT", 2)
def _rept(v, count):
    s, e = to_text(v)
    n, ne = to_number(count)
    k = F.coalesce(whole(n), F.lit(40_000))
    long = k * F.length(s) > 32767
    return text(F.repeat(s, F.when(long | (k < 0), 0).otherwise(k)), first_error(e, ne, bad((n < 0) | long, "#VALUE!")))


@value("EXACT", 2)
def _exact(a, b):
    (x, e), (y, f) = to_text(a), to_text(b)
    return logical(x == y, first_error(e, f))


@value("FIND", 2, 3)
def _find(needle, hay, start=None):
    (x, e), (s, f) = to_text(needle), to_text(hay)
    a, ae = to_number(lit(1) if start is None else start)
    k = F.coalesce(whole(a), F.lit(2**31 - 1))
    at = F.when(x == "", k).otherwise(F.position(x, s, k))
    odd = bad(s.rlike(_WIDE), "#UNSUPPORTED!")
    return num(at.cast("double"), first_error(e, f, ae, bad((k < 1) | (k > F.length(s) + 1) | (at == 0), "#VALUE!"), odd), False)


def _wild(x: Column) -> Column:
    """A pattern with * ? ~ as a regular expression: signs are quoted first, then the wild ones freed."""
    quoted = F.regexp_replace(x, r"([\\^$.|+()\[\]{}*?~])", r"\\$1")
    freed = F.regexp_replace(F.regexp_replace(quoted, r"\\~\\([*?~])", "\u0001$1"), r"\\([*?])", "$1")
    freed = F.replace(F.replace(freed, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*?"))
    # \u0001 marks what a tilde protected; the sign behind it was turned above and is turned back
    freed = F.replace(F.replace(F.replace(freed, F.lit("\u0001.*?"), F.lit(r"\*")), F.lit("\u0001."), F.lit(r"\?")), F.lit("\u0001~"), F.lit("~"))
    return F.concat(F.lit("(?is)"), freed)


@value("SEARCH", 2, 3)
def _search(needle, hay, start=None):
    (x, e), (s, f) = to_text(needle), to_text(hay)
    a, ae = to_number(lit(1) if start is None else start)
    k = F.coalesce(whole(a), F.lit(2**31 - 1))
    rest = F.substring(s, k, F.length(s))
    parts = F.regexp_extract_all(rest, F.concat(F.lit("(?is)^(.*?)"), F.regexp_replace(_wild(x), r"^\(\?is\)", "")), F.lit(1))
    at = F.when(x == "", k).otherwise(F.coalesce(F.length(F.get(parts, F.lit(0))) + k, F.lit(0)))
    odd = bad(s.rlike(_WIDE), "#UNSUPPORTED!")
    return num(at.cast("double"), first_error(e, f, ae, bad((k < 1) | (k > F.length(s) + 1) | (at == 0), "#VALUE!"), odd), False)


@value("SUBSTITUTE", 3, 4)
def _substitute(v, old, new, which=None):
    (s, e), (o, f), (w, g) = to_text(v), to_text(old), to_text(new)
    if which is None:
        return text(F.when(o == "", s).otherwise(F.replace(s, o, w)), first_error(e, f, g))
    n, ne = to_number(which)
    k = F.coalesce(whole(n), F.lit(2**31 - 1))
    parts = F.split(s, F.concat(F.lit(r"\Q"), o, F.lit(r"\E")), -1)
    head = F.concat_ws("\u0000", F.slice(parts, F.lit(1), F.greatest(k, F.lit(1))))
    tail = F.concat_ws("\u0000", F.slice(parts, F.greatest(k, F.lit(1)) + 1, F.size(parts)))
    done = F.concat(F.replace(head, F.lit("\u0000"), o), w, F.replace(tail, F.lit("\u0000"), o))
    return text(F.when((o == "") | (F.size(parts) <= k), s).otherwise(done), first_error(e, f, g, ne, bad(k < 1, "#VALUE!")))


@value("VALUE", 1)
def _value(v):
    if v.s is None:
        x, e = to_number(v)
        return num(x, e, False)
    got = parse_number(v.s)
    x = F.coalesce(got, v.n) if v.n is not None else got
    return num(F.coalesce(x, F.lit(0.0)) if v.blank else x, first_error(v.err, F.when(v.s.isNotNull() & got.isNull(), F.lit("#VALUE!"))), False)


@value("HYPERLINK", 1, 2)
def _hyperlink(link, friendly=None):
    s, e = to_text(link)
    return text(s, e) if friendly is None else choose([], friendly, e) if e is not None else friendly


def letters(column: Column) -> Column:
    """Column letters of a number from 1 to 16384."""
    k = column.cast("int")
    sign = lambda i: F.char(i + 65)
    third, second, first = F.floor((k - 703) / 676), F.floor((k - 27) / 26) % 26, (k - 1) % 26
    return F.concat(F.when(k > 702, sign(third)).otherwise(""), F.when(k > 26, sign(second)).otherwise(""), sign(first))


def address(row, column, kind=None, a1=None, sheet=None, rows: int = 1_048_576):
    """The text of a reference; rows: as many as there may be."""
    (r, c, k), e = numbers(row, column, lit(1) if kind is None or kind.blank else kind)
    r, c, k = trunc(r), trunc(c), trunc(k)
    style, se = to_bool(lit(True) if a1 is None or a1.blank else a1)
    row_text, col_text = r.cast("bigint").cast("string"), c.cast("int").cast("string")
    fixed_row, fixed_col = k.isin(1.0, 2.0), k.isin(1.0, 3.0)
    dollar = lambda on: F.when(on, F.lit("$")).otherwise("")
    plain = F.concat(dollar(fixed_col), letters(F.least(c, F.lit(16384.0))), dollar(fixed_row), row_text)
    boxed = lambda on, t: F.when(on, t).otherwise(F.concat(F.lit("["), t, F.lit("]")))
    other = F.concat(F.lit("R"), boxed(fixed_row, row_text), F.lit("C"), boxed(fixed_col, col_text))
    out, te = F.when(style, plain).otherwise(other), None
    if sheet is not None and not (sheet.blank and not sheet.lanes):
        name, te = to_text(sheet)
        simple = name.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$")
        out = F.concat(F.when(simple, name).otherwise(F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))), F.lit("!"), out)
    return text(out, first_error(e, se, te, bad((r < 1) | (c < 1) | (r > rows) | (c > 16_384) | ~k.isin(1.0, 2.0, 3.0, 4.0), "#VALUE!")))


def format_number(x: Column, pattern: str) -> Column | None:
    """The pinned number formats: 0 # , between digits, decimals of 0, trailing %."""
    import re

    m = re.fullmatch(r"([#0,]*0[#0,]*|#[#0,]*0|0)(?:\.(0+))?(%*)", pattern)
    if not m or m[1].startswith(",") or m[1].endswith(","):
        return None
    places, percents = len(m[2] or ""), len(m[3])
    zeros = m[1].replace(",", "").count("0")
    y = decimal_places(x * 100.0**percents, F.lit(float(places)), "half")
    body = F.format_number(F.abs(y), places)
    if "," not in m[1]:
        body = F.replace(body, F.lit(","), F.lit(""))
    if zeros > 1:
        dot = 1 + places if places else 0
        width = F.greatest(F.length(body), F.lit(zeros + dot))
        body = F.lpad(body, width, F.lit("0"))
    return F.concat(F.when(y < 0, "-").otherwise(""), body, F.lit("%" * percents))


# The date tokens that are rendered, with the patterns that give the same text.
DATE_TOKENS = {"yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d"}


def format_date(x: Column, pattern: str) -> Column | None:
    import re

    parts = re.findall(r"y+|m+|d+|[-/., ]+|.", pattern.lower())
    if not any(p in DATE_TOKENS for p in parts) or not all(p in DATE_TOKENS or re.fullmatch(r"[-/., ]+", p) for p in parts):
        return None
    java = "".join(DATE_TOKENS.get(p, f"'{p}'") for p in parts)
    return F.date_format(date_of(F.floor(x)), java)


def text_of(v: Val, pattern: str) -> Val:
    """TEXT with a format that is known when the formula is compiled."""
    x, e = to_number(v)
    if pattern.lower() == "general":
        return text(general(x), e)
    if pattern == "":
        return text(F.lit(""), e)
    got = format_number(x, pattern)
    if got is not None:
        return text(got, e)
    got = format_date(x, pattern)
    if got is not None:
        return text(got, first_error(e, bad((x < 0) | (x > LAST_DAY + 1), "#VALUE!"), bad(F.floor(x).isin(0, 60), "#UNSUPPORTED!")))
    return error("#UNSUPPORTED!")


__all__ = ["LARGEST", "VALUES", "guarded"]
