"""All functions by name: those of single values, aggregates, and those that see their arguments' trees."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.compiler import MOST_CELLS, Arr, Compiler, Grid, Lambda, Rng, grid_of, packed
from .criteria import matches
from .scalar import VALUES, address, bad, bind, date_of, datevalue, numbers, text_of, trunc, weekdays_between, whole
from .values import Unsupported, Val, choose, error, first_error, lit, logical, num, text, to_bool, to_number, to_text

FUNCTIONS: dict[str, tuple[int, int | None, str, Callable]] = {n: (a, b, "value", f) for n, (a, b, f) in VALUES.items()}


def tree(name: str, low: int, high: int | None = None):
    def add(fn):
        for n in name.split():
            FUNCTIONS[n] = (low, high, "tree", fn)
        return fn

    return add


# -- aggregates --------------------------------------------------------------------------------------------------------


def _some(a: Column) -> Column:
    """The elements that aren't null."""
    return F.filter(a, lambda x: x.isNotNull())


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def _first(a: Column) -> Column:
    return F.get(_some(a), F.lit(0))


def _seen_number(v: Val, logicals: bool, texts: bool) -> Column | None:
    """The number that a cell of a range counts as."""
    x = v.n
    if logicals and v.b is not None:
        x = v.b.cast("double") if x is None else F.coalesce(x, v.b.cast("double"))
    if texts and v.s is not None:
        zero = F.when(v.s.isNotNull(), 0.0)
        x = zero if x is None else F.coalesce(x, zero)
    return x


def _sentinel(err: Column) -> Column:
    return F.when(err.startswith("#UNSUPPORTED") | err.startswith("#BLOCKED") | err.startswith("#RESOURCE"), err)


class Cells:
    """The arguments of an aggregate: single values (which coerce), array cells and ranges (which don't)."""

    def __init__(self, c: Compiler, args: list, env: dict):
        self.c = c
        self.items: list[tuple[str, Val, str | None]] = []
        for a in args:
            got = c.compile(a, env)
            if isinstance(got, Arr):
                self.items += [("cell", v, None) for v in got.cells()]
            elif isinstance(got, Rng):
                self.items.append(("range", got.val, got.table))
            elif isinstance(got, Grid):
                self.items.append(("grid", got, None))
            else:
                self.items.append(("direct", c.scalar(got), None))

    def errors(self, sentinels_only: bool = False) -> Column | None:
        out = []
        for how, v, table in self.items:
            if how == "grid":
                if "e" in v.lanes:
                    out.append(_first(v.each(lambda x: _sentinel(x.err) if sentinels_only else x.err)))
                continue
            err = v.err
            if how == "direct":
                err = to_number(v)[1]
            if err is None:
                continue
            if sentinels_only and how != "direct":
                err = _sentinel(err)
            out.append(self.first(err, table) if how == "range" else err)
        return first_error(*out)

    def first(self, err: Column, table: str | None) -> Column:
        """The first error of a range, by the table's order column; without one, the least by name."""
        df = self.c.df if table is None else self.c.tables[table]
        if df is not None and ORDER in df.columns:
            return self.c.reduce(table, F.min_by(err, F.when(err.isNotNull(), F.col(ORDER))))
        return self.c.reduce(table, F.min(err))

    def numbers(self, logicals: bool = False, texts: bool = False) -> list[tuple[str, Column, str | None]]:
        """The numbers that count; null where a cell doesn't. logicals, texts: as AVERAGEA and its kin see cells."""
        out = []
        for how, v, table in self.items:
            if how == "direct":
                out.append((how, F.when(v.is_blank(), F.lit(0.0)).otherwise(to_number(v)[0]) if v.blank else to_number(v)[0], None))
                continue
            if how == "grid":
                lanes = set(v.lanes) & {"n", *("b" * logicals), *("s" * texts)}
                if lanes:
                    out.append((how, _some(v.each(lambda x: _seen_number(x, logicals, texts))), None))
                continue
            x = _seen_number(v, logicals, texts)
            if x is not None:
                out.append((how, x, table))
        return out

    def fold(self, parts: list, agg: Callable[[Column], Column], each: Callable[[Column], Column], join: Callable[[Column, Column], Column], over: Callable[[Column], Column]) -> Column | None:
        """agg: of a range as it stands in an aggregation, over: of the numbers of a grid, each: of a single value."""
        done = [self.c.reduce(t, agg(x)) if how == "range" else over(x) if how == "grid" else each(x) for how, x, t in parts]
        return reduce(join, done) if done else None

    def sum(self, parts, of=lambda x: x) -> Column:
        mapped = [(h, F.transform(x, of) if h == "grid" else of(x), t) for h, x, t in parts]
        got = self.fold(mapped, lambda x: F.coalesce(F.sum(x), F.lit(0.0)), lambda x: F.coalesce(x, F.lit(0.0)), lambda a, b: a + b, _total)
        return F.lit(0.0) if got is None else got

    def count(self, parts) -> Column:
        got = self.fold(parts, lambda x: F.count(x), lambda x: x.isNotNull().cast("bigint"), lambda a, b: a + b, lambda a: F.size(_some(a)).cast("bigint"))
        return F.lit(0) if got is None else got

    def array(self, parts) -> Column:
        """All numbers as an array, for what has no partial form; a range is gathered, so groups must be of bounded size."""
        done = [self.c.reduce(t, F.collect_list(x)) if h == "range" else x if h == "grid" else _some(F.array(x)) for h, x, t in parts]
        return F.concat(*done) if done else F.array().cast("array<double>")


def aggregate(name: str, low: int = 1, high: int = 255, logicals: bool = False, texts: bool = False, finite: bool = True):
    def add(fn):
        def call(c, args, env):
            cells = Cells(c, args, env)
            got, err = fn(cells, cells.numbers(logicals, texts))
            return num(got, first_error(cells.errors(), err), finite)

        tree(name, low, high)(call)
        return fn

    return add


aggregate("SUM")(lambda c, p: (c.sum(p), None))
aggregate("SUMSQ")(lambda c, p: (c.sum(p, lambda x: x * x), None))


def _mean(c, p):
    n = c.count(p)
    return F.try_divide(c.sum(p), n), bad(n == 0, "#DIV/0!")


aggregate("AVERAGE")(_mean)
aggregate("AVERAGEA", logicals=True, texts=True)(_mean)


def _extreme(agg, pick, over):
    def fn(c, p):
        got = c.fold(p, agg, lambda x: x, lambda a, b: pick(a, b), over)
        return (F.lit(0.0) if got is None else F.coalesce(got, F.lit(0.0))), None

    return fn


for _name, _logicals in (("MIN", False), ("MINA", True)):
    aggregate(_name, logicals=_logicals, finite=False)(_extreme(F.min, F.least, F.array_min))
for _name, _logicals in (("MAX", False), ("MAXA", True)):
    aggregate(_name, logicals=_logicals, finite=False)(_extreme(F.max, F.greatest, F.array_max))


@aggregate("PRODUCT")
def _product(c, p):
    got = c.fold(p, lambda x: F.coalesce(F.product(x), F.lit(1.0)), lambda x: F.coalesce(x, F.lit(1.0)), lambda a, b: a * b, lambda a: F.aggregate(a, F.lit(1.0), lambda s, x: s * x))
    return (F.lit(0.0) if got is None else F.when(c.count(p) == 0, 0.0).otherwise(got)), None


@aggregate("STDEV")
def _stdev(c, p):
    if len(p) == 1 and p[0][0] == "range":
        got = c.c.reduce(p[0][2], F.stddev_samp(p[0][1]))
        return got, bad(c.count(p) < 2, "#DIV/0!")
    n, mean = c.count(p), F.try_divide(c.sum(p), c.count(p))
    if any(h == "range" for h, _, _ in p):
        return F.sqrt(F.try_divide(c.sum(p, lambda x: x * x) - n * mean * mean, n - 1)), bad(n < 2, "#DIV/0!")
    return F.sqrt(F.try_divide(c.sum(p, lambda x: (x - mean) * (x - mean)), n - 1)), bad(n < 2, "#DIV/0!")


@aggregate("MEDIAN")
def _median(c, p):
    if len(p) == 1 and p[0][0] == "range":
        got = c.c.reduce(p[0][2], F.median(p[0][1]))
    else:
        a = F.array_sort(c.array(p))
        n = F.size(a)
        got = (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2
    return got, bad(got.isNull())


@tree("COUNT", 1, 255)
def _count(c, args, env):
    cells, parts = Cells(c, args, env), []
    for how, v, t in cells.items:
        if how == "direct":
            parts.append((how, F.when(F.coalesce(to_number(v)[1].isNull(), F.lit(True)) if to_number(v)[1] is not None else F.lit(True), to_number(v)[0]), t))
        elif how == "grid":
            parts.append((how, v.each(lambda x: x.n), t)) if "n" in v.lanes else None
        elif v.n is not None:
            parts.append((how, v.n, t))
    if any(h == "grid" and "e" in v.lanes for h, v, _ in cells.items):
        found = cells.errors(True)
        return num(cells.count(parts).cast("double"), None if found is None else _sentinel(found), False)
    errs = [v.err for h, v, _ in cells.items if h == "direct" and v.err is not None]
    return num(cells.count(parts).cast("double"), first_error(*[F.when(~e.startswith("#U") & ~e.startswith("#B") & ~e.startswith("#RES"), None).otherwise(e) for e in errs]), False)


@tree("COUNTA", 1, 255)
def _counta(c, args, env):
    cells = Cells(c, args, env)
    parts = [(h, v.each(lambda x: F.when(~x.is_blank(), 1)) if h == "grid" else F.when(~v.is_blank(), 1), t) for h, v, t in cells.items]
    return num(cells.count(parts).cast("double"), cells.errors(True) if any(h == "grid" or v.err is not None for h, v, _ in cells.items) and not any(h == "direct" for h, _, _ in cells.items) else None, False)


def _truths(c, args, env):
    """The logicals that contribute: direct values coerce, in ranges logicals and numbers count."""
    cells, out, errs = Cells(c, args, env), [], []
    for how, v, t in cells.items:
        if how == "direct":
            b, e = to_bool(v)
            out.append((how, b, t))
            errs.append(e)
            continue
        if how == "grid":
            if "e" in v.lanes:
                errs.append(_first(v.each(lambda x: x.err)))
            truth = lambda x: F.coalesce(*[k for k in (x.b, None if x.n is None else x.n != 0) if k is not None])
            if set(v.lanes) & {"n", "b"}:
                out.append((how, _some(v.each(truth)), t))
            continue
        if v.err is not None:
            errs.append(c.reduce(t, F.min(v.err)) if how == "range" else v.err)
        x = v.b
        if v.n is not None:
            x = (v.n != 0) if x is None else F.coalesce(x, v.n != 0)
        if x is not None:
            out.append((how, x, t))
    return cells, out, first_error(*errs)


def _logic(name, agg, join, neutral, over):
    def call(c, args, env):
        cells, parts, err = _truths(c, args, env)
        if not parts:
            return error("#VALUE!")
        got = cells.fold(parts, lambda x: F.coalesce(agg(x), F.lit(neutral)), lambda x: F.coalesce(x, F.lit(neutral)), join, over)
        return logical(got, first_error(err, bad(cells.count(parts) == 0, "#VALUE!")))

    tree(name, 1, 255)(call)


_logic("AND", F.bool_and, lambda a, b: a & b, True, lambda a: F.forall(a, lambda x: x))
_logic("OR", F.bool_or, lambda a, b: a | b, False, lambda a: F.exists(a, lambda x: x))
_logic("XOR", lambda x: F.bit_xor(x.cast("int")) == 1, lambda a, b: a != b, False, lambda a: F.size(F.filter(a, lambda x: x)) % 2 == 1)


def _kth(name, largest):
    def call(c, args, env):
        cells = Cells(c, args[:1], env)
        k, ke = to_number(c.value(args[1], env))
        a = F.sort_array(cells.array(cells.numbers()), asc=not largest)
        got = F.get(a, k.try_cast("int") - 1)
        return num(got, first_error(cells.errors(), ke, bad((k < 1) | (k > F.size(a))), bad(k != F.floor(k), "#UNSUPPORTED!")), False)

    tree(name, 2)(call)


_kth("LARGE", True)
_kth("SMALL", False)


@tree("RANK RANK.EQ", 2, 3)
def _rank(c, args, env):
    x, e = to_number(c.value(args[0], env))
    cells = Cells(c, args[1:2], env)
    order, oe = to_number(c.value(args[2], env)) if len(args) > 2 else (F.lit(0.0), None)
    parts = cells.numbers()
    if any(h == "range" for h, _, _ in parts):
        raise Unsupported("ranks within a table are operators.ordered.rank")
    beat = cells.sum(parts, lambda v: F.when(F.when(order == 0, v > x).otherwise(v < x), 1.0))
    seen = cells.sum(parts, lambda v: F.when(v == x, 1.0))
    return num(beat + 1, first_error(e, cells.errors(), oe, bad(seen == 0, "#N/A")), False)


def _two(c, args, env) -> tuple[list, list]:
    """Two arguments of equal shape, as pairs."""
    a, b = (c.compile(x, env) for x in args)
    if isinstance(a, Rng) and isinstance(b, Rng) and a.table == b.table:
        return [("range", a.val, b.val, a.table)], []
    if isinstance(a, Grid) or isinstance(b, Grid):
        return [("grid", grid_of(a), grid_of(b), None)], []
    if isinstance(a, Arr) and isinstance(b, Arr):
        if len(a.cells()) != len(b.cells()):
            return [], ["#N/A"]
        return [("cell", x, y, None) for x, y in zip(a.cells(), b.cells(), strict=True)], []
    raise Unsupported("two ranges of one table or two arrays")


def _pearson(two: Column, mx: Column, my: Column) -> Column:
    part = lambda f: F.aggregate(two, F.lit(0.0), lambda s, v: s + f(v))
    xy, xx, yy = part(lambda v: (v["x"] - mx) * (v["y"] - my)), part(lambda v: (v["x"] - mx) ** 2), part(lambda v: (v["y"] - my) ** 2)
    return F.try_divide(xy, F.sqrt(xx * yy))


@tree("CORREL", 2)
def _correl(c, args, env):
    pairs, errs = _two(c, args, env)
    if errs:
        return error(errs[0])
    if pairs[0][0] == "range":
        _, a, b, t = pairs[0]
        r = c.reduce(t, F.corr(a.n, b.n))
        errs = first_error(*[c.reduce(t, F.min(v.err)) for v in (a, b) if v.err is not None])
        return num(r, first_error(errs, bad(r.isNull() | F.isnan(r), "#DIV/0!")))
    if pairs[0][0] == "grid":
        _, a, b, _ = pairs[0]
        if "n" not in a.lanes or "n" not in b.lanes:
            return error("#DIV/0!")
        two = F.filter(F.zip_with(a.each(lambda v: v.n), b.each(lambda v: v.n), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda v: v["x"].isNotNull() & v["y"].isNotNull())
        mean = lambda k: F.try_divide(_total(F.transform(two, lambda v: v[k])), F.size(two))
        r = bind(lambda two, mx, my: _pearson(two, mx, my), two, mean("x"), mean("y"))
        errs = first_error(*[_first(g.each(lambda v: v.err)) for g in (a, b) if "e" in g.lanes])
        return num(r, first_error(bad(F.size(a.cells) != F.size(b.cells), "#N/A"), errs, bad(r.isNull(), "#DIV/0!")))
    both = [F.when(x.n.isNotNull() & y.n.isNotNull(), F.struct(x.n.alias("x"), y.n.alias("y"))) for _, x, y, _ in pairs if x.n is not None and y.n is not None]
    n = float(len(both))
    if not both:
        return error("#DIV/0!")
    total = lambda f: reduce(lambda p, q: p + q, [f(v) for v in both])
    mx, my = total(lambda v: v["x"]) / n, total(lambda v: v["y"]) / n
    sxy, sxx, syy = total(lambda v: (v["x"] - mx) * (v["y"] - my)), total(lambda v: (v["x"] - mx) ** 2), total(lambda v: (v["y"] - my) ** 2)
    return num(F.try_divide(sxy, F.sqrt(sxx * syy)), bad(sxx * syy == 0, "#DIV/0!"))


@tree("SUMPRODUCT", 1, 255)
def _sumproduct(c, args, env):
    got = [c.compile(a, env) for a in args]
    if all(isinstance(g, Rng) for g in got) and len({g.table for g in got}) == 1:
        err = first_error(*[g.val.err for g in got])
        product = reduce(lambda a, b: a * b, [F.coalesce(g.val.n, F.lit(0.0)) if g.val.n is not None else F.lit(0.0) for g in got])
        total = c.reduce(got[0].table, F.coalesce(F.sum(product if err is None else F.when(err.isNull(), product)), F.lit(0.0)))
        return num(total, None if err is None else c.reduce(got[0].table, F.min(err)))
    if any(isinstance(g, Grid) for g in got):
        zero = lambda *vs: num(reduce(lambda a, b: a * b, [F.coalesce(v.n, F.lit(0.0)) if v.n is not None else F.lit(0.0) for v in vs]), first_error(*[v.err for v in vs]), False)
        grids = [grid_of(g if isinstance(g, (Grid, Arr)) else Arr([[c.scalar(g)]])) for g in got]
        differ = reduce(lambda a, b: a | b, [(_col(g.height) != _col(grids[0].height)) | (_col(g.width) != _col(grids[0].width)) for g in grids])
        made = c.lift_grids(zero, grids)

        def total(cells):
            g = Grid(cells, made.height, made.width)
            return F.struct(_total(g.each(lambda v: v.n)).alias("n"), _first(g.each(lambda v: v.err)).alias("err"))

        done = c.once(lambda x: x, c.once(total, made.cells))
        return num(done["n"], first_error(bad(differ, "#VALUE!"), done["err"]))
    arrays = [g if isinstance(g, Arr) else Arr([[c.scalar(g)]]) for g in got]
    if len({a.shape for a in arrays}) > 1:
        return error("#VALUE!")
    cells = list(zip(*[a.cells() for a in arrays], strict=True))
    err = first_error(*[v.err for row in cells for v in row])
    products = [reduce(lambda a, b: a * b, [F.coalesce(v.n, F.lit(0.0)) if v.n is not None else F.lit(0.0) for v in row]) for row in cells]
    return num(reduce(lambda a, b: a + b, products), err)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# The function that a SUBTOTAL code stands for.
SUBTOTALS = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV", 8: "STDEVP", 9: "SUM", 10: "VAR", 11: "VARP"}


def _variance(cells: Cells, parts: list, sample: bool) -> tuple[Column, Column]:
    """Of single values and grids; the count that divides."""
    n, mean = cells.count(parts), F.try_divide(cells.sum(parts), cells.count(parts))
    by = n - 1 if sample else n
    return F.try_divide(cells.sum(parts, lambda x: (x - mean) * (x - mean)), by), by


def _spread(fn):
    return lambda c, p: (c.c.reduce(p[0][2], fn(p[0][1])) if p and p[0][0] == "range" else F.lit(None).cast("double"), None)


#: A table's rows may be marked as hidden, or as subtotals themselves, by columns of these names.
HIDDEN, NESTED = "_hidden", "_subtotal"


@tree("SUBTOTAL", 2, 255)
def _subtotal(c, args, env):
    if args[0][0] != "num":
        raise Unsupported("SUBTOTAL with a code that isn't a number")
    code = int(args[0][1])
    name = SUBTOTALS.get(code - 100 if code > 100 else code)
    if name is None:
        return error("#VALUE!")
    shown = F.lit(True)
    columns = c.df.columns if c.df is not None else []
    if NESTED in columns:
        shown = shown & ~F.col(NESTED)
    if code > 100 and HIDDEN in columns:
        shown = shown & ~F.col(HIDDEN)
    inner = Compiler(c.df, c.tables, c.names, c.ranges, c.reduced)
    seen = {}
    for i, a in enumerate(args[1:]):
        got = c.compile(a, env)
        if isinstance(got, Rng):
            keep = lambda x: None if x is None else F.when(shown, x)
            got = Rng(Val(keep(got.val.n), keep(got.val.s), keep(got.val.b), keep(got.val.err), True), got.table)
        elif isinstance(got, Grid) and got.flagged:
            out = lambda x: x["t"] | x["h"] if code > 100 else x["t"]  # noqa: E731, B023
            got = Grid(F.transform(got.cells, lambda x: F.struct(*[F.when(~out(x), x[k]).alias(k) for k in ("n", "s", "b", "err")])), got.height, got.width, got.lanes)
        seen[f"_A{i}"] = got
    refs = [("name", None, k) for k in seen]
    if name in ("STDEVP", "VAR", "VARP"):
        cells = Cells(inner, refs, seen)
        parts = cells.numbers()
        if parts and all(h != "range" for h, _, _ in parts):
            var, by = _variance(cells, parts, name == "VAR")
            return num(F.sqrt(var) if name == "STDEVP" else var, first_error(cells.errors(), bad(by < 1, "#DIV/0!")))
        fn = {"STDEVP": F.stddev_pop, "VAR": F.var_samp, "VARP": F.var_pop}[name]
        got, _ = _spread(fn)(cells, cells.numbers())
        return num(got, first_error(cells.errors(), bad(got.isNull(), "#DIV/0!")))
    return FUNCTIONS[name][3](inner, refs, env | seen)


# -- criteria ----------------------------------------------------------------------------------------------------------


def _criterion(c: Compiler, node: tuple, env: dict):
    """A constant as a Python value, so that it is read once; anything else as a value."""
    if node[0] in ("num", "str", "bool"):
        return node[1]
    if node[0] == "un" and node[1] == "-" and node[2][0] == "num":
        return -node[2][1]
    if node[0] == "bin" and node[1] == "&" and all(x[0] in ("str", "num") for x in node[2:]):
        return "".join(x[1] if x[0] == "str" else f"{x[1]:g}" for x in node[2:])
    return c.value(node, env)


def _conditional(c, values, tests, env, how: str):
    """One reduction under conditions. values: a tree or None; tests: (range tree, criterion tree) pairs."""
    got = [(c.compile(r, env), _criterion(c, k, env)) for r, k in tests]
    target = c.compile(values, env) if values is not None else got[0][0]
    if all(isinstance(x, Rng) for x, _ in got) and isinstance(target, Rng):
        if len({x.table for x, _ in got} | {target.table}) > 1:
            raise Unsupported("conditions on different tables")
        hit = reduce(lambda a, b: a & b, [matches(x.val, k) for x, k in got])
        v = target.val
        items = [("range", v.n, hit, v.err)]
        red = lambda col: c.reduce(target.table, col)
    elif all(isinstance(x, Arr) for x, _ in got) and isinstance(target, Arr):
        if len({x.shape for x, _ in got} | {target.shape}) > 1:
            return error("#VALUE!")
        items = []
        for i, v in enumerate(target.cells()):
            hit = reduce(lambda a, b: a & b, [matches(x.cells()[i], k) for x, k in got])
            items.append(("cell", v.n, hit, v.err))
        red = None
    elif all(isinstance(x, (Arr, Grid)) for x in [target, *[x for x, _ in got]]):
        return _conditional_grids(grid_of(target), [(grid_of(x), k) for x, k in got], how, c.anchored and values is not None and len(tests) == 1 and how in ("sum", "mean"))
    else:
        raise Unsupported("conditions need ranges or arrays")

    def fold(agg, each, join):
        parts = [red(agg(x)) if red else each(x) for x in each_value()]
        return reduce(join, parts)

    def each_value():
        for _, n, hit, _ in items:
            yield F.when(hit, F.lit(1.0) if how == "count" else n if n is not None else F.lit(None).cast("double"))

    errs = [F.when(hit, e) for _, _, hit, e in items if e is not None and how != "count"]
    err = first_error(*[red(F.min(e)) if red else e for e in errs])
    zero = F.lit(0.0)
    total = lambda: fold(lambda x: F.coalesce(F.sum(x), zero), lambda x: F.coalesce(x, zero), lambda a, b: a + b)
    if how in ("sum", "count"):
        return num(total(), err)
    n = fold(F.count, lambda x: x.isNotNull().cast("bigint"), lambda a, b: a + b)
    if how == "mean":
        return num(F.try_divide(total(), n), first_error(err, bad(n == 0, "#DIV/0!")))
    pick, agg = (F.greatest, F.max) if how == "max" else (F.least, F.min)
    return num(F.coalesce(fold(agg, lambda x: x, pick), zero), err, False)


def _conditional_grids(target: Grid, tests: list, how: str, anchored: bool) -> Val:
    """Conditions on grids, cell by cell. anchored: SUMIF and AVERAGEIF, whose target is refused if smaller."""
    grids = [target, *[g for g, _ in tests]]
    zipped = F.arrays_zip(*[g.cells.alias(f"g{i}") for i, g in enumerate(grids)])
    differ = reduce(lambda a, b: a | b, [(_col(g.height) != _col(target.height)) | (_col(g.width) != _col(target.width)) for g in grids])

    def met(x):
        return reduce(lambda a, b: a & b, [matches(g.val(x[f"g{i + 1}"]), k) for i, (g, k) in enumerate(tests)])

    hit = F.filter(zipped, lambda x: F.coalesce(met(x), F.lit(False)))
    err = first_error(bad(differ, "#UNSUPPORTED!" if anchored else "#VALUE!"), _first(F.transform(hit, lambda x: x["g0"]["err"])) if "e" in target.lanes and how != "count" else None)
    if how == "count":
        return num(F.size(hit).cast("double"), err, False)
    values = _some(F.transform(hit, lambda x: x["g0"]["n"]))
    if how == "sum":
        return num(_total(values), err)
    if how == "mean":
        return num(F.try_divide(_total(values), F.size(values)), first_error(err, bad(F.size(values) == 0, "#DIV/0!")))
    return num(F.coalesce((F.array_max if how == "max" else F.array_min)(values), F.lit(0.0)), err, False)


def _pairs(args):
    return list(zip(args[::2], args[1::2], strict=True))


tree("SUMIF", 2, 3)(lambda c, a, env: _conditional(c, a[2] if len(a) > 2 else None, [(a[0], a[1])], env, "sum"))
tree("AVERAGEIF", 2, 3)(lambda c, a, env: _conditional(c, a[2] if len(a) > 2 else None, [(a[0], a[1])], env, "mean"))
tree("COUNTIF", 2, 2)(lambda c, a, env: _conditional(c, None, [(a[0], a[1])], env, "count"))
tree("COUNTIFS", 2)(lambda c, a, env: error("#VALUE!") if len(a) % 2 else _conditional(c, None, _pairs(a), env, "count"))
for _name, _how in (("SUMIFS", "sum"), ("AVERAGEIFS", "mean"), ("MAXIFS", "max"), ("MINIFS", "min")):
    tree(_name, 3)(lambda c, a, env, how=_how: error("#VALUE!") if len(a) % 2 == 0 else _conditional(c, a[0], _pairs(a[1:]), env, how))


def _database(name, how):
    """DSUM(table, field, criteria): criteria is an array whose first row has labels; its rows are alternatives."""

    def call(c, args, env):
        if args[0][0] != "name" or args[2][0] != "array":
            raise Unsupported("a database function needs a table's name and an array of criteria")
        table = args[0][2]
        own = table not in c.tables
        df = c.df if own else c.tables[table]
        prefix = (lambda n: ("name", None, n)) if own else (lambda n: ("name", table, n))
        field = args[1]
        label = field[1] if field[0] == "str" else df.columns[int(field[1]) - 1] if field[0] == "num" and 1 <= int(field[1]) <= len(df.columns) else None
        known = {x.lower(): x for x in df.columns}
        if label is None or label.lower() not in known:
            return error("#VALUE!")
        labels = [x[1] for x in args[2][1][0]]
        any_row = None
        for row in args[2][1][1:]:
            hit = F.lit(True)
            for name_, cell in zip(labels, row, strict=True):
                got = c.compile(prefix(known[name_.lower()]), env)
                k = _criterion(c, cell, env)
                if k != "":
                    hit = hit & matches(got.val if isinstance(got, Rng) else got, k)
            any_row = hit if any_row is None else any_row | hit
        v = c.compile(prefix(known[label.lower()]), env)
        v = v.val if isinstance(v, Rng) else v
        x = F.when(any_row, v.n)
        where = None if own else table
        total, n = c.reduce(where, F.coalesce(F.sum(x), F.lit(0.0))), c.reduce(where, F.count(x))
        return num(total) if how == "sum" else num(F.try_divide(total, n), bad(n == 0, "#DIV/0!"))

    tree(name, 3, 3)(call)


_database("DSUM", "sum")
_database("DAVERAGE", "mean")

# -- flows of money ------------------------------------------------------------------------------------------------------


def _flows(c, args, env) -> tuple[Column, Column | None]:
    """Numbers in order, as an array. A range is a column of one group, gathered by the table's order column."""
    cells = Cells(c, args, env)
    done = []
    for how, v, t in cells.items:
        if how == "grid":
            done.append(_some(v.each(lambda x: x.n)) if "n" in v.lanes else F.array().cast("array<double>"))
            continue
        if v.n is None and how != "direct":
            continue
        x = to_number(v)[0] if how == "direct" else v.n
        if how == "range":
            order = F.col(ORDER) if ORDER in (c.df if t is None else c.tables[t]).columns else F.lit(0)
            done.append(F.transform(F.array_sort(c.reduce(t, F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x")))))), lambda s: s["x"]))
        else:
            done.append(F.filter(F.array(x), lambda y: y.isNotNull()))
    return (F.concat(*done) if done else F.array().cast("array<double>")), cells.errors()


#: The column that orders a table's rows, for functions of sequences.
ORDER = "_pos"


def _discounted(flows: Column, rate: Column, ages: Column | None = None) -> Column:
    """sum of flow / (1 + rate)^age; ages are places unless given."""
    if ages is None:
        return F.aggregate(F.transform(flows, lambda x, i: x / F.pow(1 + rate, i)), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.zip_with(flows, ages, lambda x, t: x / F.pow(1 + rate, t)), F.lit(0.0), lambda a, x: a + x)


@tree("NPV", 2, 255)
def _npv(c, args, env):
    r, e = to_number(c.value(args[0], env))
    flows, fe = _flows(c, args[1:], env)
    return num(_discounted(flows, r) / (1 + r), first_error(e, fe, bad(r == -1, "#DIV/0!")))


def _ages(c, node, env):
    days, e = _flows(c, [node], env)
    days = F.transform(days, lambda d: F.floor(d))
    return F.transform(days, lambda d: (d - F.get(days, F.lit(0))) / 365.0), e


@tree("XNPV", 3)
def _xnpv(c, args, env):
    r, e = to_number(c.value(args[0], env))
    flows, fe = _flows(c, args[1:2], env)
    ages, ae = _ages(c, args[2], env)
    return num(_discounted(flows, r, ages), first_error(e, fe, ae, bad((r <= 0) | F.exists(ages, lambda t: t < 0) | (F.size(flows) != F.size(ages)))))


def _newton(flows: Column, ages: Column, guess: Column, tries: int) -> tuple[Column, Column]:
    """The rate at which flows are worth nothing, and whether the last step was small."""
    out = bind(lambda f, a, g: _steps(f, a, g, tries), flows, ages, guess)
    return out["r"], F.abs(out["step"]) < 1e-7


def _steps(flows: Column, ages: Column, guess: Column, tries: int) -> Column:
    start = F.struct(guess.alias("r"), F.lit(1.0).alias("step"))

    def step(acc, _):
        r = acc["r"]
        base = F.when(1 + r > 1e-9, 1 + r).otherwise(1e-9)
        value = F.aggregate(F.zip_with(flows, ages, lambda x, t: x / F.pow(base, t)), F.lit(0.0), lambda a, x: a + x)
        slope = F.aggregate(F.zip_with(flows, ages, lambda x, t: -t * x / F.pow(base, t + 1)), F.lit(0.0), lambda a, x: a + x)
        move = F.coalesce(F.try_divide(value, slope), F.lit(0.0))
        done = F.abs(acc["step"]) < 1e-12
        return F.struct(F.when(done, r).otherwise(r - move).alias("r"), F.when(done, acc["step"]).otherwise(move).alias("step"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(tries)), start, step)


def _signs(flows: Column) -> Column:
    return ~(F.exists(flows, lambda x: x > 0) & F.exists(flows, lambda x: x < 0))


@tree("IRR", 1, 2)
def _irr(c, args, env):
    flows, fe = _flows(c, args[:1], env)
    g, ge = to_number(c.value(args[1], env)) if len(args) > 1 else (F.lit(0.1), None)
    r, ok = _newton(flows, F.transform(flows, lambda _, i: i.cast("double")), g, 20)
    return num(r, first_error(None if fe is None else F.when(fe.isNotNull(), F.lit("#VALUE!")), ge, bad(_signs(flows) | ~ok)))


@tree("XIRR", 2, 3)
def _xirr(c, args, env):
    flows, fe = _flows(c, args[:1], env)
    ages, ae = _ages(c, args[1], env)
    g, ge = to_number(c.value(args[2], env)) if len(args) > 2 else (F.lit(0.1), None)
    r, ok = _newton(flows, ages, g, 100)
    return num(r, first_error(fe, ae, ge, bad(_signs(flows) | ~ok | F.exists(ages, lambda t: t < 0))))


# -- days with holidays ----------------------------------------------------------------------------------------------------


def _holidays(c, args, env, at: int) -> tuple[Column, Column | None]:
    """Distinct holidays on weekdays, as an array of serials."""
    if len(args) <= at:
        return F.array().cast("array<double>"), None
    days, e = _flows(c, [args[at]], env)
    days = F.transform(days, lambda d: F.floor(d).cast("double"))
    return F.array_distinct(F.filter(days, lambda d: (d + 5) % 7 < 5)), e


@tree("DATEVALUE", 1, 1)
def _datevalue(c, args, env):
    got = c.compile(args[0], env)
    return c.lift(lambda v: datevalue(v, c.once if isinstance(got, Val) else bind), [got])


@tree("NETWORKDAYS", 2, 3)
def _networkdays(c, args, env):
    (a, b), e = numbers(c.value(args[0], env), c.value(args[1], env))
    free, fe = _holidays(c, args, env, 2)

    def days(a, b, *free):
        """The working days, or -1 and -2 for what can't be counted."""
        off = [F.size(F.filter(f, lambda d: (d >= a) & (d <= b))) for f in free]
        n = reduce(lambda x, y: x - y, off, weekdays_between(a, b))
        return F.when(b < a, -1.0).when(a < 0, -2.0).otherwise(n)

    n = bind(days, F.floor(a).cast("double"), F.floor(b).cast("double"), *([free] if len(args) > 2 else []))
    return num(n, first_error(e, fe, bad(n == -1, "#UNSUPPORTED!"), bad(n == -2)), False)


@tree("WORKDAY", 2, 3)
def _workday(c, args, env):
    (a, n), e = numbers(c.value(args[0], env), c.value(args[1], env))
    a, n = F.floor(a).cast("double"), trunc(n)
    free, fe = _holidays(c, args, env, 2)
    # the n-th working day lies within n * 7 / 5 days and the holidays; each step leaps over what is missing
    left = F.size(free) + F.lit(3)
    sign = F.signum(n)

    def worked(day):
        forward = weekdays_between(a + 1, day) - F.size(F.filter(free, lambda d: (d > a) & (d <= day)))
        back = weekdays_between(day, a - 1) - F.size(F.filter(free, lambda d: (d < a) & (d >= day)))
        return F.when(sign > 0, forward).otherwise(back)

    start = a + sign * F.greatest(F.lit(0), F.floor((F.abs(n) - 1) / 5)) * 7
    span = F.sequence(F.lit(0), (left * 2 + 14).cast("int"))
    got = F.aggregate(span, start, lambda day, _: F.when(worked(day) < F.abs(n), day + sign).otherwise(day))
    return num(F.when(n == 0, a).otherwise(got), first_error(e, fe, bad((got < 1) | (a < 0))), False)


# -- text over many cells ------------------------------------------------------------------------------------------------


def _texts(c, args, env):
    cells = Cells(c, args, env)
    done = []
    for how, v, t in cells.items:
        if how == "grid":
            done.append(v.each(lambda x: to_text(x)[0]))
            continue
        s = to_text(v)[0]
        if how == "range":
            order = F.col(ORDER) if ORDER in (c.df if t is None else c.tables[t]).columns else s
            done.append(F.transform(F.array_sort(c.reduce(t, F.collect_list(F.struct(order.alias("o"), s.alias("s"))))), lambda x: x["s"]))
        else:
            done.append(F.array(s))
    errs = [c.reduce(t, F.min(v.err)) if h == "range" else v.err for h, v, t in cells.items if h != "grid" and v.err is not None]
    errs += [_first(v.each(lambda x: x.err)) for h, v, _ in cells.items if h == "grid" and "e" in v.lanes]
    return F.concat(*done), first_error(*errs)


@tree("CONCAT", 1)
def _concat(c, args, env):
    parts, e = _texts(c, args, env)
    out = F.array_join(parts, "")
    return text(out, first_error(e, bad(F.length(out) > 32767, "#VALUE!")))


@tree("TEXTJOIN", 3, 254)
def _textjoin(c, args, env):
    if args[0][0] == "array":
        raise Unsupported("TEXTJOIN with several delimiters")
    d, de = to_text(c.value(args[0], env))
    skip, se = to_bool(c.value(args[1], env))
    parts, e = _texts(c, args[2:], env)
    parts = F.when(skip, F.filter(parts, lambda s: s != "")).otherwise(parts)
    out = F.aggregate(F.transform(parts, lambda s, i: F.concat(F.when(i > 0, d).otherwise(""), s)), F.lit(""), lambda a, s: F.concat(a, s))
    return text(out, first_error(de, se, e, bad(F.length(out) > 32767, "#VALUE!")))


@tree("TEXT", 2)
def _text(c, args, env):
    v, how = c.value(args[0], env), args[1]
    if how[0] == "num":
        how = ("str", f"{how[1]:g}")
    if how[0] == "bool":
        return error("#VALUE!")
    if how[0] != "str":
        raise Unsupported("TEXT with a format that isn't constant")
    return text_of(v, how[1])


# -- arrays of known shape ---------------------------------------------------------------------------------------------------


def _array(c, node, env, grids: bool = False) -> Arr | Grid:
    got = c.compile(node, env)
    if isinstance(got, Grid):
        if grids:
            return got
        raise Unsupported("an array whose size depends on data")
    return got if isinstance(got, Arr) else Arr([[c.scalar(got)]])


def _constant(c, node, env, default: float | None = None) -> float | None:
    """A number that is known when the formula is compiled."""
    if node is None or node[0] == "omit":
        return default
    if node[0] == "un" and node[1] == "-":
        return -_constant(c, node[2], env)
    if node[0] in ("num", "bool"):
        return float(node[1])
    raise Unsupported("a shape that depends on data")


def _at(args, i):
    return args[i] if len(args) > i else None


def _made(rows) -> Arr | Val:
    if not rows or not rows[0]:
        return error("#CALC!")
    if len(rows) * len(rows[0]) > MOST_CELLS:
        return error("#RESOURCE!")
    return Arr(rows)


@tree("SEQUENCE", 1, 4)
def _sequence(c, args, env):
    n, m = int(_constant(c, args[0], env, 1)), int(_constant(c, _at(args, 1), env, 1))
    start, step = _constant(c, _at(args, 2), env, 1), _constant(c, _at(args, 3), env, 1)
    if n > 1 and m > 1:
        return error("#UNSUPPORTED!")
    if n < 1 or m < 1:
        return error("#CALC!" if 0 in (n, m) else "#VALUE!")
    values = [lit(start + step * i) for i in range(n * m)]
    return _made([values] if n == 1 else [[v] for v in values])


tree("RANDARRAY", 0, 5)(lambda c, a, env: error("#UNSUPPORTED!"))
for _name in ("NOW", "TODAY", "RAND", "RANDBETWEEN", "INFO", "ISOMITTED"):
    tree(_name, 0)(lambda c, a, env: error("#UNSUPPORTED!"))
for _name in ("WEBSERVICE", "RTD", "STOCKHISTORY"):
    tree(_name, 0)(lambda c, a, env: error("#BLOCKED!"))


def _flat(c, args, env):
    a, by_column = _array(c, args[0], env), bool(_constant(c, _at(args, 2), env, 0))
    return a.cells() if not by_column else [r[j] for j in range(a.shape[1]) for r in a.rows]


def _flattened(name, down):
    """One column or row; leaving out blanks (1), errors (2) or both (3) makes its size depend on data."""

    def call(c, args, env):
        ignore = int(_constant(c, _at(args, 1), env, 0))
        if ignore not in (0, 1, 2, 3):
            return error("#VALUE!")
        if not ignore and not isinstance(c.compile(args[0], env), Grid):
            flat = _flat(c, args, env)
            return Arr([[v] for v in flat] if down else [flat])
        g = _grid(c, args[0], env)
        g = _turned(g) if _flag(c, _at(args, 2), env) else g
        gone = lambda v: (v.is_blank() if ignore & 1 else F.lit(False)) | (v.err.isNotNull() if ignore & 2 and v.err is not None else F.lit(False))
        kept = F.filter(F.flatten(_lines(g)), lambda x: ~gone(g.val(x)))
        n = bind(F.size, kept)
        return _sized(kept, n if down else 1, 1 if down else n, bad(n == 0, "#CALC!"), g.lanes)

    tree(name, 1, 3)(call)


_flattened("TOCOL", True)
_flattened("TOROW", False)


@tree("VSTACK", 1)
def _vstack(c, args, env):
    parts = [_array(c, a, env) for a in args]
    width = max(p.shape[1] for p in parts)
    return _made([[*r, *[error("#N/A")] * (width - len(r))] for p in parts for r in p.rows])


@tree("HSTACK", 1)
def _hstack(c, args, env):
    parts = [_array(c, a, env) for a in args]
    height = max(p.shape[0] for p in parts)
    return _made([[v for p in parts for v in (p.rows[i] if i < p.shape[0] else [error("#N/A")] * p.shape[1])] for i in range(height)])


def _cut(n: float | None, size: int, take: bool) -> slice | None:
    if n is None:
        return slice(0, size)
    k = int(n)
    if k == 0:
        return None
    if take:
        return slice(0, min(k, size)) if k > 0 else slice(max(0, size + k), size)
    return slice(min(k, size), size) if k > 0 else slice(0, max(0, size + k))


def _portion(name, take):
    def call(c, args, env):
        a = _array(c, args[0], env)
        cuts = [_cut(_constant(c, _at(args, i + 1), env), a.shape[i], take) for i in (0, 1)]
        if None in cuts:
            return error("#CALC!" if take else "#UNSUPPORTED!")
        return _made([r[cuts[1]] for r in a.rows[cuts[0]]])

    tree(name, 2, 3)(call)


_portion("TAKE", True)
_portion("DROP", False)


@tree("EXPAND", 2, 4)
def _expand(c, args, env):
    a = _array(c, args[0], env)
    h, w = int(_constant(c, args[1], env, a.shape[0])), int(_constant(c, _at(args, 2), env, a.shape[1]))
    pad = c.value(args[3], env) if len(args) > 3 else error("#N/A")
    if h < a.shape[0] or w < a.shape[1]:
        return error("#VALUE!")
    return _made([[a.rows[i][j] if i < a.shape[0] and j < a.shape[1] else pad for j in range(w)] for i in range(h)])


def _wrap(name, by_row):
    def call(c, args, env):
        a, n = _array(c, args[0], env), int(_constant(c, args[1], env))
        pad = c.value(args[2], env) if len(args) > 2 else error("#N/A")
        if min(a.shape) > 1:
            return error("#VALUE!")
        if n < 1:
            return error("#NUM!")
        flat = a.cells()
        flat += [pad] * (-len(flat) % n)
        rows = [flat[i : i + n] for i in range(0, len(flat), n)]
        return _made(rows if by_row else [list(r) for r in zip(*rows, strict=True)])

    tree(name, 2, 3)(call)


_wrap("WRAPROWS", True)
_wrap("WRAPCOLS", False)


def _chosen(name, axis):
    def call(c, args, env):
        a, out = _array(c, args[0], env), []
        wanted = []
        for x in args[1:]:
            wanted += [_constant(c, y, env) for r in x[1] for y in r] if x[0] == "array" else [_constant(c, x, env)]
        size = a.shape[axis]
        for k in map(int, wanted):
            if k == 0 or abs(k) > size:
                return error("#VALUE!")
            out.append(k - 1 if k > 0 else size + k)
        return _made([a.rows[i] for i in out] if axis == 0 else [[r[j] for j in out] for r in a.rows])

    tree(name, 2)(call)


_chosen("CHOOSEROWS", 0)
_chosen("CHOOSECOLS", 1)


@tree("INDEX", 2, 3)
def _index(c, args, env):
    a = _array(c, args[0], env, True)
    if isinstance(a, Grid):
        (i, e), (j, f) = to_number(c.value(args[1], env)), to_number(c.value(args[2], env)) if len(args) > 2 else (F.lit(1.0), None)
        if len(args) == 2:
            i, j = F.when(_col(a.height) == 1, F.lit(1.0)).otherwise(i), F.when(_col(a.height) == 1, i).otherwise(j)
        i, j = trunc(i), trunc(j)
        err = first_error(e, f, bad((i == 0) | (j == 0), "#UNSUPPORTED!"), bad((i < 1) | (j < 1) | (i > _col(a.height)) | (j > _col(a.width)), "#REF!"))
        return _guard(a.at((i - 1) * _col(a.width) + j - 1), err)
    if a.shape[0] == 1 and len(args) == 2:
        i, j, e, f = F.lit(1.0), *to_number(c.value(args[1], env))[:1], None, to_number(c.value(args[1], env))[1]
    else:
        (i, e), (j, f) = to_number(c.value(args[1], env)), to_number(c.value(args[2], env)) if len(args) > 2 else (F.lit(1.0), None)
    i, j = trunc(i), trunc(j)
    err = first_error(e, f, bad((i < 1) | (j < 1) | (i > a.shape[0]) | (j > a.shape[1]), "#REF!"))
    return _pick(a.cells(), (i - 1) * a.shape[1] + j, None, err)


def _position(c, needle: Val, cells: list[Val] | Grid, kind: int, last: bool = False, wild: bool = False) -> tuple[Column, Column | None]:
    """1-based place of a value among cells; 0 if absent. kind 0: equal (wild: texts may be patterns), 1 and -1: the
    search of sorted cells."""
    if isinstance(cells, Grid):
        return _place_in(needle, cells, kind, last, wild)
    if kind:
        cmp = [_order(v, needle) for v in cells]
        places = F.array(*[F.coalesce(x, F.lit(9)) for x in cmp])
        return _halving(places, kind, F.lit(len(cells)), max(1, len(cells).bit_length() + 1)), needle.err
    hits = [F.when(_equal(v, needle, wild), F.lit(i + 1)) for i, v in enumerate(cells)]
    order = hits[::-1] if last else hits
    return F.coalesce(*order, F.lit(0)), needle.err


def _guard(v: Val, err: Column | None) -> Val:
    """v, or an error that comes before it."""
    if err is None:
        return v
    fix = lambda c: None if c is None else F.when(err.isNull(), c)
    return Val(fix(v.n), fix(v.s), fix(v.b), first_error(err, v.err), v.blank)


def _place_in(needle: Val, keys: Grid, kind: int, last: bool = False, wild: bool = False) -> tuple[Column, Column | None]:
    """_position() among the cells of a grid."""
    if kind:
        sides = keys.each(lambda v: F.coalesce(_order(v, needle), F.lit(9)))
        return bind(lambda places: _halving(places, kind, F.size(places), 21), sides), needle.err
    hits = keys.each(lambda v: _equal(v, needle, wild))
    if last:
        n = F.size(hits)
        at = F.array_position(F.reverse(hits), True)
        return F.when(at > 0, n - at + 1).otherwise(0), needle.err
    return F.coalesce(F.array_position(hits, True), F.lit(0)).cast("int"), needle.err


def _halving(places: Column, kind: int, size: Column, steps: int) -> Column:
    """The floor-midpoint search of sorted cells, of which the answer on unsorted ones is part. places: how each cell
    compares; the first probe that is equal ends the search, else it settles on the last one that didn't lie beyond."""
    state = F.struct(F.lit(0).alias("lo"), (size - 1).cast("int").alias("hi"), F.lit(-1).alias("hit"))

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        side = F.get(places, mid) * kind
        busy = (acc["lo"] <= acc["hi"]) & (acc["hit"] < 0)
        return F.struct(F.when(busy & (side < 0), mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(busy & (side > 0), mid - 1).otherwise(acc["hi"]).alias("hi"), F.when(busy & (side == 0), mid).otherwise(acc["hit"]).alias("hit"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step, lambda acc: F.when(acc["hit"] >= 0, acc["hit"]).otherwise(acc["hi"]) + 1)


def _equal(v: Val, needle: Val, wild: bool) -> Column:
    """Is a cell equal to what is sought; wild: texts with * and ? (~ before one stands for itself) are patterns."""
    same = F.coalesce(_order(v, needle) == 0, F.lit(False))
    if wild and needle.s is not None and v.s is not None:
        found = F.rlike(v.s, F.concat(F.lit("(?is)^"), wildcard_of(needle.s), F.lit("$")))
        same = F.when(needle.s.rlike(r"[*?~]"), F.coalesce(found, F.lit(False))).otherwise(same)
    return same


def wildcard_of(s: Column) -> Column:
    """The pattern that a text with wild cards stands for."""
    held = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"~\*", "\x01"), r"~\?", "\x02"), "~~", "\x03")
    quoted = F.regexp_replace(held, r"([\\^$.|+()\[\]{}])", r"\\$1")
    wild = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", ".")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(wild, "\x01", r"\\*"), "\x02", r"\\?"), "\x03", "~")


def _order(v: Val, other: Val) -> Column:
    """-1, 0, 1 of two values of one kind, else null. Blank cells match nothing."""
    parts = []
    for lane, fix in (("n", lambda x: x), ("s", F.lower), ("b", lambda x: x.cast("int"))):
        a, b = getattr(v, lane), getattr(other, lane)
        if a is not None and b is not None:
            parts.append(F.when(fix(a) < fix(b), -1).when(fix(a) == fix(b), 0).when(fix(a) > fix(b), 1))
    if other.blank and v.n is not None:
        parts.append(F.when(other.is_blank(), F.when(v.n < 0, -1).when(v.n == 0, 0).when(v.n > 0, 1)))
    return F.coalesce(*parts) if parts else F.lit(None).cast("int")


def _pick(cells: list[Val], at: Column, missing: Val | None, err: Column | None) -> Val:
    """The at-th of the cells (from 1), by one array for each lane; where there is none, `missing`."""
    kinds = {"n": "double", "s": "string", "b": "boolean", "err": "string"}

    def lane(k):
        if all(getattr(v, k) is None for v in cells):
            return None
        return F.get(F.array(*[getattr(v, k) if getattr(v, k) is not None else F.lit(None).cast(kinds[k]) for v in cells]), (at - 1).cast("int"))

    found = Val(lane("n"), lane("s"), lane("b"), lane("err"), any(v.blank for v in cells))
    if missing is not None:
        return choose([(at == 0, missing)], found, err)
    bad_ = first_error(err, found.err)
    fix = lambda c: None if c is None else c if err is None else F.when(err.isNull(), c)
    return Val(fix(found.n), fix(found.s), fix(found.b), bad_, found.blank)


@tree("MATCH", 2, 3)
def _match(c, args, env):
    a, kind = _array(c, args[1], env, True), int(_constant(c, _at(args, 2), env, 1))
    flat = isinstance(a, Grid)
    if not flat and min(a.shape) > 1:
        return error("#UNSUPPORTED!")
    at, e = _position(c, c.value(args[0], env), a if flat else a.cells(), (kind > 0) - (kind < 0), wild=True)
    if flat:
        e = first_error(bad((_col(a.height) > 1) & (_col(a.width) > 1), "#UNSUPPORTED!"), e)
    return num(at.cast("double"), first_error(e, bad(at == 0, "#N/A")), False)


@tree("XMATCH", 2, 4)
def _xmatch(c, args, env):
    mode, way = int(_constant(c, _at(args, 2), env, 0)), int(_constant(c, _at(args, 3), env, 1))
    if mode or way not in (1, -1):
        return error("#UNSUPPORTED!")
    a = _array(c, args[1], env, True)
    at, e = _position(c, c.value(args[0], env), a if isinstance(a, Grid) else a.cells(), 0, way == -1)
    return num(at.cast("double"), first_error(e, bad(at == 0, "#N/A")), False)


def _table_lookup(name, flip):
    def call(c, args, env):
        a = _array(c, args[1], env, True)
        if isinstance(a, Grid):
            k, ke = to_number(c.value(args[2], env))
            k, (h, w) = trunc(k), (_col(a.height), _col(a.width))
            near = bool(_constant(c, _at(args, 3), env, 1))
            keys = F.slice(a.cells, F.lit(1), w.cast("int")) if flip else F.filter(a.cells, lambda _, i: i % w == 0)
            at, e = _position(c, c.value(args[0], env), Grid(keys, h, 1, a.lanes), 1 if near else 0, wild=True)
            err = first_error(e, ke, bad(k < 1, "#VALUE!"), bad(k > (h if flip else w), "#REF!"), bad(at == 0, "#N/A"))
            return _guard(a.at(((k - 1) * w + at - 1) if flip else ((at - 1) * w + k - 1)), err)
        rows = [list(r) for r in zip(*a.rows, strict=True)] if flip else a.rows
        k, ke = to_number(c.value(args[2], env))
        k = trunc(k)
        near = bool(_constant(c, _at(args, 3), env, 1))
        at, e = _position(c, c.value(args[0], env), [r[0] for r in rows], 1 if near else 0, wild=True)
        err = first_error(e, ke, bad(k < 1, "#VALUE!"), bad(k > len(rows[0]), "#REF!"), bad(at == 0, "#N/A"))
        if args[2][0] == "num" and 1 <= int(args[2][1]) <= len(rows[0]):  # only that column's kinds can come out
            return _pick([r[int(args[2][1]) - 1] for r in rows], at, None, err)
        return _pick([v for r in rows for v in r], (at - 1) * len(rows[0]) + k, None, err)

    tree(name, 3, 4)(call)


_table_lookup("VLOOKUP", False)
_table_lookup("HLOOKUP", True)


@tree("LOOKUP", 2, 3)
def _lookup(c, args, env):
    a = _array(c, args[1], env, True)
    back = _array(c, args[2], env, True) if len(args) > 2 else None
    if isinstance(a, Grid) or isinstance(back, Grid):
        a = grid_of(a)
        h, w = _col(a.height), _col(a.width)
        if back is None:
            wide = w > h
            keys = F.when(wide, F.slice(a.cells, F.lit(1), w.cast("int"))).otherwise(F.filter(a.cells, lambda _, i: i % w == 0))
        at, e = _position(c, c.value(args[0], env), Grid(keys, h, w, a.lanes) if back is None else a, 1)
        e = first_error(e, bad(at == 0, "#N/A"))
        return _guard(grid_of(back).at(at - 1) if back is not None else a.at(F.when(wide, (h - 1) * w + at - 1).otherwise(at * w - 1)), e)
    if len(args) > 2:
        keys, out = a.cells(), _array(c, args[2], env).cells()
    elif a.shape[1] > a.shape[0]:
        keys, out = a.rows[0], a.rows[-1]
    else:
        keys, out = [r[0] for r in a.rows], [r[-1] for r in a.rows]
    at, e = _position(c, c.value(args[0], env), keys, 1)
    return _pick(out, at, None, first_error(e, bad(at == 0, "#N/A")))


@tree("XLOOKUP", 3, 6)
def _xlookup(c, args, env):
    mode, way = int(_constant(c, _at(args, 4), env, 0)), int(_constant(c, _at(args, 5), env, 1))
    if mode or way not in (1, -1):
        return error("#UNSUPPORTED!")
    a, back = _array(c, args[1], env, True), _array(c, args[2], env, True)
    flat = isinstance(a, Grid) or isinstance(back, Grid)
    at, e = _position(c, c.value(args[0], env), grid_of(a) if flat else a.cells(), 0, way == -1)
    missing = c.value(args[3], env) if len(args) > 3 and args[3][0] != "omit" else error("#N/A")
    if flat:
        return choose([(at == 0, missing)], grid_of(back).at(at - 1), e)
    return _pick(back.cells(), at, missing, e)


# -- shapes and places -----------------------------------------------------------------------------------------------------

# The size of a sheet.
SHEET_ROWS, SHEET_COLUMNS = 1_048_576, 16_384


def _size(name, axis):
    def call(c, args, env):
        got = c.compile(args[0], env)
        if isinstance(got, Rng):
            return num(c.reduce(got.table, F.count(F.lit(1))).cast("double"), None, False) if axis == 0 else lit(1)
        if isinstance(got, Grid):
            size = got.full[axis] if got.full else (got.height, got.width)[axis]
            return num(_col(size).cast("double"), None, False)
        return lit(got.shape[axis] if isinstance(got, Arr) else 1)

    tree(name, 1, 1)(call)


_size("ROWS", 0)
_size("COLUMNS", 1)


@tree("ADDRESS", 2, 5)
def _address(c, args, env):
    """A sheet ends at row 2^20, a table has as many rows as it has."""
    rows = 1 << 53 if c.df is not None else 1_048_576
    return c.lift(lambda *vals: address(*vals, rows=rows), [c.compile(a, env) for a in args])


@tree("ROW", 0, 1)
def _row(c, args, env):
    """The row's place in the table, from its order column."""
    if args or c.df is None or ORDER not in c.df.columns:
        raise Unsupported("ROW needs a table with an order column, or a workbook")
    return num((F.col(ORDER) + 1).cast("double"), None, False)


@tree("COLUMN", 0, 1)
def _column(c, args, env):
    if not args or args[0][0] != "name" or c.df is None or args[0][2] not in c.df.columns:
        raise Unsupported("COLUMN needs a column, or a workbook")
    return lit(c.df.columns.index(args[0][2]) + 1)


@tree("CELL", 1, 2)
def _cell(c, args, env):
    what = args[0][1].lower() if args[0][0] == "str" else ""
    v = c.value(args[1], env) if len(args) > 1 else None
    if v is None or what not in ("type", "contents", "col"):
        return error("#UNSUPPORTED!")
    if what == "contents":
        return v
    if what == "col":
        return _column(c, args[1:], env)
    return text(F.when(v.is_blank(), F.lit("b")).when(v.s.isNotNull() if v.s is not None else F.lit(False), F.lit("l")).otherwise(F.lit("v")))


# -- names and lambdas -------------------------------------------------------------------------------------------------------


@tree("LET", 3)
def _let(c, args, env):
    if len(args) % 2 == 0:
        return error("#VALUE!")
    env = dict(env)
    for name, node in zip(args[:-1:2], args[1::2], strict=True):
        env[name[2].upper()] = c.compile(node, env)
    return c.compile(args[-1], env)


@tree("LAMBDA", 1)
def _lambda(c, args, env):
    return Lambda([a[2].upper() for a in args[:-1]], args[-1], dict(env))


def _fn(c, node, env) -> Lambda | None:
    got = c.compile(node, env)
    return got if isinstance(got, Lambda) else None


@tree("MAP", 2)
def _map(c, args, env):
    fn, parts = _fn(c, args[-1], env), [_array(c, a, env) for a in args[:-1]]
    if fn is None:
        return error("#VALUE!")
    if len({p.shape for p in parts}) > 1:
        return error("#UNSUPPORTED!")
    return Arr([[c.scalar(c.apply(fn, [p.rows[i][j] for p in parts])) for j in range(parts[0].shape[1])] for i in range(parts[0].shape[0])])


def _folded(c, args, env):
    fn = _fn(c, args[-1], env)
    acc = c.value(args[0], env)
    out = []
    for v in _array(c, args[1], env).cells():
        acc = c.scalar(c.apply(fn, [acc, v])) if fn else error("#VALUE!")
        out.append(acc)
    return out


tree("REDUCE", 3, 3)(lambda c, a, env: _folded(c, a, env)[-1])


@tree("SCAN", 3, 3)
def _scan(c, args, env):
    flat, (_, w) = _folded(c, args, env), _array(c, args[1], env).shape
    return Arr([flat[i : i + w] for i in range(0, len(flat), w)])


def _by(name, rows):
    def call(c, args, env):
        a, fn = _array(c, args[0], env), _fn(c, args[1], env)
        if fn is None:
            return error("#VALUE!")
        lines = a.rows if rows else [list(r) for r in zip(*a.rows, strict=True)]
        out = [c.scalar(c.apply(fn, [Arr([x] if rows else [[v] for v in x])])) for x in lines]
        return Arr([[v] for v in out] if rows else [out])

    tree(name, 2, 2)(call)


_by("BYROW", True)
_by("BYCOL", False)


@tree("MAKEARRAY", 3, 3)
def _makearray(c, args, env):
    h, w, fn = int(_constant(c, args[0], env)), int(_constant(c, args[1], env)), _fn(c, args[2], env)
    if fn is None or h < 1 or w < 1:
        return error("#VALUE!")
    return _made([[c.scalar(c.apply(fn, [lit(i + 1), lit(j + 1)])) for j in range(w)] for i in range(h)])


# -- arrays whose size depends on data -----------------------------------------------------------------------------------------


def _sized(cells: Column, height, width, err: Column | None, lanes: str = "nsbe") -> Grid:
    """A grid, or an error in its place."""
    if err is None:
        return Grid(cells, height, width, lanes)
    wrong = F.array(F.struct(*[F.lit(None).cast(t).alias(k) for k, t in (("n", "double"), ("s", "string"), ("b", "boolean"))], err.alias("err")))
    one = lambda x: F.when(err.isNotNull(), 1).otherwise(_col(x))
    return Grid(F.when(err.isNotNull(), wrong).otherwise(cells), one(height), one(width), lanes.replace("e", "") + "e")


def _lines(g: Grid) -> Column:
    """The rows of a grid, as arrays."""
    h, w = _col(g.height).cast("int"), _col(g.width).cast("int")
    plain = F.transform(g.cells, lambda x: F.struct(*[x[k].alias(k) for k in ("n", "s", "b", "err")]))
    blank = F.struct(*[F.lit(None).cast(t).alias(k) for k, t in (("n", "double"), ("s", "string"), ("b", "boolean"), ("err", "string"))])
    whole = bind(lambda cells, h, w: F.concat(cells, F.array_repeat(blank, F.greatest(h * w - F.size(cells), F.lit(0)))), plain, h, w)
    return bind(lambda cells, h, w: F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.slice(cells, i * w + 1, w)), whole, h, w)


def _turned(g: Grid) -> Grid:
    """Rows and columns exchanged."""
    h, w = _col(g.height).cast("int"), _col(g.width).cast("int")
    cells = bind(lambda lines, w: F.flatten(F.transform(F.sequence(F.lit(0), w - 1), lambda j: F.transform(lines, lambda r: F.get(r, j)))), _lines(g), w)
    return Grid(cells, w, h, g.lanes)


def _key_of(v: Val) -> Column:
    """What a cell sorts by: numbers before texts before logicals, blanks last."""
    n, s, b = (getattr(v, k) if getattr(v, k) is not None else F.lit(None).cast(t) for k, t in (("n", "double"), ("s", "string"), ("b", "boolean")))
    return F.struct(F.when(n.isNotNull(), 0).when(s.isNotNull(), 1).when(b.isNotNull(), 2).otherwise(9).alias("k"), n.alias("n"), F.lower(s).alias("s"), b.alias("b"))


def _arranged(lines: Column, keys: list[tuple[Column, Column]]) -> Column:
    """Lines in the order of the keys (an array and 1 or -1 each); ties stay as they are."""
    fields = [F.transform(k, lambda x, i: x) for k, _ in keys]
    zipped = F.arrays_zip(lines.alias("line"), F.transform(lines, lambda _, i: i).alias("at"), *[f.alias(f"k{i}") for i, f in enumerate(fields)])

    def before(x, y):
        out = None
        for i, (_, way) in enumerate(keys):
            a, b = x[f"k{i}"], y[f"k{i}"]
            gone = (a["k"] == 9) != (b["k"] == 9)
            side = F.when(gone, F.when(a["k"] == 9, 1).otherwise(-1)).when(a == b, 0).when(a < b, -way).otherwise(way)
            side = F.when(a.eqNullSafe(b), 0).otherwise(side)
            out = side if out is None else F.when(out != 0, out).otherwise(side)
        return F.when(out != 0, out).when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0).cast("int")

    return F.transform(F.array_sort(zipped, before), lambda x: x["line"])


def _way(c, node, env) -> tuple[Column, Column | None]:
    """1 or -1; any other order is #VALUE!."""
    if node is None or node[0] == "omit":
        return F.lit(1), None
    x, e = to_number(c.value(node, env))
    return F.when(x < 0, -1).otherwise(1), first_error(e, bad((x != 1) & (x != -1), "#VALUE!"))


def _grid(c, node, env) -> Grid:
    got = c.compile(node, env)
    if isinstance(got, Rng):
        raise Unsupported("rows of a table: see operators.arrays")
    return grid_of(got)


def _flag(c, node, env) -> bool:
    return bool(_constant(c, node, env, 0))


@tree("FILTER", 2, 3)
def _filter(c, args, env):
    g, hit = _grid(c, args[0], env), _grid(c, args[1], env)
    err = _first(hit.each(lambda v: to_bool(v)[1] if to_bool(v)[1] is not None else F.lit(None).cast("string")))
    hits = hit.each(lambda v: to_bool(v)[0])
    down = (_col(hit.width) == 1) & (_col(hit.height) == _col(g.height))
    across = (_col(hit.height) == 1) & (_col(hit.width) == _col(g.width))
    n = bind(lambda hits: F.size(F.filter(hits, lambda x: x)), hits)
    cells = bind(lambda lines, hits, down: F.when(down, F.flatten(F.filter(lines, lambda _, i: F.get(hits, i)))).otherwise(F.flatten(F.transform(lines, lambda r: F.filter(r, lambda _, j: F.get(hits, j))))), _lines(g), hits, down)
    height, width = F.when(down, n).otherwise(_col(g.height)), F.when(down, _col(g.width)).otherwise(n)
    err = first_error(err, bad(~(down | across), "#VALUE!"))
    if len(args) > 2 and args[2][0] != "omit":
        none = packed(c.value(args[2], env))
        cells = F.when(n == 0, F.array(none)).otherwise(cells)
        height, width = F.when(n == 0, 1).otherwise(height), F.when(n == 0, 1).otherwise(width)
    else:
        err = first_error(err, bad(n == 0, "#CALC!"))
    return _sized(cells, height, width, err)


#: Arrays of known size up to so many cells are sorted by Spark's generated code.
FEW = 64


def _sort_few(c, rows: list[list[Val]], flip: bool, k: Column, ke: Column | None, way: Column, we: Column | None) -> Grid:
    """SORT of lines of known number and length. Descending, what has to stay ascending (blanks last, ties in their order)
    is negated."""
    of = grid_of(Arr(rows))

    def line(cells):
        return c.once(lambda cells, key: F.struct(cells.alias("line"), _key_of(of.val(key)).alias("key"), key["err"].alias("err")), cells, F.get(cells, k - 1))

    def item(x, i, down):
        gone = F.when(x["key"]["k"] == 9, 1).otherwise(0)
        return F.struct((-gone if down else gone).alias("gone"), x["key"].alias("key"), F.lit(-i if down else i).alias("at"), x["line"].alias("line"))

    def arranged(*lines):
        side = [F.sort_array(F.array(*[item(x, i, down) for i, x in enumerate(lines)]), not down) for down in (False, True)]
        return F.when(way < 0, side[1]).otherwise(side[0])

    def cells(order):
        at = lambda i, j: F.get(F.get(order, F.lit(i))["line"], F.lit(j))
        h, w = len(rows), len(rows[0])
        return F.array(*([at(i, j) for j in range(w) for i in range(h)] if flip else [at(i, j) for i in range(h) for j in range(w)]))

    def both(*lines):
        failed = F.coalesce(*[x["err"] for x in lines])
        return F.struct(c.once(cells, arranged(*lines)).alias("cells"), failed.alias("err"))

    done = c.once(both, *[c.once(line, F.array(*[packed(v) for v in r])) for r in rows])
    err = first_error(ke, we, bad((k < 1) | (k > len(rows[0])), "#VALUE!"), done["err"] if "e" in of.lanes else None)
    height, width = (len(rows[0]), len(rows)) if flip else (len(rows), len(rows[0]))
    return _sized(done["cells"], height, width, err, of.lanes)


@tree("SORT", 1, 4)
def _sort(c, args, env):
    got = c.compile(args[0], env)
    if isinstance(got, Rng):
        raise Unsupported("rows of a table: see operators.arrays")
    flip = _flag(c, _at(args, 3), env)
    k, ke = to_number(c.value(args[1], env)) if len(args) > 1 and args[1][0] != "omit" else (F.lit(1.0), None)
    k = trunc(k).cast("int")
    way, we = _way(c, _at(args, 2), env)
    if isinstance(got, Arr) and len(got.cells()) <= FEW:
        return _sort_few(c, [list(r) for r in zip(*got.rows, strict=True)] if flip else got.rows, flip, k, ke, way, we)
    g = _turned(grid_of(got)) if flip else grid_of(got)
    lines = _lines(g)
    cell = lambda r: g.val(F.get(r, k - 1))
    err = first_error(ke, we, bad((k < 1) | (k > _col(g.width)), "#VALUE!"), _first(F.transform(lines, lambda r: F.get(r, k - 1)["err"])) if "e" in g.lanes else None)
    out = Grid(F.flatten(_arranged(lines, [(F.transform(lines, lambda r: _key_of(cell(r))), way)])), g.height, g.width, g.lanes)
    out = _turned(out) if flip else out
    return _sized(out.cells, out.height, out.width, err, g.lanes)


@tree("SORTBY", 2)
def _sortby(c, args, env):
    g, keys, errs = _grid(c, args[0], env), [], []
    i = 1
    while i < len(args):
        by = _grid(c, args[i], env)
        way, e = _way(c, _at(args, i + 1), env)
        errs += [e, bad((_col(by.width) != 1) | (_col(by.height) != _col(g.height)), "#VALUE!"), _first(by.each(lambda v: v.err)) if "e" in by.lanes else None]
        keys.append((by.each(_key_of), way))
        i += 2
    across = isinstance(g.height, int) and g.height == 1
    if across:
        raise Unsupported("SORTBY over columns")
    return _sized(F.flatten(_arranged(_lines(g), keys)), g.height, g.width, first_error(*errs), g.lanes)


@tree("UNIQUE", 1, 3)
def _unique(c, args, env):
    """Different rows in the order of their first places. Texts that differ in case only, and a blank beside 0 or "",
    leave open which one stands for both: refused."""
    g = _grid(c, args[0], env)
    flip, once = _flag(c, _at(args, 1), env), _flag(c, _at(args, 2), env)
    g = _turned(g) if flip else g
    folded = lambda r: F.transform(r, lambda x: F.struct(F.coalesce(x["n"], F.when(x["s"].isNull() & x["b"].isNull() & x["err"].isNull(), 0.0)).alias("n"), F.lower(F.when(x["s"] != "", x["s"])).alias("s"), x["b"].alias("b"), x["err"].alias("err")))
    lines = _lines(g)
    clash = bind(lambda lines: F.size(F.array_distinct(lines)) != F.size(F.array_distinct(F.transform(lines, folded))), lines)
    kept = bind(lambda lines: F.filter(F.array_distinct(lines), lambda r: F.size(F.filter(lines, lambda q: q == r)) == 1), lines) if once else F.array_distinct(lines)
    n = bind(F.size, kept)
    out = Grid(F.flatten(kept), n, g.width, g.lanes)
    out = _turned(out) if flip else out
    return _sized(out.cells, out.height, out.width, first_error(bad(clash, "#UNSUPPORTED!"), bad(n == 0, "#CALC!")), g.lanes)


tree("OFFSET", 3, 5)(lambda c, a, env: error("#UNSUPPORTED!"))
tree("INDIRECT", 1, 2)(lambda c, a, env: c.compile(__import__("sheetwise.plans.parser", fromlist=["parse"]).parse(a[0][1]), env) if a[0][0] == "str" else error("#UNSUPPORTED!"))
__all__ = ["FUNCTIONS", "date_of", "whole"]
