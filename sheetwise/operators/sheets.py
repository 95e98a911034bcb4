"""Recalculation of workbooks.

Cells are rows (CELLS of sources.xlsx), of any number of books. The order of work comes from each book's graph of
references, which one task lays out (a package's caps bound a book); cells on a cycle are refused. Then all formulas
of a level, over all books, are computed at once: references are resolved by joins on (book, sheet, row, column), and
each distinct relative formula is one expression. So the number of jobs follows the depth of the graph, not the number
of cells: a formula that was filled down a million rows is one column.

What depends on the number of distinct relative formulas is held by the driver (their texts and trees, and which kinds
of values their references hold). A book deeper than MOST_LEVELS, such as a long running balance by cell references,
gets #RESOURCE! from there on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cells import RESULT, compiled
from ..plans.references import COLUMNS, ROWS, Program
from ._parts import stored

MOST_LEVELS = 200
#: Formulas that are branches of one projection.
BRANCHES = 100
#: How often arrays that spill into cells which others read may change the order of work.
PASSES = 8

VALUES = "book string, sheet string, r int, c int, n double, s string, b boolean, err string, h boolean, t boolean, owner_r int, owner_c int, formula boolean"
_LEVELS = "book string, sheet string, r int, c int, pid int, level int, dirty boolean"


def _programs(formulas: DataFrame) -> tuple[list[Program], list[bool], DataFrame]:
    """Distinct relative formulas, and formulas (of them) with their number."""
    spark = formulas.sparkSession
    rows = formulas.select("key", "array").distinct().orderBy("key", "array").collect()
    programs, arrays = [Program.of_key(r.key) for r in rows], [r.array for r in rows]
    numbers = spark.createDataFrame([(r.key, r.array, i) for i, r in enumerate(rows)], "key string, array boolean, pid int")
    return programs, arrays, formulas.join(numbers, ["key", "array"])


def _needs(spark: SparkSession, programs: list[Program]) -> DataFrame:
    rows = [(i, k, n.sheet, n.r0, n.c0, n.r1, n.c1, n.rel_r0, n.rel_c0, n.rel_r1, n.rel_c1, n.spill) for i, p in enumerate(programs) for k, n in enumerate(p.needs)]
    return spark.createDataFrame(rows, "pid int, slot int, nsheet string, a0 int, b0 int, a1 int, b1 int, ra0 boolean, rb0 boolean, ra1 boolean, rb1 boolean, spill boolean")


def _placed(cells: DataFrame, needs: DataFrame) -> DataFrame:
    """(book, sheet, r, c, pid, slot, tsheet, r0, c0, r1, c1, spill): the references of each cell as areas."""
    edge = lambda n, rel, own, size: F.when(F.col(rel), F.pmod(F.col(n) + F.col(own), F.lit(size))).otherwise(F.col(n))
    x0, x1 = edge("a0", "ra0", "r", ROWS), edge("a1", "ra1", "r", ROWS)
    y0, y1 = edge("b0", "rb0", "c", COLUMNS), edge("b1", "rb1", "c", COLUMNS)
    sheet = F.when(F.col("nsheet") == "", F.col("sheet")).otherwise(F.col("nsheet")).alias("tsheet")
    return cells.join(needs, "pid").select("book", "sheet", "r", "c", "pid", "slot", sheet, F.least(x0, x1).alias("r0"), F.least(y0, y1).alias("c0"), F.greatest(x0, x1).alias("r1"), F.greatest(y0, y1).alias("c1"), "spill")


def _levels(book: str, cells, refs, spilled, edited):
    """The level of each formula cell of one book: 0 for those that read no formula, -1 on a cycle, -2 beyond
    MOST_LEVELS; and whether it depends on an edited cell. pandas frames, of one book."""
    n = len(cells)
    cells = cells.reset_index(drop=True)
    sheets = {s: i for i, s in enumerate(dict.fromkeys([*cells["sheet"], *refs["tsheet"], *spilled["sheet"], *edited["sheet"]]))}
    key = lambda sheet, r, c: (sheet.map(sheets).to_numpy(np.int64) * COLUMNS + c.to_numpy(np.int64)) * ROWS + r.to_numpy(np.int64)
    own = key(cells["sheet"], cells["r"], cells["c"]) if n else np.zeros(0, np.int64)
    # what stands in a column of a sheet, in order: formulas, and cells that a formula's array fills
    place, who = own, np.arange(n)
    order = np.argsort(own)
    if len(spilled):
        at = key(spilled["sheet"], spilled["owner_r"], spilled["owner_c"])
        spot = np.minimum(np.searchsorted(own[order], at), max(n - 1, 0))
        ok = own[order][spot] == at if n else np.zeros(len(at), bool)
        place = np.concatenate([place, key(spilled["sheet"], spilled["r"], spilled["c"])[ok]])
        who = np.concatenate([who, order[spot][ok]])
    by = np.argsort(place, kind="stable")
    place, who = place[by], who[by]
    source = np.searchsorted(own[order], key(refs["sheet"], refs["r"], refs["c"])) if len(refs) else np.zeros(0, np.int64)
    source = order[source] if n else source
    heads, tails = [], []
    tsheet = refs["tsheet"].map(sheets).to_numpy(np.int64)
    r0, c0, r1, c1 = (refs[k].to_numpy(np.int64) for k in ("r0", "c0", "r1", "c1"))
    columns = np.unique(place // ROWS)
    for k in range(len(refs)):
        base = tsheet[k] * COLUMNS
        for col in columns[np.searchsorted(columns, base + c0[k]) : np.searchsorted(columns, base + c1[k], "right")]:
            lo, hi = np.searchsorted(place, [col * ROWS + r0[k], col * ROWS + r1[k] + 1])
            if hi > lo:
                found = np.unique(who[lo:hi])
                heads.append(np.full(len(found), source[k]))
                tails.append(found)
    head = np.concatenate(heads) if heads else np.zeros(0, np.int64)  # reads
    tail = np.concatenate(tails) if tails else np.zeros(0, np.int64)  # is read
    pairs = np.unique(head * max(n, 1) + tail)
    head, tail = pairs // max(n, 1), pairs % max(n, 1)

    def peel(src, dst, alive):
        """Rounds in which cells lose their last predecessor; those never freed stay at -1."""
        keep = alive[src] & alive[dst]
        src, dst = src[keep], dst[keep]
        by = np.argsort(src, kind="stable")
        src, dst = src[by], dst[by]
        first = np.searchsorted(src, np.arange(n + 1))
        waiting = np.bincount(dst, minlength=n)
        level = np.full(n, -1)
        front = np.flatnonzero(alive & (waiting == 0))
        step = 0
        while len(front):
            level[front] = step
            size = first[front + 1] - first[front]
            at = np.repeat(first[front] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            out = dst[at]
            np.subtract.at(waiting, out, 1)
            out = np.unique(out)
            front = out[waiting[out] == 0]
            step += 1
        return level

    alive = np.ones(n, bool)
    level = peel(tail, head, alive)
    cyclic = np.zeros(n, bool)
    if (level < 0).any():
        stuck = level < 0
        cyclic = stuck & (peel(head, tail, stuck) < 0)
        free = ~cyclic
        level = np.where(free, peel(tail, head, free), -1)
    deep = level >= MOST_LEVELS
    level = np.where(deep, -2, level)

    dirty = np.ones(n, bool)
    if len(edited):
        changed = key(edited["sheet"], edited["r"], edited["c"])
        dirty = np.isin(own, changed)
        for k in range(len(refs)):
            if not dirty[source[k]]:
                s, c, r = changed // ROWS // COLUMNS, changed // ROWS % COLUMNS, changed % ROWS
                if ((s == tsheet[k]) & (c >= c0[k]) & (c <= c1[k]) & (r >= r0[k]) & (r <= r1[k])).any():
                    dirty[source[k]] = True
        while True:
            more = head[dirty[tail]]
            if dirty[more].all():
                break
            dirty[more] = True
    out = cells[["sheet", "r", "c", "pid"]].copy()
    out.insert(0, "book", book)
    out["level"], out["dirty"] = level, dirty
    return out


def levels(formulas: DataFrame, refs: DataFrame, spilled: DataFrame, edited: DataFrame | None) -> DataFrame:
    """_levels() of every book, each in one task."""
    import pandas as pd

    cols = ["kind", "sheet", "r", "c", "pid", "tsheet", "r0", "c0", "r1", "c1"]
    null = lambda k: F.lit(None).cast("string" if k in ("sheet", "tsheet") else "int").alias(k)

    def part(df: DataFrame, kind: int, **names: str) -> DataFrame:
        return df.select("book", F.lit(kind).alias("kind"), *[F.col(names.get(k, k)).alias(k) if names.get(k, k) in df.columns else null(k) for k in cols[1:]])

    parts = [part(formulas, 0), part(refs, 1), part(spilled, 2, r0="owner_r", c0="owner_c")]
    if edited is not None:
        parts.append(part(edited, 3))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        split = {k: pdf[pdf["kind"] == k] for k in range(4)}
        spill = split[2].rename(columns={"r0": "owner_r", "c0": "owner_c"})
        return _levels(pdf["book"].iloc[0], split[0], split[1], spill, split[3])

    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("book").applyInPandas(one, _LEVELS)


def _inputs(todo: DataFrame, refs: DataFrame, values: DataFrame, used: DataFrame) -> DataFrame:
    """(book, sheet, r, c, pid, slot, cells, height, width, rows, columns) of the references of the cells to do."""
    mine = refs.join(todo.select("book", "sheet", "r", "c"), ["book", "sheet", "r", "c"])
    areas = mine.filter(~F.col("spill")).join(used, ["book", "tsheet"], "left")
    # what lies beyond the last used row or column is blank; small areas are kept whole, so that their shape is known
    whole = (F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1) <= 64
    r1 = F.when(whole, F.col("r1")).otherwise(F.least("r1", F.coalesce("last_r", F.lit(-1))))
    c1 = F.when(whole, F.col("c1")).otherwise(F.least("c1", F.coalesce("last_c", F.lit(-1))))
    height, width = F.greatest(r1 - F.col("r0") + 1, F.lit(0)).cast("long"), F.greatest(c1 - F.col("c0") + 1, F.lit(0)).cast("long")
    areas = areas.select("book", "sheet", "r", "c", "pid", "slot", "tsheet", "r0", "c0", height.alias("height"), width.alias("width"), (F.col("r1") - F.col("r0") + 1).cast("long").alias("rows"), (F.col("c1") - F.col("c0") + 1).cast("long").alias("columns"))
    n = F.col("height") * F.col("width")
    spots = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    spots = areas.select("*", F.explode_outer(spots).alias("pos"))
    spots = spots.withColumns({"tr": (F.col("r0") + F.floor(F.col("pos") / F.greatest("width", F.lit(1)))).cast("int"), "tc": (F.col("c0") + F.col("pos") % F.greatest("width", F.lit(1))).cast("int")})
    got = values.select(F.col("book").alias("vb"), F.col("sheet").alias("vs"), F.col("r").alias("vr"), F.col("c").alias("vc"), "n", "s", "b", "err", "h", "t")
    met = spots.join(got, (F.col("book") == F.col("vb")) & (F.col("tsheet") == F.col("vs")) & (F.col("tr") == F.col("vr")) & (F.col("tc") == F.col("vc")), "left")
    flag = lambda k: F.coalesce(k, F.lit(False)).alias(k)
    cell = F.when(F.col("pos").isNotNull(), F.struct("pos", "n", "s", "b", "err", flag("h"), flag("t")))
    by = ["book", "sheet", "r", "c", "pid", "slot", "height", "width", "rows", "columns"]
    plain = lambda a: F.transform(F.array_sort(a), lambda x: F.struct(*[x[k].alias(k) for k in ("n", "s", "b", "err", "h", "t")]))
    out = met.groupBy(*by).agg(plain(F.collect_list(cell)).alias("cells"))
    spilled = values.filter("owner_r is not null").select(F.col("book").alias("vb"), F.col("sheet").alias("vs"), F.col("r").alias("vr"), F.col("c").alias("vc"), "owner_r", "owner_c", "n", "s", "b", "err", "h", "t")
    regions = mine.filter("spill").join(spilled, (F.col("book") == F.col("vb")) & (F.col("tsheet") == F.col("vs")) & (F.col("r0") == F.col("owner_r")) & (F.col("c0") == F.col("owner_c")), "left")
    # an anchor without a region is #REF!
    cell = F.struct(F.coalesce("vr", F.lit(0)).alias("vr"), F.coalesce("vc", F.lit(0)).alias("vc"), "n", "s", "b", F.when(F.col("vb").isNull(), F.lit("#REF!")).otherwise(F.col("err")).alias("err"), flag("h"), flag("t"))
    tall, wide = (F.coalesce(F.max(v) - F.min(v) + 1, F.lit(1)).cast("long") for v in ("vr", "vc"))
    found = regions.groupBy("book", "sheet", "r", "c", "pid", "slot").agg(plain(F.collect_list(cell)).alias("cells"), tall.alias("height"), wide.alias("width"), tall.alias("rows"), wide.alias("columns"))
    return out.unionByName(found.select(out.columns))


def _held(inputs: DataFrame) -> dict[int, dict[int, str]]:
    """For each formula and slot the lanes that hold something in some cell."""
    any_ = lambda k: F.bool_or(F.exists("cells", lambda x: x[k].isNotNull())).alias(k)
    out: dict[int, dict[int, str]] = {}
    for r in inputs.groupBy("pid", "slot").agg(*[any_(k) for k in ("n", "s", "b", "err")]).collect():  # as many as distinct references
        out.setdefault(r.pid, {})[r.slot] = "".join(k[0] for k in ("n", "s", "b", "err") if r[k])
    return out


def _evaluated(todo: DataFrame, inputs: DataFrame, programs: list[Program], arrays: list[bool], pids: list[int]) -> tuple[DataFrame, bool]:
    """(book, sheet, r, c, out RESULT) of the cells to do, and whether one may have several cells."""
    held = _held(inputs) if any(programs[p].needs for p in pids) else {}
    slot = F.struct(*[F.col(k) for k in ("cells", "height", "width", "rows", "columns")])
    maps = inputs.groupBy("book", "sheet", "r", "c").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot"), slot.alias("v")))).alias("slots"))
    rows = todo.join(maps, ["book", "sheet", "r", "c"], "left")
    parts, many = [], False
    for at in range(0, len(pids), BRANCHES):
        some = pids[at : at + BRANCHES]
        out: Column | None = None
        steps: list[dict[str, Column]] = []
        for p in some:
            col, several, own = compiled(programs[p], arrays[p], held.get(p, {}), f"_x{p}")
            many |= several
            out = (F.when if out is None else out.when)(F.col("pid") == p, col.cast(RESULT))
            for i, step in enumerate(own):
                steps[i:i] = [{}] * (i == len(steps))
                steps[i] = steps[i] | step
        mine = rows if len(pids) <= BRANCHES else rows.filter(F.col("pid").isin(some))
        for step in steps:
            mine = mine.withColumns(step)
        parts.append(mine.select("book", "sheet", "r", "c", "h", "t", out.alias("out")))
    return reduce(lambda a, b: a.unionByName(b), parts), many


def _spread(done: DataFrame, occupied: DataFrame) -> DataFrame:
    """VALUES of computed formulas. An array whose region leaves the sheet or meets something gives #SPILL!."""
    cells = done.select("book", "sheet", F.col("r").alias("owner_r"), F.col("c").alias("owner_c"), "h", "t", F.size("out").alias("size"), F.explode("out").alias("x"))
    cells = cells.select("*", (F.col("owner_r") + F.col("x.i")).alias("r"), (F.col("owner_c") + F.col("x.j")).alias("c"))
    others = cells.filter((F.col("x.i") > 0) | (F.col("x.j") > 0))
    off = others.filter((F.col("r") >= ROWS) | (F.col("c") >= COLUMNS)).select("book", "sheet", "owner_r", "owner_c")
    met = others.join(occupied, ["book", "sheet", "r", "c"]).select("book", "sheet", "owner_r", "owner_c")
    # two arrays that want one cell block each other
    twice = others.groupBy("book", "sheet", "r", "c").agg(F.count("*").alias("k")).filter("k > 1").select("book", "sheet", "r", "c")
    both = others.join(twice, ["book", "sheet", "r", "c"]).select("book", "sheet", "owner_r", "owner_c")
    blocked = off.union(met).union(both).distinct().withColumn("blocked", F.lit(True))
    cells = cells.join(blocked, ["book", "sheet", "owner_r", "owner_c"], "left")
    first = (F.col("x.i") == 0) & (F.col("x.j") == 0)
    stop = F.coalesce("blocked", F.lit(False))
    cells = cells.filter(first | ~stop)
    lane = lambda k: F.when(~stop, F.col(f"x.{k}")).alias(k)
    whole = F.col("size") > 1
    region = lambda k: F.when(whole & ~stop, F.col(k)).alias(k)
    return cells.select("book", "sheet", "r", "c", lane("n"), lane("s"), lane("b"), F.when(stop, F.lit("#SPILL!")).otherwise(F.col("x.err")).alias("err"), F.when(first, F.col("h")).otherwise(False).alias("h"), "t", region("owner_r"), region("owner_c"), first.alias("formula"))


def references(cells: DataFrame) -> DataFrame:
    """(book, sheet, r, c, pid, slot, tsheet, r0, c0, r1, c1, spill): the areas that the formulas of CELLS refer to."""
    formulas = cells.filter("kind in ('normal', 'shared', 'array', 'table') and key is not null").select("book", F.lower("sheet").alias("sheet"), "r", "c", "key", (F.col("kind") == "array").alias("array"))
    programs, _, numbered = _programs(formulas)
    return _placed(numbered, _needs(cells.sparkSession, programs))


def recalculate(cells: DataFrame, edited: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """VALUES of every cell of the books: stored ones, computed ones (formula) and those that arrays fill. cells: CELLS.
    edited: (book, sheet, r, c) that changed since `before` was computed; only what depends on them is computed again.

    A formula that can't be read, or that the engine declines, is #UNSUPPORTED!, as is a cell on a cycle. A cell that
    a formula's text refers to on a missing sheet is #REF!. Sheets are told apart without case."""
    spark = cells.sparkSession
    lower = F.lower("sheet").alias("sheet")
    none = lambda k, t: F.lit(None).cast(t).alias(k)
    fixed = cells.filter("kind = 'value' and (n is not null or s is not null or b is not null or err is not null)")
    base = fixed.select("book", lower, "r", "c", "n", "s", "b", "err", F.coalesce("hidden", F.lit(False)).alias("h"), F.lit(False).alias("t"), none("owner_r", "int"), none("owner_c", "int"), F.lit(False).alias("formula"))
    written = cells.filter("kind in ('normal', 'shared', 'array', 'table')")
    formulas = written.filter("key is not null").select("book", lower, "r", "c", "key", (F.col("kind") == "array").alias("array"), F.coalesce("hidden", F.lit(False)).alias("h"))
    programs, arrays, numbered = _programs(formulas)
    subtotals = [i for i, p in enumerate(programs) if "SUBTOTAL" in p.calls()]
    todo = stored(numbered.select("book", "sheet", "r", "c", "pid", "h", F.col("pid").isin(subtotals).alias("t")))
    refused = written.filter("key is null").select("book", lower, "r", "c", none("n", "double"), none("s", "string"), none("b", "boolean"), F.lit("#UNSUPPORTED!").alias("err"), F.coalesce("hidden", F.lit(False)).alias("h"), F.lit(False).alias("t"), none("owner_r", "int"), none("owner_c", "int"), F.lit(True).alias("formula"))
    start = stored(base.unionByName(refused))
    sheets = cells.filter("sheet is not null").select("book", F.lower("sheet").alias("tsheet")).distinct()
    refs = stored(_placed(todo, _needs(spark, programs)))
    missing = refs.join(sheets, ["book", "tsheet"], "left_anti").select("book", "sheet", "r", "c").distinct().withColumn("gone", F.lit(True))
    spilled = start.filter("false").select("book", "sheet", "r", "c", "owner_r", "owner_c")
    occupied = start.select("book", "sheet", "r", "c").union(todo.select("book", "sheet", "r", "c"))
    mark = None
    values = start
    for _ in range(PASSES):
        plan = stored(levels(todo, refs, spilled, edited).join(missing, ["book", "sheet", "r", "c"], "left").join(todo.select("book", "sheet", "r", "c", "h", "t"), ["book", "sheet", "r", "c"]))
        values = start
        wrong = F.when(F.col("gone"), F.lit("#REF!")).when(F.col("level") == -2, F.lit("#RESOURCE!")).otherwise(F.lit("#UNSUPPORTED!"))
        known = plan.filter("gone or level < 0").select("book", "sheet", "r", "c", none("n", "double"), none("s", "string"), none("b", "boolean"), wrong.alias("err"), "h", "t", none("owner_r", "int"), none("owner_c", "int"), F.lit(True).alias("formula"))
        values = values.unionByName(known)
        work = plan.filter("gone is null and level >= 0")
        if before is not None and edited is not None:
            clean = work.filter("not dirty").select("book", "sheet", "r", "c")
            same = before.join(clean.select("book", "sheet", F.col("r").alias("ar"), F.col("c").alias("ac")), ["book", "sheet"]).filter("coalesce(owner_r, r) = ar and coalesce(owner_c, c) = ac").drop("ar", "ac")
            values = stored(values.unionByName(same.select(values.columns)))
            work = work.filter("dirty")
        else:
            values = stored(values) if programs else values
        steps = work.groupBy("level").agg(F.sort_array(F.collect_set("pid")).alias("pids")).orderBy("level").collect()  # distinct formulas by level
        for step in steps:
            own = work.filter(F.col("level") == step.level).select("book", "sheet", "r", "c", "pid", "h", "t")
            used = values.groupBy("book", F.col("sheet").alias("tsheet")).agg(F.max("r").alias("last_r"), F.max("c").alias("last_c"))
            inputs = stored(_inputs(own, refs, values, used)) if any(programs[p].needs for p in step.pids) else spark.createDataFrame([], "book string, sheet string, r int, c int, pid int, slot int, cells array<struct<n:double,s:string,b:boolean,err:string,h:boolean,t:boolean>>, height long, width long, rows long, columns long")
            done, many = _evaluated(own, inputs, programs, arrays, list(step.pids))
            if many:
                fresh = _spread(stored(done), occupied.union(values.select("book", "sheet", "r", "c")).distinct())
            else:
                x = F.col("out")[0]
                fresh = done.select("book", "sheet", "r", "c", x["n"].alias("n"), x["s"].alias("s"), x["b"].alias("b"), x["err"].alias("err"), "h", "t", none("owner_r", "int"), none("owner_c", "int"), F.lit(True).alias("formula"))
            values = values.unionByName(stored(fresh.select(values.columns)))
        arrays_now = values.filter("owner_r is not null and not formula").select("book", "sheet", "r", "c", "owner_r", "owner_c")
        now = arrays_now.agg(F.count("*"), F.sum(F.xxhash64(*arrays_now.columns).cast("decimal(38,0)"))).first() if programs else (0, None)
        if not now[0] or tuple(now) == mark:
            break
        mark, spilled, edited = tuple(now), stored(arrays_now), None
    return values
