"""Queries over workbooks that are built from the tables, one for each part of the reader, the recalculation and the
verifier, each with the same result in SQL.

Books are built by Spark, a book in a task, from the rows of a nation or region; then they are read back as packages.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import verify as V
from .operators.sheets import recalculate
from .sources.package import build
from .sources.xlsx import Caps, read_cells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PACKAGES = "path string, content binary"


def _f(text: str | None = None, v=None, **more) -> dict:
    return ({"f": text} if text is not None else {}) | {"v": v} | more


def books(rows: DataFrame, by: str, make: Callable[[list], bytes], order: str) -> DataFrame:
    """A package for each group of rows: make(rows in order) gives its bytes."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({"path": [f"{by}{pdf[by].iloc[0]}"], "content": [make(pdf.to_dict("records"))]})

    return rows.groupBy(by).applyInPandas(one, PACKAGES)


def query(name: str, sql: str):
    def add(fn):
        def run(spark, sf_dir):
            out = fn(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
            return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        QUERIES[name], SQL[name] = run, sql
        return fn

    return add


def _values(cells: DataFrame) -> DataFrame:
    """The formula cells and arrays of recalculated books."""
    got = recalculate(cells)
    return got.filter("formula or owner_r is not null").select("book", "sheet", "r", "c", "n", "s", "b", "err")


_NATIONS = "(SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, 'n_regionkey' || n_regionkey AS book FROM nation)"


# -- reading -------------------------------------------------------------------------------------------------------------


def _plain(rows: list) -> bytes:
    cells: dict = {(0, 0): "key", (0, 1): "name", (0, 2): "even"}
    for i, x in enumerate(rows, 1):
        cells |= {(i, 0): int(x["n_nationkey"]), (i, 1): x["n_name"], (i, 2): bool(x["n_nationkey"] % 2 == 0)}
    return build({"Nations": cells, "Empty": {}}, hidden={"Nations": {2}})


@query("src_xlsx_cells", f"""SELECT book, 'Nations' AS sheet, CAST(i AS INT) AS r, CAST(x.c AS INT) AS c, CASE WHEN x.c = 0 THEN CAST(n_nationkey AS DOUBLE) END AS n, CASE WHEN x.c = 1 THEN n_name END AS s, CASE WHEN x.c = 2 THEN n_nationkey % 2 = 0 END AS b, i = 2 AS hidden
FROM {_NATIONS} CROSS JOIN (VALUES (0), (1), (2)) x(c)
UNION ALL SELECT DISTINCT 'n_regionkey' || n_regionkey, 'Nations', 0, CAST(x.c AS INT), CAST(NULL AS DOUBLE), x.s, CAST(NULL AS BOOLEAN), false FROM nation CROSS JOIN (VALUES (0, 'key'), (1, 'name'), (2, 'even')) x(c, s)""")
def _xlsx_cells(t):
    return read_cells(books(t("nation"), "n_regionkey", _plain, "n_nationkey")).filter("kind = 'value'").select("book", "sheet", "r", "c", "n", "s", "b", "hidden")


def _typed(rows: list) -> bytes:
    cells: dict = {}
    for i, x in enumerate(rows, 1):
        k, name = int(x["n_nationkey"]), x["n_name"]
        raw = [f'<c r="A{i}" t="inlineStr"><is><r><t>{name[:2]}</t></r><r><t>{name[2:]}</t></r><rPh><t>x</t></rPh></is></c>', f'<c r="B{i}" t="str"><v>{name}_x0041_</v></c>', f'<c r="C{i}" t="b"><v>{k % 2}</v></c>', f'<c r="D{i}" t="e"><v>#N/A</v></c>', f'<c r="E{i}" t="d"><v>2020-01-{k + 1:02d}</v></c>', f'<c r="F{i}" t="n"><v>{k}e1</v></c>', f'<c r="G{i}"/>']
        cells |= {(i - 1, j): {"xml": r} for j, r in enumerate(raw)}
    return build({"Types": cells})


@query("src_cell_types", f"""SELECT book, CAST(i - 1 AS INT) AS r, max(CASE WHEN c = 0 THEN n_name END) AS inline, max(CASE WHEN c = 1 THEN n_name || 'A' END) AS str, bool_or(c = 2 AND n_nationkey % 2 = 1) AS logical, max(CASE WHEN c = 3 THEN '#N/A' END) AS error, max(CASE WHEN c = 4 THEN '#UNSUPPORTED!' END) AS date, max(CASE WHEN c = 5 THEN n_nationkey * 10.0 END)::DOUBLE AS number, count(*) AS cells
FROM {_NATIONS} CROSS JOIN (SELECT unnest(range(7)) AS c) GROUP BY book, i""")
def _cell_types(t):
    cells = read_cells(books(t("nation"), "n_regionkey", _typed, "n_nationkey")).filter("kind = 'value'")
    at = lambda c, k: F.max(F.when(F.col("c") == c, F.col(k)))
    return cells.groupBy("book", "r").agg(at(0, "s").alias("inline"), at(1, "s").alias("str"), at(2, "b").alias("logical"), at(3, "err").alias("error"), at(4, "err").alias("date"), at(5, "n").alias("number"), F.count("*").alias("cells"))


#: One small cap of each kind is what a hostile package here breaks.
SMALL_CAPS = Caps(total=40_000, part=30_000, parts=12, ratio=50, depth=20)


def _hostile(rows: list) -> bytes:
    k = int(rows[0]["n_nationkey"]) % 12
    one = {(0, 0): 1}
    whole = build({"S": one})
    main = "xl/worksheets/sheet1.xml"
    bad = {2: b"<!DOCTYPE x><worksheet/>", 3: b"<worksheet>" * 30 + b"</worksheet>" * 30, 4: b'<worksheet><sheetData><row r="1"><c r="A1"/><c r="A1"/></row></sheetData></worksheet>', 5: b'<worksheet><sheetData><row r="1"><c r="1A"/></row></sheetData></worksheet>', 6: b"<worksheet>" + b" " * 29_000 + b"</worksheet>", 7: b"<worksheet><sheetData>", 8: bytes((i * 7919 + i // 251 * 13) % 251 + 1 for i in range(31_000)), 9: b'<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>9</v></c></row></sheetData></worksheet>'}
    if k == 0:
        return whole
    if k == 1:
        return whole[: len(whole) // 2]
    if k == 10:
        return build({"S": one}, extra={f"extra/{i}": b"" for i in range(9)})
    if k == 11:
        out = BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("readme.txt", "no workbook")
        return out.getvalue()
    return build({"S": one}, extra={main: bad[k]})


@query("src_caps", """SELECT 'n_nationkey' || n_nationkey AS book, CASE n_nationkey % 12 WHEN 0 THEN 'none' WHEN 1 THEN 'zip' WHEN 2 THEN 'doctype' WHEN 3 THEN 'cap_depth' WHEN 6 THEN 'cap_ratio' WHEN 7 THEN 'xml' WHEN 8 THEN 'cap_part' WHEN 10 THEN 'cap_parts' ELSE 'structure' END AS problem FROM nation""")
def _caps(t):
    cells = read_cells(books(t("nation"), "n_nationkey", _hostile, "n_nationkey"), SMALL_CAPS)
    return cells.groupBy("book").agg(F.coalesce(F.max(F.when(F.col("kind") == "error", F.col("problem"))), F.lit("none")).alias("problem"))


# -- recalculation -------------------------------------------------------------------------------------------------------


def _shared(rows: list) -> bytes:
    cells: dict = {(0, 0): "key", (0, 2): 7}
    for i, x in enumerate(rows, 1):
        cells[(i, 0)] = int(x["n_nationkey"])
        cells[(i, 1)] = _f("A2*2+$C$1+ROW()", None, t="shared", si=0, ref=f"B2:B{len(rows) + 1}") if i == 1 else {"t": "shared", "si": 0}
    return build({"S": cells})


@query("wb_shared_formulas", f"SELECT book, CAST(i AS INT) AS r, CAST(n_nationkey * 2 + 7 + i + 1 AS DOUBLE) AS n FROM {_NATIONS}")
def _shared_formulas(t):
    return _values(read_cells(books(t("nation"), "n_regionkey", _shared, "n_nationkey"))).select("book", "r", "n")


def _accounts(rows: list) -> bytes:
    data: dict = {(0, 0): "key", (0, 1): "balance", (0, 2): "segment"}
    for i, x in enumerate(rows, 1):
        data |= {(i, 0): int(x["c_custkey"]), (i, 1): float(x["c_acctbal"]), (i, 2): x["c_mktsegment"]}
    sums = {
        (0, 0): _f("SUM(Data!B:B)"), (0, 1): _f("AVERAGE(Data!B:B)"), (0, 2): _f('COUNTIF(Data!C:C,"BUILDING")'), (0, 3): _f('SUMIFS(Data!B:B,Data!C:C,"BUILDING",Data!B:B,">0")'),
        (1, 0): _f("A1/COUNT(Data!B:B)"), (1, 1): _f("ROUND(A2-B1,6)=0"), (1, 2): _f("MAX(Data!B2:B100000)"), (1, 3): _f("IF(C2>A2,\"above\",\"below\")"),
        (2, 0): _f("VLOOKUP(MAX(Data!A:A),Data!A:C,3,FALSE)"), (2, 1): _f("INDEX(Data!B:B,MATCH(MAX(Data!A:A),Data!A:A,0))"), (2, 2): _f("SUMPRODUCT((Data!B2:B100000>0)*1)"), (2, 3): _f("XLOOKUP(-1,Data!A:A,Data!B:B,\"none\")"),
        (3, 0): _f("SUBTOTAL(9,Data!B:B)"), (3, 1): _f("LARGE(Data!B:B,1)-C2"), (3, 2): _f("MEDIAN(Data!B:B)"), (3, 3): _f("ROWS(Data!A:A)+COLUMNS(Data!A1:C1)"),
    }
    return build({"Data": data, "Sums": sums})


@query("wb_recalculation", """WITH a AS (SELECT c_nationkey, sum(c_acctbal) AS a1, avg(c_acctbal) AS b1, count(*) FILTER (c_mktsegment = 'BUILDING') AS c1, coalesce(sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 0), 0) AS d1, max(c_acctbal) AS c2, max_by(c_mktsegment, c_custkey) AS a3, max_by(c_acctbal, c_custkey) AS b3, count(*) FILTER (c_acctbal > 0) AS c3, median(c_acctbal) AS c4 FROM customer GROUP BY c_nationkey)
SELECT 'c_nationkey' || c_nationkey AS book, round(a1, 6) AS total, round(b1, 6) AS mean, CAST(c1 AS DOUBLE) AS building, round(d1, 6) AS positive, round(b1, 6) AS again, true AS same, c2 AS most, CASE WHEN c2 > b1 THEN 'above' ELSE 'below' END AS side, a3 AS segment, b3 AS last, CAST(c3 AS DOUBLE) AS above_zero, 'none' AS missing, round(a1, 6) AS subtotal, CAST(0 AS DOUBLE) AS gap, round(c4, 6) AS middle, CAST(1048579 AS DOUBLE) AS size FROM a""")
def _recalculation(t):
    got = _values(read_cells(books(t("customer"), "c_nationkey", _accounts, "c_custkey")))
    at = lambda r, c, k: F.max(F.when((F.col("r") == r) & (F.col("c") == c), F.col(k)))
    names = {"total": (0, 0, "n"), "mean": (0, 1, "n"), "building": (0, 2, "n"), "positive": (0, 3, "n"), "again": (1, 0, "n"), "same": (1, 1, "b"), "most": (1, 2, "n"), "side": (1, 3, "s"), "segment": (2, 0, "s"), "last": (2, 1, "n"), "above_zero": (2, 2, "n"), "missing": (2, 3, "s"), "subtotal": (3, 0, "n"), "gap": (3, 1, "n"), "middle": (3, 2, "n"), "size": (3, 3, "n")}
    return got.groupBy("book").agg(*[at(*v).alias(k) for k, v in names.items()])


def _chain(rows: list) -> bytes:
    cells: dict = {}
    for i, x in enumerate(rows):
        cells[(i, 0)] = int(x["n_nationkey"])
        cells[(i, 1)] = _f("A1" if i == 0 else f"B{i}+A{i + 1}")  # a running sum by references
        cells[(i, 2)] = _f(f"SUM($A$1:A{i + 1})-B{i + 1}")
        cells[(i, 3)] = _f(f"E{i + 1}+1")
        cells[(i, 4)] = _f(f"D{i + 1}" if i % 2 else f"A{i + 1}")
        cells[(i, 5)] = _f(f'IFERROR(D{i + 1},"caught")')
    return build({"Run": cells}, iterate=True)


@query("wb_levels_and_cycles", f"SELECT book, CAST(i - 1 AS INT) AS r, CAST(sum(n_nationkey) OVER (PARTITION BY book ORDER BY i) AS DOUBLE) AS running, CAST(0 AS DOUBLE) AS gap, CASE WHEN i % 2 = 1 THEN CAST(n_nationkey + 1 AS DOUBLE) END AS free, CASE WHEN i % 2 = 0 THEN '#UNSUPPORTED!' END AS cycle, CASE WHEN i % 2 = 0 THEN '#UNSUPPORTED!' END AS uncaught FROM {_NATIONS}")
def _cycles(t):
    got = _values(read_cells(books(t("nation"), "n_regionkey", _chain, "n_nationkey")))
    at = lambda c, k: F.max(F.when(F.col("c") == c, F.col(k)))
    return got.groupBy("book", "r").agg(at(1, "n").alias("running"), at(2, "n").alias("gap"), at(3, "n").alias("free"), at(3, "err").alias("cycle"), at(5, "err").alias("uncaught"))


def _arrays(rows: list) -> bytes:
    cells: dict = {}
    n = len(rows)
    for i, x in enumerate(rows):
        cells |= {(i, 0): int(x["n_nationkey"]), (i, 1): x["n_name"]}
    cells |= {
        (0, 3): _f(f"SORT(A1:B{n},1,-1)"), (0, 6): _f("SUM(D1#)"), (0, 7): _f("D2"), (0, 8): _f(f"FILTER(A1:A{n},A1:A{n}>10,-1)"), (0, 10): _f("SEQUENCE(3)"), (2, 10): 99,
        (0, 11): _f(f"COUNTA(UNIQUE(B1:B{n}))"), (0, 12): _f("ROWS(ANCHORARRAY(D1))"), (0, 13): _f("A1:A2*2", None, t="array", ref="N1:N2"), (4, 13): _f(f"@A1:A{n}"),
    }
    return build({"S": cells})


@query("wb_spilled_arrays", f"""WITH n AS {_NATIONS}, d AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n_nationkey DESC) AS j, count(*) OVER (PARTITION BY book) AS k FROM n), f AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY i) AS j, n_nationkey FROM n WHERE n_nationkey > 10)
SELECT book, CAST(j - 1 AS INT) AS r, 3 AS c, CAST(n_nationkey AS DOUBLE) AS n, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS err FROM d
UNION ALL SELECT book, CAST(j - 1 AS INT), 4, CAST(NULL AS DOUBLE), n_name, NULL FROM d
UNION ALL SELECT book, 0, 6, CAST(sum(n_nationkey) AS DOUBLE), NULL, NULL FROM n GROUP BY book
UNION ALL SELECT book, 0, 7, CAST(n_nationkey AS DOUBLE), NULL, NULL FROM d WHERE j = 2
UNION ALL SELECT book, CAST(j - 1 AS INT), 8, CAST(n_nationkey AS DOUBLE), NULL, NULL FROM f
UNION ALL SELECT book, 0, 8, -1, NULL, NULL FROM n GROUP BY book HAVING max(n_nationkey) <= 10
UNION ALL SELECT book, 0, 10, NULL, NULL, '#SPILL!' FROM n GROUP BY book
UNION ALL SELECT book, 0, 11, CAST(count(DISTINCT n_name) AS DOUBLE), NULL, NULL FROM n GROUP BY book
UNION ALL SELECT book, 0, 12, CAST(count(*) AS DOUBLE), NULL, NULL FROM n GROUP BY book
UNION ALL SELECT book, CAST(i - 1 AS INT), 13, CAST(n_nationkey * 2 AS DOUBLE), NULL, NULL FROM n WHERE i <= 2
UNION ALL SELECT book, 4, 13, CAST(n_nationkey AS DOUBLE), NULL, NULL FROM n WHERE i = 5""")
def _spilled(t):
    return _values(read_cells(books(t("nation"), "n_regionkey", _arrays, "n_nationkey"))).select("book", "r", "c", "n", "s", "err")


def _moved(rows: list) -> bytes:
    cells: dict = {(0, 0): "key"}
    for i, x in enumerate(rows, 1):
        cells |= {(i, 0): int(x["n_nationkey"]), (i, 1): _f(f"OFFSET(A{i + 1},-1,0)"), (i, 2): _f("INDIRECT(\"R[0]C1\",FALSE)*10"), (i, 3): _f("SUM(OFFSET($A$1,1,0,2,1))"), (i, 4): _f("INDIRECT(\"[x]S!A1\")"), (i, 5): _f("OFFSET(A1,-1,0)"), (i, 6): _f("first+Nowhere!A1")}
    return build({"S": cells}, names={"first": "S!$A$2"})


@query("wb_offset_indirect", f"""SELECT book, CAST(i AS INT) AS r, CAST(lag(n_nationkey) OVER w AS DOUBLE) AS above, CASE WHEN i = 1 THEN 'key' END AS heading, CAST(n_nationkey * 10 AS DOUBLE) AS ten, CAST(sum(CASE WHEN i <= 2 THEN n_nationkey END) OVER (PARTITION BY book) AS DOUBLE) AS two, '#REF!' AS outside, '#REF!' AS off, '#REF!' AS nowhere FROM {_NATIONS} WINDOW w AS (PARTITION BY book ORDER BY i)""")
def _offset(t):
    got = _values(read_cells(books(t("nation"), "n_regionkey", _moved, "n_nationkey")))
    at = lambda c, k: F.max(F.when(F.col("c") == c, F.col(k)))
    return got.groupBy("book", "r").agg(at(1, "n").alias("above"), at(1, "s").alias("heading"), at(2, "n").alias("ten"), at(3, "n").alias("two"), at(4, "err").alias("outside"), at(5, "err").alias("off"), at(6, "err").alias("nowhere"))


def _ledger(rows: list) -> bytes:
    cells: dict = {}
    for i, x in enumerate(rows):
        cells |= {(i, 0): int(x["n_nationkey"]), (i, 1): _f(f"A{i + 1}*A{i + 1}")}
    cells |= {(0, 3): _f("SUM(B:B)"), (0, 4): _f("D1+1"), (1, 3): _f("COUNT(A:A)")}
    return build({"S": cells})


@query("wb_edit", f"""WITH n AS (SELECT *, CASE WHEN i = 1 THEN 100 ELSE n_nationkey END AS v FROM {_NATIONS})
SELECT book, CAST(sum(v * v) AS DOUBLE) AS total, CAST(sum(v * v) + 1 AS DOUBLE) AS next, CAST(count(*) AS DOUBLE) AS k, CAST(10000 AS DOUBLE) AS first FROM n GROUP BY book""")
def _edit(t):
    from .operators._parts import stored

    cells = stored(read_cells(books(t("nation"), "n_regionkey", _ledger, "n_nationkey")))
    before = stored(recalculate(cells))
    spot = (F.col("r") == 0) & (F.col("c") == 0)
    changed = cells.withColumn("n", F.when(spot, 100.0).otherwise(F.col("n")))
    edited = cells.filter(spot).select("book", F.lower("sheet").alias("sheet"), "r", "c")
    got = recalculate(changed, edited, before).filter("formula")
    at = lambda r, c: F.max(F.when((F.col("r") == r) & (F.col("c") == c), F.col("n")))
    return got.groupBy("book").agg(at(0, 3).alias("total"), at(0, 4).alias("next"), at(1, 3).alias("k"), at(0, 1).alias("first"))


# -- verification ----------------------------------------------------------------------------------------------------------


def _stale(rows: list) -> bytes:
    """Stored values that are right, stale, missing, or of formulas that can't be computed, by nation."""
    cells: dict = {(0, 9): "x"}
    for i, x in enumerate(rows):
        k = int(x["n_nationkey"])
        right = [k * 2.0, k * 2.0 + 1, None, k * 2.0, k * 2.0 + 1e-15 * max(1, k), float(k)][k % 6]
        text = ["A{0}*2", "A{0}*2", "A{0}*2", "NOSUCHTHING(A{0},RANDARRAY())+RANDARRAY()", "A{0}*2", "VLOOKUP(\"zz\",J1:J1,1,FALSE)"][k % 6].format(i + 1)
        cells |= {(i, 0): k, (i, 1): _f(text, right)}
    return build({"S": cells})


_STATUS = "CASE n_nationkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'no_oracle' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'exact' ELSE 'mismatch' END"


@query("verify_diff", f"SELECT book, CAST(i - 1 AS INT) AS r, {_STATUS} AS status FROM {_NATIONS}")
def _diff(t):
    cells = read_cells(books(t("nation"), "n_regionkey", _stale, "n_nationkey"))
    return V.diff(cells, recalculate(cells), digits15=True).select("book", "r", "status")


@query("verify_fidelity", f"""WITH s AS (SELECT book, {_STATUS} AS status FROM {_NATIONS}), k AS (SELECT book, count(*) AS formula_cells, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'mismatch') AS mismatch, count(*) FILTER (status = 'no_oracle') AS no_oracle FROM s GROUP BY book)
SELECT *, round(CASE WHEN formula_cells > no_oracle THEN 100.0 * exact / (formula_cells - no_oracle) END, 6)::DOUBLE AS strict_pct FROM k""")
def _fidelity(t):
    cells = read_cells(books(t("nation"), "n_regionkey", _stale, "n_nationkey"))
    return V.fidelity(V.diff(cells, recalculate(cells), digits15=True)).select("book", "formula_cells", "exact", "mismatch", "no_oracle", "strict_pct")


@query("corpus_mismatches", f"SELECT book, CAST(i - 1 AS INT) AS r, CASE n_nationkey % 6 WHEN 5 THEN 'number>error' WHEN 3 THEN 'number>error' ELSE 'number>number' END AS change, CASE n_nationkey % 6 WHEN 5 THEN 'lookup_actual_na' WHEN 3 THEN 'expected_value' ELSE CASE WHEN 1.0 / (n_nationkey * 2 + 1) >= 0.01 THEN 'numeric_gross' ELSE 'numeric_mid' END END AS pattern FROM {_NATIONS} WHERE {_STATUS} = 'mismatch'")
def _mismatches(t):
    cells = read_cells(books(t("nation"), "n_regionkey", _stale, "n_nationkey"))
    return V.mismatches(V.diff(cells, recalculate(cells), digits15=True)).select("book", "r", "change", "pattern")


@query("corpus_narrow", f"SELECT book, CAST(i - 1 AS INT) AS r, n_nationkey % 6 <> 3 AS eligible, n_nationkey % 6 <> 3 AS supported, bool_and(n_nationkey % 6 <> 3) OVER (PARTITION BY book) AS book_eligible FROM {_NATIONS}")
def _narrow(t):
    cells = read_cells(books(t("nation"), "n_regionkey", _stale, "n_nationkey"))
    return V.narrow(V.diff(cells, recalculate(cells))).select("book", "r", "eligible", "supported", "book_eligible")


def _declined(rows: list) -> bytes:
    cells: dict = {}
    for i, x in enumerate(rows):
        k = int(x["n_nationkey"])
        text = ["[1]Other!A1", "WEBSERVICE(\"u\")", "TODAY()", "RANDARRAY()", "D9+1"][k % 5]
        cells |= {(i, 0): _f(text, 1.0), (i, 1): _f(f"A{i + 1}+1", 2.0), (i, 2): _f(f"SUM(A{i + 1}:B{i + 1})", 3.0)}
    cells |= {(8, 3): _f("D9", 0.0)}
    return build({"S": cells})


@query("corpus_declines", f"""SELECT book, CAST(i - 1 AS INT) AS r, x.c, CASE n_nationkey % 5 WHEN 0 THEN 'external' WHEN 1 THEN 'blocked_io' WHEN 2 THEN 'volatile' WHEN 3 THEN 'volatile' ELSE 'other' END AS cause, x.c = 0 AND n_nationkey % 5 <> 4 OR n_nationkey % 5 = 1 AS direct FROM {_NATIONS} CROSS JOIN (VALUES (0), (1), (2)) x(c)
UNION ALL SELECT DISTINCT book, 8, 3, 'other', false FROM {_NATIONS}""")
def _declines(t):
    from .operators._parts import stored
    from .operators.sheets import references

    cells = stored(read_cells(books(t("nation"), "n_regionkey", _declined, "n_nationkey")))
    return V.declines(V.diff(cells, recalculate(cells)), references(cells)).select("book", "r", "c", "cause", "direct")


@query("verify_decision", f"""WITH k AS (SELECT book, count(*) AS formula_cells, bool_or(n_nationkey % 6 IN (1, 3, 4, 5)) AS bad FROM {_NATIONS} GROUP BY book)
SELECT book, CASE WHEN bad THEN 'FAIL' ELSE 'PASS' END AS decision, CASE WHEN bad THEN 1 ELSE 0 END AS exit_code, formula_cells FROM k""")
def _decision(t):
    cells = read_cells(books(t("nation"), "n_regionkey", _stale, "n_nationkey"))
    return V.verify(cells)[0].select("book", "decision", "exit_code", "formula_cells")


@query("verify_policy", """SELECT 'n_regionkey' || n_regionkey AS book, 'assertion_failed' AS code, CAST(count(*) AS BIGINT) AS k FROM nation WHERE n_nationkey * n_nationkey > 100 GROUP BY 1
UNION ALL SELECT DISTINCT 'n_regionkey' || n_regionkey, 'excel_evidence_required', 1 FROM nation""")
def _policy(t):
    policy = V.parse_policy('require_excel_result = true\n[[assertions]]\nsheet = "S"\nrange = "B1:B5"\noperator = "between_number"\nvalue = "0"\nupper = "100"\n')
    cells = read_cells(books(t("nation"), "n_regionkey", _ledger, "n_nationkey"))
    return V.verify(cells, policy=policy)[1].groupBy("book", "code").agg(F.count("*").alias("k"))


@query("corpus_fingerprint", f"SELECT book, CAST(count(*) + 3 AS BIGINT) AS n_cells, book = 'n_regionkey2' AS changed FROM {_NATIONS} GROUP BY book")
def _fingerprint(t):
    from .operators._parts import stored

    cells = stored(read_cells(books(t("nation"), "n_regionkey", _ledger, "n_nationkey")))
    changed = cells.withColumn("n", F.when((F.col("book") == "n_regionkey2") & (F.col("r") == 0) & (F.col("c") == 0), -3.5).otherwise(F.col("n")))
    a, b = V.fingerprint(recalculate(cells)), V.fingerprint(recalculate(changed)).select("book", F.col("hash").alias("other"))
    return a.join(b, "book").select("book", "n_cells", (F.col("hash") != F.col("other")).alias("changed"))


__all__ = ["QUERIES", "SQL"]
