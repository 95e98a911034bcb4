"""Packages, workbooks, verification."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sheetwise.__main__ import main
from sheetwise.operators import verify as V
from sheetwise.plans.references import compile_text, parse_a1, parse_area
from sheetwise.sources.package import build
from sheetwise.sources.xlsx import CELLS, Caps, LoadError, cell_rows, read_book, read_cells
from sheetwise.workbook import Workbook


def f(text=None, v=None, **more):
    return ({"f": text} if text is not None else {}) | {"v": v} | more


ONE = {(0, 0): 1, (0, 1): "x"}
SHEET = "xl/worksheets/sheet1.xml"


def broken(xml: bytes) -> bytes:
    return build({"S": ONE}, extra={SHEET: xml})


@pytest.mark.parametrize(
    ("kind", "data", "caps"),
    [
        ("zip", b"no package", None), ("zip", b"", None), ("zip", build({"S": ONE})[:300], None), ("structure", build({"S": ONE}, extra={"xl/workbook.xml": b"<workbook><sheets><sheet name='S' r:id='r9'/></sheets></workbook>"}).replace(b"r:id", b"r:id"), None),
        ("doctype", broken(b"<!DOCTYPE a [<!ENTITY b 'c'>]><worksheet>&b;</worksheet>"), None), ("xml", broken(b"<worksheet><sheetData>"), None), ("xml", broken(b"<worksheet>&unknown;</worksheet>"), None),
        ("cap_depth", broken(b"<a>" * 300 + b"</a>" * 300), None), ("cap_parts", build({"S": ONE}), Caps(parts=3)), ("cap_part", build({"S": ONE}), Caps(part=100)), ("cap_total", build({"S": ONE}), Caps(total=500)), ("cap_ratio", broken(b"<worksheet>" + b" " * 10**6 + b"</worksheet>"), None),
        ("structure", broken(b'<worksheet><sheetData><row r="1"><c r="A1"/><c r="A1"/></row></sheetData></worksheet>'), None), ("structure", broken(b'<worksheet><sheetData><row r="1"><c r="XFE1"/></row></sheetData></worksheet>'), None),
        ("structure", broken(b'<worksheet><sheetData><row r="x"/></sheetData></worksheet>'), None), ("structure", broken(b'<worksheet><sheetData><row r="1"><c r="A1" t="q"><v>1</v></c></row></sheetData></worksheet>'), None),
        ("structure", broken(b'<worksheet><sheetData><row r="1"><c r="A1"><v>one</v></c></row></sheetData></worksheet>'), None), ("structure", broken(b'<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>7</v></c></row></sheetData></worksheet>'), None),
    ],
)
def test_hostile_packages(kind, data, caps):
    with pytest.raises(LoadError) as x:
        book = read_book(data, caps)
        assert book.sheets, "a workbook without sheets"
    assert x.value.kind == kind or kind == "structure" and x.value.kind == "xml"


def test_sizes_that_lie_are_found():
    """The directory says 10 bytes, the part unpacks to more."""
    data = bytearray(broken(b"<worksheet>" + b"<a/>" * 30_000 + b"</worksheet>"))
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        assert z.getinfo(SHEET).file_size > 100_000
    with pytest.raises(LoadError) as x:
        read_book(bytes(data), Caps(part=50_000))
    assert x.value.kind == "cap_part"


def test_references():
    assert parse_a1("XFD1048576") == (1048575, 16383) and parse_a1("A0") is None and parse_a1("XFE1") is None and parse_area("C3:A1") == (0, 0, 2, 2)
    down = [compile_text("SUM(A1:B1)*$C$1", 0, 3).key, compile_text("SUM(A2:B2)*$C$1", 1, 3).key]
    assert down[0] == down[1] != compile_text("SUM(A1:B1)*$C$1", 1, 3).key
    program = compile_text("A1+Sheet2!B:B", 0, 0)
    assert program.needs[1].at(5, 5) == (0, 2 - 1 + 5, 1048575, 6) and program.of_key(program.key) == program
    wrapped = compile_text("A1048576", 0, 0).needs[0]
    assert wrapped.at(1, 0) == (0, 0, 0, 0)  # leaves the sheet, comes in again


@pytest.fixture(scope="module")
def budget():
    cells = {(0, 0): "item", (0, 1): "q1", (0, 2): "q2", (0, 3): "sum"}
    for i, (name, a, b) in enumerate([("rent", 100, 110), ("food", 50.5, 49.5), ("fun", 20, None)], 1):
        cells |= {(i, 0): name, (i, 1): a, (i, 2): b, (i, 3): f("SUM(B2:C2)", 210.0 if i == 1 else 100.0 if i == 2 else 20.0, t="shared", si=0, ref="D2:D4") if i == 1 else {"t": "shared", "si": 0, "v": 100.0 if i == 2 else 20.0}}
    cells |= {(4, 3): f("SUM(D2:D4)", 330.0), (5, 3): f('IF(D5>300,"high","low")', "high"), (6, 0): f("SORT(B2:B4)"), (6, 2): f("SUM(A7#)"), (6, 3): f("A8+A9"), (9, 0): f("A11"), (10, 0): f("A10"), (11, 0): f("SUBTOTAL(9,D2:D5)+SUBTOTAL(109,B2:B4)"), (12, 0): f("SUBTOTAL(9,A12,B2)")}
    return build({"Budget": cells, "Other": {(0, 0): f("Budget!D5*rate"), (1, 0): f("SUM(Budget!D:D)")}}, names={"rate": "Budget!$B$4"}, hidden={"Budget": {2}})


def test_workbook(spark, budget):
    w = Workbook.open_bytes(spark, budget).recalc()
    rows = {(r.sheet, r.r, r.c): next((r[k] for k in ("err", "n", "s", "b") if r[k] is not None), None) for r in w.values.collect()}
    at = lambda sheet, ref: rows.get((sheet, *parse_a1(ref)))
    assert w.sheet_names == ["Budget", "Other"]
    assert [at("budget", x) for x in ("D2", "D3", "D4", "D5", "D6")] == [210, 100, 20, 330, "high"]
    assert [at("budget", x) for x in ("A7", "A8", "A9", "C7", "D7")] == [20, 50.5, 100, 170.5, 150.5]
    assert at("budget", "A10") == at("budget", "A11") == "#UNSUPPORTED!"
    assert at("budget", "A12") == 660 + 120 and at("budget", "A13") == 100  # the hidden row isn't in 109, a subtotal not in another
    assert at("other", "A1") == 6600 and at("other", "A2") == 330 + 330 + 150.5
    assert {(r.sheet, r.r, r.c, r.problem) for r in w.diagnostics().collect()} == {("Budget", 9, 0, "unsupported"), ("Budget", 10, 0, "unsupported")}
    w.edit("Budget", "B4", 1000)
    w.edit("Budget", "A10", "=B4+1")
    assert w.value("Budget", "D5") == 1310 and w.value("Budget", "A11") == 1001 and w.value("Other", "A1") == 1310_000 and w.value("Budget", "Z9") is None
    assert w.spill_region("Budget", "A7") == "A7:A9" and w.cell("Budget", "A9") == {"sheet": "Budget", "ref": "A9", "value": 1000.0, "formula": None, "stored": None, "spilled_from": "A7"}
    with pytest.raises(KeyError):
        w.value("Nowhere", "A1")


def test_a_package_that_fails_leaves_the_others(spark, budget):
    cells = read_cells(spark.createDataFrame([("good", budget), ("bad", b"x"), ("none", None)], "path string, content binary"))
    kinds = {(r.book, r.kind): r["count"] for r in cells.groupBy("book", "kind").count().collect()}
    assert kinds["bad", "error"] == kinds["none", "error"] == 1 and kinds["good", "book"] == 1 and kinds["good", "shared"] == 3
    assert cells.columns == [c.split()[0] for c in CELLS.split(", ")]


POLICY = '# a policy\npolicy_version = "any.verify.policy/v1"\non_unsupported = "fail"\nrequire_determinism = false\n\n[[assertions]]\nsheet = "Budget"\nrange = "D2:D4"\noperator = "between_number"\nvalue = "0"\nupper = "150"\n'


def test_policy():
    p = V.parse_policy(POLICY)
    assert p.on_unsupported == "fail" and not p.require_determinism and p.assertions[0].upper == "150" and p.on_formula_error == "fail"
    for wrong in ('on_unsupported = "maybe"', "unknown = true", "require_comparison = 1", 'on_blocked = "fail"\non_blocked = "fail"', "on_blocked = fail", "nothing", '[[assertions]]\nsheet = "S"', '[[assertions]]\nsheet = "S"\nrange = "A1"\noperator = "equals_number"\nvalue = "x"', '[[assertions]]\nsheet = "S"\nrange = "A1"\noperator = "is"', 'assertions = true', 'policy_version = "v2"'):
        with pytest.raises(V.PolicyError):
            V.parse_policy(wrong)


def test_verify(spark, budget):
    clean = build({"S": {(0, 0): 2, (0, 1): f("A1*2", 4.0)}})
    stale = build({"S": {(0, 0): 2, (0, 1): f("A1*2", 5.0), (0, 2): f("1/0", "#DIV/0!")}})
    macros = build({"S": {(0, 0): 2, (0, 1): f("A1*2", 4.0)}}, extra={"xl/vbaProject.bin": b"x"})
    outside = build({"S": {(0, 0): 2, (0, 1): f("[1]T!A1", 4.0), (0, 2): f("TODAY()", 1.0)}})
    cells = read_cells(spark.createDataFrame([("clean", clean), ("stale", stale), ("macros", macros), ("outside", outside), ("bad", b"x"), ("Budget", budget)], "path string, content binary"))
    decisions, issues, checked = V.verify(cells)
    got = {r.book: (r.decision, r.exit_code, r.formula_cells) for r in decisions.collect()}
    assert got == {"clean": ("PASS", 0, 1), "stale": ("FAIL", 1, 2), "macros": ("FALLBACK", 2, 1), "outside": ("FALLBACK", 2, 2), "bad": ("FALLBACK", 2, 0), "Budget": ("FALLBACK", 2, 14)}
    codes = {(r.book, r.code) for r in issues.collect()}
    assert {("stale", "mismatch"), ("stale", "formula_error"), ("macros", "vba_project"), ("outside", "external_reference"), ("outside", "determinism_unavailable"), ("outside", "unsupported"), ("bad", "load_failed")} <= codes
    labels = {(r.book, r.r, r.c): (r.outcome, r.stored) for r in checked.filter("book in ('clean', 'stale')").collect()}
    assert labels == {("clean", 0, 1): ("computed", "matches_stored"), ("stale", 0, 1): ("computed", "differs_stored"), ("stale", 0, 2): ("formula_error", "matches_stored")}
    assert V.verify(cells.filter("book = 'Budget'"), policy=V.parse_policy(POLICY))[0].first().decision == "FAIL"
    base = cells.filter("book = 'clean'").withColumn("book", F.lit("stale"))
    _, _, both = V.verify(cells.filter("book = 'stale'"), baseline=base)
    assert {(r.c, r.baseline) for r in both.collect()} == {(1, "matches_baseline"), (2, "evidence_unavailable")}
    with pytest.raises(V.PolicyError):
        V.verify(cells, supplied=base)


def test_command(spark, budget, tmp_path, capsys):
    book, policy, out = tmp_path / "b.xlsx", tmp_path / "p.toml", tmp_path / "r.json"
    book.write_bytes(build({"S": {(0, 0): 2, (0, 1): f("A1*2", 4.0)}}))
    assert main(["verify", str(book), "--json", str(out), "--quiet"], spark) == 0
    assert json.loads(out.read_text())["books"][0]["decision"] == "PASS"
    policy.write_text('[[assertions]]\nsheet = "S"\nrange = "B1"\noperator = "equals_number"\nvalue = "5"\n')
    assert main(["verify", str(book), "--policy", str(policy)], spark) == 1 and "assertion_failed" in capsys.readouterr().out
    policy.write_text("nonsense")
    assert main(["verify", str(book), "--policy", str(policy)], spark) == main(["verify", str(tmp_path / "none.xlsx")], spark) == main(["look", str(book)], spark) == 64


def test_deep_chains_and_big_cycles():
    """The order of work of 100,000 cells: a chain, a wide diamond, a cycle."""
    import pandas as pd

    from sheetwise.operators import sheets

    n = 20_000
    cells = pd.DataFrame({"book": "b", "sheet": "s", "r": range(n), "c": 0, "pid": 0})
    none = pd.DataFrame({"sheet": pd.Series([], dtype=object), "r": [], "c": [], "owner_r": [], "owner_c": []})
    reads = lambda pairs: pd.DataFrame([("s", r, 0, "s", a, 0, b, 0) for r, a, b in pairs], columns=["sheet", "r", "c", "tsheet", "r0", "c0", "r1", "c1"])
    wide = sheets._levels("b", cells, reads([(i, 0, 0) for i in range(1, n - 1)] + [(n - 1, 1, n - 2)]), none, none)
    assert wide.level.tolist() == [0] + [1] * (n - 2) + [2] and wide.dirty.all()
    chain = sheets._levels("b", cells, reads([(i, i - 1, i - 1) for i in range(1, n)]), none, none)
    assert chain.level.tolist()[:200] == list(range(200)) and set(chain.level[200:]) == {-2}
    ring = sheets._levels("b", cells, reads([(i, (i + 1) % 100, (i + 1) % 100) for i in range(100)] + [(i, i - 1, i - 1) for i in range(101, 110)] + [(200, 50, 50)]), none, none)
    assert set(ring.level[:100]) == {-1} and ring.level.tolist()[100:110] == list(range(10)) and ring.level[200] == 0
    edited = pd.DataFrame({"sheet": ["s"], "r": [n // 2], "c": [0]})
    some = sheets._levels("b", cells, reads([(i, i - 1, i - 1) for i in range(1, n)]), none, edited)
    assert some.dirty.tolist() == [False] * (n // 2) + [True] * (n - n // 2)
