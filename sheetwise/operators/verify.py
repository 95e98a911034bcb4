"""Verification of recalculated workbooks: cell by cell against stored values, a baseline or a supplied result.

A formula cell has one outcome, which says nothing about others' results, and a label for each source that it is
compared with. Findings of all cells and a policy give the decision: FAIL before FALLBACK before PASS. Everything is a
join or a group over the cells of any number of books.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.library import FUNCTIONS
from ..functions.values import SENTINELS, fuzzy
from ..plans.references import Program, parse_area
from ..workbook import diagnostics
from .sheets import recalculate

# The lanes of a value, the exit code of each decision, functions whose value isn't settled by the cells,
# functions that look things up, and the everyday functions of the narrow fidelity cut.
LANES = ("n", "s", "b", "err")
EXIT = {"PASS": 0, "FAIL": 1, "FALLBACK": 2}
USAGE = 64
VOLATILE = ("NOW", "TODAY", "RAND", "RANDBETWEEN", "RANDARRAY", "OFFSET", "INDIRECT", "CELL", "INFO")
LOOKUPS = ("VLOOKUP", "HLOOKUP", "LOOKUP", "MATCH", "INDEX", "XLOOKUP", "XMATCH")
EVERYDAY = (
    "SUM", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "ROUND", "ROUNDUP", "ROUNDDOWN", "INT", "ABS", "MOD", "SUMPRODUCT", "SUMIF", "SUMIFS", "COUNTIF", "COUNTIFS", "AVERAGEIF",
    "AVERAGEIFS", "IF", "IFS", "AND", "OR", "NOT", "IFERROR", "IFNA", "VLOOKUP", "HLOOKUP", "INDEX", "MATCH", "LOOKUP", "CHOOSE", "OFFSET", "INDIRECT", "LEFT", "RIGHT", "MID", "LEN", "TRIM",
    "UPPER", "LOWER", "PROPER", "CONCATENATE", "CONCAT", "TEXT", "VALUE", "FIND", "SEARCH", "SUBSTITUTE", "DATE", "YEAR", "MONTH", "DAY", "EDATE", "EOMONTH", "WEEKDAY", "ROW", "COLUMN", "ROWS", "COLUMNS",
    "ISBLANK", "ISERROR", "ISNA", "ISNUMBER", "ISTEXT", "RANK", "LARGE", "SMALL",
)
_FORMULA = "kind in ('normal', 'shared', 'array', 'table')"


def _blank(prefix: str = "") -> Column:
    return F.coalesce(*[F.col(f"{prefix}{k}").cast("string") for k in LANES]).isNull()


def _bits(x: Column) -> Column:
    """A double's bits as a number that grows with it."""
    raw = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("bigint")
    return F.when(raw < 0, F.lit(-(2**63)) - raw).otherwise(raw)


def ulps(x: Column, y: Column) -> Column:
    """How many doubles lie between two, as a decimal."""
    return F.abs(_bits(x).cast("decimal(20,0)") - _bits(y).cast("decimal(20,0)"))


def computed(cells: DataFrame, values: DataFrame) -> DataFrame:
    """The formula cells of CELLS with their values (n, s, b, err), stored values (stored_n, ..) and formulas."""
    own = cells.filter(_FORMULA).select("book", "sheet", F.lower("sheet").alias("low"), "r", "c", "formula", "key", "problem", *[F.col(k).alias(f"stored_{k}") for k in LANES])
    got = values.filter("formula").select("book", F.col("sheet").alias("low"), "r", "c", *LANES)
    return own.join(got, ["book", "low", "r", "c"], "left").drop("low")


def status(most_ulps: int = 0, digits15: bool = False, prefix: str = "stored_") -> Column:
    """exact, ulp_diff, mismatch, engine_unsupported or no_oracle of a computed row against the lanes with the prefix.
    Texts count as equal only with equal case, numbers bit by bit (0 and -0 are one), with digits15 by 15 digits."""
    o = {k: F.col(f"{prefix}{k}") for k in LANES}
    n = F.col("n")
    same = n == o["n"]
    if digits15:
        same = same | (fuzzy(n) == fuzzy(o["n"]))
    exact = F.coalesce(same, F.lit(False)) | F.coalesce(F.col("s") == o["s"], F.lit(False)) | F.coalesce(F.col("b") == o["b"], F.lit(False)) | F.coalesce(F.col("err") == o["err"], F.lit(False))
    out = F.when(_blank(prefix), "no_oracle").when(F.col("err").isin(*SENTINELS), "engine_unsupported").when(exact, "exact")
    if most_ulps:
        out = out.when(F.coalesce(F.when(n.isNotNull() & o["n"].isNotNull(), ulps(n, o["n"]) <= most_ulps), F.lit(False)), "ulp_diff")
    return out.otherwise("mismatch")


def diff(cells: DataFrame, values: DataFrame, most_ulps: int = 0, digits15: bool = False) -> DataFrame:
    """Every formula cell with its status against its stored value."""
    return computed(cells, values).withColumn("status", status(most_ulps, digits15))


def fidelity(diffed: DataFrame, *by: str) -> DataFrame:
    """Counts by status (in groups, by book unless named otherwise) and two shares in percent, null where nothing could
    be judged: of the cells that were attempted (lenient), and of all that have a stored value (strict)."""
    count = lambda k: F.count_if(F.col("status") == k).alias(k)
    out = diffed.groupBy(*(by or ("book",))).agg(F.count("*").alias("formula_cells"), *[count(k) for k in ("exact", "ulp_diff", "mismatch", "engine_unsupported", "no_oracle")])
    good, judged = F.col("exact") + F.col("ulp_diff"), F.col("formula_cells") - F.col("no_oracle")
    return out.withColumns({"lenient_pct": F.try_divide(100.0 * good, judged - F.col("engine_unsupported")), "strict_pct": F.try_divide(100.0 * good, judged)})


# -- tools over many books ---------------------------------------------------------------------------------------------------


def _calls(key: str | None) -> list[str] | None:
    return None if key is None else sorted(Program.of_key(key).calls())


def calls(diffed: DataFrame) -> DataFrame:
    """diffed with `calls`, the functions that each formula names (null if it can't be read). Distinct relative formulas
    are read once each."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "calls": [_calls(k) for k in batch["key"]]})

    known = diffed.filter("key is not null").select("key").distinct().mapInPandas(run, "key string, calls array<string>")
    return diffed.join(known, "key", "left")


def mismatches(diffed: DataFrame) -> DataFrame:
    """The mismatching cells with the kinds of both values (`change`) and one `pattern` each, most specific first."""
    kind = lambda p: F.coalesce(*[F.when(F.col(f"{p}{k}").isNotNull(), F.lit(name)) for k, name in zip(LANES, ("number", "text", "bool", "error"), strict=True)], F.lit("blank"))
    off = F.abs(F.col("n") - F.col("stored_n")) / F.greatest(F.abs(F.col("stored_n")), F.lit(1e-300))
    lookup = F.arrays_overlap("calls", F.array(*[F.lit(x) for x in LOOKUPS]))
    wrong, right = F.col("err"), F.col("stored_err")
    pattern = (
        F.when(lookup & (right == "#N/A") & wrong.isNull(), "lookup_expected_na").when(lookup & (wrong == "#N/A") & right.isNull(), "lookup_actual_na")
        .when(wrong.isNotNull() & right.isNotNull(), "error_kind").when(right.isNotNull(), "expected_error").when(wrong.isNotNull(), "expected_value")
        .when(off >= 1e-2, "numeric_gross").when(off >= 1e-4, "numeric_mid").when(off.isNotNull(), "numeric_fine")
        .when(F.lower("s") == F.lower("stored_s"), "text_case").when(F.trim("s") == F.trim("stored_s"), "text_white_space").when(F.col("s").isNotNull() & F.col("stored_s").isNotNull(), "text")
        .otherwise("kind")
    )
    found = calls(diffed.filter("status = 'mismatch'"))
    return found.withColumns({"change": F.concat(kind("stored_"), F.lit(">"), kind("")), "pattern": pattern})


def narrow(diffed: DataFrame) -> DataFrame:
    """diffed with `eligible` (the formula can be read and names everyday functions only), `supported` (the engine has all
    of them) and `book_eligible` (all formulas of its book are eligible)."""
    known = calls(diffed)
    everyday = F.size(F.array_except("calls", F.array(*[F.lit(x) for x in EVERYDAY]))) == 0
    known = known.withColumn("eligible", F.coalesce(everyday & F.col("problem").isNull(), F.lit(False)))
    known = known.withColumn("supported", F.col("eligible") & (F.size(F.array_except("calls", F.array(*[F.lit(x) for x in sorted(FUNCTIONS)]))) == 0))
    books = known.groupBy("book").agg(F.bool_and("eligible").alias("book_eligible"))
    return known.join(books, "book")


#: Why a cell was declined by its own formula, in order.
CAUSES = ("external", "blocked_io", "volatile", "unknown_function", "parse", "other")


def declines(diffed: DataFrame, refs: DataFrame) -> DataFrame:
    """The declined cells (engine_unsupported) with `cause`, one of CAUSES, and `direct`: is it the cell's own, or that of
    a declined cell that it reads, at any distance? A cell's own cause comes before what it reads; of those, the first
    in the order of CAUSES. refs: (book, sheet, r, c, tsheet, r0, c0, r1, c1), the references of formulas."""
    known = calls(diffed.filter("status = 'engine_unsupported'"))
    has = lambda names: F.coalesce(F.arrays_overlap("calls", F.array(*[F.lit(x) for x in names])), F.lit(False))
    plain = F.regexp_replace("formula", '"[^"]*"', "")
    own = (
        F.when(plain.contains("["), 0).when(has(("WEBSERVICE", "RTD", "STOCKHISTORY")) | (F.col("err") == "#BLOCKED!"), 1).when(has(("NOW", "TODAY", "RAND", "RANDBETWEEN", "RANDARRAY", "INFO")), 2)
        .when(F.coalesce(F.size(F.array_except("calls", F.array(*[F.lit(x) for x in sorted(FUNCTIONS)]))) > 0, F.lit(False)), 3).when(F.col("problem") == "parse", 4)
    )
    from ._parts import cut

    cells = cut(known.select("book", "sheet", F.lower("sheet").alias("low"), "r", "c", "formula", own.alias("own")))
    ends = cells.select("book", F.col("low").alias("tsheet"), F.col("r").alias("pr"), F.col("c").alias("pc"))
    declined = cells.select("book", F.col("low").alias("sheet"), "r", "c")
    blocks = F.sequence(F.shiftright("r0", 8), F.shiftright("r1", 8))
    wide = refs.join(declined, ["book", "sheet", "r", "c"], "left_semi").select("*", F.explode(blocks).alias("block"))
    met = wide.join(ends.withColumn("block", F.shiftright("pr", 8)), ["book", "tsheet", "block"])
    edges = cut(met.filter("pr between r0 and r1 and pc between c0 and c1").select("book", F.col("sheet").alias("low"), "r", "c", "tsheet", "pr", "pc").distinct())
    state = cells.select("book", "low", "r", "c", F.col("own").alias("cause"))
    while True:  # as many rounds as the longest way from a cause
        ahead = edges.join(state.select("book", F.col("low").alias("tsheet"), F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("cause").alias("up")), ["book", "tsheet", "pr", "pc"]).groupBy("book", "low", "r", "c").agg(F.min("up").alias("up"))
        fresh = cut(state.join(ahead, ["book", "low", "r", "c"], "left").join(cells.select("book", "low", "r", "c", "own"), ["book", "low", "r", "c"]).select("book", "low", "r", "c", F.coalesce("own", F.least("cause", "up")).alias("cause"), (~F.coalesce("own", F.least("cause", "up")).eqNullSafe(F.col("cause"))).alias("moved")))
        state = fresh.drop("moved")
        if not fresh.filter("moved").limit(1).count():
            break
    named = F.get(F.array(*[F.lit(x) for x in CAUSES]), F.coalesce("cause", F.lit(5)))
    return cells.join(state, ["book", "low", "r", "c"]).select("book", "sheet", "r", "c", "formula", named.alias("cause"), F.col("own").isNotNull().alias("direct"))


def token() -> Column:
    """A value as a text that tells any two values apart: N and a number's bits, S and a text's bytes, B0, B1, E and an
    error, _ for a blank."""
    bits = F.lpad(F.lower(F.hex(F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.col("n")).cast("bigint"))), 16, "0")
    return F.when(F.col("err").isNotNull(), F.concat(F.lit("E"), F.col("err"))).when(F.col("n").isNotNull(), F.concat(F.lit("N"), bits)).when(F.col("s").isNotNull(), F.concat(F.lit("S"), F.lower(F.hex(F.encode("s", "UTF-8"))))).when(F.col("b").isNotNull(), F.concat(F.lit("B"), F.col("b").cast("int").cast("string"))).otherwise("_")


def fingerprint(values: DataFrame) -> DataFrame:
    """(book, n_cells, hash): a fingerprint of each book's computed cells that doesn't depend on their order. Each cell
    with its place is hashed to 128 bits, which are added up."""
    row = values.filter("formula").select("book", F.concat_ws("\t", "sheet", F.col("r").cast("string"), F.col("c").cast("string"), token()).alias("row"))
    half = lambda k: F.conv(F.substring(F.md5("row"), k, 15), 16, 10).cast("decimal(38,0)")
    sums = row.groupBy("book").agg(F.count("*").alias("n_cells"), F.sum(half(1)).alias("a"), F.sum(half(16)).alias("b"))
    return sums.select("book", "n_cells", F.sha2(F.concat_ws(":", F.col("n_cells").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("hash"))


# -- policy -----------------------------------------------------------------------------------------------------------------


class PolicyError(ValueError):
    """A policy that can't be read; nothing is decided."""


@dataclass
class Assertion:
    sheet: str = ""
    range: str = ""
    operator: str = ""
    value: str | None = None
    upper: str | None = None


ACTIONS = ("fallback", "fail", "allow")
OPERATORS = ("not_error", "equals_text", "equals_number", "between_number", "equals_bool", "equals_error", "blank")


@dataclass
class Policy:
    on_unsupported: str = "fallback"
    on_blocked: str = "fallback"
    on_resource_limit: str = "fallback"
    on_parse_error: str = "fallback"
    on_formula_error: str = "fail"
    on_external_reference: str = "fallback"
    on_vba_project: str = "fallback"
    require_comparison: bool = False
    require_excel_result: bool = False
    require_determinism: bool = True
    allow_stored_value_match: bool = True
    allow_baseline_match: bool = True
    assertions: list[Assertion] = field(default_factory=list)


def _text(raw: str, line: int) -> str:
    m = re.fullmatch(r'"([^"\\]*)"', raw)
    if not m:
        raise PolicyError(f"line {line}: expected a quoted text without escapes, got {raw!r}")
    return m[1]


def parse_policy(text: str) -> Policy:
    """A small part of TOML: `key = value` and [[assertions]]. Unknown and repeated keys are errors, so that a typing
    error can't weaken a policy."""
    policy, seen = Policy(), set()
    current: Assertion | None = None
    for i, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#")[0].strip()
        if not line:
            continue
        if line == "[[assertions]]":
            current, seen = Assertion(), set()
            policy.assertions.append(current)
            continue
        key, eq, value = (x.strip() for x in line.partition("="))
        if not eq:
            raise PolicyError(f"line {i}: expected key = value")
        if key in seen:
            raise PolicyError(f"line {i}: key {key!r} twice")
        seen.add(key)
        if current is not None:
            if key not in ("sheet", "range", "operator", "value", "upper"):
                raise PolicyError(f"line {i}: unknown assertion key {key!r}")
            setattr(current, key, _text(value, i))
        elif key == "policy_version":
            if not re.fullmatch(r"\w+\.verify\.policy/v1", _text(value, i)):
                raise PolicyError(f"line {i}: unknown policy version")
        elif key.startswith("on_") and hasattr(policy, key):
            if _text(value, i) not in ACTIONS:
                raise PolicyError(f"line {i}: unknown action {value}")
            setattr(policy, key, _text(value, i))
        elif key != "assertions" and hasattr(policy, key):
            if value not in ("true", "false"):
                raise PolicyError(f"line {i}: expected true or false")
            setattr(policy, key, value == "true")
        else:
            raise PolicyError(f"line {i}: unknown key {key!r}")
    for i, a in enumerate(policy.assertions):
        if not (a.sheet and a.range and a.operator) or parse_area(a.range) is None:
            raise PolicyError(f"assertion {i}: sheet, range or operator is missing")
        if a.operator not in OPERATORS:
            raise PolicyError(f"assertion {i}: unknown operator {a.operator!r}")
        if a.operator.startswith("equals_") and a.value is None or a.operator == "between_number" and (a.value is None or a.upper is None):
            raise PolicyError(f"assertion {i}: a value is missing")
        for x in [a.value, a.upper] if a.operator.endswith("_number") else []:
            if x is not None:
                try:
                    float(x)
                except ValueError:
                    raise PolicyError(f"assertion {i}: no number: {x!r}") from None
    return policy


def _holds(a: Assertion) -> Column:
    """Does a cell (its lanes are null if it is blank) meet an assertion?"""
    op = a.operator
    if op == "not_error":
        hit = F.col("err").isNull()
    elif op == "blank":
        hit = _blank()
    elif op == "equals_text":
        hit = F.col("s") == a.value
    elif op == "equals_error":
        hit = F.col("err") == a.value
    elif op == "equals_bool":
        hit = F.col("b") == F.lit((a.value or "").lower() == "true")
    elif op == "equals_number":
        hit = F.col("n") == float(a.value)
    else:
        hit = F.col("n").between(float(a.value), float(a.upper))
    return F.coalesce(hit, F.lit(False))


# -- the verifier -------------------------------------------------------------------------------------------------------------

ISSUES = "book string, code string, severity string, action string, sheet string, r int, c int"


def outcome() -> Column:
    """The outcome of a formula cell of computed()."""
    err = F.col("err")
    return F.when(F.col("problem") == "parse", "parse_failed").when(err == "#UNSUPPORTED!", "unsupported").when(err == "#BLOCKED!", "blocked").when(err == "#RESOURCE!", "resource_limited").when(err.isNotNull(), "formula_error").otherwise("computed")


def _compared(cells: DataFrame, other: DataFrame, prefix: str, name: str) -> DataFrame:
    """cells with matches_<name>, differs_<name> or evidence_unavailable."""
    lanes = other.select("book", F.lower("sheet").alias("low"), "r", "c", *[F.col(k).alias(f"{prefix}{k}") for k in LANES], F.lit(True).alias("there"))
    both = cells.withColumn("low", F.lower("sheet")).join(lanes, ["book", "low", "r", "c"], "left").drop("low")
    same = F.lit(True)
    for k in LANES:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    label = F.when(F.col("there").isNull(), "evidence_unavailable").when(same, f"matches_{name}").otherwise(f"differs_{name}")
    return both.withColumn(name, label).drop("there", *[f"{prefix}{k}" for k in LANES])


def verify(cells: DataFrame, values: DataFrame | None = None, policy: Policy | None = None, baseline: DataFrame | None = None, supplied: DataFrame | None = None, build: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verifies every book of CELLS. Returns three tables: (book, decision, exit_code, formula_cells, errors, warnings), the
    findings (ISSUES), and the formula cells with `outcome` and a label for each source.

    baseline: CELLS of books of the same names, which are recalculated; supplied: CELLS whose stored values come from
    the build of a spreadsheet program that `build` names. Without either, stored values are compared. A book that
    couldn't be read is FALLBACK."""
    if supplied is not None and not build:
        raise PolicyError("a supplied result needs the build that made it")
    policy = policy or Policy()
    values = recalculate(cells) if values is None else values
    got = computed(cells, values).withColumn("outcome", outcome())
    plain = got.withColumn("_status", status()).withColumn("stored", F.when(F.col("_status") == "no_oracle", "evidence_unavailable").when(F.col("_status") == "exact", "matches_stored").otherwise("differs_stored"))
    plain = plain.withColumn("stored", F.when(F.col("_status") == "engine_unsupported", "evidence_unavailable").otherwise(F.col("stored"))).drop("_status")
    if baseline is not None:
        base = computed(baseline, recalculate(baseline)).select("book", "sheet", "r", "c", *LANES)
        plain = _compared(plain, base, "base_", "baseline")
    if supplied is not None:
        plain = _compared(plain, supplied.filter(_FORMULA).select("book", "sheet", "r", "c", *LANES), "given_", "supplied")
    source = "supplied" if supplied is not None else "baseline" if baseline is not None else "stored"
    named = calls(plain)
    actions = {"parse_failed": policy.on_parse_error, "unsupported": policy.on_unsupported, "blocked": policy.on_blocked, "resource_limited": policy.on_resource_limit, "formula_error": policy.on_formula_error}
    spot = ["sheet", "r", "c"]

    def found(where: DataFrame, code: Column | str, action: Column | str, severity: str | None = None) -> DataFrame:
        act = F.lit(action) if isinstance(action, str) else action
        sev = F.lit(severity) if severity else F.when(act == "fail", "error").otherwise("warning")
        return where.select("book", (F.lit(code) if isinstance(code, str) else code).alias("code"), sev.alias("severity"), act.alias("action"), *spot)

    none = lambda df: df.select("book", F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("int").alias("r"), F.lit(None).cast("int").alias("c"))
    act = None
    for k, v in actions.items():
        act = F.when(F.col("outcome") == k, v) if act is None else act.when(F.col("outcome") == k, v)
    issues = found(plain.filter("outcome <> 'computed'"), F.col("outcome"), act)
    issues = issues.unionByName(found(plain.filter((F.col(source) == f"differs_{source}") & ~F.col("outcome").isin("parse_failed", "unsupported", "blocked", "resource_limited")), "mismatch", "fail"))
    if source != "stored":
        issues = issues.unionByName(found(plain.filter(F.col(source) == "evidence_unavailable"), f"{source}_cell_unavailable", "fallback"))
    bare = F.regexp_replace("formula", '"[^"]*"', "")
    issues = issues.unionByName(found(plain.filter(bare.contains("[")), "external_reference", policy.on_external_reference))
    books = cells.select("book").distinct()
    macros = cells.filter("kind = 'book' and array_contains(split(formula, ','), 'macros')")
    issues = issues.unionByName(found(none(macros), "vba_project", policy.on_vba_project))
    issues = issues.unionByName(found(none(cells.filter("kind = 'error'")), "load_failed", policy.on_parse_error if policy.on_parse_error != "allow" else "fallback"))
    if policy.require_determinism:
        issues = issues.unionByName(found(named.filter(F.arrays_overlap("calls", F.array(*[F.lit(x) for x in VOLATILE])) | bare.rlike(rf"(?i)\b({'|'.join(VOLATILE)})\(")), "determinism_unavailable", "fallback"))
    if policy.require_comparison:
        usable = plain.filter(F.col(source) != "evidence_unavailable").select("book").distinct()
        issues = issues.unionByName(found(none(books.join(usable, "book", "left_anti")), "comparison_required", "fallback"))
    if policy.require_excel_result and supplied is None:
        issues = issues.unionByName(found(none(books), "excel_evidence_required", "fallback"))
    if source == "stored" and not policy.allow_stored_value_match:
        issues = issues.unionByName(found(none(books), "stored_evidence_disabled", "fallback"))
    if source == "baseline" and not policy.allow_baseline_match:
        issues = issues.unionByName(found(none(books), "baseline_evidence_disabled", "fallback"))
    for a in policy.assertions:
        r0, c0, r1, c1 = parse_area(a.range)
        spark = cells.sparkSession
        there = cells.filter(F.lower("sheet") == a.sheet.lower()).select("book", F.lit(a.sheet).alias("sheet")).distinct()
        grid = spark.range((r1 - r0 + 1) * (c1 - c0 + 1)).select((F.floor(F.col("id") / (c1 - c0 + 1)) + r0).cast("int").alias("r"), (F.col("id") % (c1 - c0 + 1) + c0).cast("int").alias("c"))
        seen = there.crossJoin(F.broadcast(grid)).join(values.filter(F.col("sheet") == a.sheet.lower()).select("book", "r", "c", *LANES), ["book", "r", "c"], "left")  # the assertion's own cells
        issues = issues.unionByName(found(seen.filter(~_holds(a)), "assertion_failed", "fail"))
        lost = books.join(there.select("book"), "book", "left_anti")
        issues = issues.unionByName(found(none(lost), "assertion_evaluation_failed", "fallback"))
    weight = issues.groupBy("book").agg(F.bool_or(F.col("action") == "fail").alias("fail"), F.bool_or(F.col("action") == "fallback").alias("back"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    counts = plain.groupBy("book").agg(F.count("*").alias("formula_cells"))
    decision = F.when(F.col("fail"), "FAIL").when(F.col("back"), "FALLBACK").otherwise("PASS")
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    out = books.join(weight, "book", "left").join(counts, "book", "left").select("book", decision.alias("decision"), zero("formula_cells"), zero("errors"), zero("warnings"))
    code = F.element_at(F.create_map(*[F.lit(x) for kv in EXIT.items() for x in kv]), F.col("decision"))
    return out.select("book", "decision", code.alias("exit_code"), "formula_cells", "errors", "warnings"), issues, plain


def report(decisions: DataFrame, issues: DataFrame) -> str:
    """The decisions and findings of a few books as JSON, in a fixed order."""
    found: dict[str, list] = {}
    for r in issues.orderBy("book", "sheet", "r", "c", "code").collect():
        found.setdefault(r.book, []).append({k: r[k] for k in ("code", "severity", "sheet", "r", "c") if r[k] is not None})
    books = [r.asDict() | {"issues": found.get(r.book, [])} for r in decisions.orderBy("book").collect()]
    return json.dumps({"schema_version": "verify.report/v1", "books": books}, sort_keys=True)


__all__ = ["ACTIONS", "CAUSES", "Assertion", "Policy", "PolicyError", "calls", "computed", "declines", "diagnostics", "diff", "fidelity", "fingerprint", "mismatches", "narrow", "parse_policy", "report", "status", "verify"]
