"""python -m sheetwise verify BOOK.xlsx [--baseline BOOK.xlsx] [--supplied BOOK.xlsx --build NAME] [--policy FILE] [--json FILE] [--quiet]

Exit code 0: PASS, 1: FAIL, 2: FALLBACK, 64: wrong use.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.verify import EXIT, USAGE, Policy, PolicyError, parse_policy, report, verify
from .sources.xlsx import read_cells


def _cells(spark: SparkSession, path: str) -> DataFrame:
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return read_cells(spark.read.format("binaryFile").load(path)).withColumn("book", F.lit("book")).cache()


def main(args: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sheetwise", exit_on_error=False)
    p.add_argument("command", choices=["verify"])
    p.add_argument("book")
    for name in ("--baseline", "--supplied", "--build", "--policy", "--json"):
        p.add_argument(name)
    p.add_argument("--quiet", action="store_true")
    try:
        a = p.parse_args(args)
        policy = Policy()
        if a.policy:
            with open(a.policy, encoding="utf-8") as f:
                policy = parse_policy(f.read())
        spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").getOrCreate()
        others = {k: _cells(spark, getattr(a, k)) for k in ("baseline", "supplied") if getattr(a, k)}
        decisions, issues, _ = verify(_cells(spark, a.book), policy=policy, build=a.build, **others)
        issues = issues.cache()
        row = decisions.first()
        text = report(decisions, issues)
        if a.json:
            with open(f"{a.json}.new", "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(f"{a.json}.new", a.json)
    except (SystemExit, argparse.ArgumentError, PolicyError, OSError, UnicodeDecodeError) as x:
        print(f"{type(x).__name__}: {x}", file=sys.stderr)
        return USAGE
    if not a.quiet:
        print(f"{row.decision}  {a.book}\n  formula cells: {row.formula_cells}; findings: {row.errors} errors, {row.warnings} warnings")
        if not a.json:
            print(text)
    return EXIT[row.decision]


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
