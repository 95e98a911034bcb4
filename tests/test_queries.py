"""Every query against its SQL, as sorted rows."""

import glob
import math
import os

import duckdb
import pytest

from sheetwise import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5) + 0.0
    return str(v)


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in data), key=str)


@pytest.mark.parametrize("chunk", range(10))
def test_queries_equal_sql(spark, duck, chunk):
    wrong = []
    for name in list(queries.QUERIES)[chunk::10]:
        try:
            df = queries.QUERIES[name](spark, SMALL)
            got = rows(df.columns, [tuple(r) for r in df.collect()])
            cur = duck.execute(queries.SQL[name])
            want = rows([d[0] for d in cur.description], cur.fetchall())
        except Exception as x:
            wrong.append(f"{name}: {type(x).__name__} {str(x)[:400]}")
            continue
        if got != want:
            differ = next(((a, b) for a, b in zip(got[1], want[1], strict=False) if a != b), None)
            wrong.append(f"{name}: {got[0]} {want[0]}, {len(got[1])} and {len(want[1])} rows, first {differ}")
    assert not wrong, "\n".join(wrong)


def test_sql_for_every_query():
    assert queries.QUERIES.keys() == queries.SQL.keys()
