"""Queries against their SQL on tables that differ from sf0.001: equal keys, more rows than a sheet, other texts."""

import duckdb
import pytest

from sheetwise import queries
from sheetwise.table import Table, evaluate
from test_queries import rows


@pytest.fixture
def equal(spark, tmp_path):
    def check(name, **tables):
        """name's rows equal its SQL's, over tables made by SQL."""
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = queries.QUERIES[name](spark, str(tmp_path))
        cur = con.execute(queries.SQL[name])
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())

    return check


def test_lookup_takes_the_last_of_equal_keys(equal):
    supplier = "SELECT i AS s_suppkey, CAST(i % 7 AS DOUBLE) AS s_acctbal FROM range(500) t(i)"
    equal("fn_lookup", supplier=supplier, customer="SELECT i AS c_custkey, i / 10 - 1 AS c_acctbal FROM range(100) t(i)")


def test_address_beyond_the_rows_of_a_sheet(spark, equal):
    equal("fn_address", part="SELECT 1048570 + i * i * i AS p_partkey, CAST(1 + i % 50 AS INTEGER) AS p_size FROM range(2000) t(i)")
    assert evaluate(spark, "ADDRESS(1048576,1)") == "$A$1048576"
    assert evaluate(spark, "ADDRESS(1048577,1)") == "#VALUE!"  # a sheet has no such row


def _size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_datevalue_reads_a_text_once(spark, equal):
    """The text's expression stood in the plan for each form of a date and each part of the time: 15 ms a row."""
    orders = spark.range(3).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey")
    df = Table(orders).select("o_orderkey", errors=True, v='DATEVALUE(IF(o_orderkey=2,"x",1+MOD(o_orderkey,12)&"/"&1+MOD(o_custkey,28)&"/2011"))')
    assert [tuple(r) for r in df.orderBy("o_orderkey").collect()] == [(0, 40544.0, None), (1, 40582.0, None), (2, None, "#VALUE!")]
    assert _size(df) < 100_000
    equal("fn_datevalue", orders="SELECT i * 5 AS o_orderkey, i * 3 AS o_custkey FROM range(1000) t(i)")


def test_sort_of_few_cells_isnt_unrolled_again_and_again(spark, equal):
    part = spark.createDataFrame([(1, 3.0, "b"), (2, None, "B"), (3, 0.0, None)], "k long, x double, s string")
    got = lambda f: [r.v for r in Table(part).select("k", v=f).orderBy("k").collect()]
    text = lambda way: f'TEXTJOIN("|",FALSE,SORT(HSTACK(x,s,2,"a",TRUE),1,{way},TRUE))'
    assert got(text(1)) == ["2|3|a|b|TRUE", "2|a|B|TRUE|", "0|2|a|TRUE|"]
    assert got(text(-1)) == ["TRUE|b|a|3|2", "TRUE|B|a|2|", "TRUE|a|2|0|"]
    ties = 'TEXTJOIN("|",FALSE,SORT({{"q",1;"P",2;"Q",3;"p",4}},1,{}))&LEFT(s,0)'
    assert got(ties.format(1))[0] == "P|2|p|4|q|1|Q|3"
    assert got(ties.format(-1))[0] == "q|1|Q|3|P|2|p|4"
    assert got("IFERROR(INDEX(SORT(HSTACK(1/x,5),1,1,TRUE),1,1),-1)") == [1 / 3, -1, -1]
    assert got("IFERROR(INDEX(SORT(HSTACK(x,5),3),1,1),-1)") == [-1, -1, -1]
    formula = "SUMPRODUCT(SORT(HSTACK(x,25,x/40),1,-1,TRUE),{1,10,100})"
    assert _size(Table(part).select("k", v=formula)) < 20_000
    equal("fn_sort_formula", part="SELECT i AS p_partkey, i % 50 AS p_size, 900 + i / 10 AS p_retailprice FROM range(1000) t(i)")
