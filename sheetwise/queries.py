"""One query per operator and function, each with the same result in SQL.

Numbers are rounded to six places on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.library import ORDER
from .operators import arrays, lookup, ordered
from .operators._parts import positions
from .table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def six(sql: str) -> str:
    return f"round(CAST({sql} AS DOUBLE), 6)"


def row(name: str, table: str, key: str, formula: str, sql: str, number: bool = True, errors: str | None = None):
    """A formula for each row. errors: SQL for the error column."""

    def run(spark, sf_dir):
        return rounded(Table(read(spark, sf_dir, table)).select(key, errors=errors is not None, v=formula))

    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, {six(sql) if number else sql} AS v{f', {errors} AS v_error' if errors else ''} FROM {table}"


def group(name: str, table: str, by: list[str], formula: str, sql: str, number: bool = True):
    """A formula for each group."""

    def run(spark, sf_dir):
        return rounded(Table(read(spark, sf_dir, table)).summarise(by, v=formula))

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join([*by, f'{six(sql) if number else sql} AS v'])} FROM {table}" + (f" GROUP BY {', '.join(by)}" if by else "")


def plan(name: str, sql: str):
    """A query of its own."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(lambda t: read(spark, sf_dir, t)))
        SQL[name] = sql
        return fn

    return add


def part(name, formula, sql, number=True, errors=None):
    row(name, "part", "p_partkey", formula, sql, number, errors)


def customer(name, formula, sql, number=True, errors=None):
    row(name, "customer", "c_custkey", formula, sql, number, errors)


def order(name, formula, sql, number=True, errors=None):
    row(name, "orders", "o_orderkey", formula, sql, number, errors)


def items(name, formula, sql, number=True, by=("l_returnflag",)):
    group(name, "lineitem", list(by), formula, sql, number)


def serial(day: str) -> str:
    return f"date_diff('day', DATE '1899-12-30', CAST({day} AS DATE))"


def digits(x: str) -> str:
    return f"CAST(printf('%.14e', {x}) AS DOUBLE)"


# -- operators ---------------------------------------------------------------------------------------------------------

part("op_add", "p_retailprice+p_size", "p_retailprice+p_size")
part("op_subtract", "p_retailprice-p_size", "p_retailprice-p_size")
part("op_multiply", "p_retailprice*p_size", "p_retailprice*p_size")
part("op_divide", "p_retailprice/(p_size-10)", "p_retailprice/nullif(p_size-10,0)", errors="CASE WHEN p_size=10 THEN '#DIV/0!' END")
part("op_power", "p_size^1.5", "pow(p_size,1.5)")
part("op_concat", 'p_brand&"/"&p_size', "p_brand||'/'||CAST(p_size AS VARCHAR)", False)
part("op_equal", 'p_brand=UPPER(p_brand)', "lower(p_brand)=lower(upper(p_brand))", False)
part("op_not_equal", "p_size<>10", "p_size<>10", False)
part("op_less", "p_retailprice<1000", "p_retailprice<1000", False)
part("op_less_equal", "p_size<=25", "p_size<=25", False)
part("op_greater", "p_size>25", "p_size>25", False)
part("op_greater_equal", "p_retailprice>=900+p_size*5", "p_retailprice>=900+p_size*5", False)
part("op_compare_kinds", "IF(p_size>25,p_size,p_name)<IF(MOD(p_size,2)=0,p_brand,TRUE)", "CASE WHEN p_size>25 OR p_size%2=1 THEN true ELSE lower(p_name)<lower(p_brand) END", False)
part("op_fuzzy_equal", "p_size/10+0.2=IF(p_size>25,(p_size+2)/10,(p_size+2)/10+0.00000000001)", "p_size>25", False)
part("op_negate", "-p_size^2", "pow(-p_size,2)")
part("op_plus", "+p_size", "p_size")
part("op_percent", "p_size%", "p_size/100.0")
part("op_broadcast", "SUM({1,2}*p_size+{10;20})", "3*p_size*2+60")
part("op_broadcast_pads", "SUM(IFERROR({1;2;3}*p_size+{1;2},100))", "3*p_size+103")
part("op_intersect", "@p_size", "p_size")
part("op_array", "SUM({1,2;3,4})+p_size", "10+p_size")
part("op_let", "LET(x,p_size*2,y,x+1,x*y)", "(p_size*2)*(p_size*2+1)")
part("op_lambda", "LAMBDA(a,b,a*b+1)(p_size,2)", "p_size*2+1")
part("op_map", "SUM(MAP({1,2,3},LAMBDA(x,x*p_size)))", "6*p_size")
part("op_reduce", "REDUCE(p_size,{1,2,3},LAMBDA(a,b,a*2+b))", "((p_size*2+1)*2+2)*2+3")
part("op_scan", "INDEX(SCAN(0,{1,2,3},LAMBDA(a,b,a+b*p_size)),2)", "3*p_size")
part("op_byrow", "SUM(BYROW({1,2;3,4},LAMBDA(r,MAX(r)*p_size)))", "6*p_size")
part("op_bycol", "SUM(BYCOL({1,2;3,4},LAMBDA(r,MIN(r)*p_size)))", "3*p_size")
part("op_makearray", "SUM(MAKEARRAY(3,3,LAMBDA(i,j,i*j)))+p_size", "36+p_size")
part("op_indirect", 'INDIRECT("p_size")', "p_size")
part("op_blocked", 'WEBSERVICE("u")', "CAST(NULL AS DOUBLE)", errors="'#BLOCKED!'")
part("op_volatile", "NOW()", "CAST(NULL AS DOUBLE)", errors="'#UNSUPPORTED!'")
part("op_unknown_name", "NO_SUCH_FUNCTION(p_size)", "CAST(NULL AS DOUBLE)", errors="'#NAME?'")
part("op_error_order", "p_size+NA()+1/0", "CAST(NULL AS DOUBLE)", errors="'#N/A'")


@plan("op_offset", "SELECT o_orderkey, lead(o_totalprice, 2) OVER (ORDER BY o_orderkey) AS moved FROM orders")
def _offset(t):
    return ordered.offset(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 2, F.col("o_orderkey")).select("o_orderkey", "moved")


@plan("op_offset_grouped", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS moved FROM orders")
def _offset_grouped(t):
    return ordered.offset(t("orders"), "o_totalprice", -1, F.col("o_orderkey"), by=["o_custkey"]).select("o_orderkey", "moved")


@plan("op_scan_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS running FROM orders")
def _running(t):
    got = ordered.accumulate(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", F.col("o_orderkey"))
    return got.select("o_orderkey", F.round("running", 2).alias("running"))


@plan("op_range_of_table", f"SELECT p_partkey, {six('p_retailprice/(SELECT max(p_retailprice) FROM part)')} AS v FROM part")
def _range_of_table(t):
    return Table(t("part"), {"all": t("part")}).select("p_partkey", v="p_retailprice/MAX(all!p_retailprice)")


# -- aggregates --------------------------------------------------------------------------------------------------------

items("fn_sum", "SUM(l_quantity)", "sum(l_quantity)")
items("fn_average", "AVERAGE(l_extendedprice)", "avg(l_extendedprice)")
items("fn_averagea", "AVERAGEA(l_quantity,l_linestatus)", "sum(l_quantity)/(2*count(*))")
items("fn_count", "COUNT(l_quantity,l_linestatus)", "count(l_quantity)")
items("fn_counta", "COUNTA(l_linestatus,l_quantity)", "2*count(*)")
items("fn_min", "MIN(l_extendedprice)", "min(l_extendedprice)")
items("fn_max", "MAX(l_extendedprice)", "max(l_extendedprice)")
items("fn_mina", "MINA(l_quantity>5,l_tax+0.5)", "least(CASE WHEN bool_and(l_quantity>5) THEN 1 ELSE 0 END,min(l_tax)+0.5)", by=("l_orderkey",))
items("fn_maxa", "MAXA(l_quantity>40,l_tax)", "greatest(CASE WHEN bool_or(l_quantity>40) THEN 1 ELSE 0 END,max(l_tax))", by=("l_orderkey",))
items("fn_product", "PRODUCT(1+l_discount/10000)", "product(1+l_discount/10000)")
items("fn_sumsq", "SUMSQ(l_quantity)", "sum(l_quantity*l_quantity)")
items("fn_median", "MEDIAN(l_extendedprice)", "median(l_extendedprice)")
items("fn_stdev", "STDEV(l_quantity)", "stddev_samp(l_quantity)")
items("fn_correl", "CORREL(l_quantity,l_extendedprice)", "corr(l_quantity,l_extendedprice)")
items("fn_sumproduct", "SUMPRODUCT(l_quantity,l_discount)", "sum(l_quantity*l_discount)")
items("fn_sumproduct_condition", "SUMPRODUCT((l_quantity>25)*1,l_tax)", "sum(CASE WHEN l_quantity>25 THEN l_tax ELSE 0 END)")
items("fn_subtotal", "SUBTOTAL(109,l_quantity)+SUBTOTAL(4,l_tax)", "sum(l_quantity)+max(l_tax)")
items("fn_subtotal_variance", "SUBTOTAL(10,l_quantity)-SUBTOTAL(11,l_quantity)", "var_samp(l_quantity)-var_pop(l_quantity)")
items("fn_and", "AND(l_quantity>0,l_tax>=0)", "bool_and(l_quantity>0 AND l_tax>=0)", False)
items("fn_or", "OR(l_quantity>49)", "bool_or(l_quantity>49)", False)
items("fn_xor", "XOR(l_quantity>25)", "count(*) FILTER (l_quantity>25)%2=1", False)
items("fn_rows", "ROWS(l_quantity)", "count(*)")
items("fn_concat_range", 'COUNT(l_tax)&" of "&COUNTA(l_returnflag)', "count(l_tax)||' of '||count(l_returnflag)", False)
group("fn_sum_whole", "lineitem", [], "SUM(l_extendedprice*(1-l_discount))", "sum(l_extendedprice*(1-l_discount))")
group("fn_textjoin_range", "nation", ["n_regionkey"], 'TEXTJOIN(",",TRUE,n_name)', "string_agg(n_name, ',' ORDER BY n_name)", False)
group("fn_concat", "nation", ["n_regionkey"], "CONCAT(n_name)", "string_agg(n_name, '' ORDER BY n_name)", False)


@plan("fn_large", "SELECT o_custkey, kth FROM (SELECT o_custkey, o_totalprice AS kth, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS n FROM orders) WHERE n = 2")
def _large(t):
    return ordered.kth(t("orders"), "o_totalprice", 2, ["o_custkey"])


@plan("fn_small", "SELECT min(kth) AS kth FROM (SELECT o_totalprice AS kth FROM orders ORDER BY 1 LIMIT 100 OFFSET 99)")
def _small(t):
    return ordered.kth(t("orders"), "o_totalprice", 100, largest=False)


@plan("fn_rank", "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (ORDER BY l_quantity DESC) AS DOUBLE) AS rank FROM lineitem")
def _rank(t):
    return ordered.rank(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").select("l_orderkey", "l_linenumber", "rank")


@plan("fn_rank_eq", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS DOUBLE) AS rank FROM orders")
def _rank_eq(t):
    return ordered.rank(t("orders"), "o_totalprice", ["o_custkey"], ascending=True).select("o_orderkey", "rank")


@plan("op_rollup", f"SELECT l_returnflag, l_linestatus, {six('sum(l_quantity)')} AS q, {six('avg(l_tax)')} AS x, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _rollup(t):
    return arrays.rollup(t("lineitem"), ["l_returnflag", "l_linestatus"], q="SUBTOTAL(9,l_quantity)", x="SUBTOTAL(1,l_tax)")


# -- criteria ----------------------------------------------------------------------------------------------------------

_BY = ("l_linestatus",)
items("fn_sumif", 'SUMIF(l_discount,">0.05",l_extendedprice)', "sum(CASE WHEN l_discount>0.05 THEN l_extendedprice ELSE 0 END)", by=_BY)
items("fn_countif", 'COUNTIF(l_returnflag,"r")', "count(*) FILTER (l_returnflag='R')", by=_BY)
items("fn_averageif", 'AVERAGEIF(l_quantity,"<=10",l_tax)', "avg(CASE WHEN l_quantity<=10 THEN l_tax END)", by=_BY)
items("fn_sumifs", 'SUMIFS(l_extendedprice,l_returnflag,"<>A",l_quantity,">=20",l_shipdate,">1/1/1997")', "sum(CASE WHEN l_returnflag<>'A' AND l_quantity>=20 AND l_shipdate>TIMESTAMP '1997-01-01' THEN l_extendedprice ELSE 0 END)", by=_BY)
items("fn_countifs", 'COUNTIFS(l_returnflag,"?",l_quantity,"<25",l_tax,0.04)', "count(*) FILTER (l_quantity<25 AND l_tax=0.04)", by=_BY)
items("fn_averageifs", 'AVERAGEIFS(l_extendedprice,l_quantity,">10",l_discount,"<0.03")', "avg(CASE WHEN l_quantity>10 AND l_discount<0.03 THEN l_extendedprice END)", by=_BY)
items("fn_maxifs", 'MAXIFS(l_extendedprice,l_returnflag,"N",l_quantity,"<5")', "coalesce(max(CASE WHEN l_returnflag='N' AND l_quantity<5 THEN l_extendedprice END),0)", by=_BY)
items("fn_minifs", 'MINIFS(l_extendedprice,l_quantity,">45")', "coalesce(min(CASE WHEN l_quantity>45 THEN l_extendedprice END),0)", by=_BY)
group("fn_countif_wildcard", "orders", ["o_orderstatus"], 'COUNTIF(o_orderpriority,"1*")+10*COUNTIF(o_orderpriority,"*e?")', "count(*) FILTER (o_orderpriority ILIKE '1%')+10*count(*) FILTER (o_orderpriority ILIKE '%e_')")
group("fn_dsum", "orders", ["o_orderstatus"], 'DSUM(orders,"o_totalprice",{"o_orderpriority","o_totalprice";"1-URGENT",">100000";"5-LOW",""})', "coalesce(sum(CASE WHEN (o_orderpriority='1-URGENT' AND o_totalprice>100000) OR o_orderpriority='5-LOW' THEN o_totalprice END),0)")
group("fn_daverage", "orders", ["o_orderstatus"], 'DAVERAGE(orders,4,{"o_orderpriority";"2*"})', "avg(CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice END)")


@plan("op_fused_criteria", f"SELECT l_returnflag, {six('sum(CASE WHEN l_discount>0.05 THEN l_extendedprice ELSE 0 END)')} AS high, CAST(count(*) FILTER (l_quantity<10) AS DOUBLE) AS few, {six('avg(CASE WHEN l_tax=0 THEN l_quantity END)')} AS free FROM lineitem GROUP BY l_returnflag")
def _fused(t):
    return Table(t("lineitem")).summarise(["l_returnflag"], high='SUMIFS(l_extendedprice,l_discount,">0.05")', few='COUNTIFS(l_quantity,"<10")', free="AVERAGEIFS(l_quantity,l_tax,0)")


# -- lookups -----------------------------------------------------------------------------------------------------------


@plan("fn_vlookup", "SELECT o_orderkey, c_name AS name, c_nationkey AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _vlookup(t):
    return lookup.exact(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", t("customer"), "c_custkey", {"name": "c_name", "nation": "c_nationkey"}, "c_custkey").drop("o_custkey")


@plan("fn_xlookup", "SELECT n_name, coalesce(r_name, 'none') AS region FROM nation LEFT JOIN region ON n_regionkey + 1 = r_regionkey")
def _xlookup(t):
    nation = t("nation").withColumn("k", F.col("n_regionkey") + 1)
    return lookup.exact(nation, "k", t("region"), "r_regionkey", {"region": "r_name"}, "r_regionkey", missing={"region": "none"}).select("n_name", "region")


@plan("fn_xlookup_last", "SELECT c_custkey, o_orderkey AS latest FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _xlookup_last(t):
    return lookup.exact(t("customer").select("c_custkey"), "c_custkey", t("orders"), "o_custkey", {"latest": "o_orderkey"}, "o_orderkey", last=True)


_APPROXIMATE = "SELECT c_custkey, s_acctbal AS bracket, s_suppkey AS supplier FROM customer ASOF LEFT JOIN (SELECT s_acctbal, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON c_acctbal >= s_acctbal"


@plan("fn_lookup", _APPROXIMATE)
def _lookup(t):
    return lookup.approximate(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", t("supplier"), "s_acctbal", {"bracket": "s_acctbal", "supplier": "s_suppkey"}, order="s_suppkey").drop("c_acctbal")


@plan("fn_vlookup_approximate", "SELECT event_id, o_orderdate AS day FROM events ASOF LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS o_orderdate, epoch(o_orderdate) AS t0 FROM orders) ON epoch(ts) >= t0")
def _asof(t):
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    events = t("events").select("event_id", seconds("ts").alias("at"))
    days = t("orders").select(F.col("o_orderdate").cast("date").alias("o_orderdate"), seconds("o_orderdate").alias("at"))
    return lookup.approximate(events, "at", days, "at", {"day": "o_orderdate"}).drop("at")


@plan("fn_lookup_ties", "SELECT c_custkey, s.s_suppkey AS supplier, CASE WHEN s.s_suppkey IS NULL THEN '#N/A' END AS supplier_error FROM customer ASOF LEFT JOIN (SELECT floor(s_acctbal / 2000) AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON floor(c_acctbal / 2000) >= s.k")
def _lookup_ties(t):
    """Of equal keys the last, here by falling supplier."""
    table = t("supplier").select(F.floor(F.col("s_acctbal") / 2000).alias("k"), "s_suppkey", (-F.col("s_suppkey")).alias("o"))
    sought = t("customer").select("c_custkey", F.floor(F.col("c_acctbal") / 2000).alias("k"))
    return lookup.approximate(sought, "k", table, "k", {"supplier": "s_suppkey"}, order="o", errors=True).drop("k")


@plan("fn_lookup_text", "SELECT r_name, (SELECT max_by(n_name, lower(n_name)) FROM nation WHERE lower(n_name) <= lower(r_name)) AS upto, (SELECT min_by(n_name, lower(n_name)) FROM nation WHERE lower(n_name) >= lower(r_name)) AS since FROM region")
def _lookup_text(t):
    up = lookup.approximate(t("region").select("r_name"), "r_name", t("nation"), "n_name", {"upto": "n_name"}, order="n_nationkey")
    return lookup.approximate(up, "r_name", t("nation"), "n_name", {"since": "n_name"}, descending=True, order="n_nationkey")


@plan("fn_vlookup_missing", "SELECT o_orderkey, c_name AS name, CASE WHEN c_custkey IS NULL THEN '#N/A' END AS name_error FROM orders LEFT JOIN customer ON o_custkey * 2 = c_custkey")
def _vlookup_missing(t):
    orders = t("orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("k"))
    return lookup.exact(orders, "k", t("customer"), "c_custkey", {"name": "c_name"}, "c_custkey", errors=True).drop("k")


@plan("fn_match_wild", "SELECT r_regionkey, CAST(min(p) AS DOUBLE) AS position, CASE WHEN min(p) IS NULL THEN '#N/A' END AS position_error FROM region LEFT JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation) ON n_name ILIKE '%' || substr(r_name, 2, 1) || '_' GROUP BY 1")
def _match_wild(t):
    table = positions(t("nation").select("n_name", "n_nationkey"), F.col("n_nationkey"))
    sought = t("region").select("r_regionkey", F.concat(F.lit("*"), F.substring("r_name", 2, 1), F.lit("?")).alias("k"))
    return lookup.position(sought, "k", table, "n_name", "_pos", errors=True, wild=True).drop("k")


@plan("fn_match", "SELECT o_orderkey, CAST(p AS DOUBLE) AS position FROM orders LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) ON o_custkey = c_custkey")
def _match(t):
    table = positions(t("customer").select("c_custkey"), F.col("c_custkey"))
    return lookup.position(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", table, "c_custkey", "_pos").drop("o_custkey")


@plan("fn_match_descending", "SELECT c_custkey, s_acctbal AS bracket FROM customer ASOF LEFT JOIN (SELECT DISTINCT s_acctbal FROM supplier) ON c_acctbal <= s_acctbal")
def _match_descending(t):
    return lookup.approximate(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", t("supplier"), "s_acctbal", {"bracket": "s_acctbal"}, descending=True).drop("c_acctbal")


@plan("fn_xmatch", "SELECT n_name, CAST(p AS DOUBLE) AS position FROM nation LEFT JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_name) AS p FROM region) ON n_regionkey = r_regionkey")
def _xmatch(t):
    table = positions(t("region").select("r_regionkey", "r_name"), F.col("r_name"))
    return lookup.position(t("nation"), "n_regionkey", table, "r_regionkey", "_pos", last=True).select("n_name", "position")


part("fn_hlookup", 'HLOOKUP(p_size,{1,20,40;"s","m","l"},2)', "CASE WHEN p_size>=40 THEN 'l' WHEN p_size>=20 THEN 'm' ELSE 's' END", False)
part("fn_index", "INDEX({10,20;30,40},MOD(p_size,2)+1,2)", "CASE WHEN p_size%2=0 THEN 20 ELSE 40 END")
part("fn_choose", 'CHOOSE(MOD(p_size,3)+1,"a","b","c")', "CASE p_size%3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END", False)
part("fn_vlookup_constant", 'VLOOKUP(MOD(p_size,4),{0,"x";1,"y";2,"z"},2,FALSE)', "CASE p_size%4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'z' END", False, errors="CASE WHEN p_size%4=3 THEN '#N/A' END")
part("fn_xlookup_constant", 'XLOOKUP(p_brand,{"Brand#11","Brand#12"},{1,2},0)', "CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 0 END")
_LETTERS = "CASE WHEN p_size>26 THEN chr(64+(p_size-1)//26) ELSE '' END||chr(65+(p_size-1)%26)"
part("fn_address", "ADDRESS(p_partkey+1,p_size)", f"'$'||{_LETTERS}||'$'||(p_partkey+1)", False)
part("fn_column", "COLUMN(p_size)", "5")
part("fn_columns", "COLUMNS({1,2,3})+0*p_size", "3")
part("fn_cell", 'CELL("type",p_name)&CELL("type",p_size)', "'lv'", False)
part("fn_hyperlink", 'HYPERLINK("item/"&p_partkey,p_name)', "p_name", False)


@plan("fn_row", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS DOUBLE) AS v FROM orders")
def _row(t):
    return Table(positions(t("orders").select("o_orderkey"), F.col("o_orderkey"))).select("o_orderkey", v="ROW()")


# -- logic -------------------------------------------------------------------------------------------------------------

customer("fn_if", 'IF(c_acctbal<0,"owes",c_mktsegment)', "CASE WHEN c_acctbal<0 THEN 'owes' ELSE c_mktsegment END", False)
part("fn_ifs", 'IFS(p_size>40,"l",p_size>20,"m",TRUE,"s")', "CASE WHEN p_size>40 THEN 'l' WHEN p_size>20 THEN 'm' ELSE 's' END", False)
customer("fn_switch", 'SWITCH(c_mktsegment,"BUILDING",1,"machinery",2,0)', "CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END")
part("fn_iferror", "IFERROR(1/(p_size-10),-1)", "coalesce(1.0/nullif(p_size-10,0),-1)")
part("fn_iferror_refusal", "IFERROR(RANDARRAY(),p_size)", "CAST(NULL AS DOUBLE)", errors="'#UNSUPPORTED!'")
part("fn_ifna", "IFNA(IF(p_size>10,NA(),p_size),0)", "CASE WHEN p_size>10 THEN 0 ELSE p_size END")
part("fn_not", "NOT(p_size>10)", "NOT p_size>10", False)
part("fn_and_row", "AND(p_size>10,p_retailprice<1500,1)", "p_size>10 AND p_retailprice<1500", False)
part("fn_true", "TRUE()", "true", False)
part("fn_false", "FALSE()", "false", False)
part("fn_na", "NA()", "CAST(NULL AS DOUBLE)", errors="'#N/A'")
part("fn_isblank", "ISBLANK(p_name)", "p_name IS NULL", False)
part("fn_iserr", "ISERR(1/(p_size-10))", "p_size=10", False)
part("fn_iserror", "ISERROR(IF(p_size>10,NA(),1))", "p_size>10", False)
part("fn_isna", "ISNA(IF(p_size>10,NA(),1/0))", "p_size>10", False)
part("fn_isnumber", "ISNUMBER(IF(p_size>10,p_name,p_size))", "p_size<=10", False)
part("fn_istext", "ISTEXT(IF(p_size>10,p_name,p_size))", "p_size>10", False)

# -- mathematics and statistics ------------------------------------------------------------------------------------------

customer("fn_abs", "ABS(c_acctbal)", "abs(c_acctbal)")
customer("fn_int", "INT(c_acctbal)", "floor(c_acctbal)")
_SEVENTH = digits("abs(c_acctbal/7)*100")
customer("fn_trunc", "TRUNC(c_acctbal/7,2)", f"sign(c_acctbal)*floor({_SEVENTH})/100")
customer("fn_round", "ROUND(c_acctbal/7,2)", f"sign(c_acctbal)*floor({_SEVENTH}+0.5)/100")
customer("fn_roundup", "ROUNDUP(c_acctbal/7,2)", f"sign(c_acctbal)*ceil({_SEVENTH})/100")
customer("fn_rounddown", "ROUNDDOWN(c_acctbal,-2)", "trunc(c_acctbal/100)*100")
customer("fn_mod", "MOD(c_acctbal,-7)", "c_acctbal+7*floor(c_acctbal/-7)")
customer("fn_quotient", "QUOTIENT(c_acctbal,7)", "trunc(c_acctbal/7)")
customer("fn_ceiling", "CEILING(c_acctbal,5)", "ceil(c_acctbal/5)*5")
customer("fn_floor", "FLOOR(c_acctbal,5)", "floor(c_acctbal/5)*5")
customer("fn_sqrt", "SQRT(c_acctbal)", "CASE WHEN c_acctbal>=0 THEN sqrt(abs(c_acctbal)) END", errors="CASE WHEN c_acctbal<0 THEN '#NUM!' END")
customer("fn_ln", "LN(c_acctbal)", "CASE WHEN c_acctbal>0 THEN ln(abs(c_acctbal)+CASE WHEN c_acctbal=0 THEN 1 ELSE 0 END) END", errors="CASE WHEN c_acctbal<=0 THEN '#NUM!' END")
part("fn_power", "POWER(p_size,0.5)", "sqrt(p_size)")
part("fn_exp", "EXP(p_size/10)", "exp(p_size/10.0)")
part("fn_log", "LOG(p_size,2)", "ln(p_size)/ln(2)")
part("fn_log10", "LOG(p_retailprice)", "log10(p_retailprice)")
for _f in ("sin", "cos", "atan"):
    part(f"fn_{_f}", f"{_f.upper()}(p_size)", f"{_f}(p_size)")
part("fn_acos", "ACOS(p_size/100)", "acos(p_size/100.0)")
part("fn_asin", "ASIN(p_size/100)", "asin(p_size/100.0)")
part("fn_pi", "PI()*p_size", "pi()*p_size")


def _erf(x: str) -> str:
    return f"2/sqrt(pi())*list_sum([pow(-1,n)*pow({x},2*n+1)/(factorial(CAST(n AS INTEGER))*(2*n+1)) for n in range(0,30)])"


part("fn_erfc", "ERFC(p_size/40)", f"1-{_erf('(p_size/40.0)')}")
part("fn_normdist", "NORMDIST(p_size,25,20,TRUE)", f"0.5+0.5*{_erf('((p_size-25)/20.0/sqrt(2))')}")
part("fn_norm_dist", "NORM.DIST(p_size,25,20,FALSE)", "exp(-pow((p_size-25)/20.0,2)/2)/(20*sqrt(2*pi()))")


def _probit(p: str) -> str:
    """The quantile of the normal distribution by bisection of its distribution function, which is a series here."""
    return f"list_reduce([-6.0]||[pow(0.5,k)*6 for k in range(0,40)], lambda z,w: CASE WHEN 0.5+0.5*sign(z+w)*({_erf('(abs(z+w)/sqrt(2))')}) < {p} THEN z+w ELSE z END)"


part("fn_normsinv", "NORMSINV((p_size+9)/70)", _probit("((p_size+9)/70.0)"))
part("fn_norminv", "NORMINV((p_size+9)/70,5,3)", f"5+3*{_probit('((p_size+9)/70.0)')}")

# -- finance -------------------------------------------------------------------------------------------------------------

_G = "pow(1.005,p_size)"
_PMT = f"(p_retailprice*{_G}*0.005/({_G}-1))"
part("fn_pmt", "PMT(0.005,p_size,p_retailprice)", f"-{_PMT}")
part("fn_pv", "PV(0.005,p_size,-100)", f"100*({_G}-1)/0.005/{_G}")
part("fn_fv", "FV(0.005,p_size,-100,-p_retailprice,1)", f"p_retailprice*{_G}+100*1.005*({_G}-1)/0.005")
part("fn_ipmt", "IPMT(0.005,1,p_size,p_retailprice)", "-p_retailprice*0.005")
part("fn_ppmt", "PPMT(0.005,1,p_size,p_retailprice)", f"-{_PMT}+p_retailprice*0.005")
part("fn_sln", "SLN(p_retailprice,100,p_size)", "(p_retailprice-100)/p_size")
part("fn_vdb", "VDB(p_retailprice,100,10,0,1.5)", "p_retailprice*0.2+p_retailprice*0.8*0.2*0.5")
part("fn_vdb_switch", "VDB(p_retailprice,10,10,0,10)", "p_retailprice-10")
part("fn_npv", "NPV(0.1,-1000,p_retailprice,p_size)", "-1000/1.1+p_retailprice/1.21+p_size/1.331")
_ROOT = "(2*p_size/(sqrt(p_retailprice*p_retailprice+4000*p_size)-p_retailprice)-1)"  # -1000 + a x + b x^2 = 0 for x = 1 / (1 + r)
part("fn_irr", "IRR(HSTACK(-1000,p_retailprice,p_size))", _ROOT)
part("fn_xnpv", "XNPV(0.1,HSTACK(-1000,p_retailprice,p_size),{40000,40365,40465})", "-1000+p_retailprice/1.1+p_size/pow(1.1,465/365.0)")
part("fn_xirr", "XIRR(HSTACK(-1000,p_retailprice,p_size),{40000,40365,40730})", _ROOT)


@plan("fn_npv_range", f"SELECT o_custkey, {six('sum(o_totalprice/pow(1.1, n))')} AS v FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1")
def _npv_range(t):
    return Table(t("orders").withColumn(ORDER, F.col("o_orderkey"))).summarise(["o_custkey"], v="NPV(0.1,o_totalprice)")


# -- dates ---------------------------------------------------------------------------------------------------------------

order("fn_date", "DATE(YEAR(o_orderdate),MONTH(o_orderdate)+14,1)", serial("date_trunc('month',o_orderdate)+INTERVAL 14 MONTH"))
order("fn_datevalue", 'DATEVALUE(1+MOD(o_orderkey,12)&"/"&1+MOD(o_custkey,28)&"/2011")', serial("make_date(2011,1+o_orderkey%12,1+o_custkey%28)"))
order("fn_year", "YEAR(o_orderdate)", "year(o_orderdate)")
order("fn_month", "MONTH(o_orderdate)", "month(o_orderdate)")
order("fn_day", "DAY(o_orderdate)", "day(o_orderdate)")
row("fn_hour", "events", "event_id", "HOUR(ts)", "hour(ts)")
order("fn_weekday", "WEEKDAY(o_orderdate,2)*10+WEEKDAY(o_orderdate)", "isodow(o_orderdate)*10+dayofweek(o_orderdate)+1")
order("fn_edate", "EDATE(o_orderdate,3)", serial("o_orderdate+INTERVAL 3 MONTH"))
order("fn_eomonth", "EOMONTH(o_orderdate,-1)", serial("last_day(o_orderdate-INTERVAL 1 MONTH)"))
_THIRTY = "(year(o_orderdate)-1994)*360+(month(o_orderdate)-1)*30+day(o_orderdate)-15"
order("fn_days360", "DAYS360(DATE(1994,1,15),o_orderdate)", _THIRTY)
order("fn_days360_european", "DAYS360(DATE(1994,1,15),o_orderdate,TRUE)", _THIRTY.replace("day(o_orderdate)", "least(day(o_orderdate),30)"))
order("fn_yearfrac", "YEARFRAC(DATE(1994,1,15),o_orderdate,3)", "date_diff('day',DATE '1994-01-15',CAST(o_orderdate AS DATE))/365.0")
_SINCE = "date_diff('day',DATE '1994-01-03',CAST(o_orderdate AS DATE))"
order("fn_networkdays", "NETWORKDAYS(DATE(1994,1,3),o_orderdate)", f"({_SINCE}//7)*5+least({_SINCE}%7+1,5)")
order("fn_networkdays_holidays", "NETWORKDAYS(DATE(1994,1,3),o_orderdate,{35431,35796,35797,36161})", f"({_SINCE}//7)*5+least({_SINCE}%7+1,5)-(CASE WHEN o_orderdate>=DATE '1997-01-01' THEN 1 ELSE 0 END)-(CASE WHEN o_orderdate>=DATE '1998-01-01' THEN 1 ELSE 0 END)-(CASE WHEN o_orderdate>=DATE '1998-01-02' THEN 1 ELSE 0 END)-(CASE WHEN o_orderdate>=DATE '1999-01-01' THEN 1 ELSE 0 END)")
order("fn_workday_back", "WORKDAY(o_orderdate,-5)", f"{serial('o_orderdate')}-CASE isodow(o_orderdate) WHEN 6 THEN 5 WHEN 7 THEN 6 ELSE 7 END")
order("fn_workday", "WORKDAY(o_orderdate,10)", f"{serial('o_orderdate')}+CASE isodow(o_orderdate) WHEN 6 THEN 13 WHEN 7 THEN 12 ELSE 14 END")

# -- text ----------------------------------------------------------------------------------------------------------------

part("fn_left", "LEFT(p_name,4)", "substr(p_name,1,4)", False)
part("fn_right", "RIGHT(p_name,3)", "right(p_name,3)", False)
part("fn_mid", "MID(p_name,3,4)", "substr(p_name,3,4)", False)
part("fn_len", "LEN(p_name)", "length(p_name)")
row("fn_len_wide", "documents", "doc_id", "LEN(text)", "length(text)+length(regexp_replace(text,'[^\\x{10000}-\\x{10FFFF}]','','g'))")
part("fn_upper", "UPPER(p_name)", "upper(p_name)", False)
part("fn_lower", "LOWER(p_type)", "lower(p_type)", False)
part("fn_proper", "PROPER(p_brand)", "upper(substr(p_brand,1,1))||lower(substr(p_brand,2))", False)
part("fn_trim", 'TRIM("  "&p_name&"   "&p_brand&" ")', "trim(regexp_replace(p_name||' '||p_brand,' +',' ','g'))", False)
part("fn_concatenate", 'CONCATENATE(p_brand,"-",p_size)', "p_brand||'-'||p_size", False)
part("fn_textjoin", 'TEXTJOIN("|",TRUE,p_brand,"",p_type)', "p_brand||'|'||p_type", False)
part("fn_rept", "REPT(p_brand,2)", "repeat(p_brand,2)", False)
part("fn_find", 'FIND("r",p_brand,2)', "CASE WHEN instr(substr(p_brand,2),'r')>0 THEN instr(substr(p_brand,2),'r')+1 END", errors="CASE WHEN instr(substr(p_brand,2),'r')=0 THEN '#VALUE!' END")
part("fn_search", 'SEARCH("R?N",p_brand)', "CASE WHEN regexp_matches(p_brand,'(?i)r.n') THEN length(regexp_extract(p_brand,'(?i)^(.*?)r.n',1))+1 END", errors="CASE WHEN NOT regexp_matches(p_brand,'(?i)r.n') THEN '#VALUE!' END")
part("fn_substitute", 'SUBSTITUTE(p_type,"E","e")', "replace(p_type,'E','e')", False)
part("fn_substitute_nth", 'SUBSTITUTE("a-b-"&p_size,"-","+",2)', "'a-b+'||p_size", False)
part("fn_exact", "EXACT(p_brand,UPPER(p_brand))", "p_brand=upper(p_brand)", False)
part("fn_value", 'VALUE("$"&p_size&".50")*2', "(p_size+0.5)*2")
part("fn_text", 'TEXT(p_retailprice,"#,##0.00")', "format('{:,.2f}',p_retailprice)", False)
part("fn_text_padded", 'TEXT(p_size,"000")', "lpad(CAST(p_size AS VARCHAR),3,'0')", False)
order("fn_text_date", 'TEXT(o_orderdate,"dd/mm/yyyy")', "strftime(o_orderdate,'%d/%m/%Y')", False)

# -- dynamic arrays ---------------------------------------------------------------------------------------------------------


@plan("fn_filter", "SELECT p_partkey, p_size FROM part WHERE p_size > 40 AND p_brand <> 'Brand#11'")
def _filter(t):
    return arrays.filter_rows(t("part").select("p_partkey", "p_size", "p_brand"), 'AND(p_size>40,p_brand<>"Brand#11")').select("p_partkey", "p_size")


@plan("fn_sort", "SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) - 1 AS place FROM customer")
def _sort(t):
    return arrays.sort(t("customer").select("c_custkey", "c_nationkey"), ("c_nationkey", -1), order="c_custkey", place="place")


@plan("fn_sortby", "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY lower(c_mktsegment), c_acctbal DESC, c_custkey) - 1 AS place FROM customer")
def _sortby(t):
    return arrays.sort(t("customer"), ("c_mktsegment", 1), ("c_acctbal", -1), order="c_custkey", place="place").select("c_custkey", "c_mktsegment", "place")


part("fn_sort_formula", "SUMPRODUCT(SORT(HSTACK(p_size,25,p_retailprice/40),1,-1,TRUE),{1,10,100})", "greatest(p_size,25,p_retailprice/40)+10*(p_size+25+p_retailprice/40-greatest(p_size,25,p_retailprice/40)-least(p_size,25,p_retailprice/40))+100*least(p_size,25,p_retailprice/40)")
part("fn_filter_formula", "SUM(FILTER(VSTACK(p_size,25,30),VSTACK(p_size>25,TRUE,p_size<40),0))", "25+CASE WHEN p_size>25 THEN p_size ELSE 0 END+CASE WHEN p_size<40 THEN 30 ELSE 0 END")
part("fn_unique_formula", "ROWS(UNIQUE(VSTACK(MOD(p_size,2),MOD(p_size,3),0)))", "len(list_distinct([p_size%2,p_size%3,0]))")
part("fn_sortby_formula", "INDEX(SORTBY({1;2;3},VSTACK(p_size,25,p_retailprice/40)),1)", "CASE WHEN p_size<=25 AND p_size<=p_retailprice/40 THEN 1 WHEN 25<=p_retailprice/40 THEN 2 ELSE 3 END")
part("fn_lookup_kinds", "XLOOKUP(MOD(p_size,3),{0,1},HSTACK(p_name,p_size),NA())", "CASE p_size%3 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) END", False, errors="CASE WHEN p_size%3=2 THEN '#N/A' END")
part("fn_vlookup_wild", "VLOOKUP(LEFT(p_brand,5)&\"*\"&RIGHT(p_brand,1),{\"brand~*1\",1;\"Brand#21\",2;\"xBrand#31\",3;\"brand#33\",4;\"BRAND#x2\",5},2,FALSE)", "CASE right(p_brand,1) WHEN '1' THEN 1 WHEN '3' THEN 4 WHEN '2' THEN 5 END", errors="CASE WHEN right(p_brand,1) NOT IN ('1','2','3') THEN '#N/A' END")
part("fn_xlookup_literal", "XLOOKUP(IF(p_size>25,\"a*\",\"abc\"),{\"abc\",\"a*\"},{1,2})", "CASE WHEN p_size>25 THEN 2 ELSE 1 END")


@plan("fn_unique", "SELECT c_mktsegment, c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def _unique(t):
    return arrays.unique(t("customer"), ["c_mktsegment", "c_nationkey"], order="c_custkey")


@plan("fn_unique_once", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def _unique_once(t):
    return arrays.unique(t("orders"), ["o_custkey"], exactly_once=True)


@plan("fn_sequence", "SELECT CAST(5 + 0.5 * i AS DOUBLE) AS value FROM range(1000) r(i)")
def _sequence(t):
    return arrays.sequence(t("region").sparkSession, 1000, 5, 0.5)


part("fn_randarray", "RANDARRAY(2)", "CAST(NULL AS DOUBLE)", errors="'#UNSUPPORTED!'")


@plan("fn_tocol", "SELECT s_suppkey, 0 AS _c, s_nationkey + 0.0::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 1, s_acctbal FROM supplier")
def _tocol(t):
    return arrays.to_column(t("supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("double")), ["s_nationkey", "s_acctbal"], "s_suppkey")


part("fn_torow", "SUMPRODUCT(TOROW(VSTACK(HSTACK(p_size,1),{2,3}),0,TRUE),{1,10,100,1000})", "p_size+3120")


@plan("fn_vstack", "SELECT n_nationkey AS c1, n_name AS c2, n_regionkey AS c3, CAST(NULL AS VARCHAR) AS c1_error, CAST(NULL AS VARCHAR) AS c2_error, CAST(NULL AS VARCHAR) AS c3_error FROM nation UNION ALL SELECT r_regionkey, r_name, NULL, NULL, NULL, '#N/A' FROM region")
def _vstack(t):
    return arrays.vstack(t("nation").select("n_nationkey", "n_name", "n_regionkey"), t("region").select("r_regionkey", "r_name"), errors=True)


@plan("fn_hstack", "SELECT _pos, n_name, r_name, CAST(NULL AS VARCHAR) AS left_error, CASE WHEN r_name IS NULL THEN '#N/A' END AS right_error FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS _pos FROM nation) FULL JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS _pos FROM region) USING (_pos)")
def _hstack(t):
    return arrays.hstack(t("nation").select("n_name"), [F.col("n_name")], t("region").select("r_name"), [F.col("r_name")], errors=True)


@plan("fn_take", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _take(t):
    return arrays.take(t("orders"), 10, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey")


@plan("fn_take_last", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def _take_last(t):
    return arrays.take(t("orders").select("o_orderkey"), -7, F.col("o_orderkey"))


@plan("fn_drop", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 25")
def _drop(t):
    return arrays.drop(t("orders").select("o_orderkey"), 25, F.col("o_orderkey"))


@plan("fn_expand", "SELECT i AS _pos, CASE WHEN r_name IS NULL THEN 'none' ELSE r_name END AS r_name FROM range(8) g(i) LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS p FROM region) ON p = i")
def _expand(t):
    return arrays.expand(t("region").select("r_name"), 8, {"r_name": "none"}, F.col("r_name"))


_WRAP = "SELECT p // 3 AS _row, max(CASE WHEN p % 3 = 0 THEN n_name END) AS c1, max(CASE WHEN p % 3 = 1 THEN n_name END) AS c2, max(CASE WHEN p % 3 = 2 THEN n_name END) AS c3 FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) GROUP BY 1"


@plan("fn_wraprows", _WRAP)
def _wraprows(t):
    return arrays.wrap_rows(t("nation"), "n_name", 3, F.col("n_nationkey"))


part("fn_wrapcols", "SUMPRODUCT(WRAPCOLS(HSTACK(p_size,1,2,3),2),{1,10;100,1000})", "p_size+3120")


@plan("fn_chooserows", "SELECT _at, n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS p, row_number() OVER (ORDER BY n_nationkey DESC) AS q FROM nation) JOIN (VALUES (0, 3, 0), (1, 0, 1), (2, 3, 0)) w(_at, a, b) ON p = a OR q = b")
def _chooserows(t):
    return arrays.choose_rows(t("nation"), [3, -1, 3], F.col("n_nationkey")).select("_at", "n_name")


@plan("fn_choosecols", "SELECT n_regionkey, n_nationkey FROM nation")
def _choosecols(t):
    return arrays.choose_columns(t("nation").select("n_nationkey", "n_name", "n_regionkey"), -1, 1)


@plan("op_first_error", "SELECT user_id, arg_min(e, event_id) FILTER (e IS NOT NULL) AS v_error FROM (SELECT user_id, event_id, CASE WHEN event_id%5=1 THEN '#N/A' WHEN event_id%7=2 THEN '#DIV/0!' END AS e FROM events) GROUP BY 1")
def _first_error(t):
    """The first error of a range, by place."""
    rows = t("events").select("user_id", "event_id", F.col("event_id").alias(ORDER))
    return Table(rows).summarise(["user_id"], errors=True, v="SUM(IF(MOD(event_id,5)=1,NA(),IF(MOD(event_id,7)=2,1/0,event_id)))").drop("v")


from . import workbook_queries as _books  # noqa: E402

QUERIES |= _books.QUERIES
SQL |= _books.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several conditional sums over the largest table in one pass."""
    return QUERIES["op_fused_criteria"](spark, sf_dir)
