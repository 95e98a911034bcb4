"""Values stated by the documentation of the functions."""

import math

import pytest

from sheetwise.table import evaluate

GOLDEN = {
    'SUM(TRUE,"2")': 3, 'PRODUCT(2,"3",TRUE)': 6, 'SUMSQ(3,"4",TRUE)': 26, 'AVERAGEA({10,7,9,2,"Not available"})': 5.6, "MOD(-3,2)": 1, "MOD(3,-2)": -1,
    "INT(-8.9)": -9, "QUOTIENT(-10,3)": -3, "ROUND(1.005,2)": 1.01, "ROUND(2.675,2)": 2.68, "CEILING(2.5,0)": 0, "CEILING(2.5,-2)": "#NUM!", "FLOOR(2.5,0)": "#DIV/0!",
    "SLN(10000,1000,0)": "#DIV/0!", "IRR({-100,30,40,50,60})": 0.2489, "IRR({100,200,300})": "#NUM!", "VDB(10000,1000,5,0,0.5)": 2000, "VDB(10000,1000,5,4,5)": 296,
    "VDB(100,10,5,0,1,0)": 18, "DAYS360(DATE(2011,1,1),DATE(2011,12,31))": 360, "WEEKDAY(DATE(2020,1,1),1.9)": 4, "EDATE(DATE(2020,1,31),1)": 43890, "HOUR(0.75)": 18, "HOUR(-0.25)": "#NUM!",
    'LEN("😀")': 2, 'PROPER("2-cent\'s worth")': "2-Cent'S Worth", 'SEARCH("b?d","abcd")': 2, 'TEXT("1234.5","0.00")': "1234.50", "VLOOKUP(2,{5;2;8;2;1;9;3},1)": 2, "MATCH(2,{5;2;8;2;1;9;3})": 4,
    "SUMPRODUCT({1,2},{3,#N/A})": "#N/A", "XOR({1,0})": True, "SUM(MAP({1,2},{3,4},LAMBDA(a,b,a*b+1.5)))": 14, "SUM(MAKEARRAY(3,4,LAMBDA(i,j,i*j)))": 60, 'REDUCE("",{1,2,3},LAMBDA(a,b,a&b))': "123",
    "-2^2": 4, "2^3^2": 64, "0.1+0.2=0.3": True, '""&(1/3)': "0.333333333333333", '""&10^20': "1E+20", '""&10^19': "10000000000000000000", '""&1.5*10^-18': "1.5E-18", '""&1234.5': "1234.5", '""&-0.05': "-0.05",
    "DATE(1900,2,28)": 59, "DATE(1900,3,1)": 61, "DAY(60)": 29, "MONTH(60)": 2, "DAY(61)": 1, 'COUNTIF({4,6,7,"8"},">$5")': 2, 'COUNTIF({"apple","Banana","apricot"},"ap*")': 2, 'SUMIFS({1,2,3},{"a","b","a"},"a",{5,6,7},">5")': 3,
    "1/0": "#DIV/0!", 'IFERROR(1/0,"x")': "x", "IFNA(NA(),7)": 7, "ISERR(NA())": False, "IFERROR(RANDARRAY(),1)": "#UNSUPPORTED!", 'IF("yes",1,2)': "#VALUE!", 'IFS(FALSE,1,TRUE,"b")': "b", "IFS(FALSE,1)": "#N/A",
    'SWITCH(2,1,"a",2,"b","c")': "b", 'CHOOSE(2.9,"x","y")': "y", "CHOOSE(3,1,2)": "#VALUE!", "0^0": "#NUM!", "0^-1": "#DIV/0!", "(-8)^(1/3)": -2, '"a"="A"': True, 'EXACT("a","A")': False, '"5"=5': False, '"b">1': True, "TRUE>\"z\"": True,
    "LOG(8,2)": 3, "LOG(100)": 2, "LOG(5,1)": "#DIV/0!", "LN(0)": "#NUM!", "ERFC(0.5)": 0.4795001221869535, "ERFC(3)": 2.209049699858544e-05, "ERFC(-1)": 1.842700792949715, "NORMDIST(42,40,1.5,TRUE)": 0.9087887802741321, "NORMSINV(0.908789)": 1.3333346730441074, "NORMINV(0.5,3,2)": 3,
    "PMT(0.08/12,10,10000)": -1037.0320893591606, "PV(0.08/12,240,500)": -59777.14585118777, "FV(0.06/12,10,-200,-500,1)": 2581.4033740601185, "IPMT(0.1/12,1,36,8000)": -66.66666666666667, "PPMT(0.1/12,1,24,2000)": -75.62318600836673, "NPV(0.1,-10000,3000,4200,6800)": 1188.4434123352207,
    "XNPV(0.09,{-10000,2750,4250,3250,2750},{39448,39508,39751,39859,39904})": 2086.647602031535, "XIRR({-10000,2750,4250,3250,2750},{39448,39508,39751,39859,39904})": 0.373362535, "RANK(3,{1,3,5,3})": 2, "LARGE({3,5,3,5,4},2)": 5, "SMALL({3,5,3,5,4},3)": 4, "SMALL({1,2},3)": "#NUM!", "MEDIAN({1,2,3,4})": 2.5, "STDEV({1,2,3,4})": 1.2909944487358056,
    "CORREL({3,2,4,5,6},{9,7,12,15,17})": 0.9970544855015815, "NETWORKDAYS(41183,41334)": 110, "NETWORKDAYS(41183,41334,{41235})": 109, "WORKDAY(39722,151)": 39933, "WORKDAY(39722,-5)": 39715, "YEARFRAC(40909,41120,2)": 211 / 360, "YEARFRAC(40909,41120,1)": "#UNSUPPORTED!", "EOMONTH(40544,-3)": 40482, 'DATEVALUE("8/22/2011")': 40777,
    'LEFT("Sale Price",4)': "Sale", 'RIGHT("Sale Price",5)': "Price", 'MID("Fluid Flow",7,20)': "Flow", 'MID("abc",0,1)': "#VALUE!", 'TRIM("  a   b ")': "a b", 'REPT("-",3)': "---", 'FIND("M","Miriam McGovern",3)': 8, 'FIND("z","abc")': "#VALUE!", 'SUBSTITUTE("Quarter 1, 2011","1","2",3)': "Quarter 1, 2012", 'SUBSTITUTE("aaa","a","b")': "bbb", 'SUBSTITUTE("a.b.c",".","",2)': "a.bc",
    'VALUE("$1,000")': 1000, 'VALUE("16:48:00")': 0.7, 'VALUE("x")': "#VALUE!", 'VALUE("(5)")': -5, 'VALUE("5%")': 0.05, 'TEXT(1234.567,"#,##0.00")': "1,234.57", 'TEXT(0.285,"0.0%")': "28.5%", 'TEXT(40909,"yyyy-mm-dd")': "2012-01-01", 'TEXT(7,"000")': "007", 'TEXT(5,"[red]0")': "#UNSUPPORTED!", 'CONCAT({"a","b"},1)': "ab1", 'TEXTJOIN(", ",TRUE,"a","","b")': "a, b", 'UPPER("é")': "#UNSUPPORTED!",
    "ADDRESS(2,3)": "$C$2", "ADDRESS(2,3,2)": "C$2", "ADDRESS(2,3,2,FALSE)": "R2C[3]", 'ADDRESS(2,3,1,FALSE,"EXCEL SHEET")': "'EXCEL SHEET'!R2C3", "ADDRESS(1,703)": "$AAA$1", "ADDRESS(1,702)": "$ZZ$1", "ADDRESS(0,1)": "#VALUE!", 'HLOOKUP("B",{"A","B";1,2},2,FALSE)': 2, 'LOOKUP(4.2,{1,4,6},{"x","y","z"})': "y", 'XLOOKUP("q",{"a","b"},{1,2},"none")': "none", "XMATCH(4,{1,4,4},0,-1)": 3, "INDEX({1,2;3,4},2,1)": 3, "INDEX({1,2;3,4},3,1)": "#REF!",
    "SEQUENCE(3)": [[1], [2], [3]], "TAKE({1,2,3},,-2)": [[2, 3]], "DROP({1;2;3},1)": [[2], [3]], "EXPAND({1},1,2,0)": [[1, 0]], "WRAPROWS({1,2,3},2)": [[1, 2], [3, "#N/A"]], "WRAPCOLS({1,2,3},2,0)": [[1, 3], [2, 0]], "CHOOSECOLS({1,2,3},-1,1)": [[3, 1]], "CHOOSEROWS({1;2},2)": [[2]], "VSTACK({1,2},3)": [[1, 2], [3, "#N/A"]], "HSTACK({1;2},{3;4})": [[1, 3], [2, 4]], "TOCOL({1,2;3,4})": [[1], [2], [3], [4]], "TOROW({1,2;3,4},0,TRUE)": [[1, 3, 2, 4]],
    "{1,2}+{10;20}": [[11, 12], [21, 22]], "SCAN(0,{1,2,3},LAMBDA(a,b,a+b))": [[1, 3, 6]], "BYROW({1,2;3,4},LAMBDA(r,SUM(r)))": [[3], [7]], "BYCOL({1,2;3,4},LAMBDA(r,MAX(r)))": [[3, 4]], "LET(x,2,y,x*3,x+y)": 8, "LAMBDA(x,x+1)": "#CALC!", "LAMBDA(x,y,x*y)(3,4)": 12, "LAMBDA(x,x)(1,2)": "#VALUE!", "NOSUCH(1)": "#NAME?", 'WEBSERVICE("u")': "#BLOCKED!", "ROWS({1;2;3})": 3, 'XLOOKUP("a*",{"abc","a*"},{1,2})': 2, 'VLOOKUP("a~*",{"abc",1;"a*",2},2,FALSE)': 2, 'VLOOKUP("a*",{"xabc",1;"abc",2},2,FALSE)': 2, 'XMATCH("b?d",{"bcd","b?d"})': 2, "SORT({3;1;2})": [[1], [2], [3]], 'SORT({3,"b";1,"a";2,"c"},2,-1)': [[2, "c"], [3, "b"], [1, "a"]], "SORT({3,1,2},1,1,TRUE)": [[1, 2, 3]],
    "FILTER({1;2;3},{1;0;1})": [[1], [3]], "FILTER({1,2,3},{TRUE,FALSE,TRUE})": [[1, 3]], "FILTER({1;2},{0;0})": [["#CALC!"]], 'FILTER({1;2},{0;0},"none")': [["none"]], "FILTER({1;2},{0;0;1})": [["#VALUE!"]], 'UNIQUE({1;2;1;"a"})': [[1], [2], ["a"]], 'UNIQUE({"a";"A"})': [["#UNSUPPORTED!"]], "UNIQUE({1;2;1},FALSE,TRUE)": [[2]], 'SORTBY({"x";"y";"z"},{1;1;2},-1,{5;4;3})': [["z"], ["y"], ["x"]],
    "SUM(FILTER({1;2;3},{1;0;1})*2)": 8, 'VLOOKUP(2,SORT({2,"b";1,"a"}),2,FALSE)': "b", "INDEX(SORT({3;1;2}),2)": 2, "TOCOL({1,#N/A;2,3},2)": [[1], [2], [3]], 'IF({TRUE,FALSE},1,"x")': [[1, "x"]], "SUMPRODUCT(SORT({2;1}),{3;4})": 11, 'XLOOKUP(2,SORT({2;1}),{"p";"q"},"no")': "q", "LOOKUP(2.5,SORT({3;2;1}))": 2, "RANK(2,SORT({3;2;1}))": 2, 'COUNT(SORT({3;"x"}))': 1, "OFFSET({1},1,1)": "#UNSUPPORTED!", "COLUMNS({1,2})": 2, "50%": 0.5, "@{7,8}": 7,
    "AND({TRUE,1})": True, 'OR(FALSE,"TRUE")': True, "NOT(0)": True, "MINA({TRUE,5})": 1, 'MAXA({FALSE,-5,"x"})': 0, "COUNT({1,\"2\",TRUE},\"3\")": 2, 'COUNTA({1,"",TRUE})': 3, "MAXIFS({1,5,3},{1,0,1},1)": 3, "AVERAGEIF({1,2,3},\">5\")": "#DIV/0!", "ROUNDUP(-3.14159,1)": -3.2, "ROUNDDOWN(31415.92654,-2)": 31400, "TRUNC(-8.9)": -8, "POWER(5,2)": 25, "SQRT(-1)": "#NUM!", "PI()": math.pi, 'HYPERLINK("u","n")': "n", 'CELL("type","x")': "l",
}


@pytest.mark.parametrize("chunk", range(8))
def test_golden(spark, chunk):
    wrong = []
    for formula, want in list(GOLDEN.items())[chunk::8]:
        try:
            got = evaluate(spark, formula)
        except Exception as x:
            got = f"{type(x).__name__}: {str(x)[:200]}"
        same = abs(got - want) <= 1e-4 * max(1e-8, abs(want)) if isinstance(want, float) and isinstance(got, float) else got == want
        if not same:
            wrong.append((formula, got, want))
    assert not wrong, "\n".join(map(str, wrong))
