"""The formula language: parsing, plain values, columns that agree with them, patterns, recalculation."""

import math

import pytest

from gridloom.errors import ParseError
from gridloom.functions import columns as C
from gridloom.functions import scalar as S
from gridloom.functions.numfmt import color, format_column, format_value
from gridloom.plans import formulas as P
from gridloom.plans.addresses import Cell, column_letters, column_number, fill, parse_cell, parse_range
from gridloom.plans.grid import Cycle, Graph, Grid, evaluate_once, same_template

ROWS = [(1, 2.5, "hello World", True), (-7, 0.0, "", False), (None, -1.5, None, None), (12, 100.0, "ÄbC o'neil", True), (0, 9.0, "  x ", False)]
FORMULAS = [
    "=n+x", "=-n^2", "=n*50%", "=x/n", "=n=1", "=n<>x", "=x>=2", "=t&\":\"&n&b", "=SUM(n,x,t)", "=AVERAGE(n,t)", "=AVERAGE(t)", "=COUNT(n,x,t,b)", "=MAX(n,x)", "=MIN(t)", "=PRODUCT(n,x)", "=PRODUCT(t)",
    "=ABS(n)", "=ROUND(x*1.005,2)", "=ROUND(x,-1)", "=ROUNDUP(x,0)", "=ROUNDDOWN(x)", "=TRUNC(x)", "=INT(x)", "=SIGN(x)", "=EVEN(x)", "=ODD(x)", "=MOD(n,3)", "=MOD(n,0)", "=SQRT(x)", "=LN(x)", "=LOG(x,2)",
    "=LOG(t)", "=LOG10(x)", "=FACT(n)", "=IF(n>0,\"p\",\"q\")", "=IF(t,1,2)", "=IF(b,n,0)", "=AND(b,n)", "=OR(FALSE,b)", "=NOT(b)", "=ISBLANK(t)", "=ISERROR(1/n)", "=ISNA(#N/A)", "=ISNUMBER(n)", "=ISTEXT(t)",
    "=CONCAT(t,n,TRUE)", "=LEN(t)", "=LEFT(t,3)", "=LEFT(t,-1)", "=RIGHT(t,2)", "=RIGHT(t,0)", "=TRIM(t)", "=UPPER(t)", "=LOWER(t)", "=PROPER(t)", "=DATE(2024,n,1)", "=NOSUCH(1)", "=#REF!+1", "=t+1",
]


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def test_columns_agree_with_values(spark):
    df = spark.createDataFrame(ROWS, "n bigint, x double, t string, b boolean")
    vals = {f: C.formula(f, df.schema) for f in FORMULAS}
    import pyspark.sql.functions as F

    cols = [F.struct((v.col if v.col is not None else F.lit(None)).alias("v"), (v.err if v.err is not None else F.lit(None).cast("string")).alias("e")).alias(f"c{i}") for i, v in enumerate(vals.values())]
    for row, out in zip(ROWS, df.coalesce(1).select(*cols).collect(), strict=True):
        env = dict(zip("nxtb", row, strict=True))

        def run(tree):
            try:
                match tree:
                    case P.Name(n):
                        return env[n]
                    case P.Literal(v):
                        return v
                    case P.ErrorLiteral(label):
                        return S.Err(label)
                    case P.Unary("%", a):
                        return S.operate("/", run(a), 100)
                    case P.Unary(op, a):
                        x = S.number(run(a))
                        return -x if op == "-" else x
                    case P.Binary(op, a, b):
                        return S.operate(op, run(a), run(b))
                    case P.Call(f, args):
                        return S.call(f, [run(a) for a in args])
            except S.Stop as stop:
                return stop.err

        for i, f in enumerate(FORMULAS):
            want, (v, e) = run(P.parse(f)), out[i]
            if isinstance(want, S.Err):
                assert e == want.label, (f, row, want, v, e)
            else:
                assert e is None and (close(v, want) or v is None and want is None), (f, row, want, v, e)


@pytest.mark.parametrize(("text", "value"), [
    ("=-2^2", -4.0), ("=2^3^1", 8.0), ("=10%+1", 1.1), ("=1&2", "12"), ('="a""b"', 'a"b'), ("=SUM(1;2,3)", 6.0), ("=IF(1/0,1,2)", S.Err("#DIV/0!")), ("=ISERROR(1/0)", True),
    ("=VLOOKUP(4,A1:B4,2)", "low"), ("=VLOOKUP(3,A1:B4,2,FALSE)", "c"), ("=VLOOKUP(8,A1:B4,2,FALSE)", S.Err("#N/A")), ("=VLOOKUP(1,A1:B4,9)", S.Err("#REF!")), ("=HLOOKUP(0,A1:B2,2,FALSE)", 5),
    ("=MATCH(3,A1:A4,0)", 3), ("=MATCH(4,A1:A4)", 1), ("=INDEX(A1:B4,4,2)", "d"), ("=XLOOKUP(4,A1:A4,B1:B4,\"none\",1)", "b"), ("=XLOOKUP(4,A1:A4,B1:B4,\"none\",-1)", "c"),
    ("=XLOOKUP(\"?\",B3:B4,A3:A4,0,2,-1)", 9), ("=XLOOKUP(77,A1:A4,B1:B4)", S.Err("#N/A")), ("=OFFSET(A1:B4,1,1)", None), ("=OFFSET(A1:B4,9,0)", S.Err("#REF!")), ("=SUM(A1:A4)", 17.0), ("=Z99", S.Err("#REF!")), ("=A1=0", True), ("=1=1.0", False),
])
def test_values(text, value):
    grid = [[0, "low"], [5, "b"], [3, "c"], [9, "d"]]
    if "OFFSET(A1:B4,1,1)" in text:
        assert evaluate_once("=LEN(OFFSET(A1:B4,1,1))", grid) == 3
        return
    got = evaluate_once(text, grid)
    assert got == pytest.approx(value) if isinstance(value, float) else got == value


def test_addresses():
    assert [column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(column_number(column_letters(i)) == i for i in range(2000))
    assert parse_cell("$B$3") == Cell(2, 1, True, True) and parse_cell("'My Sheet'!A1").sheet == "My Sheet"
    assert parse_cell("R[-1]C2").at(4, 9) == Cell(3, 1, False, True)
    assert parse_range("C3:A1").box() == (0, 0, 2, 2)
    assert fill("{a}-{b}", {"a": 1}) == "1-{b}"
    for bad in ("=1+", "=SUM(1", "=A1:", "=@"):
        with pytest.raises(ParseError):
            P.parse(bad)


def test_written_reads_back():
    for f in [*FORMULAS, "=SUM($A$1:B2)*Sheet2!C3"]:
        assert P.parse(P.written(P.parse(f))) == P.parse(f)


def test_recalculation():
    g = Grid({"S": [[1, "=A1*2", "=B1+A2"], [4, "=SUM(A1:B1)", "=1/0"]], "T": [["=S!C1"]]})
    g.recalculate()
    assert g.values("S") == [[1, 2.0, 6.0], [4, 3.0, "#DIV/0!"]] and g.values("T") == [[6.0]]
    g.set_value("S", 0, 0, 10)
    assert set(g.recalculate()) == {("S", 0, 1), ("S", 0, 2), ("S", 1, 1), ("T", 0, 0)}
    assert g.values("T") == [[24.0]]
    with pytest.raises(Cycle):
        g.set_formula("S", 0, 0, "=T!A1")
    with pytest.raises(Cycle):
        g.set_formula("S", 0, 0, "=SUM(A1:B2)")
    assert Graph.from_json(g.graph.to_json()).cells == g.graph.cells
    assert same_template([(0, "=A1+$B$1"), (1, "=A2+$B$1"), (2, "=A3+$B$1")]) is not None and same_template([(0, "=A1"), (1, "=A1")]) is None


@pytest.mark.parametrize(("pattern", "value", "shown"), [
    ("#,##0.00", 1234567.891, "1,234,567.89"), ("0%", 0.256, "26%"), ("0.0%;(0.0%);zero", -0.1, "(10.0%)"), ("0;-0;zero", 0, "zero"), ("[Red]0.00", -3.14159, "-3.14"), ("000", 7, "007"),
    ("#.##", 0.5, ".5"), ("0,", 12345, "12"), ('"$"0.0" each"', 2, "$2.0 each"), ("yyyy-mm-dd", 45000, "2023-03-15"), ("d mmm yy", 1, "1 Jan 00"), ("0;0;0;<@>", "t", "<t>"), ("General", 2.0, "2"),
])
def test_patterns(spark, pattern, value, shown):
    assert format_value(pattern, value) == shown
    if not isinstance(value, str) and pattern != "General":
        import pyspark.sql.functions as F

        assert spark.range(1).select(format_column(pattern, F.lit(float(value))).alias("s")).first().s == shown
    assert color("[Red]0", 1) == "Red"


def test_compiled_lookups_agree_with_values(spark):
    """Over fixed ranges in any order, with repeats and blanks, a filled-down lookup gives what the function over values gives."""
    import random

    from gridloom.functions import scalar as S
    from gridloom.sheet import Sheet

    rng = random.Random(5)
    xs = [float(v) for v in range(-1, 12)]
    s = Sheet.of(spark.createDataFrame([(x,) for x in xs], "x double"))
    for _ in range(2):
        keys = [float(rng.randrange(0, 10)) for _ in range(7)]
        vals = [f"v{i}" for i in range(7)]
        t = Sheet.from_data(spark, [["k", "v"], *map(list, zip(keys, vals, strict=True))], headers=True)
        wide = Sheet.from_data(spark, [[f"c{i}" for i in range(7)], keys, [float(i) for i in range(7)]], headers=True)
        grid, line = [[k, v] for k, v in zip(keys, vals, strict=True)], [keys, [float(i) for i in range(7)]]
        cases = {
            "=VLOOKUP(A2, t!$A$2:$B$8, 2, FALSE)": ("VLOOKUP", lambda x, g=grid: [x, g, 2, False]), "=VLOOKUP(A2, t!$A$2:$B$8, 2)": ("VLOOKUP", lambda x, g=grid: [x, g, 2]),
            "=HLOOKUP(A2, w!$A$2:$G$3, 2, FALSE)": ("HLOOKUP", lambda x, g=line: [x, g, 2, False]),
            "=MATCH(A2, t!$A$2:$A$8, 0)": ("MATCH", lambda x, k=keys: [x, k, 0]), "=MATCH(A2, t!$A$2:$A$8, 1)": ("MATCH", lambda x, k=keys: [x, k, 1]), "=MATCH(A2, t!$A$2:$A$8, -1)": ("MATCH", lambda x, k=keys: [x, k, -1]),
            **{f'=XLOOKUP(A2, t!$A$2:$A$8, t!$B$2:$B$8, "none", {m}, {d})': ("XLOOKUP", lambda x, k=keys, v=vals, m=m, d=d: [x, k, v, "none", m, d]) for m in (-1, 0, 1) for d in (1, -1)},
            "=INDEX(t!$A$2:$B$8, A2, 2)": ("INDEX", lambda x, g=grid: [g, x, 2]),
        }
        out = s
        for n, text in enumerate(cases):
            out = out.fill_down(f"f{n}", text, others={"t": t, "w": wide})
        rows = out.records()

        def want(fn, args):
            try:
                v = S.call(fn, args)
            except S.Stop as stop:
                return str(stop.err)
            return str(v) if isinstance(v, S.Err) else v

        for r in rows:
            for n, (text, (fn, args)) in enumerate(cases.items()):
                w = want(fn, args(r["x"]))
                got = r[f"f{n}"]
                same = str(got) == str(w) or not isinstance(w, str) and got is not None and not str(got).startswith("#") and float(got) == float(w)
                assert same, (text, keys, r["x"], got, w)
