"""Scripts."""

import pytest

from gridloom.errors import GridError, ParseError
from gridloom.lang.interpreter import Interpreter, ordered
from gridloom.sheet import Sheet


@pytest.fixture
def it(spark):
    return Interpreter(spark)


def run(it, text, name="r"):
    it.run(text)
    return it.get(name)


@pytest.mark.parametrize(("text", "value"), [
    ("dim r = 7 / 2", 3), ("dim r = -7 / 2", -3), ("dim r = 7.0 / 2", 3.5), ("dim r = 1 + 2 * 3 ' note", 7), ('dim r = "a" & 1 & true', "a1true"), ("dim r = not (1 = 1.0) or false", False), ('dim r = "abc" like "a%"', True), ("dim r = 2 in [1, 2]", True),
    ("dim r = null is null", True), ("dim r = [1, 2, 3][-1]", 3), ("dim r = {a: {b: 5}}.a.b", 5), ("dim r = interval 2 days", 172800000), ("dim f = x => x * 2\ndim r = f(4)", 8), ("dim r = length(\"é\")", 2), ("dim r = len(\"é\")", 1),
    ("dim r = round(2.567, 1) + sum([1, 2])", 5.6), ("dim r = filter([1, 2, 3], [true, false, 1])", [1, 3]), ("dim r = filter([1], [false])", "#CALC!"),
    ("dim r = 0\nfor i = 1 to 10 step 3\n r = r + i\nnext", 22), ("dim r = 0\nwhile true\n r = r + 1\n if r > 4 then exit while\nwend", 5), ("dim r = 0\nfor each x in [1, 2, 3]\n if x = 2 then\n  exit for\n end if\n r = x\nnext x", 1),
    ("function f(byref a, optional b = 2, paramarray c)\n a = a + b + length(c)\nend function\ndim r = 1\nf(r, 3, 4, 5)", 6), ("dim r = [1, 2]\nr[0] = 9", [9, 2]), ("dim r = {a: 1}\nr.b = 2", {"a": 1, "b": 2}),
    ("if 1 > 2 then\n dim q = 1\nelseif 2 > 1 then\n r0 = 1\nelse\n r0 = 2\nend if\ndim r = 3", 3),
])
def test_values(it, text, value):
    if "r0" in text:
        it.set("r0", 0)
    got = run(it, text)
    assert got == pytest.approx(value) if isinstance(value, float) else got == value


@pytest.mark.parametrize("text", ["dim r = 1 / 0", 'dim r = "a" < "b"', "dim r = nope", "dim r = sqrt(-1)", "dim r = 9223372036854775807 + 1", "f(1)", "dim r = {a: 1}.b"])
def test_errors_have_lines(it, text):
    with pytest.raises(GridError) as e:
        it.run("dim x = 1\n" + text)
    assert e.value.line == 2
    with pytest.raises(ParseError):
        it.run("dim = 3")


def test_tables(it, spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,name\n1,ann\n2,bob\n3,cy\n")
    (tmp_path / "o.csv").write_text("user_id,amount\n1,10\n1,5\n3,7\n")
    it.run(f'''
import "{tmp_path}/u.csv" into u
import "{tmp_path}/o.csv" into o
dim j = u left join o on "id" = "user_id"
dim t = query(select name, sum(amount) as total from j group by name order by total desc)
dim big = u.filter(row => row.id > 1 and row.name like "%y")
dim up = u.map(row => {{id: row.id * 10, name: upper(row.name)}})
dim more = u + [{{id: 4, name: "di"}}]
u upsert [{{id: 2, name: "BOB"}}, {{id: 9, name: "zed"}}] on "id"
dim cell = u["B3"]
dim part = u["A2:A3"]
dim sides = o or o
dim n = query(select count(*) as n from "{tmp_path}/o.csv").n0
''' if False else f'''
import "{tmp_path}/u.csv" into u
import "{tmp_path}/o.csv" into o
dim j = u left join o on "id" = "user_id"
dim t = query(select name, sum(amount) as total from j group by name order by total desc)
dim big = u.filter(row => row.id > 1 and row.name like "%y")
dim up = u.map(row => {{id: row.id * 10, name: upper(row.name)}})
dim more = u + [{{id: 4, name: "di"}}]
u upsert [{{id: 2, name: "BOB"}}, {{id: 9, name: "zed"}}] on "id"
dim cell = u["B3"]
dim n = query(select count(*) as n from "{tmp_path}/o.csv")
print t.row_count()
export t to "{tmp_path}/t.json"
''')
    assert it.get("t").rows() == [["bob", None], ["ann", 15], ["cy", 7]]
    assert it.get("big").rows() == [[3, "cy"]] and it.get("up").rows()[0] == [10, "ANN"] and it.get("more").row_count() == 4
    assert it.get("u").rows() == [[1, "ann"], [2, "BOB"], [3, "cy"], [9, "zed"]] and it.get("cell") == "BOB" and it.get("n").rows() == [[3]] and it.output == ["3"]
    assert Sheet.read(spark, f"{tmp_path}/t.json").row_count() == 3


def test_lambdas_that_need_rows_fall_back(it, spark):
    it.set("s", spark.createDataFrame([(1, "a"), (2, "bb")], "n bigint, t string"))
    it.run('dim k = {a: 5, bb: 6}\ndim r = with_column(s, "v", x => k[x.t] + x.n)')
    assert it.get("r").column("v") == ["6", "8"]


def test_python_and_books(it, spark):
    it.run('register_python("plus", "lambda a, b: a + b", "bigint")\ndim r = plus(2, 3)')
    it.set("s", spark.range(3).toDF("n"))
    assert it.get("r") == 5 and it.run("query(select plus(n, 1) as m from s)").column("m") == [1, 2, 3]
    it.run('dim b = book_from_dict({x: s, y: s})\ndim c = b.consolidate("src")\ndim names = b.sheet_names()')
    assert it.get("names") == ["x", "y"] and it.get("c").row_count() == 6


def test_python_functions_of_any_arity(it, spark):
    it.run('register_python("zero", "lambda: 5", "bigint")\nregister_python("three", "lambda a, b, c: a + b * c", "bigint")')
    it.set("s", spark.range(3).toDF("n"))
    assert [tuple(r) for r in it.run("query(select zero() as z, three(n, n, 2) as t from s)").rows()] == [(5, 0), (5, 3), (5, 6)]


def test_null_order():
    assert ordered("select a from t order by a, b desc limit 3") == "select a from t order by a nulls last, b desc nulls first limit 3"
    assert ordered("select a from t order by a nulls first") == "select a from t order by a nulls first "
