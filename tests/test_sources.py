"""Files in and out, type inference, tables inside texts."""

import json

import pytest

from gridloom.errors import GridError, ParseError, Unsupported
from gridloom.sheet import Book, Sheet
from gridloom.sources import files, infer, tables, xlsx


def test_csv_types_and_headers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,flag,x,note\n1,yes,1.5,"a, b"\n2,no,,\n3,true,2,=A1\n')
    df = files.read(spark, str(p))
    assert dict(df.dtypes) == {"id": "bigint", "flag": "boolean", "x": "double", "note": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, True, 1.5, "a, b"), (2, False, None, None), (3, True, 2.0, "=A1")]
    assert files.read(spark, str(p), has_headers=False).columns == ["column_0", "column_1", "column_2", "column_3"]
    assert files.read(spark, str(p), detect_headers=True).columns[0] == "id"
    with pytest.raises(GridError):
        files.read(spark, str(p), color=1)
    assert infer.resolve({"bool", "int"}) == "string" and infer.resolve({"bool", "int"}, True) == "bigint" and infer.resolve({"null"}) == "string"


def test_json_lines_parquet_and_append(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": {"c": 2}}, {"b": None, "z": 9}]))
    df = files.read(spark, str(tmp_path / "a.json"))
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.collect()] == [(1, '{"c": 2}'), (None, None)]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": 2, "q": 3}\n')
    assert files.read(spark, str(tmp_path / "b.jsonl")).columns == ["a"]
    s = Sheet.from_records(spark, [{"k": "a", "v": 1}, {"k": "b", "v": 2}])
    for kind in ("csv", "tsv", "json", "jsonl", "parquet", "xlsx", "toon"):
        path = str(tmp_path / f"out.{kind}")
        s.write(path)
        back = Sheet.read(spark, path)
        assert back.rows() == [["a", 1], ["b", 2]], kind
        if kind in ("xlsx", "parquet", "toon"):
            with pytest.raises(Unsupported):
                s.write(path, "append")
        else:
            s.write(path, "append")
            assert Sheet.read(spark, path).row_count() == 4, kind
    Sheet.from_records(spark, [{"k": "b", "v": 7}, {"k": "c", "v": 8}]).write(str(tmp_path / "out.json"), "append_or_update", "k")
    assert sorted(map(tuple, Sheet.read(spark, str(tmp_path / "out.json")).rows())) == [("a", 1), ("a", 1), ("b", 2), ("b", 7), ("c", 8)]
    with pytest.raises(GridError):
        s.write(str(tmp_path / "x.doc"))


def test_workbooks(spark, tmp_path):
    book = Book({"One": Sheet.from_records(spark, [{"a": 1, "b": "x<y"}]), "Zwei & 3": Sheet.from_records(spark, [{"c": True}])})
    book.write(str(tmp_path / "b.xlsx"))
    data = (tmp_path / "b.xlsx").read_bytes()
    assert xlsx.sheet_names(data) == ["One", "Zwei & 3"] and xlsx.read_sheet(data, "One") == [["a", "b"], [1.0, "x<y"]]
    assert Book.read(spark, str(tmp_path / "b.xlsx")).get("Zwei & 3").rows() == [[True]]
    with pytest.raises(Unsupported):
        xlsx.sheet_names(b"\xd0\xcf\x11\xe0....")


def test_html():
    page = "<table><tr><th>a<th>a<th></tr><tr><td rowspan=2>1<td colspan=2>x &amp; y</tr><tr><td>2</td></tr></table><p>no</p><table><tr><td>q</table>"
    (one, head), (two, plain) = tables.html_tables(page)
    assert head and not plain and one == [["a", "a", ""], ["1", "x & y", "x & y"], ["1", "2", None]] and two == [["q"]]
    assert tables.header_names(one[0], 3) == ["a", "a_2", "Column_3"]
    assert tables.html_tables("nothing") == []


def test_markdown_and_toon():
    md = "x\n| a | b |\n|---|:-:|\n| 1 | p\\|q |\n| 2 |\n\n```\n| c | d |\n|---|---|\n```\n"
    assert tables.markdown_tables(md) == [[["a", "b"], ["1", "p|q"], ["2", None]]]
    assert tables.markdown_tables(md, min_rows=4) == []
    text = tables.toon_text("t", ["a", "b"], [[1, "x, y"], [None, True]])
    assert tables.toon_table(text) == ("t", ["a", "b"], [["1", "x, y"], ["null", "true"]])
    for bad in ("t[2]{a}:\n 1\n", "t[1]{a,b}:\n 1\n", "hello"):
        with pytest.raises(ParseError):
            tables.toon_table(bad)
    assert tables.text_tables("a  b\n----\n1  2\n\nword") == [[["a", "b"], ["1", "2"]]]


def test_sheets_and_books(spark):
    s = Sheet.from_data(spark, [["n", "t"], [1, "a"], [2, "b"], [3, "a"]], headers=True)
    assert s.a1("A1") == "n" and s.a1("B3") == "b" and s.row(-1) == {"n": 3, "t": "a"} and s.range("A2:A3").rows() == [[1], [2]]
    assert s.set("B2", "z").column("t") == ["z", "b", "a"] and s.insert_row(1, 9, "q").column("n") == [1, 9, 2, 3]
    assert s.remove_duplicates("t").column("n") == [1, 2] and s.filter_rows("n", 2).rows() == [[2, "b"]] and s.filter_rows("n", "2").rows() == []
    assert s.map("upper", at="B2:B3").column("t") == ["A", "B", "a"] and s.transpose().rows() == [["1", "2", "3"], ["a", "b", "a"]]
    assert s.fill_down("d", "=A2*2").column("d") == ["2", "4", "6"] and s.with_formula("e", "=n/(n-1)").column("e") == ["#DIV/0!", "2", "1.5"]
    assert s.aggregate("sum") == 6.0 and s.aggregate("count", "A2:B3") == 2 and s.evaluate("=SUM(A2:A4)") == 6.0
    assert s.append(s).row_count() == 6 and s.append_distinct(Sheet.from_data(spark, [["t", "n"], ["a", 5], ["c", 6], ["c", 7]], True), "t").column("n") == [1, 2, 3, 6]
    assert s.upsert(Sheet.from_data(spark, [["t", "n"], ["a", 5], ["c", 6]], True), "t").rows() == [[1, "a"], [2, "b"], [5, "a"], [6, "c"]]
    assert s.join(s.rename("n", "m"), "t").rows() == [[1, "a", 1], [1, "a", 3], [2, "b", 2], [3, "a", 1], [3, "a", 3]]
    assert s.zip(s).columns == ["n", "t", "n_1", "t_1"] and s.with_values("v", [7, 8, 9]).column("v") == [7, 8, 9]
    assert Sheet.from_data(spark, [["a", "b"], [1, "=A2+1"]], True).recalculated().rows() == [[1, 2.0]]
    b = Book({"x": s}).merge(Book({"x": s, "y": s.select("n")}))
    assert b.names() == ["x", "x_1", "y"] and b.consolidate("from").columns == ["from", "n", "t"] and b.rename("y", "z").get(-1).name == "z"
    assert s.invalid("n", "range", low=2, high=3) == [1]


def test_folders_keep_their_order(spark, tmp_path):
    """Parts of very different sizes: Spark reads the large ones first."""
    for kind in ("csv", "jsonl", "parquet"):
        s = Sheet.of(spark.range(0, 3000, 1, 1).select("id", __import__("pyspark.sql.functions").sql.functions.expr("repeat('x', cast(id / 20 as int))").alias("t")).repartitionByRange(6, "id"))
        s.write(str(tmp_path / f"o.{kind}"))
        back = Sheet.read(spark, str(tmp_path / f"o.{kind}"))
        assert back.column("id") == list(range(3000)) and back.df.where("__row <> id").count() == 0, kind


def test_quotes_over_lines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"x\ny"\n2,"say ""hi"""\n')
    assert Sheet.read(spark, str(tmp_path / "q.csv")).rows() == [[1, "x\ny"], [2, 'say "hi"']]


def test_json_arrays_are_read_and_written_by_executors(spark, tmp_path, monkeypatch):
    """Objects across splits, brackets and quotes in strings, any layout; nothing of the file passes the driver."""
    monkeypatch.setattr(files, "read_bytes", None)
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = [{"a}": i, "t": ["}]", '"{', "\\", 'x\\"}, {', None, "\u00e9\n"][i % 6], "n": [1, 2.5][i % 2], "o": {"b": [{"c": i}, "]"]}, "m": [True, "yes", 3][i % 3]} for i in range(200)]
        records[70]["t"] = "}" * 2000
        for how in ({}, {"indent": 1}, {"ensure_ascii": False, "separators": (",", ":")}):
            (tmp_path / "a.json").write_text(json.dumps(records, **how))
            back = Sheet.read(spark, str(tmp_path / "a.json"))
            assert back.frame.rdd.getNumPartitions() > 1
            assert back.rows() == files.from_records(spark, records).toPandas().astype(object).where(lambda d: d.notna(), None).values.tolist()
            assert dict(back.frame.dtypes) == {"a}": "bigint", "t": "string", "n": "double", "o": "string", "m": "string"}
        back.write(str(tmp_path / "b.json"))
        assert json.loads((tmp_path / "b.json").read_text()) == back.records() == Sheet.read(spark, str(tmp_path / "b.json")).records()
        for text in ("[]", " [ ]\n"):
            (tmp_path / "a.json").write_text(text)
            assert Sheet.read(spark, str(tmp_path / "a.json")).rows() == []
        for text in ('{"a": 1}', '[1, {"a": 1}]', '[{"a": 1}, 2]', '[{"a": 1}', '[{"a": 1} {"a": 2}]', '[{"a": 1}, {"a": 2}, {"a": x}]', '[{"a": 1]}', ""):
            (tmp_path / "a.json").write_text(text)
            with pytest.raises(GridError):
                Sheet.read(spark, str(tmp_path / "a.json"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
