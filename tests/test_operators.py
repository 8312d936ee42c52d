"""Joins, merging, cleaning and lookups on small frames with the awkward keys."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.errors import ColumnMissing, DuplicateColumn, GridError
from gridloom.operators import joins, lookup, quality, rows
from gridloom.operators.ordering import number_rows
from gridloom.sheet import Sheet


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def key_text(v):
    if v is None:
        return ""
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_join_against_a_model(spark, how):
    rng = random.Random(3)
    left = [(rng.choice([None, "", "1", "30", "x"]), i) for i in range(12)]
    right = [(rng.choice([None, 1.0, 30.0, 2.5]), -i) for i in range(9)]
    out = joins.join(spark.createDataFrame(left, "k string, a int"), spark.createDataFrame(right, "k double, b int"), "k", how)
    assert out.columns == ["k", "a", "b"]
    model, met = [], set()
    for k, a in left:
        hits = [(i, r) for i, r in enumerate(right) if key_text(r[0]) == key_text(k)]
        met |= {i for i, _ in hits}
        model += [(None if how == "right" and r[0] is None else (str(r[0]) if how == "right" else k), a, r[1]) for _, r in hits]
        if not hits and how in ("left", "full"):
            model.append((k, a, None))
    if how in ("right", "full"):
        model += [(None if r[0] is None else str(r[0]), None, r[1]) for i, r in enumerate(right) if i not in met]
    assert got(out) == sorted(model, key=str)


def test_join_names(spark):
    a, b = spark.createDataFrame([(1, 2)], "id int, x int"), spark.createDataFrame([(1, 3, 4)], "id int, x int, y int")
    assert joins.join(a, b, "id").columns == ["id", "x", "x_right", "y"]
    with pytest.raises(DuplicateColumn):
        joins.join(a.withColumn("x_right", F.lit(1)), b, "id")
    with pytest.raises(ColumnMissing):
        joins.join(a, b, "nope")


def test_native_keys_do_not_match_null(spark):
    a = spark.createDataFrame([(None, 1)], "k int, a int")
    assert joins.join(a, a.withColumnRenamed("a", "b"), "k", keys="sql").count() == 0
    assert joins.join(a, a.withColumnRenamed("a", "b"), "k").count() == 1


def model_upsert(target, source):
    out = [list(r) for r in target]
    for k, v in source:
        places = [i for i, r in enumerate(out) if key_text(r[0]) == key_text(k)]
        if places:
            out[places[-1]][1] = v
            out[places[-1]][0] = k
        else:
            out.append([k, v])
    return [tuple(r) for r in out]


def test_upsert_against_a_model(spark):
    rng = random.Random(5)
    for _ in range(3):
        t = [(rng.choice([None, "", "a", "b", "c"]), str(rng.randrange(9))) for _ in range(6)]
        s = [(rng.choice([None, "a", "c", "d", "e"]), rng.choice([None, "x", "y"])) for _ in range(6)]
        td = spark.createDataFrame([(i, *r) for i, r in enumerate(t)], "n bigint, k string, v string")
        sd = spark.createDataFrame([(i, *r) for i, r in enumerate(s)], "m bigint, k string, v string")
        out = rows.upsert(td, sd, "k", "n", "m").orderBy("n").select("k", "v").collect()
        want = model_upsert(t, s)
        assert [(key_text(a), b) for a, b in map(tuple, out)] == [(key_text(a), b) for a, b in want]


def test_append_and_consolidate(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, True)], "k int, z boolean")
    assert got(rows.append(a, b)) == [(1, "x"), (2, None)]
    both = rows.consolidate({"one": a, "two": b}, "src")
    assert both.columns == ["src", "k", "a", "z"] and got(both) == [("one", 1, "x", None), ("two", 2, None, True)]
    with pytest.raises(DuplicateColumn):
        rows.consolidate({"one": a}, "k")
    s = spark.createDataFrame([(0, "p"), (1, None), (2, "p"), (3, ""), (4, "q")], "n int, k string")
    t = spark.createDataFrame([("q",)], "k string")
    assert got(rows.append_distinct(t, s, "k", "n")) == sorted([("q",), ("p",), (None,)], key=str)


def test_dedupe_and_empty_rows(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", None), (2, None, ""), (3, "b", "x")], "n int, p string, q string")
    assert [r.n for r in rows.remove_duplicates(df, ["p"], "n").orderBy("n").collect()] == [0, 2, 3]
    assert [r.n for r in rows.remove_empty_rows(df, "n").orderBy("n").collect()] == [0, 1, 3]


def test_cleaning(spark):
    df = spark.createDataFrame([("  A  b\t", 1), ("", None), (None, 2)], "t string, n int")
    how = quality.Cleaning.of("normalize_whitespace", "lower", "empty_to_null", fill="none")
    once = quality.clean(df, how)
    assert got(once) == sorted([("a b", 1), ("none", None), ("none", 2)], key=str)
    assert got(quality.clean(once, how)) == got(once)
    with pytest.raises(GridError):
        quality.Cleaning.of("polish")


def test_validation(spark):
    df = spark.createDataFrame([(0, "a@b.co"), (1, "a@b"), (2, None), (3, "+1 (555) 010-1234")], "n int, t string")
    assert [r.n for r in quality.failures(df, "t", "email", "n").orderBy("n").collect()] == [1, 2, 3]
    assert [r.n for r in quality.failures(df, "t", "phone", "n").orderBy("n").collect()] == [0, 1, 2]
    ages = spark.createDataFrame([(0, "30"), (1, "200"), (2, "x")], "n int, a string")
    assert [r.n for r in quality.failures(ages, "a", "range", "n", low=0, high=120).orderBy("n").collect()] == [1, 2]


def test_lookups(spark):
    keys = spark.createDataFrame([(i, float(x)) for i, x in enumerate([-1, 0, 2, 3, 4, 9, 50])], "i int, x double")
    table = spark.createDataFrame([(0, 0.0, "a"), (1, 5.0, "b"), (2, 3.0, "c"), (3, 9.0, "d")], "pos int, k double, v string")
    prefix = {r.x: r.v for r in lookup.prefix(keys, "x", table, "k", "v", "pos", "v").collect()}

    def scan(x):
        out = None
        for k, v in [(0, "a"), (5, "b"), (3, "c"), (9, "d")]:
            if k > x:
                break
            out = v
        return out

    assert prefix == {x: scan(x) for x in prefix}
    below = {r.x: r.v for r in lookup.nearest(keys, "x", table, "k", "v", "v").collect()}
    above = {r.x: r.v for r in lookup.nearest(keys, "x", table, "k", "v", "v", "above").collect()}
    pairs = [(0, "a"), (3, "c"), (5, "b"), (9, "d")]
    assert below == {x: next((v for k, v in reversed(pairs) if k <= x), None) for x in below}
    assert above == {x: next((v for k, v in pairs if k >= x), None) for x in above}
    dup = spark.createDataFrame([(0, 1.0, "first"), (1, 1.0, "last")], "pos int, k double, v string")
    one = spark.createDataFrame([(1.0,), (7.0,)], "x double")
    assert got(lookup.exact(one, "x", dup, "k", "v", "pos", "v")) == [(1.0, "first"), (7.0, None)]
    assert got(lookup.exact(one, "x", dup, "k", "v", "pos", "v", last=True, default=F.lit("none"))) == [(1.0, "last"), (7.0, "none")]
    import re

    assert re.match(lookup.wildcard_regex(r"a*c?\*"), "abbbcd*") and not re.match(lookup.wildcard_regex("a?"), "abc")


def test_row_numbers_are_contiguous_and_in_order(spark):
    df = number_rows(spark.range(1000).repartition(5).sortWithinPartitions("id"))
    assert sorted(r["__row"] for r in df.collect()) == list(range(1000))
    assert number_rows(spark.range(0)).count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_sheet_order_survives_shuffles(spark, adaptive):
    """Wide rows over many partitions: every verb, then a chain; how many rows, which numbers, in which order."""
    n = 40_000
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        pad = F.rpad(F.col("id").cast("string"), 120, "x")
        left = Sheet.of(spark.range(0, n, 1, 7).select("id", pad.alias("pad")))
        right = Sheet.of(spark.range(0, n, 1, 5).select((F.lit(n - 1) - F.col("id")).alias("id"), (F.col("id") * 2).alias("v")))
        odd, even = left.where("id % 2 = 1"), left.where("id % 2 = 0")

        def numbered(s, want):
            got = s.df.select("__row", "id").orderBy("__row").collect()
            assert [r[0] for r in got] == list(range(len(want)))
            assert [r[1] for r in got] == want

        numbered(left.join(right, "id", "left"), list(range(n)))
        numbered(right.join(left, "id"), list(range(n - 1, -1, -1)))
        numbered(odd.join(left, "id", "right"), [*range(1, n, 2), *range(0, n, 2)])
        numbered(odd, list(range(1, n, 2)))
        numbered(even.append(odd), [*range(0, n, 2), *range(1, n, 2)])
        numbered(even.append(odd).append(even).remove_duplicates("id"), [*range(0, n, 2), *range(1, n, 2)])
        numbered(odd.upsert(left, "id"), [*range(1, n, 2), *range(0, n, 2)])
        numbered(odd.append_distinct(left, "id"), [*range(1, n, 2), *range(0, n, 2)])
        chain = even.append(odd).where("id % 3 = 0").join(right, "id", "left").remove_duplicates("id").where("id > 9")
        numbered(chain, [*[i for i in range(0, n, 6) if i > 9], *[i for i in range(3, n, 6) if i > 9]])
        assert chain.row(0)["id"] == 12 and chain.a1("A2") == 12 and chain.row(-1)["id"] == max(range(3, n, 6))
        numbered(left.sort("pad", descending=True).take(3), sorted(range(n), key=lambda i: str(i).ljust(120, "x"), reverse=True)[:3])
        numbered(right.top(4, "v"), [0, 1, 2, 3])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_row_and_column_edits(spark):
    s = Sheet.from_data(spark, [["name", "n"], ["a", 1], ["b", 2], ["c", 3]], headers=True)
    assert s.update_row(1, "x", 9).rows() == [["a", 1], ["x", 9], ["c", 3]]
    assert s.update_row(-1, "x", 9).rows() == [["a", 1], ["b", 2], ["x", 9]]
    assert s.insert_row(1, "x", 9).rows() == [["a", 1], ["x", 9], ["b", 2], ["c", 3]]
    assert s.insert_column(1, "two", F.col("n") * 2).rows() == [["a", 2, 1], ["b", 4, 2], ["c", 6, 3]]
    assert s.row_named("name", "b") == {"name": "b", "n": 2} and s.set_row_named("name", "b", n=7).column("n") == [1, 7, 3]
    assert s.name_columns_by_row(1).columns == ["b", "2"] and s.name_columns_by_row(1).rows() == [["a", "1"], ["c", "3"]]
    assert s.sort("n", descending=True).column("n") == [3, 2, 1] and s.top(2, "n").column("n") == [3, 2] and s.take(1, 1).rows() == [["b", 2]]
    for wrong in (lambda: s.update_row(3, "x", 1), lambda: s.insert_row(5, "x", 1), lambda: s.insert_column(9, "z", F.lit(1)), lambda: s.row_named("name", "q"), lambda: s.a1("A1:B9")):
        with pytest.raises(GridError):
            wrong()
