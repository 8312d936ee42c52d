"""SQL engine, charts, command line."""

import json

import pytest

from gridloom import charts, cli
from gridloom.errors import GridError
from gridloom.plans.engine import SqlEngine
from gridloom.sheet import Sheet


def test_engine(spark, tmp_path):
    (tmp_path / "people list.csv").write_text("name,age\nann,30\nbob,\n")
    e = SqlEngine(spark)
    assert e.register_csv(str(tmp_path / "people list.csv")) == "people_list"
    e.register_table("nums", spark.range(5))
    assert [r.name for r in e.query("select name from people_list order by age desc").collect()] == ["bob", "ann"]
    assert e.query("select id, row_number() over (order by id desc) as n from nums union all select 9, 9").count() == 6
    e.deregister_table("nums")
    with pytest.raises(GridError):
        e.deregister_table("nums")


def test_filters_reach_the_scan(spark):
    from gridloom.catalog import load

    e = SqlEngine(spark)
    e.register_table("li", load(spark, "/root/testdata/sf0.001", "lineitem"))
    plan = e.query("select l_orderkey from li where l_quantity > 40")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_charts(spark):
    c = charts.spec(spark.createDataFrame([("a", 1), ("b</script>", 2)], "k string, n int"), "bar", "k", "n", title="t")
    assert json.loads(charts.to_json(c))["series"][0]["values"] == [1, 2] and "b</script>" not in charts.to_html(c)
    with pytest.raises(GridError):
        charts.spec(spark.range(3), "radar", "id")


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["-e", "dim r = n + 1\nprint(r)", "-D", "n=41"]) == 0 and capsys.readouterr().out == "42\n"
    assert cli.main(["-e", "dim r = 1 / 0"]) == 1 and "line 1: division by zero" in capsys.readouterr().err
    s = Sheet.from_records(spark, [{"a": 1, "b": "x,y"}])
    assert cli.shown(s, "csv") == 'a,b\n1,"x,y"' and cli.shown(s, "table") == "a  b\n1  x,y" and json.loads(cli.shown(s, "json")) == [{"a": 1, "b": "x,y"}]


def test_cell_data(spark):
    import pyspark.sql.functions as F

    from gridloom.functions.celldata import field

    df = spark.createDataFrame([('{"ue": 1, "userEnteredValue": 2, "formattedValue": "x"}',), ("{}",), (None,)], "c string")
    got = df.select(field(F.col("c"), "user_entered_value").alias("a"), field(F.col("c"), "formatted_value").alias("b")).collect()
    assert [tuple(r) for r in got] == [("1", "x"), (None, None), (None, None)]


def test_count_trigger(spark, tmp_path):
    from gridloom.streaming import windows

    spark.range(25).write.parquet(str(tmp_path / "in"))
    sizes = []
    windows.every(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), 10, lambda df, _: sizes.append(df.count())).awaitTermination()
    assert sum(sizes) == 25 and max(sizes) <= 10


def test_count_trigger_carries_over_batches(spark, tmp_path):
    from gridloom.streaming import windows

    for k in range(4):
        spark.range(k * 7, k * 7 + 7).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sizes = []
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    windows.every(stream, 10, lambda df, n: sizes.append((n, df.count()))).awaitTermination()
    assert sizes == [(0, 10), (1, 10), (2, 8)]


def test_count_trigger_gives_firings_together(spark, tmp_path):
    """One call and one job per micro-batch, rows in the order they came, as one firing after the other has them."""
    from pyspark.sql import functions as F

    from gridloom.streaming import windows

    for k in range(3):
        spark.range(k * 700, k * 700 + 700, 1, 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, calls = {}, []

    def give(df, first):
        calls.append(first)
        for r in df.groupBy(windows.FIRING).agg(F.sort_array(F.collect_list("id")).alias("ids")).collect():
            assert got.setdefault(r[0], r.ids) is r.ids

    windows.every(stream, 10, give, together=True).awaitTermination()
    assert got == {n: list(range(n * 10, n * 10 + 10)) for n in range(210)} and calls == [0, 70, 140]
    got.clear(), calls.clear()
    windows.every(stream, 400, give, together=True).awaitTermination()
    assert [len(got[n]) for n in range(6)] == [400] * 5 + [100] and calls == [0, 1, 3, 5] and got[5] == list(range(2000, 2100))
    singles = []
    windows.every(stream, 400, lambda df, n: singles.append([r.id for r in df.collect()])).awaitTermination()
    assert singles == [list(range(k * 400, min(2100, k * 400 + 400))) for k in range(6)]


def test_late_rows_are_left_out(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridloom.streaming import windows

    rows = [["2024-01-01 10:00", "2024-01-01 10:30"], ["2024-01-01 15:00"], ["2024-01-01 15:05"], ["2024-01-01 10:40", "2024-01-01 15:10"], ["2024-01-02 00:00"]]
    for k, part in enumerate(rows):
        spark.createDataFrame([(x,) for x in part], "t string").select(F.col("t").cast("timestamp").alias("ts"), F.lit("a").alias("k")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = []
    out = windows.tumbling(stream, "ts", "1 hour", ["k"], [F.count(F.lit(1)).alias("n")], late="1 hour")
    out.writeStream.outputMode("append").trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()
    done = {r.window_start.hour: r.n for r in got}
    assert done[10] == 2 and done[15] == 3  # 10:40 came when the watermark stood at 14:00 (a batch goes by that of the batch before)
