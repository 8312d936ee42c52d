"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import pandas as pd
import pytest

import __spark_entry__
from gridloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    out = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE:
        assert len(out)
        return
    want = db.execute(catalog.ORACLE[name]).df()
    names = sorted(out.columns)
    assert names == sorted(want.columns)
    rows = lambda d: sorted(tuple(norm(float(v) if hasattr(v, "dtype") and v.dtype.kind == "f" else v) for v in r) for r in d[names].astype(object).values.tolist())
    assert rows(out) == rows(want)


def test_whole_tables(spark):
    count = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    rows = {n: catalog.QUERIES[n](spark, SF).collect() for n in ("join_inner", "join_left", "join_left_native", "join_right", "join_right_native", "join_full", "join_full_native", "join_theta", "asof_last_order", "set_except", "join_anti")}
    customers = {r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    users = {r.user_id for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    for n in ("join_left", "join_left_native", "join_full", "join_full_native"):
        assert customers <= {int(r.c_custkey) for r in rows[n]}
    for n in ("join_right", "join_right_native"):
        assert {int(r.user_id) for r in rows[n]} == customers
    assert {r.o_orderkey for r in rows["join_inner"]} == {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    assert {r.k for r in rows["set_except"]} == customers - users == {r.c_custkey for r in rows["join_anti"]}
    assert len(rows["asof_last_order"]) == count("events")
    parts = [(r.p_partkey, r.p_size, r.p_retailprice) for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    assert sorted(map(tuple, rows["join_theta"])) == sorted((a, b) for a, s, x in parts for b, t, y in parts if s == t and x < y)


def test_theta_join_is_dealt_to_many_tasks(spark, tmp_path):
    parts = [(i, 7, float(i % 50)) for i in range(600)] + [(9000, None, 1.0), (9001, 7, None)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = catalog.QUERIES["join_theta"](spark, str(tmp_path)).selectExpr("p_partkey", "other", "spark_partition_id() as task").collect()
    assert sorted((r.p_partkey, r.other) for r in rows) == sorted((a, b) for a, s, x in parts[:600] for b, t, y in parts[:600] if x < y)
    tasks = [r.task for r in rows]
    assert max(map(tasks.count, set(tasks))) < 0.8 * len(rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridloom.streaming import windows

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counted = windows.tumbling(stream, "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")], late="1 hour")
    got = []
    q = counted.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
    q.awaitTermination()
    final = {(r.window_start, r.event_type): r.n for r in got}
    assert sum(final.values()) == events.count()
    seen = []
    windows.until_end(stream, lambda df, _: seen.append(df.count()))
    assert sum(seen) == events.count()
