"""Lookups of a sheet's values in another sheet (VLOOKUP, MATCH, XLOOKUP) as joins.

A lookup table's order matters, so each takes its row column. ``exact`` joins on the first (or last) row of each key.
``below``/``above`` are as-of joins done in one sort: both sides are united and the last (next) key seen is carried along.
``prefix`` reproduces approximate VLOOKUP over keys in *any* order: the scan stops at the first greater key; over the row order
the running maximum of the keys turns that into an as-of search on ascending keys.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import need


def _one_per_key(table: DataFrame, key: str, row: str, last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    rest = [c for c in table.columns if c not in (key, row)]
    return table.groupBy(F.col(f"`{key}`").alias("__k")).agg(pick(F.struct(*[F.col(f"`{c}`") for c in rest]), row).alias("__r"))


def exact(df: DataFrame, column: str, table: DataFrame, key: str, value: str, row: str, into: str, last: bool = False, default: Column | None = None) -> DataFrame:
    """``into``: the ``value`` of the first (last) ``table`` row whose ``key`` equals ``column``; else ``default`` (null is #N/A)."""
    need(df, [column])
    need(table, [key, value, row])
    one = _one_per_key(table.select(key, value, row), key, row, last)
    met = df.join(one, df[column] == one["__k"], "left")
    out = F.when(F.col("__k").isNotNull(), F.col("__r")[value]).otherwise(default if default is not None else F.lit(None))
    return met.withColumn(into, out).drop("__k", "__r")


def nearest(df: DataFrame, column: str, table: DataFrame, key: str, value: str, into: str, direction: str = "below", row: str | None = None, buckets: int | None = None) -> DataFrame:
    """As-of: the value at the largest key <= ``column`` (``below``) or the smallest >= it (``above``).

    Rows are dealt by ranges of the key, each range is sorted on its own, and only the last (first) entry of every range is carried
    to the next ranges, so no task sees more than a range: ``buckets`` ranges from approximate quantiles of ``column``, by default
    one for 200,000 rows and 64 at least. Of equal keys the first by ``row`` counts (without one, the smallest value).
    """
    need(df, [column])
    up = direction == "above"
    x = F.col(f"`{column}`").cast("double")
    buckets = buckets or max(64, df.count() // 200_000)
    cuts = sorted({float(q) for q in df.select(x.alias("__x")).where("__x is not null").approxQuantile("__x", [i / buckets for i in range(1, buckets)], 0.01)})
    part = lambda c: F.when(c.isNull(), -1).otherwise(F.aggregate(F.array(*map(F.lit, cuts)).cast("array<double>"), F.lit(0), lambda a, q: a + F.when(c >= q, 1).otherwise(0)))
    t = table.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("double").alias("__key")).agg((F.min_by(f"`{value}`", row) if row else F.min(f"`{value}`")).alias("__v"))
    t = t.withColumn("__p", part(F.col("__key")))
    rows = df.withColumn("__key", x).withColumn("__p", part(F.col("__key"))).withColumn("__side", F.lit(1))
    entry = F.struct(F.lit(True).alias("there"), F.col("__v").alias("v"))
    united = rows.unionByName(t.select("__key", "__p", F.lit(1 if up else 0).alias("__side"), entry.alias("__e")).withColumn("__side", F.lit(2 if up else 0)), allowMissingColumns=True)
    order = [F.col("__key").desc(), F.col("__side").desc()] if up else [F.col("__key").asc(), F.col("__side").asc()]
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = united.withColumn("__near", F.last("__e", ignorenulls=True).over(w)).where("__side = 1")
    # what a range inherits: the nearest entry of the ranges before it, one row per range
    pick = F.min_by if up else F.max_by
    edge = t.groupBy("__p").agg(pick(entry, F.col("__key")).alias("__e"))
    ranges = df.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__p")).join(edge, "__p", "left")
    w2 = Window.orderBy(F.col("__p").desc() if up else F.col("__p").asc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__p", F.last("__e", ignorenulls=True).over(w2).alias("__from"))
    out = inside.join(F.broadcast(ranges), "__p", "left")
    near = F.coalesce("__near", "__from")
    return out.withColumn(into, F.when(F.col("__key").isNotNull(), near["v"])).select(*df.columns, into)


def prefix(df: DataFrame, column: str, table: DataFrame, key: str, value: str, row: str, into: str) -> DataFrame:
    """Approximate VLOOKUP/MATCH over rows in any order. The running maximum of the keys is taken within blocks of 65,536 rows by
    number, and the maxima of the blocks before are carried over (one row per block)."""
    need(table, [key, value, row])
    k = F.col(f"`{key}`").cast("double")
    t = table.select(k.alias("__key"), F.col(f"`{value}`").alias("__v"), F.col(row).alias("__row"), F.floor(F.col(row) / F.lit(65_536)).alias("__b"))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("__b").agg(F.max("__key").alias("__m")).select("__b", F.max("__m").over(w).alias("__m"))
    t = t.withColumn("__own", F.max("__key").over(Window.partitionBy("__b").orderBy("__row"))).join(blocks, "__b")
    t = t.withColumn("__top", F.greatest("__own", "__m"))
    # x stops before the first row whose running maximum exceeds it: the last row with running maximum <= x
    steps = t.groupBy("__top").agg(F.max_by("__v", "__row").alias("__v"))
    return nearest(df, column, steps.where("__top is not null"), "__top", "__v", into)


def wildcard_regex(pattern: str) -> str:
    """``*`` any text, ``?`` one character, a backslash takes the next character as it is."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def wildcard(table: DataFrame, key: str, pattern: str, row: str, ignore_case: bool = False, last: bool = False) -> DataFrame:
    """The first (last) row whose key matches the pattern."""
    p = wildcard_regex(pattern)
    return table.where(F.col(f"`{key}`").rlike(("(?i)" if ignore_case else "") + p)).orderBy(F.desc(row) if last else F.asc(row)).limit(1)


def match_position(table: DataFrame, key: str, wanted: object, row: str) -> DataFrame:
    """Exact MATCH: the 1-based position of the first row equal to ``wanted``; ``row`` counts from 0."""
    return table.where(F.col(f"`{key}`") == F.lit(wanted)).agg((F.min(row) + 1).cast("long").alias("position"))


def index_cell(table: DataFrame, row: str, at: int, column: str) -> DataFrame:
    """INDEX(range, at, column): one cell, ``at`` counts from 1."""
    return table.where(F.col(row) == at - 1).select(F.col(f"`{column}`").alias("value"))
