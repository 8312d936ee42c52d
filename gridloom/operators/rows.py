"""Appending, merging and de-duplicating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateColumn
from .keys import need, text_key


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    """UNION ALL by the target's names: other source columns go, missing ones are null."""
    return target.unionByName(source.select(*[f"`{c}`" for c in source.columns if c in target.columns]), allowMissingColumns=True).select(*[f"`{c}`" for c in target.columns])


def append_distinct(target: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """Source rows whose key text is neither in the target nor in an earlier source row (by ``order``) are appended."""
    first = _first(source.withColumn("__k", text_key(source, key)), [F.col("__k")], order)
    new = first.join(target.select(text_key(target, key).alias("__k")), "__k", "left_anti").drop("__k")
    return append(target, new)


def _first(df: DataFrame, by: list[Column], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def remove_duplicates(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row, by ``order``, of each combination of ``columns`` (none: all but the order column)."""
    names = columns or [c for c in df.columns if c != order]
    need(df, names)
    return _first(df, [F.col(f"`{c}`") for c in names], order)


def upsert(target: DataFrame, source: DataFrame, key: str, target_order: str, source_order: str) -> DataFrame:
    """Update or insert by key text.

    A source key that the target has overwrites the shared columns, null included, of the *last* target row with it; of
    several source rows with one key the last wins, and new keys are inserted once, at the place of their first row.
    The result has the target's columns and ``target_order``; inserted rows come after all others in source order. Where the
    orders are keys (arrays), the caller's source keys come after all target keys already.
    """
    need(target, [key])
    shared = [c for c in source.columns if c in target.columns and c not in (source_order, target_order)]
    w = Window.partitionBy("__k")
    s = source.withColumn("__k", text_key(source, key))
    s = s.withColumn("__n", F.row_number().over(w.orderBy(F.desc(source_order)))).withColumn("__slot", F.min(source_order).over(w))
    s = s.where("__n = 1").select("__k", "__slot", *[F.col(f"`{c}`").alias(f"__s_{c}") for c in shared])
    t = target.withColumn("__k", text_key(target, key)).withColumn("__m", F.row_number().over(w.orderBy(F.desc(target_order))) == 1)
    met = t.join(s, "__k", "left")
    hit = F.col("__m") & F.col("__slot").isNotNull()
    updated = met.select(*[F.when(hit, F.col(f"`__s_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in shared else F.col(f"`{c}`") for c in target.columns])
    new, kind = s.join(t.select("__k"), "__k", "left_anti"), target.schema[target_order].dataType
    place = F.col("__slot")
    if not isinstance(kind, T.ArrayType):
        new = new.crossJoin(F.broadcast(target.agg(F.max(target_order).alias("__last"))))  # one row
        place = (F.coalesce("__last", F.lit(-1)) + 1 + F.col("__slot")).cast(kind)
    insert = new.select(*[F.col(f"`__s_{c}`").alias(c) for c in shared], place.alias(target_order))
    return updated.unionByName(insert, allowMissingColumns=True)


def consolidate(sheets: dict[str, DataFrame], source_column: str | None = None) -> DataFrame:
    """All rows, with the union of all columns in first-seen order; ``source_column``: a leading column with the sheet's name."""
    names = list(dict.fromkeys(c for df in sheets.values() for c in df.columns))
    if source_column is not None and source_column in names:
        raise DuplicateColumn(f"a sheet already has a column {source_column!r}")
    parts = [df if source_column is None else df.withColumn(source_column, F.lit(n)) for n, df in sheets.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*([f"`{source_column}`"] if source_column is not None else []), *[f"`{c}`" for c in names])


def remove_empty_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """Rows in which some cell is neither null nor empty text."""
    full = [F.coalesce(F.col(f"`{c}`").cast("string") != "", F.lit(False)) for c in df.columns if c != order]
    return df.where(reduce(lambda a, b: a | b, full)) if full else df
