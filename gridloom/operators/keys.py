"""Text keys: how the sheet verbs compare cells of different types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnMissing, DuplicateColumn

WHOLE = float(1 << 53)


def number_text(c: Column) -> Column:
    """A double in plain digits: 30.0 as ``30``, 1e-7 as ``0.0000001``; beyond decimal(38,18) as Spark writes it."""
    plain = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return (
        F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
        .when((c == F.floor(c)) & (F.abs(c) < WHOLE), c.try_cast("bigint").cast("string"))
        .otherwise(F.coalesce(plain, c.cast("string")))
    )


def text_of(c: Column, kind: T.DataType) -> Column:
    """The display text of a cell; null stays null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_text(c.cast("double"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def text_key(df: DataFrame, name: str) -> Column:
    """The key text of a column: null, missing and empty are one key."""
    need(df, [name])
    return F.coalesce(text_of(df[name], df.schema[name].dataType), F.lit(""))


def need(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnMissing(f"no column {missing[0]!r}; there are {', '.join(df.columns)}")


def unique(names: list[str]) -> None:
    seen: set[str] = set()
    for n in names:
        if n in seen:
            raise DuplicateColumn(f"column {n!r} would appear twice")
        seen.add(n)
