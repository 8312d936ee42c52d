"""Joins of sheets.

Output columns: those of the left, then those of the right without its key; a right name that the left has gets
``_right`` (a second clash is an error). A right join's key column holds the right key, a full join's the left one
where there is one. ``keys="text"`` compares keys as text, null and empty alike and matching each other; ``keys="sql"`` compares
values natively, null never matching, with no cast in the way of pushdown or bucketing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GridError
from .keys import need, text_key, unique

HOW = {"inner", "left", "right", "full"}


def right_names(left: list[str], right: list[str], right_key: str) -> dict[str, str]:
    """New names of the right columns that stay."""
    out = {n: f"{n}_right" if n in left else n for n in right if n != right_key}
    unique([*left, *out.values()])
    return out


def join(left: DataFrame, right: DataFrame, on: str | tuple[str, str], how: str = "inner", keys: str = "text") -> DataFrame:
    if how not in HOW:
        raise GridError(f"a join is one of {', '.join(sorted(HOW))}")
    lk, rk = (on, on) if isinstance(on, str) else on
    need(left, [lk])
    need(right, [rk])
    names = right_names(left.columns, right.columns, rk)
    if keys == "sql":
        r = right.select(F.col(rk).alias("__rk"), *[F.col(f"`{a}`").alias(b) for a, b in names.items()])
        both = left.join(r, left[lk] == r["__rk"], how)
    else:
        l2 = left.withColumn("__lt", text_key(left, lk))
        r = right.select(text_key(right, rk).alias("__rt"), F.col(f"`{rk}`").alias("__rk"), *[F.col(f"`{a}`").alias(b) for a, b in names.items()])
        both = l2.join(r, l2["__lt"] == r["__rt"], how)
    key: Column = F.col(f"`{lk}`")
    if how in ("right", "full"):
        a, b = left.schema[lk].dataType, right.schema[rk].dataType
        l_, r_ = (key, F.col("__rk")) if a == b else (key.cast("string"), F.col("__rk").cast("string"))
        # in text mode a null key can match an empty one, so the side's presence decides, not its key
        there = l_.isNotNull() if keys == "sql" else F.col("__lt").isNotNull()
        key = F.coalesce(r_, l_) if how == "right" and keys == "sql" else (r_ if how == "right" else F.when(there, l_).otherwise(r_))
    return both.select(*[key.alias(n) if n == lk else F.col(f"`{n}`") for n in left.columns], *[F.col(f"`{n}`") for n in names.values()])


def chain(first: DataFrame, *steps: tuple[DataFrame, str | tuple[str, str], str], keys: str = "text") -> DataFrame:
    """Joins from left to right: steps of (sheet, on, how)."""
    return reduce(lambda df, s: join(df, s[0], s[1], s[2], keys), steps, first)


def semi(left: DataFrame, right: DataFrame, on: str | tuple[str, str]) -> DataFrame:
    lk, rk = (on, on) if isinstance(on, str) else on
    return left.join(right.select(F.col(rk).alias("__rk")), left[lk] == F.col("__rk"), "left_semi")


def anti(left: DataFrame, right: DataFrame, on: str | tuple[str, str]) -> DataFrame:
    lk, rk = (on, on) if isinstance(on, str) else on
    return left.join(right.select(F.col(rk).alias("__rk")), left[lk] == F.col("__rk"), "left_anti")


def zip_columns(left: DataFrame, right: DataFrame, left_row: str, right_row: str) -> DataFrame:
    """Side by side by row number; a clashing name gets ``_1``, ``_2``, ... Unequal heights are the caller's error."""
    taken = set(left.columns)
    cols = []
    for n in right.columns:
        if n == right_row:
            continue
        new, k = n, 0
        while new in taken:
            k += 1
            new = f"{n}_{k}"
        taken.add(new)
        cols.append(F.col(f"`{n}`").alias(new))
    r = right.select(F.col(right_row).alias("__zip"), *cols)
    return left.join(r, left[left_row] == r["__zip"]).drop("__zip")
