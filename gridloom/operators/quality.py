"""Cleaning and validating columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GridError
from .keys import need

# What counts as an address and as a phone number.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
PHONE = r"^(?=.*[0-9])\+?[0-9().\s-]{7,}$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


@dataclass(frozen=True)
class Cleaning:
    """What to do, in this order: trim, normalize_whitespace, upper (else lower), then the null rules."""

    trim: bool = False
    normalize_whitespace: bool = False
    upper: bool = False
    lower: bool = False
    empty_to_null: bool = False
    null_to_empty: bool = False
    fill: object = None

    @classmethod
    def of(cls, *ops: str, fill: object = None) -> Cleaning:
        known = set(cls.__dataclass_fields__) - {"fill"}
        bad = [o for o in ops if o not in known and o != "fill_nulls"]
        if bad:
            raise GridError(f"unknown cleaning {bad[0]!r}; known: {', '.join(sorted(known))}, fill_nulls")
        return cls(**{o: True for o in ops if o != "fill_nulls"}, fill=fill)


def clean_column(c: Column, kind: T.DataType, how: Cleaning) -> Column:
    text = isinstance(kind, T.StringType)
    if text:
        if how.trim:
            c = strip(c)
        if how.normalize_whitespace:
            c = squeeze(c)
        if how.upper:
            c = F.upper(c)
        elif how.lower:
            c = F.lower(c)
        if how.empty_to_null:
            c = F.when(c != "", c)
        if how.null_to_empty:
            c = F.coalesce(c, F.lit(""))
    if how.fill is not None:
        fits = isinstance(how.fill, str) == text and (text or isinstance(kind, T.BooleanType) == isinstance(how.fill, bool))
        c = F.coalesce(c, F.lit(how.fill).cast(kind)) if fits else c
    return c


def clean(df: DataFrame, how: Cleaning, columns: list[str] | None = None, rows: Column | None = None) -> DataFrame:
    """``columns``: those to clean, all by default. ``rows``: only where true."""
    names = df.columns if columns is None else columns
    need(df, names)
    out = {}
    for n in names:
        c = F.col(f"`{n}`")
        new = clean_column(c, df.schema[n].dataType, how)
        out[n] = new if rows is None else F.when(rows, new).otherwise(c)
    return df.select(*[out[n].alias(n) if n in out else F.col(f"`{n}`") for n in df.columns])


def valid(c: Column, rule: str, low: float | None = None, high: float | None = None, pattern: str | None = None) -> Column:
    """True, false; null is never valid. Rules: email, phone, range, regex."""
    if rule == "email":
        ok = c.cast("string").rlike(EMAIL)
    elif rule == "phone":
        ok = c.cast("string").rlike(PHONE)
    elif rule == "range":
        x = c.try_cast("double")
        ok = (x >= F.lit(low) if low is not None else F.lit(True)) & (x <= F.lit(high) if high is not None else x.isNotNull())
    elif rule == "regex":
        if pattern is None:
            raise GridError("the rule regex needs a pattern")
        ok = c.cast("string").rlike(pattern)
    else:
        raise GridError(f"unknown rule {rule!r}")
    return F.coalesce(ok, F.lit(False))


def failures(df: DataFrame, column: str, rule: str, row: str, **how) -> DataFrame:
    """The row numbers (column ``row``) whose cell breaks the rule."""
    need(df, [column])
    return df.where(~valid(F.col(f"`{column}`"), rule, **how)).select(row)
