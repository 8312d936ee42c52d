"""Row order, row numbers and null ordering.

The order of a sheet's rows is held lazily, as a key column: an array of integers, compared from the left. A frame's own
order is one number per row (:func:`keyed`); what verbs make of it are filters, which keep keys, and concatenations
(:func:`before`, :func:`beside`). Contiguous numbers are made only when an address needs them (:func:`number_rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

ROW, KEY = "__row", "__key"
_BITS = 33
#: stands for the key of a row that isn't there: behind all others
NOWHERE = (1 << 63) - 1


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with an order key: its own order, by Spark's increasing ids. Nothing runs."""
    return df.withColumn(KEY, F.array(F.monotonically_increasing_id()))


def before(first: bool) -> Column:
    """The key of a row of the first (or of the second) of two sheets that stand one after the other."""
    return F.concat(F.array(F.lit(0 if first else 1).cast("long")), F.col(KEY))


def beside(left: str, right: str) -> Column:
    """The key of a joined row: by the left one, then by the right one; a side that has no row comes last."""
    nowhere = F.array(F.lit(NOWHERE).cast("long"))
    return F.concat(F.coalesce(F.col(left), nowhere), F.coalesce(F.col(right), nowhere))


def number_rows(df: DataFrame, name: str = ROW) -> DataFrame:
    """``df`` with contiguous row numbers from 0 in its own order.

    The rows are written once with Spark's increasing ids, which hold (partition, place in it); the partitions' heights are
    counted on what was written (one number per partition reaches the driver) and turn ids into numbers. So numbers
    and rows are of one execution, however the plan is cut into partitions when it is run again.
    """
    held = written(df.withColumn("__id", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("__id", _BITS)
    base, before_ = [], 0
    for p, n in sorted((r[0], r[1]) for r in held.groupBy(part.alias("p")).count().collect()):
        base.append((p, before_))
        before_ += n
    table = df.sparkSession.createDataFrame(base, "__p long, __base long")
    out = held.withColumn("__p", part.cast("long")).join(F.broadcast(table), "__p", "left")
    at = F.coalesce("__base", F.raise_error(F.lit("a partition that wasn't counted"))) + F.col("__id").bitwiseAND((1 << _BITS) - 1)
    return out.select(*[f"`{c}`" for c in df.columns], at.alias(name))


def by(name: str, descending: bool = False) -> Column:
    """Ascending puts nulls last, descending first, as the SQL surface documents."""
    c = F.col(f"`{name}`")
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def top(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(n)
