"""Taking rows in the order of a key up to a budget, without sorting a group in one task.

Rows of a group are dealt by their key into ``bins`` bins of one fixed, monotone scale. Bin totals are
summed before any shuffle and accumulated per group over at most ``bins`` rows; whole bins below the
budget are taken, whole bins above it are not, and in the one bin that holds the budget's end the exact
order decides. Only the rows of that bin are sorted, so no window holds more than one bin of one group.

:func:`kth_smallest` finds the value of a given rank by narrowing a histogram, without sorting at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: groups of which a row each is broadcast (some 10 MB); beyond, joins shuffle
BROADCAST_GROUPS = 100_000


def take_budget(rows: DataFrame, budgets: DataFrame, group: str, bin_: Column, order: list[Column], size: Column, nearest: bool) -> DataFrame:
    """``rows`` with ``_taken`` (boolean): in each group the first rows by (``bin_``, ``order``) whose sizes sum to the budget.

    budgets: one row per group, columns ``group`` and ``budget``; groups are matched null-safely. Both are read more than
    once, so they should be tables. Up to ``BROADCAST_GROUPS`` groups, which are counted, rows don't move to meet their group.
    ``nearest``: the row across the budget's end is taken if that comes nearer to the budget, else never.
    """
    rows = rows.withColumn("_bin", bin_).withColumn("_size", size)
    totals = rows.groupBy(group, "_bin").agg(F.sum("_size").alias("_sum"))
    w = Window.partitionBy(group).orderBy("_bin")
    upto = totals.select(group, "_bin", F.sum("_sum").over(w).alias("_upto"), "_sum")
    b = budgets.select(F.col(group).alias("_g"), "budget")
    # per group the first bin that doesn't fit whole: all before it are taken, none behind it
    edge = (
        upto.join(b, upto[group].eqNullSafe(b["_g"]), "left").where(~F.coalesce(F.col("_upto") <= F.col("budget"), F.lit(False)))
        .groupBy(F.col(group).alias("_g")).agg(F.min(F.struct(F.col("_bin").alias("_edge"), (F.col("_upto") - F.col("_sum")).alias("_before"), F.col("budget").alias("_budget"))).alias("_e"))
        .select("_g", "_e.*")
    )
    edge = F.broadcast(edge) if budgets.count() <= BROADCAST_GROUPS else edge
    placed = rows.join(edge, rows[group].eqNullSafe(edge["_g"]), "left")
    whole = placed.where(F.col("_edge").isNull() | (F.col("_bin") != F.col("_edge"))).withColumn("_taken", F.coalesce(F.col("_bin") < F.col("_edge"), F.lit(True)))
    run = F.col("_before") + F.sum("_size").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    over = run - F.col("_budget")
    fits = (over <= 0) | (F.lit(nearest) & (over < F.col("_size")) & (over <= F.col("_size") - over))
    cut = placed.where(F.col("_bin") == F.col("_edge")).withColumn("_taken", F.coalesce(fits, F.lit(False)))
    return whole.unionByName(cut).drop("_bin", "_size", "_g", "_edge", "_before", "_budget")


def kth_smallest(rows: DataFrame, value: Column, k: int, bins: int = 4096) -> tuple[object, int | None]:
    """(v, n): the k-th smallest value (1 <= k <= number of rows, none null) and how many of the rows that have it are among
    the first k; None: all of them. At most ``bins`` rows of counts reach the driver in each of a few rounds."""
    x = rows.select(value.alias("x"))
    low, high = x.agg(F.min("x"), F.max("x")).first()
    while low < high:
        at = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int").alias("b")
        got = x.where(F.col("x").between(low, high)).groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for r in sorted(got, key=lambda r: r.b):
            if k <= r.n:
                break
            k -= r.n
        if k == r.n:
            return r.high, None
        low, high = r.low, r.high
    return low, k
