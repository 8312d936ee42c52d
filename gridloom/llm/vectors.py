"""Arrow and numpy helpers for tables of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: str = "embedding") -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.col(v).isNotNull() & (F.size(v) > 0) & F.forall(v, ok) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column of vectors of one length as doubles."""
    return col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def by_dim(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch by vector length (nearly always one)."""
    sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        yield int(dim), batch if (sizes == dim).all() else batch.filter(pa.array(sizes == dim))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int = 1 << 62) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` of a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for b, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[b] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(b, e - b))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def one_per_id(df: DataFrame, id_col: str, *rest: str) -> DataFrame:
    """One row per id that is not null; of rows that differ the smallest is kept."""
    best = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.min(F.struct(*rest)).alias("_r"))
    return best.select(id_col, *[F.col(f"_r.{c}").alias(c) for c in rest])
