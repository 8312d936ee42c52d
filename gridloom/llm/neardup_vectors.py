"""Embedding near-duplicates (operator 1): sign hashes of random hyperplanes, exact cosines, components.

Each vector gets, in each of several tables, a code of ``bits`` signs against random hyperplanes. Vectors of
one label whose codes agree in some table meet there and their cosine is computed exactly, in double
precision. A pair is counted in the first table in which it meets, so no list of pairs is ever made or
de-duplicated: a bucket gives, per vector, its number of new links and the root of its local component.

bits grows with the logarithm of the largest label so that a bucket of unrelated vectors keeps about
``bucket`` rows at any size; the number of tables follows from bits so that a pair just at the threshold is
missed with probability below ``miss``. A bucket larger than ``block`` is dealt into blocks by a hash of the
id and every pair of blocks is a task's group: no group exceeds about 2 * ``block`` rows, however many rows are alike.
Equal vectors of a label are one node from the start, with their number: copies, however many, are not compared.
``link_vectors(exact=True)`` compares all vectors of a label instead, in the same blocks.

Defined results: rows are taken by vec_id (rows that repeat an id are one vector, the smallest row of it;
null ids are left out); a vector with a null label, or that is null, empty, zero or has a null or non-finite
component links with nothing, nor do vectors of different length; an empty table gives no rows. Columns beyond those named are not read,
so extra ones may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_roots
from .storage import materialize
from .vectors import by_dim, groups, matrix, one_per_id, usable


def plan_tables(largest_label: int, threshold: float, bucket: int = 64, miss: float = 1e-7) -> tuple[int, int]:
    """(bits, tables)."""
    bits = max(6, math.ceil(math.log2(max(1, largest_label) / bucket)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _links(x: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in left, j in right; i < j within one block) with cosine >= threshold."""
    found_i, found_j = [], []
    for b in range(0, len(left), 512):
        part = left[b : b + 512]
        a, c = np.nonzero(x[part] @ x[right].T >= threshold)
        i, j = part[a], right[c]
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        found_i.append(i)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def link_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = 1024, seed: int = 7, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for ``vectors`` (vec_id, label, embedding).

    ``exact``: no pair can be missed, because all vectors of a label are one bucket; the work then grows with its square.
    """
    every = materialize(one_per_id(vectors.select("vec_id", "label", "embedding"), "vec_id", "label", "embedding"), "vectors")
    used = every.where(F.col("label").isNotNull() & usable())
    nodes = materialize(used.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "vector-nodes")
    copied = nodes.where("copies > 1")
    members = materialize(used.join(copied, ["label", "embedding"]).select("vec_id", "node", "copies"), "vector-copies")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = (0, 1) if exact else plan_tables(largest, threshold)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for dim, part in by_dim(batch, 2):
                sign = (matrix(part.column(2), dim) @ planes(dim, bits, tables, seed)) >= 0
                own = (sign.reshape(len(sign), tables, bits) * powers).sum(axis=2).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * tables), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(own), dim, np.int32)), lists], names=["node", "label", "embedding", "copies", "dim", "codes"])

    kinds = dict(every.dtypes)
    coded = nodes.select("node", "label", "embedding", "copies").mapInArrow(codes, f"node long, label {kinds['label']}, embedding {kinds['embedding']}, copies long, dim int, codes array<long>")
    coded = materialize(coded, "vector-codes")
    light = coded.select("node", "label", "dim", F.posexplode("codes").alias("tab", "code"))
    key = ["label", "dim", "tab", "code"]
    sizes = materialize(light.groupBy(*key).count().where("count > 1"), "vector-buckets")
    m = F.ceil(F.col("count") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    placed = (
        light.join(sizes, key).withColumn("m", m).withColumn("own", own).withColumn("other", other)
        .select("node", *key, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    rows = placed.join(coded.select("node", "embedding", "codes", "copies"), "node")
    key = [*key, "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        held = 0

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["node", "links", "root"])

        for g in groups(batches, key):
            if g.num_rows < 2:
                continue
            ids = g.column("node").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, own_block, copies = ids[order], g.column("own").to_numpy()[order], g.column("copies").to_numpy()[order]
            tab, lo, hi, dim = (int(g.column(c)[0].as_py()) for c in ("tab", "lo", "hi", "dim"))
            x = matrix(g.column("embedding").combine_chunks(), dim)[order]
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            left, right = np.flatnonzero(own_block == lo), np.flatnonzero(own_block == hi)
            if not len(left) or not len(right):
                continue
            i, j = _links(x, left, right, lo == hi, threshold)
            if not len(i):
                continue
            root = local_roots(len(ids), i, j)
            if tab:  # a pair counts in the first table in which its codes agree: the codes the buckets were made of
                before = g.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, tables)[order][:, :tab]
                new = ~np.concatenate([(before[i[b : b + 65536]] == before[j[b : b + 65536]]).any(axis=1) for b in range(0, len(i), 65536)])
                i, j = i[new], j[new]
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            some = (links > 0) | (root != np.arange(len(ids)))
            out[0].append(ids[some])
            out[1].append(links[some])
            out[2].append(ids[root[some]])
            held += int(some.sum())
            if held > 50_000:
                yield flush()
                held = 0
        yield flush()

    found = materialize(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "node long, links long, root long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = materialize(links.join(component, "node", "full"), "vector-components")
    out = every.select("vec_id").join(members, "vec_id", "left").select("vec_id", F.coalesce("node", "vec_id").alias("node"), F.coalesce("copies", F.lit(1)).alias("copies"))
    out = out.join(linked, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))


#: all pairs by brute force; components by a recursive minimum over links
ORACLE = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings where vec_id is not null and label is not null and embedding is not null
), n as (select *, sqrt(list_dot_product(e, e)) as norm from v where list_dot_product(e, e) > 0
), l as (
  select a.vec_id as u, b.vec_id as v from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), r(vec_id, c) as (
  select vec_id, vec_id from embeddings where vec_id is not null union select l.v, r.c from r join l on r.vec_id = l.u
), m as (select vec_id, min(c) as component_id from r group by vec_id)
select e.vec_id, (select count(*) from l where l.u = e.vec_id) as n_links, m.component_id, e.vec_id = m.component_id as kept
from embeddings e join m using (vec_id)
"""
