"""Approximate nearest neighbours (operator 3): inverted file, product-quantised residuals, exact reranking.

Training (bounded, documented sample: the ``train_rows`` vectors with the smallest hash of their id) gives,
each vector once however often it occurs, ``lists`` coarse centroids and, for the residuals, ``parts`` codebooks of 256 entries each,
in up to ``stages`` stages: a stage codes the direction of what the stages before it left and keeps its length, so that a tight group is told apart
as well as a wide one, whatever else the codebooks were trained on. Every vector is
then indexed: assigned to its nearest centroid and coded. A query visits the ``probes`` lists whose
centroids have the largest inner product with it; there an asymmetric distance table (query part x codebook entry,
made once per query and task) estimates all inner products from the codes alone. The best ``rerank`` of
all lists are merged, their original vectors fetched once, and the k best by exact double precision are the answer.

Three numbers are measured, none follows how many vectors there are. ``measured`` queries (those with the smallest hash of their id)
are answered by brute force over all rows. ``probes`` is so many lists that the share ``target`` of these answers lies in
them, and no fewer than the sample's own exact neighbours need: clustered vectors need a few lists, isotropic ones, whose neighbours lie
anywhere, nearly half. Of all rows in these lists, ``ranked`` of the answers must be among the best ``rerank`` by their
estimates: the fewest stages that do it with the ``rerank`` given are used; if none does, the best number of stages with as many reranked as it takes.

Vectors are coded in units of the largest component and queries of their own, so that estimates in single precision neither overflow nor vanish.

Lists that lie near each other form an area. Codes of an area meet queries by their own area (that of the nearest list),
and only where one of these queries probes a list of the area; an area's codes are dealt into blocks of ``block``
rows and queries of one area into blocks of ``query_block``. So no task holds a hot list or all queries of one, a query travels
to as many areas as it probes, and original vectors travel once, for the candidates alone.

Defined results: rows are taken by vec_id as in operator 1; vectors that are null, empty, zero or hold null or
non-finite components, or are not of the commonest length, take no part; ties go to the smaller vec_id (equal vectors have
equal codes, and of equal estimates the smaller ids go on); fewer candidates than k give all; an empty table gives no rows. Columns
beyond vec_id and embedding are not read, so extra ones may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .vectors import groups, matrix, one_per_id, usable


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster takes a random row."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[b : b + 4096] @ c.T, axis=1) for b in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


@dataclass
class Index:
    coarse: np.ndarray  # lists x dim
    area: np.ndarray  # of each list
    books: np.ndarray  # stages x parts x 256 x dim of a part (zero padded)
    probes: int

    @property
    def record(self) -> int:
        """Bytes of a stage's code: an entry per part and the length, a float."""
        return self.books.shape[1] + 4

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, rows x stages x record)"""
        own = nearest(x, self.coarse)
        left = x - self.coarse[own]
        records = []
        for books in self.books:
            codes, length, left = stage(left, books)
            records.append(np.concatenate([codes, length[:, None].view(np.uint8)], axis=1))
        return own, np.stack(records, axis=1)

    def decode(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(stages x parts x rows: codes, stages x rows: lengths), of as many stages as are in the blobs"""
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1, self.record).transpose(1, 2, 0)
        return raw[:, :-4].copy(), raw[:, -4:].transpose(0, 2, 1).copy().view(np.float32)[..., 0]

    def tables(self, q: np.ndarray, stages: int) -> np.ndarray:
        """stages x parts x 256 x queries: inner products of codebook entries with query parts."""
        parts = split(q, self.books.shape[1]).transpose(1, 2, 0)
        return np.stack([books @ parts for books in self.books[:stages]]).astype(np.float32)

    def estimates(self, own: np.ndarray, tables: np.ndarray, lists: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """rows x queries: inner products by the centroid (``own``, queries x lists) and the first stage, the first two and so on; one array, changed in place."""
        near = own.T.astype(np.float32)[lists]
        for table, code, length in zip(tables, codes, lengths, strict=True):
            add = table[0][code[0]]
            for p in range(1, len(code)):
                add += table[p][code[p]]
            near += add * length[:, None]
            yield near

    def probed(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries x lists: inner products with the centroids, those that are visited)."""
        own = q @ self.coarse.T
        visited = np.zeros(own.shape, bool)
        np.put_along_axis(visited, np.argsort(-own, axis=1, kind="stable")[:, : self.probes], True, axis=1)
        return own, visited


def split(x: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x dim of a part, the last ones zero padded."""
    width = -(-x.shape[1] // parts)
    wide = np.zeros((len(x), parts * width))
    wide[:, : x.shape[1]] = x
    return wide.reshape(len(x), parts, width)


def directions(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((left * left).sum(axis=1)).astype(np.float32)
    return left / np.where(length > 0, length, 1)[:, None], length


def stage(left: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows x parts: codes of the directions, lengths, what is left)"""
    way, length = directions(left)
    cut = split(way, len(books))
    codes = np.stack([nearest(cut[:, p], books[p]) for p in range(len(books))], axis=1)
    coded = np.stack([books[p][codes[:, p]] for p in range(len(books))], axis=1).reshape(len(left), -1)[:, : left.shape[1]]
    return codes.astype(np.uint8), length, left - coded * length[:, None]


def probes_needed(sample: np.ndarray, coarse: np.ndarray, k: int, target: float, rng: np.random.Generator, queries: int = 256) -> int:
    """The least number of lists in which the share ``target`` of the exact neighbours of some sample rows lie.

    The k neighbours among all rows are fewer among a sample; the k nearest of the sample lie further away and so in more lists.
    """
    asked = rng.choice(len(sample), min(queries, len(sample)), replace=False)
    own = nearest(sample, coarse)
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(coarse)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return least(places(sample[asked] @ coarse.T)[np.arange(len(asked))[:, None], own[near]], target)


def places(score: np.ndarray) -> np.ndarray:
    """Of each column in the order of its row, largest first."""
    return np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1, kind="stable")


def least(places: np.ndarray, share: float) -> int:
    """The least n with the ``share`` of the places, which begin at 0, below it."""
    return int(np.quantile(places, share, method="higher")) + 1


def train(sample: np.ndarray, lists: int, areas: int, parts: int, k: int, target: float, probes: int | None = None, stages: int = 3, seed: int = 5, rounds: int = 8, book_rows: int = 8192) -> Index:
    rng = np.random.default_rng(seed)
    sample = rng.permutation(sample)
    coarse = kmeans(sample, lists, rounds, rng)
    area = nearest(coarse, kmeans(coarse, areas, rounds, rng))
    rows = sample[:book_rows]
    left = rows - coarse[nearest(rows, coarse)]
    books = np.zeros((stages, parts, 256, -(-sample.shape[1] // parts)))
    for s in range(stages):
        cut = split(directions(left)[0], parts)
        for p in range(parts):
            b = kmeans(cut[:, p], 256, rounds if s == 0 else rounds // 2, rng)
            books[s, p, : len(b)] = b
        left = stage(left, books[s])[2]
    return Index(coarse, area, books, probes or probes_needed(sample, coarse, k, target, rng))


def best_of(q: np.ndarray, v: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows (query, vector, score) with the ``n`` largest scores of each query, of equal ones the smaller vectors; in this order."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < n
    return q[keep], v[keep], s[keep]


def brute_force(vectors: DataFrame, qid: np.ndarray, q: np.ndarray, k: int) -> pa.Table:
    """query_id, vec_id, score of the k nearest of all rows of ``vectors`` to each of a few queries, by double precision."""
    size = np.sqrt((q * q).sum(axis=1))

    def nearest_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), q.shape[1])
            near = (x @ q.T).T
            near[qid[:, None] == ids[None, :]] = -np.inf
            over = np.partition(near, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
            # products of matrices give equal vectors scores that differ in the last bits
            over -= 1e-12 * size * np.sqrt((x * x).sum(axis=1).max())
            got = [best]
            for j, column in enumerate(near):
                at = np.flatnonzero((column >= over[j]) & np.isfinite(column))
                got.append((np.full(len(at), qid[j]), ids[at], (x[at] * q[j]).sum(axis=1)))
            best = best_of(*(np.concatenate(c) for c in zip(*got, strict=True)), k)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["query_id", "vec_id", "score"])

    found = vectors.select("vec_id", "embedding").mapInArrow(nearest_here, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n").toArrow()


def ranks_by_estimate(placed: DataFrame, index: Index, qid: np.ndarray, q: np.ndarray, at: np.ndarray, vid: np.ndarray) -> np.ndarray:
    """stages x answers: how many rows in the lists that query ``at`` of ``q`` visits come before its answer ``vid``
    by their estimates with so many stages; -1 where no such list has it."""
    spark, stages, step = placed.sparkSession, len(index.books), 64
    rows = placed.join(F.broadcast(spark.createDataFrame(pa.table({"id": np.unique(vid)}))), "id").select("id", "list", "codes").toArrow().sort_by("id")
    row_of = np.searchsorted(rows.column("id").to_numpy(), vid)

    def estimated(lists: np.ndarray, blobs: list[bytes], b: int) -> Iterator[np.ndarray]:
        own, visited = index.probed(q[b : b + step])
        yield from index.estimates(np.where(visited, own, -np.inf), index.tables(q[b : b + step], stages), lists, *index.decode(blobs))

    own = np.empty((stages, len(vid)), np.float32)
    lists, blobs = rows.column("list").to_numpy(), rows.column("codes").to_pylist()
    for b in range(0, len(q), step):
        of = np.flatnonzero((at >= b) & (at < b + step))
        for s, near in enumerate(estimated(lists, blobs, b)):
            own[s, of] = near[row_of[of], at[of] - b]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros(own.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists, blobs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for b in range(0, len(q), step):
                for s, near in enumerate(estimated(lists, blobs, b)):
                    for j in np.unique(at[(at >= b) & (at < b + step)]):
                        of = np.flatnonzero((at == j) & np.isfinite(own[s]))
                        column = near[:, j - b]
                        if len(of):
                            some = np.flatnonzero((column >= own[s, of].min()) & (ids != qid[j]))
                            e, i = column[some][:, None], ids[some][:, None]
                            before[s, of] += ((e > own[s, of]) | ((e == own[s, of]) & (i < vid[of]))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(before.size)), pa.array(before.ravel())], names=["at", "n"])

    counted = placed.select("id", "list", "codes").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(own.size, np.int64)
    out[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    return np.where(np.isfinite(own), out.reshape(own.shape), -1)


def fit(index: Index, placed: DataFrame, answers: pa.Table, qid: np.ndarray, q: np.ndarray, target: float, probes: int | None, rerank: int, ranked: float) -> tuple[int, int]:
    """Sets the index's ``probes`` by the answers to some queries; (stages, rerank) that the answers need."""
    if not answers.num_rows:
        return 1, rerank
    order = np.argsort(qid, kind="stable")
    at, vid = order[np.searchsorted(qid[order], answers.column("query_id").to_numpy())], answers.column("vec_id").to_numpy()
    if probes is None:
        spark = placed.sparkSession
        of = placed.join(F.broadcast(spark.createDataFrame(pa.table({"id": np.unique(vid)}))), "id").select("id", "list").toArrow().sort_by("id")
        own = of.column("list").to_numpy()[np.searchsorted(of.column("id").to_numpy(), vid)]
        index.probes = max(index.probes, least(places(q @ index.coarse.T)[at, own], target))
    ranks = ranks_by_estimate(placed, index, qid, q, at, vid)
    need = [least(r[r >= 0], ranked) if (r >= 0).any() else 1 for r in ranks]
    stages = next((s for s, n in enumerate(need) if n <= rerank), int(np.argmin(need)))
    return stages + 1, max(rerank, need[stages])


def first_of(near: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest finite numbers; of equal ones the first."""
    if n < len(near):
        least = np.partition(near, len(near) - n)[len(near) - n]
        over = np.flatnonzero(near > least)
        got = np.concatenate([over, np.flatnonzero(near == least)[: n - len(over)]])
    else:
        got = np.arange(len(near))
    return got[np.isfinite(near[got])]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, lists: int | None = None, parts: int = 32, target: float = 0.98, probes: int | None = None,
           rerank: int = 64, train_rows: int = 20_000, block: int = 16_384, query_block: int = 1024, stages: int = 3, measured: int = 256, ranked: float = 0.99) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` (vec_id, embedding) nearest to each of ``queries`` (query_id,
    embedding) by inner product, a row with the query's own id excepted. Both should be tables."""
    spark = vectors.sparkSession
    every = materialize(vectors.where(usable()).select("vec_id", "embedding"), "ann-vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x).cast("double")))
    common = every.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("count"), F.max(largest)).orderBy(F.desc("count"), "dim").first()
    if common is None:
        return empty
    dim, n, top = common
    unit = 2.0 ** min(1000, -math.frexp(top)[1])
    every = every.where(F.size("embedding") == dim)
    queries = queries.where(usable()).where(F.size("embedding") == dim).select("query_id", "embedding")
    sample = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).select("embedding").toArrow().column(0).combine_chunks()
    # a list has some 200 vectors, and ten of the sample at least at scale
    lists = min(lists or min(2048, max(16, 2 ** math.ceil(math.log2(max(1, n / 200))))), n)
    index = train(np.unique(matrix(sample, dim) * unit, axis=0), lists, max(1, min(lists, math.ceil(n / block))), parts, max(k, 1), target, probes, stages)

    def question(column: pa.Array) -> np.ndarray:
        q = matrix(column, dim)
        return q / np.abs(q).max(axis=1, keepdims=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes = index.encode(matrix(batch.column(1), dim) * unit)
                blob = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index.area[own].astype(np.int32)), pa.array(own.astype(np.int32)), blob], names=["id", "area", "list", "codes"])

    placed = materialize(every.mapInArrow(place, "id long, area int, list int, codes binary"), "ann-codes")
    tried = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(measured).toArrow()
    if not tried.num_rows:
        return empty
    qid, tried = tried.column(0).to_numpy(), tried.column(1).combine_chunks()
    used, rerank = fit(index, placed, brute_force(every, qid, matrix(tried, dim), max(k, 1)), qid, question(tried), target, probes, max(rerank, 2 * k), ranked)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, visited = index.probed(question(batch.column(1)))
                areas = [np.unique(index.area[v]).astype(np.int32).tolist() for v in visited]
                home = index.area[own.argmax(axis=1)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home), pa.array(areas, pa.list_(pa.int32()))], names=["id", "embedding", "home", "areas"])

    kind = dict(every.dtypes)["embedding"]
    asked = materialize(queries.mapInArrow(visit, f"id long, embedding {kind}, home int, areas array<int>"), "ann-queries")
    # one row per area, as many as lists at most
    rows_of = placed.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    asks_of = asked.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_block)).cast("int").alias("parts"))
    asked = asked.join(F.broadcast(asks_of), "home").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sent = asked.select("id", "embedding", "home", "part", F.explode("areas").alias("area")).join(F.broadcast(rows_of), "area")
    left = sent.select("area", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "home", "part", F.lit(0).alias("side"), "id", "embedding", F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("codes"))
    meets = materialize(sent.select("area", "home", "part").distinct(), "ann-meetings")
    right = placed.join(F.broadcast(rows_of), "area").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(meets, "area")
    right = right.select("area", "b", "home", "part", F.lit(1).alias("side"), "id", F.lit(None).cast(kind).alias("embedding"), "list", F.substring("codes", 1, used * index.record).alias("codes"))
    key = ["area", "b", "home", "part"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[np.ndarray]] = [[], [], []]  # query, vector, estimate of all groups of this task: merged before anything leaves it
        held = 0

        def merge() -> None:
            nonlocal held
            best[:] = [[x] for x in best_of(*(np.concatenate(x) for x in best), rerank)]
            held = len(best[0][0])

        def flush() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(x[0]) for x in best], names=["query_id", "vec_id", "estimate"])
            best[:], held = [[], [], []], 0
            return out

        for g in groups(batches, key):
            nq = int((g.column("side").to_numpy() == 0).sum())  # queries come first, each side by id
            if not nq or nq == g.num_rows:
                continue
            ids = g.column("id").to_numpy()
            qid, vid = ids[:nq], ids[nq:]
            q = question(g.column("embedding").slice(0, nq).combine_chunks())
            lists_ = g.column("list").slice(nq).to_numpy()
            codes, lengths = index.decode(g.column("codes").slice(nq).to_pylist())
            for b in range(0, nq, 64):
                part = q[b : b + 64]
                own, visited = index.probed(part)
                seen = np.flatnonzero(visited.any(axis=0)[lists_])  # vectors in a list that one of these queries visits
                if not len(seen):
                    continue
                for near in index.estimates(np.where(visited, own, -np.inf), index.tables(part, used), lists_[seen], codes[..., seen], lengths[:, seen]):
                    pass
                near[vid[seen][:, None] == qid[None, b : b + 64]] = -np.inf
                for i, column in enumerate(np.ascontiguousarray(near.T)):
                    c = first_of(column, rerank)
                    best[0].append(np.full(len(c), qid[b + i]))
                    best[1].append(vid[seen[c]])
                    best[2].append(column[c])
                    held += len(c)
                if held > 500_000:
                    merge()
                    if held > 250_000:
                        yield flush()
        if held:
            merge()
            yield flush()

    met = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "side", "id").mapInArrow(meet, "query_id long, vec_id long, estimate float")
    w = Window.partitionBy("query_id")
    found = met.withColumn("_n", F.row_number().over(w.orderBy(F.desc("estimate"), "vec_id"))).where(F.col("_n") <= rerank).select("query_id", "vec_id")
    both = found.join(every, "vec_id").join(queries.withColumnRenamed("embedding", "asked"), "query_id").select("query_id", "vec_id", "embedding", "asked")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = (matrix(batch.column(2), dim) * matrix(batch.column(3), dim)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])

    near = both.mapInArrow(exact, "query_id long, vec_id long, score double")
    return near.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(vectors: DataFrame, every: int = 20, **how) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``."""
    rows = materialize(one_per_id(vectors.select("vec_id", "embedding"), "vec_id", "embedding"), "ann-rows")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(rows, asked, **how)
