"""Quality by importance resampling (operator 7).

Two bags of hashed n-grams are counted: *raw* over all documents and *target* over those of a labelled sample
that are marked good. A document's log importance weight is the sum over its n-grams (words, punctuation runs
and their pairs) of log p_target / p_raw. Gumbel noise from a hash of the id is added and the k largest are kept:
that is sampling without replacement in proportion to the weights.

k is given, or calibrated: the cut on perturbed weights that best separates the sample's good from its bad rows
is carried over to the corpus as a number of rows, those above it, and ``top_k`` keeps that many.

Only the labelled sample is bounded (``sample`` documents, those with the smallest hash of the id); both bags hold
``BUCKETS`` numbers however large the corpus is; each task sends them once, in ``PARTS`` parts that are summed apart.

Defined results: null or empty text has weight 0; a null doc_id draws the noise of an empty id; rows that share an id share
its noise; labels that repeat an id count as good if one of them is; labels that are null are not used; without good labels
all weights are 0, without both kinds of labels a calibrated cut keeps everything; an empty table gives no rows. Kept columns pass
through whatever their names: the operator's own come last and get underscores where a column has their name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import uniform
from .select import kth_smallest
from .storage import free, materialize
from .textops import as_strings, lean, ngrams, slices, words

BUCKETS, PARTS = 1 << 16, 32


def features(texts: pa.Array, orders: tuple[int, ...] = (1, 2)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: (bucket of each n-gram, number of n-grams of each text). A word repeated at once is one feature, whatever the word."""
    h, counts = words(texts, punctuation=True)
    for n in orders:
        g, c = ngrams(h, counts, n)
        bucket = ((g + np.uint64(n)) >> np.uint64(48)).astype(np.int64)
        if n == 2 and len(g):
            text = np.repeat(np.arange(len(counts)), counts)
            inside = text[1:] == text[:-1]
            bucket[(h[1:] == h[:-1])[inside]] = 0
        yield bucket, c


def label_sample(labels: DataFrame, sample: int) -> dict[int, int]:
    """doc_id -> quality of at most ``sample`` labelled documents."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return {r.doc_id: r.quality for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}


def fit(docs: DataFrame, labelled: dict[int, int], orders: tuple[int, ...] = (1, 2), smooth: float = 100.0) -> np.ndarray:
    """Log ratios of the buckets: target counts against those expected by the raw model, both with ``smooth`` added per
    bucket, so that a bucket too rare in the sample to tell has a ratio near 1."""
    good = np.array(sorted(d for d, q in labelled.items() if q == 1), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        bags = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts = as_strings(batch.column(1))
            is_good = np.isin(batch.column(0).fill_null(-(1 << 62)).to_numpy(), good)
            for i, j in slices(texts):
                for bucket, c in features(texts.slice(i, j - i), orders):
                    bags[0] += np.bincount(bucket, minlength=BUCKETS)
                    if is_good[i:j].any():
                        bags[1] += np.bincount(bucket[np.repeat(is_good[i:j], c)], minlength=BUCKETS)
        for bag, whole in enumerate(bags):
            for part, x in enumerate(np.split(whole, PARTS)):
                if x.any():
                    yield pa.RecordBatch.from_arrays([pa.array([bag], pa.int32()), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for bag, part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[bag, part] = sums.get((bag, part), 0) + np.frombuffer(blob, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sums], pa.int32()), pa.array([p for _, p in sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=names)

    schema, names = "bag int, part int, counts binary", ["bag", "part", "counts"]
    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
    sums = {b: np.zeros(BUCKETS) for b in (0, 1)}
    for r in bags.repartition(2 * PARTS, "bag", "part").mapInArrow(add, schema).collect():  # a row per bag and part
        sums[r.bag][r.part * BUCKETS // PARTS : (r.part + 1) * BUCKETS // PARTS] = np.frombuffer(bytes(r.counts), np.int64)
    if not sums[1].any():
        return np.zeros(BUCKETS)
    raw = (sums[0] + 1) / (sums[0].sum() + BUCKETS)
    return np.log((sums[1] + smooth) / (sums[1].sum() * raw + smooth))


def weigh(docs: DataFrame, ratios: np.ndarray, orders: tuple[int, ...] = (1, 2), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, then ``log_weight`` and ``n_grams``."""
    columns = list(dict.fromkeys([*keep, "text"]))
    at = columns.index("text")
    names = [*keep, free(list(keep), "log_weight"), free(list(keep), "n_grams")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            texts = as_strings(batch.column(at))
            for i, j in slices(texts):
                total, n = np.zeros(j - i), np.zeros(j - i, np.int64)
                for bucket, c in features(texts.slice(i, j - i), orders):
                    upto = np.concatenate([[0.0], np.cumsum(ratios[bucket])])
                    ends = np.cumsum(c)
                    total += upto[ends] - upto[ends - c]
                    n += c
                own = [batch.column(columns.index(k)).slice(i, j - i) for k in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(total), pa.array(n)], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return docs.select(*[f"`{c}`" for c in columns]).mapInArrow(run, f"{schema}{', ' if keep else ''}`{names[-2]}` double, `{names[-1]}` long")


def perturbed(seed: str, weight: str = "log_weight") -> Column:
    """The log weight plus Gumbel noise, rounded so that its last bits don't depend on how rows were batched."""
    return F.round(F.col(f"`{weight}`"), 6) - F.log(-F.log(uniform(F.col("doc_id"), seed)))


def calibrate(docs: DataFrame, labelled: dict[int, int], ratios: np.ndarray, seed: str, orders: tuple[int, ...] = (1, 2)) -> float:
    """The cut on perturbed weights with the most good rows kept and bad rows dropped, each kind weighing one half.

    Of rows that share a labelled id the largest weight counts, so that no more numbers than labels reach the driver.
    """
    if len(set(labelled.values())) < 2:
        return -math.inf
    ids = docs.sparkSession.createDataFrame([(d,) for d in labelled], "doc_id long")
    rows = weigh(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"), ratios, orders).groupBy("doc_id").agg(F.max(perturbed(seed)).alias("w")).collect()
    w = np.array([r.w for r in rows])
    good = np.array([labelled[r.doc_id] == 1 for r in rows], bool)
    if not good.any() or good.all():
        return -math.inf
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    bad_below = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    good_above = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    gain = bad_below + good_above
    best = np.flatnonzero(gain >= gain.max() - 1e-12)[0]
    low, high = (w[best - 1] if best else w[0] - 2), (w[best] if best < len(w) else w[-1])
    return float(low + (high - low) * 0.25)


def top_k(scored: DataFrame, k: int, seed: str, weight: str = "log_weight") -> DataFrame:
    """``scored`` (a table) and, last, ``kept``: the ``k`` rows with the largest perturbed weights.

    Rows that share the weight of the last place (they share an id) are taken in the table's order.
    """
    kept, w = free(scored.columns, "kept"), perturbed(seed, weight)
    n = scored.count()
    if not 0 < k < n:
        return scored.withColumn(kept, F.lit(k > 0))
    at, some = kth_smallest(scored, -w, k)
    if some is None:
        return scored.withColumn(kept, -w <= F.lit(at))
    place = F.monotonically_increasing_id()
    placed = scored.withColumn(own := free(scored.columns, "_place"), place)
    last, _ = kth_smallest(placed.where(-w == F.lit(at)), F.col(own), some)
    return placed.withColumn(kept, (-w < F.lit(at)) | ((-w == F.lit(at)) & (F.col(own) <= F.lit(last)))).drop(own)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: str = "dsir", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` (doc_id among them) of ``docs``, then ``log_weight``, ``n_grams`` and ``kept``: the top k for the k
    that the calibrated cut gives. The scored rows are written once, since k is known only when all are scored."""
    labelled = label_sample(labels, sample)
    ratios = fit(docs, labelled)
    cut = calibrate(docs, labelled, ratios, seed)
    scored = materialize(weigh(docs, ratios, keep=keep), "importance-scores")
    weight = scored.columns[-2]
    return top_k(scored, scored.where(perturbed(seed, weight) >= F.lit(cut)).count(), seed, weight)
