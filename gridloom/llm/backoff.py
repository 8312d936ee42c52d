"""Stupid-backoff scores of documents (operator 4), computed relationally in packed form.

Model: S(w | context) = c(context w) / c(context) if the n-gram was seen at least ``cutoff`` times, else
``alpha`` * S(w | shorter context); at the end (c(w) or 1) / N. A document's score is the sum of log S over its words.

The relations are the plain ones (exploded n-grams, a count table partitioned by hash, their join, a sum per
document), but a row holds many n-grams:

1. Documents are put into batches of about ``BATCH_BYTES`` of text; a batch with its number is one row of a written table.
2. A task explodes the n-grams of a batch and keeps the distinct hashes of each hash partition as one sorted array with
   their counts. These arrays are grouped by (order, hash partition); there the counts over the corpus are summed (the count
   table) and each array is merged with it, which is the join of exploded n-grams and counts, on hashes in one order.
3. The answers are co-grouped with the batches by number; a batch looks its n-grams up and sums per document.

An n-gram so costs about four bytes of shuffle, not a row. The number of hash partitions follows from the bytes of text, so
that the arrays of one partition stay about as large at any size. Counts below ``cutoff`` of orders above 1 travel as 0: they
can be neither a hit nor the context of one.

N-grams are told apart by 48 bits of a hash: of a million others about one in 300 million shares them.

Hot n-grams need no care: a batch names each once, so a partition gets at most one entry per batch and n-gram.

Defined results: null, empty or wordless text has score 0 and no words; rows with equal ids, and rows without one, are scored
each; no other column than doc_id and text is read, so extra ones may have any name; an empty table gives no rows; a text
of any length is one document of one batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release
from .textops import as_strings, ngrams, words

KEY_BITS = 48
BATCH_BYTES = 8_000_000
#: bytes of text for which there is one hash partition: some millions of entries of each order meet there
PART_BYTES = 16_000_000


def _batches(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.Table]:
    """Tables of rows whose texts (column ``at``) hold about ``most`` bytes."""
    held, n = [], 0
    for batch in batches:
        size = np.frombuffer(as_strings(batch.column(at)).buffers()[1], np.int64)[: batch.num_rows + 1] if batch.num_rows else np.zeros(1, np.int64)
        begin = 0
        for i in range(batch.num_rows):
            n += int(size[i + 1] - size[i])
            if n >= most:
                held.append(batch.slice(begin, i + 1 - begin))
                yield pa.Table.from_batches(held)
                held, n, begin = [], 0, i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def exploded(texts: pa.Array, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``order``: (key of each n-gram in place, number of n-grams of each text)."""
    out = []
    h, counts = [], []
    for i in range(0, len(texts), 256):
        a, b = words(texts.slice(i, 256))
        h.append(a)
        counts.append(b)
    h, counts = (np.concatenate(h), np.concatenate(counts)) if h else (np.empty(0, np.uint64), np.empty(0, np.int64))
    for n in range(1, order + 1):
        g, c = ngrams(h, counts, n)
        with np.errstate(over="ignore"):
            out.append(((g * np.uint64(2 * n + 1)) >> np.uint64(64 - KEY_BITS), c))
    return out


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as 32-bit steps; a step too long for that is given as the largest number and then in full."""
    step = np.diff(keys, prepend=np.uint64(0))
    big = step >= 0xFFFFFFFF
    return np.uint32(big.sum()).tobytes() + np.where(big, np.uint64(0xFFFFFFFF), step).astype(np.uint32).tobytes() + step[big].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n_big = int(np.frombuffer(blob, np.uint32, 1)[0])
    n = (len(blob) - 4 - 8 * n_big) // 4
    step = np.frombuffer(blob, np.uint32, n, 4).astype(np.uint64)
    if n_big:
        step[step == 0xFFFFFFFF] = np.frombuffer(blob, np.uint64, n_big, 4 + 4 * n)
    return np.cumsum(step)


def small(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each: 1, 2, 4 or 8."""
    top = int(counts.max()) if len(counts) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def large(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"u{blob[0]}", offset=1).astype(np.int64)


def boxed(docs: DataFrame) -> DataFrame:
    """batch, n_bytes, docs: a row holds the rows (doc_id, text) of one batch as a compressed Arrow stream."""
    names = ["batch", "n_bytes", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, rows in enumerate(_batches(batches, 1, BATCH_BYTES)):
            texts = as_strings(rows.column("text"))
            rows = pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), texts], names=["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([task << 24 | number]), pa.array([pa.compute.sum(pa.compute.binary_length(texts)).as_py() or 0]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=names)

    return docs.mapInArrow(run, "batch long, n_bytes long, docs binary")


def unboxed(blob: bytes) -> tuple[pa.Array, pa.Array]:
    """(doc_id, text) of a batch."""
    rows = pa.ipc.open_stream(blob).read_all()
    return rows.column("doc_id").combine_chunks(), as_strings(rows.column("text"))


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, cutoff: int = 2, partitions: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score, n_backoffs (words that had to back off) of every row of ``docs`` (doc_id, text).

    ``partitions``: hash partitions of the count table, a power of two; by default one per ``PART_BYTES`` of text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    boxes = materialize(boxed(docs), "backoff-docs", compression="uncompressed")
    n_bytes = boxes.agg(F.sum("n_bytes")).first()[0] or 0
    parts = 1 << max(3, math.ceil(math.log2(partitions or max(1, n_bytes / PART_BYTES))))
    shift = np.uint64(KEY_BITS - int(math.log2(parts)))
    names = ["batch", "n", "part", "keys", "counts"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, blob in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                for n, (keys, _) in enumerate(exploded(unboxed(blob.as_buffer())[1], order), 1):
                    keys, counts = np.unique(keys, return_counts=True)
                    cut = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64))
                    at = [p for p in range(parts) if cut[p] < cut[p + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), number)), pa.array(np.full(len(at), n, np.int32)), pa.array(np.array(at, np.int32)),
                         pa.array([pack(keys[cut[p] : cut[p + 1]]) for p in at], pa.binary()), pa.array([small(counts[cut[p] : cut[p + 1]]) for p in at], pa.binary())], names=names)

    def count(group: pa.Table) -> pa.Table:
        """The rows of one (n, part): its count table, and every row's keys joined to it."""
        keys = [unpack(k) for k in group.column("keys").to_pylist()]
        table, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(table), np.int64)
        np.add.at(total, place, np.concatenate([large(c) for c in group.column("counts").to_pylist()]))
        n_all = np.zeros(len(keys), np.int64)
        if group.column("n")[0].as_py() == 1:
            n_all[0] = total.sum()
        else:
            total[total < cutoff] = 0
        mine = np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table([group.column("batch"), group.column("n"), group.column("part"), pa.array(n_all), pa.array([small(m) for m in mine], pa.binary())], names=["batch", "n", "part", "words", "counts"])

    def total_up(box: pa.Table, answers: pa.Table) -> pa.Table:
        """One batch and its answers: the scores of its documents."""
        out = [pa.field("doc_id", pa.int64()), pa.field("n_words", pa.int64()), pa.field("log_score", pa.float64()), pa.field("n_backoffs", pa.int64())]
        if not box.num_rows:
            return pa.table([[]] * 4, schema=pa.schema(out))
        doc_id, texts = unboxed(box.column("docs")[0].as_buffer())
        found: dict[tuple[int, int], bytes] = {(n, p): c for n, p, c in zip(*(answers.column(x).to_pylist() for x in ("n", "part", "counts")), strict=True)}
        grams = exploded(texts, order)
        n_words = grams[0][1]
        seen = []
        for n, (keys, _) in enumerate(grams, 1):
            have = [large(found[at]) for at in sorted(x for x in found if x[0] == n)]
            _, place = np.unique(keys, return_inverse=True)
            seen.append(np.concatenate(have)[place] if have else np.empty(0, np.int64))
        w = len(grams[0][0])
        text = np.repeat(np.arange(len(n_words)), n_words)
        place = np.arange(w) - np.repeat(np.cumsum(n_words) - n_words, n_words)  # of the word in its text
        s, open_, depth = np.zeros(w), np.ones(w, bool), np.zeros(w)
        for n in range(order, 1, -1):
            at = np.flatnonzero(open_ & (place >= n - 1))  # words with a context of n - 1
            first = np.cumsum(np.maximum(n_words - (n - 1), 0)) - np.maximum(n_words - (n - 1), 0)
            own = first[text[at]] + place[at] - (n - 1)
            shorter = np.cumsum(np.maximum(n_words - (n - 2), 0)) - np.maximum(n_words - (n - 2), 0)
            context = shorter[text[at]] + place[at] - (n - 1)
            c, d = seen[n - 1][own], seen[n - 2][context]
            hit = c >= cutoff
            s[at[hit]] = np.log(c[hit] / d[hit]) + depth[at[hit]] * math.log(alpha)
            open_[at[hit]] = False
            depth[at[~hit]] += 1
        rest = np.flatnonzero(open_)
        s[rest] = np.log(np.maximum(seen[0][rest], 1) / max(1, n_total)) + depth[rest] * math.log(alpha)
        upto = np.concatenate([[0.0], np.cumsum(s)])
        back = np.concatenate([[0], np.cumsum(depth > 0)])
        ends = np.cumsum(n_words)
        return pa.table([doc_id, pa.array(n_words), pa.array(upto[ends] - upto[ends - n_words]), pa.array(back[ends] - back[ends - n_words])], schema=pa.schema(out))

    asked = boxes.select("batch", "docs").mapInArrow(ask, "batch long, n int, part int, keys binary, counts binary")
    counted = asked.repartition(parts, "n", "part").groupBy("n", "part").applyInArrow(count, "batch long, n int, part int, words long, counts binary")
    table = materialize(counted, "backoff-counts", compression="zstd")
    release(spark)  # the exploded n-grams: the next exchange need not find them on the disks
    n_total = table.agg(F.sum("words")).first()[0] or 0
    answers = table.select("batch", "n", "part", "counts").groupBy("batch")
    return boxes.select("batch", "docs").groupBy("batch").cogroup(answers).applyInArrow(total_up, "doc_id long, n_words long, log_score double, n_backoffs long")


#: the same scores over exploded n-grams as rows, to four decimals (sums of logarithms in another order differ in the last bits)
ORACLE = r"""
with w as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), t as (
  select r, w[i] as a, case when i > 1 then w[i - 1] end as b, case when i > 2 then w[i - 2] end as c from (select r, w, unnest(range(1, len(w) + 1)) as i from w)
), one as (select a, count(*) as n from t group by a
), two as (select b, a, count(*) as n from t where b is not null group by b, a
), three as (select c, b, a, count(*) as n from t where c is not null group by c, b, a
), s as (
  select t.r,
    case when three.n >= 2 then ln(three.n::double / ctx2.n)
      when two.n >= 2 then ln(two.n::double / ctx1.n) + case when t.c is not null then ln(0.4::double) else 0 end
      else ln(one.n::double / (select count(*) from t)) + ((t.b is not null)::int + (t.c is not null)::int) * ln(0.4::double) end as s,
    case when three.n >= 2 or (t.c is null and two.n >= 2) or t.b is null then 0 else 1 end as back
  from t join one on one.a = t.a
  left join two on two.b = t.b and two.a = t.a left join one ctx1 on ctx1.a = t.b
  left join three on three.c = t.c and three.b = t.b and three.a = t.a left join two ctx2 on ctx2.b = t.c and ctx2.a = t.b
), d as (select r, sum(s) as s, sum(back) as back from s group by r)
select doc_id, cast(len(w) as bigint) as n_words, round(coalesce(s, 0), 4) as log_score, cast(coalesce(back, 0) as bigint) as n_backoffs from w left join d using (r)
"""
