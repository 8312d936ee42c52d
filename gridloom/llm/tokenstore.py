"""Token-id files with a shared zstandard dictionary (operator 9).

A dictionary is trained on a bounded sample of serialized id arrays; every document is then
compressed on its own with it, so that one short document can be read alone: its place comes from
the offset index at the file's end, the dictionary from one small file beside the shards.

Shard layout (little endian)::

    magic b"GLTS0001" | dictionary's xxh64 (8) | frames, one per document | index | footer
    index:  doc_id i64[n], offset u64[n + 1], n_tokens u32[n], flags u8[n] (1: doc_id is null)
    footer: index offset u64, n u64, bytes per id u8, index xxh64 u64, magic b"GLTSEND1"

Ids are stored as 16-bit numbers where the vocabulary allows, else 32-bit.

Documents go by range of doc_id to tasks, each of which writes its shards in ascending doc_id order
and rolls to the next shard beyond ``shard_bytes``. A file is written under a private name and
renamed, so a task that runs twice leaves one whole file of the same content.

Defined results: null text is an empty document; null doc_id comes first; equal doc_ids are ordered by
text; an empty table writes no shard and reads back as no rows; a document may be of any length. Columns beyond doc_id and text are
not read, so extra ones may have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fresh_path, materialize, open_input, write_file
from .textops import as_strings, slices, word_cache

CACHE_PIECES = 1_000_000
MAGIC, END = b"GLTS0001", b"GLTSEND1"
FOOTER = struct.Struct("<QQBQ8s")


def _hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def train_dictionary(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, width: int,
                     sample_docs: int = 1500, dict_bytes: int = 64 * 1024, sample_bytes: int = 16 * 1024) -> bytes:
    """A zstandard dictionary from the id arrays of the ``sample_docs`` documents with the smallest hash of doc_id.

    ``sample_bytes`` bounds what one document gives to the training. A sample too small to train on gives
    a dictionary of its raw content.
    """
    import zstandard

    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))  # an id that many rows share gives one
    kind = np.uint16 if width == 2 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer, spaced, CACHE_PIECES)
        for batch in batches:
            texts, keys = as_strings(batch.column(1)), batch.column(0).to_pylist()
            for i, j in slices(texts, 2_000_000):
                got, lens = cache.encode(texts.slice(i, j - i).to_pylist())
                ends = np.cumsum(lens)
                blobs = [np.append(got[e - n : e], np.uint32(end_id)).astype(kind).tobytes()[:sample_bytes] for e, n in zip(ends, lens, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "ids"])

    rows = sample.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary").collect()
    blobs = [bytes(r.ids) for r in sorted(rows, key=lambda r: (r.doc_id, bytes(r.ids)))]
    try:
        return zstandard.train_dictionary(dict_bytes, blobs).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blobs)[:dict_bytes] or b"\0" * 8


class ShardWriter:
    """Collects frames of one shard; ``chunks`` gives the file's content."""

    def __init__(self, dictionary: bytes, width: int, level: int):
        import zstandard

        self.comp = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        self.head = MAGIC + struct.pack("<Q", _hash(dictionary))
        self.width, self.kind = width, np.uint16 if width == 2 else np.uint32
        self.reset()

    def reset(self) -> None:
        self.frames: list[bytes] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        frame = self.comp.compress(ids.astype(self.kind).tobytes())
        self.frames.append(frame)
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.bytes += len(frame)

    def chunks(self) -> Iterator[bytes]:
        yield self.head
        yield from self.frames
        off = np.concatenate([[0], np.cumsum([len(f) for f in self.frames])]).astype(np.uint64) + np.uint64(len(self.head))
        index = b"".join([
            np.array([d or 0 for d in self.docs], np.int64).tobytes(), off.tobytes(), np.array(self.sizes, np.uint32).tobytes(),
            np.array([d is None for d in self.docs], np.uint8).tobytes(),
        ])
        yield index
        yield FOOTER.pack(int(off[-1]), len(self.docs), self.width, _hash(index), END)


class ShardReader:
    """Random access to one shard."""

    def __init__(self, path: str, dictionary: bytes):
        import zstandard

        self.file = open_input(path)
        size = self.file.size()
        at, n, width, digest, end = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        head = self.file.read_at(16, 0)
        if end != END or head[:8] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        if struct.unpack("<Q", head[8:])[0] != _hash(dictionary):
            raise ValueError(f"{path} was written with another dictionary")
        index = self.file.read_at(size - FOOTER.size - at, at)
        if _hash(index) != digest:
            raise ValueError(f"the index of {path} is damaged")
        self.doc = np.frombuffer(index, np.int64, n)
        self.off = np.frombuffer(index, np.uint64, n + 1, 8 * n).astype(np.int64)
        self.size = np.frombuffer(index, np.uint32, n, 16 * n + 8)
        self.null = np.frombuffer(index, np.uint8, n, 20 * n + 8)
        self.kind = np.uint16 if width == 2 else np.uint32
        self.dec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def __len__(self) -> int:
        return len(self.doc)

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.dec.decompress(frame), self.kind).astype(np.uint32)

    def get(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by one ranged read."""
        return self._ids(self.file.read_at(int(self.off[i + 1] - self.off[i]), int(self.off[i])))

    def find(self, doc_id: int) -> np.ndarray | None:
        k = int(self.null.sum())
        i = k + int(np.searchsorted(self.doc[k:], doc_id))
        return self.get(i) if i < len(self) and self.doc[i] == doc_id else None

    def scan(self, most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of all documents, in reads of about ``most`` bytes."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.off, self.off[i] + most, side="right")) - 1)
            data = self.file.read_at(int(self.off[j] - self.off[i]), int(self.off[i]))
            for k in range(i, j):
                yield k, self._ids(data[self.off[k] - self.off[i] : self.off[k + 1] - self.off[i]])
            i = j


def write_tokens(docs: DataFrame, path: str, tokenizer: str, spaced: bool, end_id: int, partitions: int | None = None,
                 level: int = 3, shard_bytes: int = 32_000_000, dictionary: bytes | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) below ``path``; returns the manifest (part, shard, path, n_docs, n_tokens), a table."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id) <= 1 << 16 else 4
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer, spaced, end_id, width)
    write_file(f"{path}/dictionary.zstd", [dictionary])
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "part int, shard int, path string, n_docs long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, shard = TaskContext.get().partitionId(), 0
        cache, out = word_cache(tokenizer, spaced, CACHE_PIECES), ShardWriter(dictionary, width, level)

        def roll() -> pa.RecordBatch:
            nonlocal shard
            name = f"{path}/part-{part:06d}-{shard:05d}.glts"
            write_file(name, out.chunks())
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": name, "n_docs": len(out.docs), "n_tokens": sum(out.sizes)}],
                                             schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            out.reset()
            shard += 1
            return row

        for batch in batches:
            texts, keys = as_strings(batch.column(1)), batch.column(0).to_pylist()
            for i, j in slices(texts, 2_000_000):
                got, lens = cache.encode(texts.slice(i, j - i).to_pylist())
                ends = np.cumsum(lens)
                for doc, e, size in zip(keys[i:j], ends.tolist(), lens.tolist(), strict=True):
                    out.add(doc, np.append(got[e - size : e], np.uint32(end_id)))
                if out.bytes >= shard_bytes:
                    yield roll()
        if out.docs:
            yield roll()

    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(ordered.mapInArrow(run, schema), "token-manifest")


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it over all files), n_tokens, ids_crc32."""
    dictionary = b""
    with open_input(f"{path}/dictionary.zstd") as f:
        dictionary = f.read()
    # one row per shard: the running sum over all shards is small (a shard holds tens of MB)
    w = Window.orderBy("part")
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    placed = manifest.join(parts.drop("n"), "part").withColumn(
        "base", F.coalesce("base", F.lit(0)) + F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = ShardReader(name, dictionary)
                crc = np.empty(len(shard), np.int64)
                for k, ids in shard.scan():
                    crc[k] = zlib.crc32(ids.tobytes())
                size = shard.size.astype(np.int64)
                doc = pa.array(shard.doc, pa.int64(), mask=shard.null.astype(bool))
                yield pa.RecordBatch.from_arrays([doc, pa.array(base + np.cumsum(size) - size), pa.array(size), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return placed.select("path", "base").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def roundtrip(spark: SparkSession, docs: DataFrame, tokenizer: str, spaced: bool, end_id: int) -> DataFrame:
    path = fresh_path(spark, "tokens")
    return read_tokens(write_tokens(docs, path, tokenizer, spaced, end_id), path)
