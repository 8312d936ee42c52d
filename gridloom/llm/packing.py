"""Cost-balanced packing of token-id documents into fixed-length sequences (operator 6).

Attention costs a linear part for each token and a quadratic part for each document inside a
sequence. Documents are taken by falling length and each goes to the cheapest sequence that
still has room for it (longest-processing-time order on estimated cost), so that sequences come
out even in cost as well as full.

The job is one scan without a shuffle: a task tokenizes its documents, keeps a buffer of at most
``buffer_sequences`` sequences of tokens and packs each full buffer. What no sequence has room for
as a whole is cut at the room that is left, so only the end of a task's last buffer can be short;
that end is cut into sequences whose lengths are powers of two, which need no padding. A task that
is run again (lost executor) makes the same pieces: all choices depend on its rows only.

Defined results: null text is an empty document (only its end id); a document longer than a sequence
fills whole sequences of its own and the rest is packed; equal lengths are taken in row order;
repeated rows are packed as often as they occur, rows without an id as such; an empty table gives no pieces; columns
beyond those named are not read, so extra ones may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import as_strings, slices, word_cache

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: sequence_id = task * 2**TASK_SHIFT + number within the task
TASK_SHIFT = 36


def cost(length: int, quadratic: float, width: int) -> float:
    """Estimated attention cost of one document inside a sequence, in token units."""
    return length + quadratic * length * length / width


def balance(lengths: list[int], width: int, quadratic: float = 1.0) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) of documents that are each at most ``width`` long.

    There are ceil(total / width) sequences, all full but the last. A document goes whole to the cheapest of all
    sequences that have room for it (of equally cheap ones the first); it is cut only if none has.
    """
    total = sum(lengths)
    n = -(-total // width)
    room, spent = np.full(n, width, np.int64), np.zeros(n)
    if n and total % width:
        room[-1] = total % width
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    left: list[int] = []
    for d in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if not lengths[d]:
            continue
        fits = room >= lengths[d]
        s = int(np.argmin(np.where(fits, spent, np.inf)))
        if fits[s]:
            out[s].append((d, 0, lengths[d]))
            room[s] -= lengths[d]
            spent[s] += cost(lengths[d], quadratic, width)
        else:
            left.append(d)
    room = room.tolist()
    # what has no whole place is cut at the room that is left, longest remainders into the roomiest sequences
    open_ = sorted((s for s in range(n) if room[s]), key=lambda s: -room[s])
    at = 0
    for d in left:
        begin = 0
        while begin < lengths[d]:
            while not room[open_[at]]:
                at += 1
            s = open_[at]
            size = min(room[s], lengths[d] - begin)
            out[s].append((d, begin, size))
            room[s] -= size
            begin += size
    return out


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Packer:
    def __init__(self, task: int, width: int, quadratic: float):
        self.width, self.quadratic = width, quadratic
        self.next = task << TASK_SHIFT
        self.rows: list[tuple] = []

    def sequence(self, pieces: list[tuple]) -> None:
        """pieces: (doc_id, start, ids, doc_tokens)."""
        at = 0
        for doc, start, ids, whole in pieces:
            crc = zlib.crc32(ids.tobytes())
            self.rows.append((doc, start, len(ids), crc, whole, self.next, at))
            at += len(ids)
        self.next += 1

    def pack(self, docs: list[tuple], last: bool) -> list[tuple]:
        """docs: (doc_id, start, ids, doc_tokens) of at most width ids; returns what waits for the next buffer."""
        plans = balance([len(d[2]) for d in docs], self.width, self.quadratic)
        cut = lambda plan: [(docs[d][0], docs[d][1] + a, docs[d][2][a : a + n], docs[d][3]) for d, a, n in plan]
        for plan in plans:
            pieces, size = cut(plan), sum(n for _, _, n in plan)
            if size == self.width:
                self.sequence(pieces)
            elif not last:
                return pieces
            else:
                for part in powers(size):
                    taken = []
                    while part:
                        doc, start, ids, whole = pieces.pop(0)
                        taken.append((doc, start, ids[:part], whole))
                        if len(ids) > part:
                            pieces.insert(0, (doc, start + part, ids[part:], whole))
                        part -= min(part, len(ids))
                    self.sequence(taken)
        return []

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 7
        self.rows = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def pack_documents(docs: DataFrame, tokenizer: str, spaced: bool = True, end_id: int = 1, width: int = 2048,
                   quadratic: float = 1.0, buffer_sequences: int = 512, cache_pieces: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; see the module's text. ``tokenizer`` is the path of a ``tokenizers`` file on every machine."""
    if width & (width - 1):
        raise ValueError("width must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = word_cache(tokenizer, spaced, cache_pieces)
        out = _Packer(TaskContext.get().partitionId(), width, quadratic)
        waiting: list[tuple] = []
        held = 0
        for batch in batches:
            texts, docs_ = as_strings(batch.column(1)), batch.column(0).to_pylist()
            for i, j in slices(texts, 2_000_000):
                ids, lens = cache.encode(texts.slice(i, j - i).to_pylist())
                ends = np.cumsum(lens)
                for doc, b, e in zip(docs_[i:j], (ends - lens).tolist(), ends.tolist(), strict=True):
                    own = np.append(ids[b:e], np.uint32(end_id))
                    whole = len(own) // width * width
                    for start in range(0, whole, width):
                        out.sequence([(doc, start, own[start : start + width], len(own))])
                    if len(own) > whole:
                        waiting.append((doc, whole, own[whole:], len(own)))
                        held += len(own) - whole
                    if held >= buffer_sequences * width:
                        waiting = out.pack(waiting, False)
                        held = sum(len(x[2]) for x in waiting)
                if len(out.rows) > 20_000:
                    yield out.flush()
        out.pack(waiting, True)
        yield out.flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
