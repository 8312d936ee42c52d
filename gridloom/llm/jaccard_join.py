"""N-gram Jaccard join of documents by prefix trees (operator 8).

A document is the set of its distinct five-word shingles, as 64-bit hashes. Equal sets are one node from the
start (their fingerprint is the node), however many copies there are.

1. *Global order.* A count-min sketch over all documents marks tokens that many documents share as heavy; the order is
   light tokens by hash, then heavy ones by hash. Any function of the token gives a valid order; this one moves shared lines
   and passages to the end. The sketch has a cell for some 32 words of text, 2**25 at most (4 MB of flags); a light token has
   fewer sets than the sketch's limit (some 120; beyond 10**9 words it grows with the text).
2. *Candidates.* Two sets at the threshold share a token of their prefixes (Bayardo's length bound, the whole prefix).
   Token lists give pairs with a sufficient length ratio. What two sets have in common lies in both prefixes or behind the
   one that ends first, so a pair needs so many common prefix tokens as the threshold asks beyond that rest; pairs with fewer go.
   A list longer than ``longest_list`` and the sketch's limit exists only for heavy tokens; it gives no pairs but a family.
   Pairs of one family are not judged by their count: all are compared in 3.
3. *Verification.* Per probe its partners (in bundles of bounded size), and per pair of blocks of a family its members, are
   stored in a :class:`~gridloom.llm.prefixtree.PrefixTree` over their whole ordered sets, which decides every link exactly.
   A large family is first compared with one of its sets, the pivot: all that link with it are one component already. 1 - Jaccard
   is a metric, so members further than twice the threshold's distance from the pivot can't link with those: the pivot's
   neighbours meet only the ring between. A large group of near copies so costs little more than its number.
4. *Components* over links (families give a spanning part of them) and the smallest doc_id of each.

No step can lose a link; tokens and sets are told apart by 64-bit hashes.

Defined results: null or wordless text has the empty set and links with nothing; fewer than five words are one shingle;
rows with a null doc_id are left out, in the query as in its SQL (the pipeline numbers its rows); a repeated doc_id gives as many
rows as it has; an empty table gives none. Columns beyond doc_id and text are not read, so extra ones may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_roots
from .prefixtree import PrefixTree, needed
from .storage import discard, materialize, release
from .textops import as_strings, lean, mix, shingle_sets, slices
from .vectors import groups

#: the sketch's size: one cell for so many characters of text, between 2**LEAST_BITS and 2**MOST_BITS cells, in parts of 2**PART_BITS
CELL_CHARS, LEAST_BITS, MOST_BITS, PART_BITS = 200, 16, 25, 16
#: members of a bundle that a probe is compared with at once
BUNDLE = 64
#: fewer rows than this may be broadcast (some 10 MB); beyond, the join shuffles
BROADCAST_ROWS = 400_000


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    n = np.array([len(s) for s in sets], np.uint64)
    with np.errstate(over="ignore"):
        return mix(np.array([np.add.reduce(mix(s)) for s in sets], np.uint64) + n).view(np.int64)


def cells(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The cell of each token in a sketch of 2**k cells: its first k bits."""
    return (tokens >> np.uint64(65 - len(sketch).bit_length())).astype(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, chars / CELL_CHARS)))))


def measure(docs: DataFrame, size: int = 5, bits: int | None = None) -> tuple[DataFrame, np.ndarray, float]:
    """(a table doc_id, n, fp: null for the empty set; the heavy cells, packed; the limit over which a cell is heavy)."""
    bits = bits or sketch_bits(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total, seen, held, n_held = np.zeros(1 << bits, np.uint32), set(), [], 0
        for batch in batches:
            texts = as_strings(batch.column(1))
            for i, j in slices(texts):
                sets = list(shingle_sets(texts.slice(i, j - i), size))
                n, fp = np.array([len(s) for s in sets], np.int64), fingerprints(sets)
                for f, t in _distinct(fp, sets, seen):
                    held.append(t)
                    n_held += len(t)
                if n_held > 1_000_000:
                    _count(total, held)
                    n_held = 0
                nothing = pa.nulls(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(fp, mask=n == 0), nothing.cast(pa.int32()), nothing.cast(pa.binary())],
                                                 names=["doc_id", "n", "fp", "part", "counts"])
        _count(total, held)
        nothing = pa.nulls(1, pa.int64())
        for part, x in enumerate(np.split(total, 1 << (bits - PART_BITS))):
            if x.any():
                yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.array([part], pa.int32()), pa.array([packed(x)], pa.binary())], names=["doc_id", "n", "fp", "part", "counts"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = materialize(rows.mapInArrow(run, "doc_id long, n long, fp long, part int, counts binary"), "shingle-sets", compression="zstd")
    return both.where("part is null").select("doc_id", "n", "fp"), *heavy_cells(both.where("part is not null").select("part", "counts"), bits)


def packed(counts: np.ndarray) -> bytes:
    """Cells of one part of the sketch (65,536 of them): all, or the places and values of those that aren't 0."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if counts.max() <= np.iinfo(k).max)
    some = np.flatnonzero(counts)
    head = bytes([np.dtype(kind).itemsize, len(some) * 3 < len(counts)])
    if head[1]:
        return head + some.astype(np.uint16).tobytes() + counts[some].astype(kind).tobytes()
    return head + counts.astype(kind).tobytes()


def add_packed(sums: np.ndarray, blob: memoryview) -> None:
    kind = np.dtype(f"u{blob[0]}")
    if blob[1]:
        n = (len(blob) - 2) // (2 + kind.itemsize)
        sums[np.frombuffer(blob, np.uint16, n, 2)] += np.frombuffer(blob, kind, n, 2 + 2 * n)
    else:
        sums += np.frombuffer(blob, kind, offset=2)


def _count(total: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        total += np.bincount(cells(np.concatenate(held), total), minlength=len(total)).astype(np.uint32)
        held.clear()


def _distinct(fps: np.ndarray, sets: list[np.ndarray], seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(fp, tokens) of non-empty sets that this task has not had yet; ``seen`` is bounded."""
    for fp, t in zip(fps.tolist(), sets, strict=True):
        if len(t) and fp not in seen:
            if len(seen) > 500_000:
                seen.clear()
            seen.add(fp)
            yield fp, t


def heavy_cells(counted: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """(one bit per cell of the sketch: more sets than chance and 64 have a token there; that limit). ``counted``: part, counts."""
    parts = 1 << (bits - PART_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in enumerate(batch.column(0).to_pylist()):
                if part not in sums:
                    sums[part] = np.zeros(1 << PART_BITS, np.int64)
                add_packed(sums[part], memoryview(batch.column(1)[k].as_buffer()))
        for part, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(s.sum())]), pa.array([s.tobytes()], pa.binary())], names=["part", "total", "counts"])

    summed = materialize(counted.repartition(parts, "part").mapInArrow(add, "part int, total long, counts binary"), "shingle-sketch")
    load = (summed.agg(F.sum("total")).first()[0] or 0) / (1 << bits)
    limit = 64 + load + 8 * math.sqrt(load)

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(b, np.int64) >= limit).tobytes() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["part", "bits"])

    out = np.zeros((parts, (1 << PART_BITS) // 8), np.uint8)
    for r in summed.select("part", "counts").mapInArrow(flags, "part int, bits binary").collect():  # 512 rows of 8 kB at most
        out[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel(), limit


def prefix_length(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return n - (-(-percent * n // 100)) + 1


def prefix(tokens: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of the prefix in the global order. ``heavy``: a flag per cell."""
    is_heavy = heavy[cells(tokens, heavy)]
    return np.concatenate([tokens[~is_heavy], tokens[is_heavy]])[: prefix_length(len(tokens), percent)]


def common_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least number of common prefix tokens of sets of sizes a and b at the threshold."""
    behind = np.maximum(a - prefix_length(a, percent), b - prefix_length(b, percent))
    return np.maximum(needed(a, b, percent) - behind, 1)


def _lists(percent: int, longest: int):
    """Over rows (tok, fp, n) sorted by tok, fp: pairs and, of long lists, family links."""
    shapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.empty(0, np.int64)] * 3
        leader: tuple[int, int] | None = None  # of a list already known to be long: (tok, fp)

        def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal leader
            tok, fp, n = cols
            if not len(tok):
                return
            cut = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            size = np.diff(np.append(cut, len(tok)))
            a, b, need, far = [], [], [], []
            for at, s in zip(cut[(size > 1) | (leader is not None)].tolist(), size[(size > 1) | (leader is not None)].tolist(), strict=True):
                known = leader is not None and leader[0] == tok[at]
                if known or s > longest:
                    first = leader[1] if known else int(fp[at])
                    leader = (int(tok[at]), first)
                    far.append(np.stack([np.full(s, first), fp[at : at + s]]))
                    continue
                if s < 2:
                    continue
                if s not in shapes:
                    shapes[s] = np.triu_indices(s, 1)
                i, j = shapes[s][0] + at, shapes[s][1] + at
                low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                fit = 100 * low >= percent * high
                i, j = i[fit], j[fit]
                a.append(fp[i])
                b.append(fp[j])
                need.append(common_needed(n[i], n[j], percent))
            if a:
                yield batch_of(np.concatenate(a), np.concatenate(b), np.concatenate(need))
            if far:
                f = np.concatenate(far, axis=1)
                yield batch_of(f[0], f[1], np.zeros(f.shape[1], np.int64))

        def distinct(cols: list[np.ndarray]) -> list[np.ndarray]:
            """Without the rows that repeat a (tok, fp): a copied set comes once from each task that has a copy."""
            tok, fp = cols[:2]
            keep = np.append(True, (tok[1:] != tok[:-1]) | (fp[1:] != fp[:-1]))
            return [c[keep] for c in cols]

        def batch_of(*cols: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["a", "b", "need"])

        for batch in batches:
            cols = [np.concatenate([c, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, c in enumerate(carry)]
            if not len(cols[0]):
                continue
            cols = distinct(cols)
            at = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if len(cols[0]) - at > 4 * longest:  # of different sets, so emit() makes it a family; it goes out as it comes
                at = len(cols[0])
            yield from emit([c[:at] for c in cols])
            carry = [c[at:] for c in cols]
        yield from emit(carry)

    return run


def _verify_bundles(percent: int):
    """Over rows (a, part, own, b, toks) sorted by a, part, own: the probe comes first (own 0); links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for g in groups(batches, ["a", "part"]):
            fps, toks = g.column("b").to_numpy(), g.column("toks").combine_chunks()
            keep = np.append(True, fps[1:] != fps[:-1])
            rows = np.flatnonzero(keep).tolist()
            if g.column("own")[0].as_py() != 0 or len(rows) < 2:
                continue
            sets = [np.frombuffer(toks[k].as_buffer(), np.uint64) for k in rows]
            hit = PrefixTree(sets[1:]).matches(sets[0], percent)
            us.append(np.full(len(hit), fps[rows[0]]))
            vs.append(fps[rows][1:][hit])
            if len(us) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])
                us, vs = [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _verify_blocks(percent: int):
    """Over rows (family, lo, hi, own, fp, toks) sorted by family, lo, hi: a spanning part of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["family", "lo", "hi"]):
            fps, first = np.unique(g.column("fp").to_numpy(), return_index=True)
            own = g.column("own").to_numpy()[first]
            toks = g.column("toks").combine_chunks()
            sets = [np.frombuffer(toks[k].as_buffer(), np.uint64) for k in first.tolist()]
            lo, hi = g.column("lo")[0].as_py(), g.column("hi")[0].as_py()
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            if not len(left) or not len(right):
                continue
            tree = PrefixTree([sets[k] for k in right.tolist()])
            i, j = [], []
            for k in left.tolist():
                hit = right[tree.matches(sets[k], percent)]
                hit = hit[hit != k]
                i.append(np.full(len(hit), k))
                j.append(hit)
            root = local_roots(len(fps), np.concatenate(i), np.concatenate(j))
            some = root != np.arange(len(fps))
            yield pa.RecordBatch.from_arrays([pa.array(fps[some]), pa.array(fps[root[some]])], names=["u", "v"])

    return run


CORE, RING, FAR = 0, 1, 2


def _by_pivot(percent: int):
    """Over rows (family, fp, toks, pivot, pivot_toks): family, fp, kind, pivot; by the distance from the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for mine, other in zip(batch.column(2), batch.column(4), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (mine, other))
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                # a link is a distance of at most 1 - percent / 100; what is further than twice that can't link with the core
                kinds.append(CORE if 100 * both >= percent * union else RING if 100 * both >= (2 * percent - 100) * union else FAR)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.int32()), batch.column(3)], names=["family", "fp", "kind", "pivot"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it was counted to be small, else as it is: the join then shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def link_documents(docs: DataFrame, percent: int = 80, size: int = 5, longest_list: int = 256, block: int = 128, sketch: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    ``longest_list``: token lists beyond it (and beyond the sketch's limit) give families; ``block``: members of a family in a
    task's block; ``sketch``: bits of the sketch's size, by default from the text. They change the work, never the result.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets, heavy_bits, limit = measure(texts, size, sketch)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, seen = np.unpackbits(heavy_bits).astype(bool), set()
        for batch in batches:
            texts = as_strings(batch.column(0))
            for i, j in slices(texts):
                own = list(shingle_sets(texts.slice(i, j - i), size))
                toks, fps, n = [], [], []
                for fp, t in _distinct(fingerprints(own), own, seen):
                    toks.append(prefix(t, heavy, percent))
                    fps.append(fp)
                    n.append(len(t))
                if toks:
                    count = [len(t) for t in toks]
                    cols = [np.concatenate(toks).view(np.int64), *(np.repeat(np.array(x, np.int64), count) for x in (fps, n))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["tok", "fp", "n"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(1))
            for i, j in slices(texts):
                own = list(shingle_sets(texts.slice(i, j - i), size))
                same = np.flatnonzero(fingerprints(own) == batch.column(0).slice(i, j - i).to_numpy()).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(same, pa.int64())), pa.array([own[k].tobytes() for k in same], pa.binary())], names=["fp", "toks"])

    lists = texts.select("text").mapInArrow(postings, "tok long, fp long, n long").repartition("tok").sortWithinPartitions("tok", "fp")
    met = materialize(lists.mapInArrow(_lists(percent, longest_list if sketch else max(longest_list, math.ceil(limit))), "a long, b long, need long"), "shingle-pairs")
    release(docs.sparkSession)
    pairs = materialize(met.where("need > 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b", "c"), "shingle-candidates")
    family = materialize(connected_components(met.where("need = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))), "shingle-families")
    discard(met)
    release(docs.sparkSession)

    # the sets that take part, one row per fingerprint
    wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(family.select(F.col("node").alias("fp"))).distinct()
    firsts = materialize(sets.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "shingle-firsts")
    wanted = materialize(firsts.join(wanted, "fp").select("fp", F.col("first").alias("doc_id"), "copies"), "shingle-wanted")
    chosen = materialize(texts.join(_small(wanted.select("fp", "doc_id")), "doc_id").select("fp", "text").mapInArrow(again, "fp long, toks binary"), "shingle-chosen")

    def verify(some: DataFrame) -> DataFrame:
        parts = materialize(some.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUNDLE)).cast("int").alias("m")), "shingle-bundles")
        dealt = some.select("a", "b").join(_small(parts), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("m")).cast("int").alias("part"))
        partner = chosen.join(_small(dealt), F.col("b") == chosen["fp"]).select("a", "part", "b", F.lit(1).alias("own"), "toks")
        probe = chosen.join(_small(parts), F.col("a") == F.col("fp")).select("a", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("part"), F.col("a").alias("b"), F.lit(0).alias("own"), "toks")
        return partner.unionByName(probe).repartition("a", "part").sortWithinPartitions("a", "part", "own", "b").mapInArrow(_verify_bundles(percent), "u long, v long")

    # families: the large ones by their distance from a pivot, the set with most copies
    member = family.select(F.col("component").alias("family"), F.col("node").alias("fp"))
    large = materialize(member.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("family"), "shingle-large")
    pivot = member.join(_small(large), "family").join(wanted.select("fp", "copies"), "fp").groupBy("family").agg(F.max_by("fp", F.struct("copies", "fp")).alias("pivot"))
    pivot = materialize(pivot.join(chosen, F.col("pivot") == F.col("fp")).select("family", "pivot", F.col("toks").alias("pivot_toks")), "shingle-pivots")
    of_pivot = member.join(_small(large), "family").join(chosen, "fp").join(pivot, "family").select("family", "fp", "toks", "pivot", "pivot_toks")
    kinds = materialize(of_pivot.mapInArrow(_by_pivot(percent), "family long, fp long, kind int, pivot long"), "shingle-kinds")
    core = kinds.where(F.col("kind") == CORE).select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    member = materialize(member.join(_small(large), "family", "left_anti").withColumn("kind", F.lit(FAR)).unionByName(kinds.select("family", "fp", "kind")), "shingle-members")
    # blocks are numbered ring, far, core; a pair of blocks meets but for core with core and core with far
    n_blocks = lambda kind: F.ceil(F.sum((F.col("kind") == kind).cast("long")) / F.lit(block)).cast("int")
    sizes = materialize(member.groupBy("family").agg(n_blocks(RING).alias("ring"), n_blocks(FAR).alias("far"), n_blocks(CORE).alias("core")), "shingle-family-sizes")
    dealt = member.join(_small(sizes), "family")
    first = F.when(F.col("kind") == RING, 0).when(F.col("kind") == FAR, F.col("ring")).otherwise(F.col("ring") + F.col("far"))
    of_kind = F.when(F.col("kind") == RING, F.col("ring")).when(F.col("kind") == FAR, F.col("far")).otherwise(F.col("core"))
    meets = F.when(F.col("kind") == RING, F.col("ring") + F.col("far") + F.col("core")).when(F.col("kind") == FAR, F.col("ring") + F.col("far")).otherwise(F.col("ring"))
    dealt = dealt.select("family", "fp", (first + F.pmod(F.xxhash64("fp"), of_kind)).cast("int").alias("own"), meets.alias("meets")).where("meets > 0")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")
    key = ["family", "lo", "hi"]
    blocks = chosen.join(_small(dealt), "fp").select(*key, "own", "fp", "toks").repartition(*key).sortWithinPartitions(*key)
    # first each set's best partner and the families; then only pairs that these links don't already connect
    best = materialize(pairs.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b"), "shingle-best")
    found = materialize(verify(best).unionByName(blocks.mapInArrow(_verify_blocks(percent), "u long, v long")).unionByName(core), "shingle-links")
    release(docs.sparkSession)
    of_a = materialize(connected_components(found).toDF("a", "of_a"), "shingle-sides")
    of_b = of_a.toDF("b", "of_b")
    open_ = pairs.join(best, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left")
    open_ = materialize(open_.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "shingle-open")
    more = materialize(verify(open_), "shingle-links")

    root = connected_components(found.unionByName(more))
    by = materialize(firsts.select("fp", "first").join(root.withColumnRenamed("node", "fp"), "fp"), "shingle-roots")
    least = materialize(by.groupBy("component").agg(F.min("first").alias("component_id")), "shingle-least")
    named = materialize(by.join(least, "component").select("fp", "component_id"), "shingle-named")
    alone = firsts.select("fp", "first").join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    out = sets.select("doc_id", "n", "fp").join(materialize(alone, "shingle-components"), "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


#: brute force over pairs of documents that share a shingle
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents where doc_id is not null
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w
), t as (select doc_id, unnest(s) as t from s
), n as (select doc_id, cast(len(s) as bigint) as n from s
), p as (select a.doc_id as a, b.doc_id as b, count(*) as c from t a join t b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), e as (select a, b from l union all select b, a from l
), r(doc_id, c) as (select doc_id, doc_id from n union select e.b, r.c from r join e on e.a = r.doc_id)
select doc_id, n as n_shingles, min(c) as component_id from r join n using (doc_id) group by doc_id, n
"""
