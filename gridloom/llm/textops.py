"""Vectorised work on whole Arrow text columns: words, hashes, shingles, cached tokenizers.

A word is a maximal run of bytes other than space and TAB..CR, with A-Z lower-cased.
Everything runs over the UTF-8 bytes of many texts at once, in slices of bounded size, so
that memory stays flat however long the texts are.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
KIND = np.where(SPACE, 0, 1).astype(np.uint8)  # 2: ASCII punctuation
KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 500_000
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * _C1
        h ^= h >> np.uint64(33)
        h *= _C2
        h ^= h >> np.uint64(33)
    return h


def _coefficients(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64)) * _GOLD) | np.uint64(1)


_COEF = _coefficients(4096)


def as_strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One non-null large_string array; null becomes empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.large_string()).fill_null("")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of rows whose texts together hold about ``most`` bytes; a longer text is alone."""
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(texts: pa.Array, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in order, number of words of each text).

    ``punctuation``: runs of ASCII punctuation are words of their own.

    A word's hash is a multilinear form of its bytes with pseudo-random odd coefficients
    per position, then mixed; two given words collide with probability about 2**-57.
    """
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    if n == 0 or off[-1] == off[0]:
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    kind = KIND[raw] if punctuation else (~SPACE[raw]).view(np.uint8)
    solid = kind > 0
    first = solid.copy()
    first[1:] &= kind[1:] != kind[:-1]
    begins = off[:-1][off[:-1] < len(raw)]
    first[begins] |= solid[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    where = np.flatnonzero(solid)
    cut = np.searchsorted(where, starts)
    lengths = np.diff(np.append(cut, len(where)))
    place = np.arange(len(where), dtype=np.int64) - np.repeat(cut, lengths)
    top = int(lengths.max())
    coef = _COEF if top <= len(_COEF) else _coefficients(top)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((LOWER[raw[where]].astype(np.uint64) + np.uint64(1)) * coef[place], cut)
        h = mix(h + lengths.astype(np.uint64) * _GOLD)
    return h, np.diff(np.searchsorted(starts, off))


def ngrams(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``n`` words inside one text, number of runs of each text)."""
    if n == 1:
        return h, counts
    if len(h) < n:
        return np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            g += mix(h[j : len(h) - n + 1 + j] + np.uint64(j + 1)) * _COEF[64 + j]
    text = np.repeat(np.arange(len(counts)), counts)
    g = mix(g[text[: len(g)] == text[n - 1 :]])
    return g, np.maximum(counts - (n - 1), 0)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; with fewer words the sequence as one; without words none."""
    h, counts = words(texts)
    g, runs = ngrams(h, counts, size)
    at, w = np.concatenate([[0], np.cumsum(runs)]), np.concatenate([[0], np.cumsum(counts)])
    for i, c in enumerate(counts.tolist()):
        if c >= size:
            yield np.unique(g[at[i] : at[i + 1]])
        elif c == 0:
            yield np.empty(0, np.uint64)
        else:
            whole, _ = ngrams(h[w[i] : w[i + 1]], np.array([c]), c)
            yield mix(whole + np.uint64(c))


_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class WordCache:
    """Token ids of whole texts, exactly those of a ``tokenizers`` file, through a bounded cache of pieces.

    Both kinds of file used here split a text before they merge anything, and never across
    these places: for ``spaced`` (byte-level BPE, a word carries its one leading space) between
    a non-space and a single space or line feed that stands before a non-space; for the other kind
    (lower case, white space dropped) at any space or line feed. Pieces between such places are
    looked up, new ones encoded by the library. A text with any other white space or control
    character, or with a capital sigma (whose lower case depends on its place), is encoded whole.
    """

    def __init__(self, path: str, spaced: bool, most: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.spaced, self.most = spaced, most
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin a piece with a space, or end a word
        self.opens[[i for t, i in vocab.items() if (t.startswith("\u0120") if spaced else t.endswith("</w>"))]] = True
        self.between = "\n" if spaced else " | "
        self.between_id = self.tok.encode(self.between, add_special_tokens=False).ids[0]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.n_ids = np.empty(1 << 16, np.uint32), 0
        self.off, self.n = np.zeros(1 << 14, np.int64), 0
        self.hits = np.zeros(1 << 14, np.int64)

    def shrink(self) -> None:
        """Forget the pieces that were met once."""
        keep = np.flatnonzero(self.hits[: self.n] > 1)
        pieces = list(self.known)
        size, off, ids, hits = self.off[1:] - self.off[:-1], self.off, self.ids, self.hits
        self.clear()
        if len(keep) <= self.most // 2:
            upto = np.cumsum(size[keep])
            got = ids[np.repeat(off[keep] - (upto - size[keep]), size[keep]) + np.arange(upto[-1] if len(upto) else 0)]
            self._add([pieces[k] for k in keep.tolist()], got, size[keep])
            self.hits[: self.n] = hits[keep] // 2

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(pieces) + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.off[self.n + 1 : self.n + 1 + len(pieces)] = self.n_ids + np.cumsum(sizes)
        self.known.update(zip(pieces, range(self.n, self.n + len(pieces)), strict=True))
        self.n += len(pieces)
        self.n_ids += len(ids)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these pieces one after the other, where each ends, from 0)."""
        size = self.off[at + 1] - self.off[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.off[at] - upto[:-1], size) + np.arange(upto[-1])], upto

    def _learn(self, new: set[str]) -> None:
        """Encode unknown pieces. Punctuation at the end of a word is a piece of its own to the library, so such a word
        is put together from two; the others go many to a text, and the ids themselves tell where each begins."""
        made: list[tuple[str, str, str]] = []
        simple: set[str] = set()
        for w in new:
            stem = w.rstrip(_MARKS)
            if len(stem) < len(w) and stem and stem[-1].isalnum():
                made.append((w, stem, w[len(stem) :]))
            else:
                simple.add(w)
        simple.update(x for _, a, b in made for x in (a, b) if x not in self.known)
        if self.spaced:
            plain = sorted(p for p in simple if p[0] == " ")
            rest = sorted(p for p in simple if p[0] != " " and p != "\n")
            alone = [p for p in simple if p == "\n"]
        else:
            plain = sorted(p for p in simple if p.isalpha())
            rest = sorted(p for p in simple if not p.isalpha() and "|" not in p)
            alone = [p for p in simple if "|" in p]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.tok.encode_batch_fast([("" if self.spaced else " ").join(part)], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(self.opens[ids])
            if len(marks) == len(part):
                self._add(part, ids, np.diff(np.append(marks, len(ids))) if self.spaced else np.diff(np.append(-1, marks)))
            else:
                alone += part
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            ids = np.array(self.tok.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.between_id)
            if len(marks) == len(part) - 1:
                sizes = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
                self._add(part, np.delete(ids, marks), sizes)
            else:
                alone += part
        for e, p in zip(self.tok.encode_batch_fast(alone, add_special_tokens=False), alone, strict=True):
            self._add([p], np.array(e.ids, np.uint32), np.array([len(e.ids)]))
        if made:
            ids, upto = self._gather(np.array([self.known[x] for _, a, b in made for x in (a, b)], np.int64))
            self._add([w for w, _, _ in made], ids, np.diff(upto[::2]))

    def _pieces(self, text: str) -> list[str] | None:
        """None: the text must be encoded whole."""
        if not self.spaced:
            text = text.replace("\n", " ")
            return text.lower().split(" ") if text.isprintable() and "\u03a3" not in text else None
        if "\0" in text or not (text.isprintable() or text.replace("\n", "").isprintable()):
            return None
        out = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return None if "" in out or " " in out else out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if self.n > self.most:
            self.shrink()
        split = [self._pieces(t) if t else [] for t in texts]
        whole = [t for t, p in zip(texts, split, strict=True) if p is None]
        flat = [w for p in split if p for w in p]
        if new := set(flat).difference(self.known):
            if "" in new:
                self._add([""], np.empty(0, np.uint32), np.zeros(1, np.int64))
            self._learn(new - {""})
        direct = iter(self.tok.encode_batch_fast(whole, add_special_tokens=False)) if whole else iter(())
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        self.hits[: self.n] += np.bincount(at, minlength=self.n)
        got, upto = self._gather(at)
        ends = upto[np.cumsum([len(p or ()) for p in split])] if split else np.empty(0, np.int64)
        lens = np.diff(np.concatenate([[0], ends]))
        if not whole:
            return got, lens
        parts, begin = [], 0
        for i, (p, end) in enumerate(zip(split, ends.tolist(), strict=True)):
            part = np.array(next(direct).ids, np.uint32) if p is None else got[begin:end]
            begin, lens[i] = end, len(part)
            parts.append(part)
        return np.concatenate(parts), lens


_CACHES: dict[tuple[str, bool, int], WordCache] = {}


def word_cache(path: str, spaced: bool, most: int) -> WordCache:
    """The cache of this Python worker, of at most ``most`` pieces (some 150 bytes each): it outlives a task, as the worker does."""
    if (path, spaced, most) not in _CACHES:
        _CACHES[path, spaced, most] = WordCache(path, spaced, most)
    return _CACHES[path, spaced, most]


def lean() -> None:
    """Called by tasks that don't tokenize: what earlier tasks left in this Python worker goes, word caches and the freed
    memory that the allocators hold; an executor's room is for the stage that runs."""
    _CACHES.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
