"""A trie over globally ordered sets, probed level by level with shared overlaps and length bounds."""

from __future__ import annotations

import numpy as np

RUN = 64  # tokens of a node at most, so that long single branches can be pruned midway


def needed(a: int | np.ndarray, b: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


class PrefixTree:
    """``sets``: non-empty arrays, each strictly ascending in the global order (here: by hash).

    Sets that begin alike share nodes, so their common overlap with a probe is counted once. A subtree is left
    as soon as the overlap so far and the most that can still come (tokens left in the probe beyond this
    node, tokens left below it) stay under what its smallest set would need.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        docs = [sets[i] for i in order]
        lcp = [0] * len(docs)
        for i in range(1, len(docs)):
            n = min(len(docs[i]), len(docs[i - 1]))
            differ = np.flatnonzero(docs[i][:n] != docs[i - 1][:n])
            lcp[i] = int(differ[0]) if len(differ) else n
        parts, parent, level, start, length, rest, least = [], [], [], [], [], [], []
        ends: list[int] = [0] * len(docs)
        at = 0
        stack = [(0, len(docs), 0, -1, 0)]
        while stack:
            lo, hi, depth, up, deep = stack.pop()
            common = min(lcp[lo + 1 : hi]) if hi - lo > 1 else len(docs[lo])
            longest, smallest = max(len(d) for d in docs[lo:hi]), min(len(d) for d in docs[lo:hi])
            for b in range(depth, common, RUN):
                run = docs[lo][b : min(b + RUN, common)]
                parts.append(run)
                parent.append(up)
                level.append(deep)
                start.append(at)
                length.append(len(run))
                rest.append(longest - b - len(run))
                least.append(smallest)
                at += len(run)
                up, deep = len(parent) - 1, deep + 1
            k = lo
            while k < hi and len(docs[k]) == common:
                ends[k] = up
                k += 1
            cuts = [k, *[j for j in range(k + 1, hi) if lcp[j] == common], hi] if k < hi else []
            stack += [(b, e, common, up, deep) for b, e in zip(cuts, cuts[1:], strict=False)]
        tokens = np.concatenate(parts)
        self.vocab, self.tok = np.unique(tokens, return_inverse=True)
        self.parent, self.start, self.length = (np.array(x, np.int64) for x in (parent, start, length))
        self.rest, self.least = np.array(rest, np.int64), np.array(least, np.int64)
        self.last = tokens[self.start + self.length - 1]
        deep = np.array(level)
        by = np.argsort(deep, kind="stable")
        self.levels = np.split(by, np.cumsum(np.bincount(deep))[:-1])
        self.end = np.empty(len(sets), np.int64)
        self.end[order] = ends
        self.size = np.array([len(s) for s in sets], np.int64)
        self.mask = np.zeros(len(self.vocab), np.uint8)

    def matches(self, probe: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets whose intersection with ``probe`` is at least ``percent`` % of the union."""
        spot = np.searchsorted(self.vocab, probe)
        spot[spot == len(self.vocab)] = 0
        spot = spot[self.vocab[spot] == probe]
        if not len(spot):
            return np.empty(0, np.int64)
        self.mask[spot] = 1
        overlap = np.full(len(self.parent), -1, np.int64)
        for nodes in self.levels:
            above = np.where(self.parent[nodes] < 0, 0, overlap[self.parent[nodes]])
            nodes, above = nodes[above >= 0], above[above >= 0]
            if not len(nodes):
                break
            length = self.length[nodes]
            cut = np.cumsum(length) - length
            place = np.repeat(self.start[nodes] - cut, length) + np.arange(int(length.sum()))
            above = above + np.add.reduceat(self.mask[self.tok[place]].astype(np.int64), cut)
            left = len(probe) - np.searchsorted(probe, self.last[nodes], side="right")
            keep = above + np.minimum(left, self.rest[nodes]) >= needed(len(probe), self.least[nodes], percent)
            overlap[nodes[keep]] = above[keep]
        self.mask[spot] = 0
        both = overlap[self.end]
        return np.flatnonzero((both >= 0) & (100 * both >= percent * (self.size + len(probe) - both)))
