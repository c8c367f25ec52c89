"""BagMinHash signatures of multisets of word shingles.

Every shingle owns the axis of its possible weights, cut into dyadic cells [0, 1), [1, 2), [2, 4),
[4, 8) and so on. Each cell has a Poisson process in time whose rate is its length; a point has a
register and a place in its cell, which repeated halving (the bits of a number) finds. A multiset
sees the points whose place lies below the shingle's weight, and a register keeps the time of the
first point that it sees. Two multisets agree in a register with the probability of their weighted
Jaccard similarity, and a shingle of weight w costs the logarithm of w in cells, not w.
"""

from __future__ import annotations

import numpy as np

from tonelake.llm.wordhash import STEP, Words, mix, numbered, of_runs, word_ids

U = np.uint64
REGISTERS, ROWS = 80, 4
BANDS = REGISTERS // ROWS
#: Expected points of a register by the first look's end, besides those that fill all registers.
SURE = 5.0


class Bags:
    """The shingle multisets of some texts: ``doc``, ``shingle`` and ``weight``, ordered by text and shingle.

    Texts of fewer than ``n`` words have one shingle of all their words, texts without words none.
    Words are compared in ASCII lower case. Shingles are hashes, or, if ``exact``, numbers that only
    equal shingles of these texts share.
    """

    def __init__(self, raw: list[bytes], n: int = 5, *, exact: bool = False):
        if exact:
            words, count = word_ids([r.lower() for r in raw])
            step = lambda x, y: numbered(x, y) if len(x) else x
            first = np.cumsum(count) - count
        else:
            w = Words(raw, lower=True)
            words, count, first = w.hash, w.count, w.first
        many = np.where(count > 0, np.maximum(count - (n - 1), 1), 0)
        doc = np.repeat(np.arange(len(raw)), many)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
        h = np.zeros(len(doc), dtype=words.dtype)
        for k in range(1, n + 1):
            # the whole texts of k words, or all shingles of the longer ones
            here = np.flatnonzero(count[doc] == k) if k < n else np.flatnonzero(count[doc] >= n)
            if not len(here):
                continue
            if exact:
                run = words
                for j in range(1, k):
                    run = step(run[: len(words) - j], words[j:])
                h[here] = run[start[here]] * n + k - 1
            else:
                h[here] = mix(of_runs(words, k)[start[here]] + np.uint64(k))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
        at = np.flatnonzero(fresh)
        self.doc, self.shingle, self.weight = doc[at], h[at], np.diff(np.r_[at, len(h)])
        self.total = many
        self.bound = np.searchsorted(self.doc, np.arange(len(raw) + 1))

    def similarity(self, a: int, b: int) -> float:
        """Weighted Jaccard similarity of two of the texts; 0 without words."""
        i, j = slice(self.bound[a], self.bound[a + 1]), slice(self.bound[b], self.bound[b + 1])
        _, p, q = np.intersect1d(self.shingle[i], self.shingle[j], assume_unique=True, return_indices=True)
        both = int(np.minimum(self.weight[i][p], self.weight[j][q]).sum())
        return both / max(1, int(self.total[a] + self.total[b]) - both)


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> U(11)) + U(1)).astype(np.float64) * 2.0**-53


def signatures(bags: Bags, docs: int) -> np.ndarray:
    """One row of ``REGISTERS`` 16-bit values for each text; of a text without words, zeros."""
    # cells of each shingle: level 0 is [0, 1), level j is [2**(j-1), 2**j)
    levels = 1 + np.ceil(np.log2(np.maximum(bags.weight, 1))).astype(np.int64)
    item = np.repeat(np.arange(len(bags.doc)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.maximum(low, 1).astype(float)
    doc, weight = bags.doc[item], bags.weight[item].astype(float)
    seed = mix(bags.shingle[item] + level.astype(np.uint64) * STEP)
    first = np.full((docs, REGISTERS), np.inf)
    total = np.maximum(bags.total, 1).astype(float)
    until = REGISTERS * (np.log(REGISTERS) + SURE) / total
    time, count = np.zeros(len(item)), np.zeros(len(item), dtype=np.uint64)
    alive = np.arange(len(item))
    flat = first.reshape(-1)
    while len(alive):
        now = alive
        while len(now):
            count[now] += U(1)
            x = mix(seed[now] + count[now] * STEP)
            time[now] += -np.log(uniform(x)) / length[now]
            y = mix(x ^ U(0xD1B54A32D192ED03))
            place = low[now] + (y & U(0xFFFFFFFF)).astype(float) * (2.0**-32 * length[now])
            register = ((y >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)
            # a point behind the time limit counts as well: it is a true point of the process
            seen = place < weight[now]
            np.minimum.at(flat, doc[now[seen]] * REGISTERS + register[seen], time[now[seen]])
            now = now[time[now] < until[doc[now]]]
        # a time that is later than a process was followed may hide an earlier point of it
        open_docs = (first > until[:, None]).any(axis=1) & (bags.total > 0)
        until[open_docs] *= 2
        alive = np.flatnonzero(open_docs[doc])
        alive = alive[time[alive] < until[doc[alive]]]
        if not open_docs.any():
            break
        if not len(alive):
            alive = np.flatnonzero(open_docs[doc])
    out = (mix(first.view(np.uint64)) >> U(48)).astype(np.uint16)
    out[bags.total == 0] = 0
    return out
