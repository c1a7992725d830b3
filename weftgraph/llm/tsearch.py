"""T-occurrence search over inverted lists by DivideSkip (Li, Lu, Lu, ICDE 2008).

A query set of n tokens matches a stored set only if that set stands in at
least T of the query's inverted lists.  The L longest lists are put aside; of
the short ones, numbers that stand only in the last T - L - 1 are skipped, as
they can't reach T - L; the others are counted there and, if they get that
far, looked up in the long lists until they can't reach T any more.  Lists are
counted whole in numpy, all numbers of a block at once, where the paper moves
a heap from number to number: in a group of near copies every list holds
nearly every set.
"""

from __future__ import annotations

from collections import Counter
from math import log2

import numpy as np

from .textkeys import least_overlap

#: The paper's tuning constant for the number of long lists.
MU = 0.01
#: Long lists that are looked up before the numbers that can't reach T are dropped.
STEP = 64
#: A list that holds more sets than this, and more than an eighth of all, is also kept as a row of marks.
DENSE = 16


class InvertedIndex:
    """Token lists of numbered sets, built when first searched after a set was added."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.sets: list[np.ndarray] = []
        self.numbers: list[int] = []
        self.widths: list[int] = []
        self.built = False

    def add(self, number: int, tokens: list[int] | np.ndarray, size: int) -> None:
        """``tokens`` may leave out those of the set that no query has; ``size`` counts them."""
        self.sets.append(np.asarray(tokens, dtype=np.uint64))
        self.numbers.append(number)
        self.widths.append(size)
        self.built = False

    def _build(self) -> None:
        m = len(self.sets)
        owners = np.repeat(np.arange(m), [len(s) for s in self.sets])
        self.tokens, place, self.lengths = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.postings = owners[np.argsort(place, kind="stable")]
        self.sizes = np.array(self.widths, dtype=np.int64)
        dense = self.lengths > max(DENSE, m // 8)
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        self.marks = np.zeros((int(dense.sum()), m), dtype=bool)
        marked = dense[place]
        self.marks[self.row[place[marked]], owners[marked]] = True
        self.built = True

    def _count(self, lists: np.ndarray) -> np.ndarray:
        """How many of the lists hold each set."""
        rows = self.row[lists]
        counts = self.marks[rows[rows >= 0]].sum(axis=0)
        lists = lists[rows < 0]
        if len(lists):
            lengths = self.lengths[lists]
            ends = np.cumsum(lengths)
            at = np.repeat(self.starts[lists] - ends + lengths, lengths) + np.arange(ends[-1])
            counts += np.bincount(self.postings[at], minlength=len(counts))
        return counts

    def search(self, tokens: list[int] | np.ndarray, n: int, among: np.ndarray | None = None) -> list[int]:
        """Numbers of the stored sets, in the order they were added, whose Jaccard similarity to a set of n reaches the bound.

        ``among``: marks of the sets that are asked for, in that order too.
        """
        if not n or not self.sets:
            return []
        if not self.built:
            self._build()
        percent = self.percent
        tokens = np.asarray(tokens, dtype=np.uint64)
        lists = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        lists = lists[self.tokens[lists] == tokens] if len(self.tokens) else lists[:0]
        least = -(-percent * n // 100)
        if len(lists) < least:
            return []
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        aside = min(least - 1, int(least / (MU * log2(int(self.lengths[lists[-1]]) + 1) + 1)))
        split = len(lists) - aside
        first = split - (least - aside) + 1
        counts = self._count(lists[:first])
        able = (counts > 0) & (100 * self.sizes >= percent * n) & (100 * n >= percent * self.sizes)
        if among is not None:
            able &= among
        found = np.flatnonzero(able)
        if not len(found):
            return []
        counts = counts[found] + self._count(lists[first:split])[found]
        need = np.maximum(least_overlap(n, self.sizes[found], percent), least)
        for start in range(split, len(lists), STEP):
            kept = counts + (len(lists) - start) >= need
            found, counts, need = found[kept], counts[kept], need[kept]
            if not len(found):
                return []
            counts = counts + self._count(lists[start : start + STEP])[found]
        return [self.numbers[i] for i in found[counts >= need].tolist()]


class Sets:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def block_links(sets: list[np.ndarray], sizes: list[int], labels: list, queries: list[bool] | None, percent: int) -> list[tuple[int, int]]:
    """Links (x, y) that join all similar members of one block, as a forest.

    ``labels``: members of one label count as joined already.  Without
    ``queries`` every pair of the block is covered: first each member against
    the leaders only, which settles groups of near copies in one look each;
    then, if several components remain, all members outside the largest
    against all that are not yet joined to them.  With ``queries`` only the
    marked members are searched for.
    """
    joined, first, links = Sets(len(sets)), {}, []
    for x, label in enumerate(labels):
        joined.join(first.setdefault(label, x), x)
    index = InvertedIndex(percent)
    for x, tokens in enumerate(sets):
        index.add(x, tokens, sizes[x])
    if queries is None:
        leaders, followers = np.zeros(len(sets), dtype=bool), False
        for x, tokens in enumerate(sets):
            hits = index.search(tokens, sizes[x], leaders)
            for y in hits:
                if joined.join(x, y):
                    links.append((x, y))
            if hits:
                followers = True
            else:
                leaders[x] = True
        counts = Counter(map(joined.root, range(len(sets))))
        if not followers or len(counts) == 1:
            return links
        largest = counts.most_common(1)[0][0]
        queries = [joined.root(x) != largest for x in range(len(sets))]
    roots = np.array([joined.root(x) for x in range(len(sets))])
    for x, asked in enumerate(queries):
        if asked:
            for y in index.search(sets[x], sizes[x], roots != roots[x]):
                if joined.join(x, y):
                    links.append((x, y))
                    old, new = sorted((roots[x], roots[y]))[::-1]
                    roots[roots == old] = new
    return links
