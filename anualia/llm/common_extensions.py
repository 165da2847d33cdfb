"""Longest common extensions of many pairs of places in one sequence.

The suffixes at places whose residue lies in a difference cover are sorted, a
quarter to a third of all: first by a window of as many words as the cover's
modulus, then by windows of twice the length as often as needed, as the places
one, two, four windows on are in the cover too. For two places there is a distance
below the modulus at which both reach the cover. A question compares the words up
to there, and the pairs that agree so far take the rest from a sparse table of
minima over the common prefixes of neighbours in sorted order.
"""

from __future__ import annotations

import numpy as np

# A cover in which every difference modulo 13 occurs once.
MODULUS = 13
COVER = np.array([0, 1, 3, 9])

_SLOT = np.full(MODULUS, -1, np.int64)
_SLOT[COVER] = np.arange(len(COVER))
# For each difference: the residue in the cover from which it leads into the cover.
_FROM = np.array([next(c for c in COVER if _SLOT[(c + d) % MODULUS] >= 0) for d in range(MODULUS)])


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Place of each key among the different keys."""
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


class Extensions:
    """Common prefixes of the suffixes of ``words``, whose last word occurs nowhere else."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        blocks = self.n // MODULUS + 1
        # The places after the end hold different words of their own.
        more = (blocks + 1) * MODULUS + 1 - self.n
        self.words = np.append(words.astype(np.int64), int(words.max(initial=0)) + 1 + np.arange(more))
        self.places = (np.arange(blocks)[:, None] * MODULUS + COVER).reshape(-1)
        self._sort()

    def _number(self, place: np.ndarray) -> np.ndarray:
        """Number of the sample at a place of the cover."""
        return place // MODULUS * len(COVER) + _SLOT[place % MODULUS]

    def _sort(self) -> None:
        n, step = len(self.places), len(COVER)
        # Order by the window, two words at a time, as long as there are ties.
        rank = np.zeros(n, np.int64)
        tied = np.arange(n)
        for at in range(0, MODULUS, 2):
            both = self.words[self.places[tied] + at] << 32 | self.words[self.places[tied] + min(at + 1, MODULUS - 1)]
            order = np.lexsort((both, rank[tied]))
            tied, both = tied[order], both[order]
            group = rank[tied]
            first = np.append(True, group[1:] != group[:-1])
            new = first | np.append(True, both[1:] != both[:-1])
            # A rank is the number of samples below; in a group it grows with the place in it.
            place = np.arange(len(tied))
            rank[tied] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
            again = ~(new & np.append(new[1:], True))
            tied = tied[again]
            if not len(tied):
                break
        # Windows of one, two, four and more moduli; ranks beyond the end are lower than all.
        self.levels = [rank]
        jump = step
        while len(tied):
            ahead = np.full(n, -1, np.int64)
            ahead[:-jump] = rank[jump:]
            rank = _ranks(rank * (n + 1) + ahead + 1)
            self.levels.append(rank)
            jump *= 2
            if int(rank.max()) == n - 1 or jump >= n:
                break
        self.rank = _ranks(self.levels[-1])
        order = np.argsort(self.rank, kind="stable")
        common = self._compare(order[:-1], order[1:])
        self.minima = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of pairs of samples, from the longest windows to single words."""
        length = np.zeros(len(a), np.int64)
        at, to = a.copy(), b.copy()
        n, step = len(self.places), len(COVER)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.flatnonzero((at < n) & (to < n))
            same = inside[self.levels[k][at[inside]] == self.levels[k][to[inside]]]
            length[same] += MODULUS << k
            at[same] += step << k
            to[same] += step << k
        open_ = np.flatnonzero((at < n) & (to < n))
        for offset in range(MODULUS):
            p, q = self.places[a[open_]] + length[open_], self.places[b[open_]] + length[open_]
            open_ = open_[self.words[p] == self.words[q]]
            if not len(open_):
                break
            length[open_] += 1
        return length

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at each pair of different places."""
        distance = (_FROM[(j - i) % MODULUS] - i) % MODULUS
        out = np.zeros(len(i), np.int64)
        open_ = np.arange(len(i))
        for offset in range(MODULUS):
            short = distance[open_] > offset
            some = open_[short]
            same = some[self.words[i[some] + offset] == self.words[j[some] + offset]]
            out[same] += 1
            open_ = np.concatenate([open_[~short], same])
            if not len(same):
                break
        a, b = (self.rank[self._number(x[open_] + distance[open_])] for x in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            row = self.minima[k]
            out[open_[some]] += np.minimum(row[low[some]], row[high[some] - (1 << k)])
        return out
