"""Multinomial draws by a count tree, so that any task can make the counts of its own patients.

A replicate of a site with n patients is n draws with replacement. The patients are
numbered and cut into leaves of LEAF; the n draws are split down a binary tree of ranges
of leaves by hashed binomial draws, and a leaf's draws are dealt to its patients by
hashes. A count is thus a function of (seed, site, replicate, number, n) alone: no task
needs another one's draws, and those of a site add up to n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Patients of a leaf.
LEAF = 64
# The increment and the multipliers of the splitmix64 generator.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Cells of one table of binomial weights.
CELLS = 1 << 17


def _mix(x: np.ndarray) -> None:
    """Each number's hash in its place."""
    part = np.empty_like(x)
    for shift, factor in ((30, FIRST), (27, SECOND), (31, 1)):
        np.right_shift(x, np.uint64(shift), out=part)
        x ^= part
        if factor > 1:
            x *= np.uint64(factor)


def mixed(x: np.ndarray) -> np.ndarray:
    """The hashes of 64-bit numbers."""
    x = x.copy()
    _mix(x)
    return x


def site_base(seed: str, site) -> int:
    """Where a site's hashes begin."""
    return int(hashlib.md5(f"{seed}:{site}".encode()).hexdigest()[:15], 16)


def _keyed(base: int, rep: np.ndarray, node: int) -> np.ndarray:
    return mixed(np.uint64(base) + (rep.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(node)) * np.uint64(STEP))


def binomials(c: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Binomial(c, p) at the quantiles u.

    The weights are those within 8 standard deviations and 8 of the mean, relative to
    the first of them; what lies outside has a chance of less than 1e-15. Equal c share
    their weights.
    """
    out = np.zeros(len(c), np.int64)
    kinds, kind = np.unique(c, return_inverse=True)
    mean, sd = kinds * p, np.sqrt(kinds * p * (1 - p))
    low = np.maximum(0, np.floor(mean - 8 * sd - 8)).astype(np.int64)
    high = np.minimum(kinds, np.ceil(mean + 8 * sd + 8)).astype(np.int64)
    width = int((high - low).max(initial=0))
    each = max(1, CELLS // (width + 1))
    for at in range(0, len(kinds), each):
        s = slice(at, at + each)
        j = low[s] + np.arange(width)[:, None]
        weights = np.ones((width + 1, j.shape[1]))
        np.multiply((kinds[s] - j) / (j + 1), p / (1 - p), out=weights[1:])
        weights[1:][j >= high[s]] = 0.0
        below = np.cumsum(np.cumprod(weights, axis=0), axis=0)
        own = np.flatnonzero((kind >= at) & (kind < at + each))
        k = kind[own] - at
        out[own] = np.minimum(low[s][k] + _passed(below, k, u[own] * below[-1, k]), high[s][k])
    return out


def _passed(below: np.ndarray, k: np.ndarray, aim: np.ndarray) -> np.ndarray:
    """How many of the rising sums in column k are at most the aim, by halving."""
    first, last = np.zeros(len(k), np.int64), np.full(len(k), len(below))
    for _ in range(len(below).bit_length()):
        mid = (first + last) // 2
        past = (first < last) & (below[np.minimum(mid, len(below) - 1), k] <= aim)
        first, last = np.where(past, mid + 1, first), np.where(past, last, mid)
    return first


class Leaves:
    """A site's tree, read in rising order of leaves: a range that was split stays split, so a task splits each range once."""

    def __init__(self, base: int, n: int, replicates: int):
        self.base, self.n, self.rep = base, n, np.arange(replicates)
        self.steps = np.zeros(0, np.uint64)
        self.stack = [(1, 0, -(-n // LEAF), np.full(replicates, n, np.int64))]

    def draws(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, draws that fall into it in each replicate) of the leaves first ... last - 1, none of which was passed before."""
        size = lambda lo, hi: min(hi * LEAF, self.n) - lo * LEAF
        while self.stack:
            node, lo, hi, c = self.stack.pop()
            if hi <= first:
                continue
            if lo >= last:
                self.stack.append((node, lo, hi, c))
                return
            if hi - lo == 1:
                yield lo, c
                continue
            mid = (lo + hi) // 2
            u = (_keyed(self.base, self.rep, node) >> np.uint64(12)) / 2.0**52
            left = binomials(c, size(lo, mid) / size(lo, hi), u)
            self.stack += [(2 * node + 1, mid, hi, c - left), (2 * node, lo, mid, left)]

    def counts(self, first: int, last: int) -> np.ndarray:
        """(replicates, patients): how often each patient of the leaves first ... last - 1 is drawn."""
        parts = []
        with np.errstate(over="ignore"):
            for leaf, c in self.draws(first, last):
                m = min(LEAF, self.n - leaf * LEAF)
                before = np.cumsum(c) - c
                # a replicate's d-th draw is the hash of its start and d steps
                start = _keyed(self.base, self.rep, (1 << 31) + leaf) - before.astype(np.uint64) * np.uint64(STEP)
                drawn = np.repeat(start, c)
                drawn += self._steps(len(drawn))
                _mix(drawn)
                if m & (m - 1):
                    drawn %= np.uint64(m)
                else:
                    drawn &= np.uint64(m - 1)
                drawn += np.repeat(self.rep.astype(np.uint64) * np.uint64(m), c)
                parts.append(np.bincount(drawn.view(np.int64), minlength=len(c) * m).astype(np.int32).reshape(len(c), m))
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(self.rep), 0), np.int32)

    def _steps(self, n: int) -> np.ndarray:
        """1 to n steps."""
        if len(self.steps) < n:
            self.steps = np.arange(1, n + n // 4 + 1, dtype=np.uint64) * np.uint64(STEP)
        return self.steps[:n]


def counts(base: int, n: int, replicates: int, first: int, last: int) -> np.ndarray:
    """(replicates, patients): how often each patient of the leaves first ... last - 1 is drawn."""
    return Leaves(base, n, replicates).counts(first, last)
