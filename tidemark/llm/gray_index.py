"""Hierarchical index over fingerprints in Gray order.

Neighbours in Gray order differ in few bits, so runs of it share many.  Each node of the tree
stands for a run: ``mask`` marks the bits on which the whole run agrees and which no node
above has settled, ``bits`` holds their values.  A search adds up, from the root down, the
differences between the query and what each node has settled; once the sum exceeds the radius
the whole run is dropped.  At a leaf all bits are settled and the sum is the distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
#: Pairs of query and node looked at at once.
SLICE = 1 << 20


def gray_rank(fingerprints: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the sequence of Gray codes."""
    rank = np.asarray(fingerprints, np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """``fingerprints``: distinct, in Gray order."""

    def __init__(self, fingerprints: np.ndarray):
        self.fingerprints = np.asarray(fingerprints, np.uint64)
        agreed = [(np.full(len(self.fingerprints), ~np.uint64(0)), self.fingerprints)]
        while len(agreed[-1][0]) > FAN:
            mask, bits = agreed[-1]
            firsts = np.arange(0, len(mask), FAN)
            all_and = np.bitwise_and.reduceat(bits, firsts)
            all_or = np.bitwise_or.reduceat(bits, firsts)
            both = np.bitwise_and.reduceat(mask, firsts)
            same = both & (all_and | ~all_or)
            agreed.append((same, all_and & same))
        self.levels = []  # from the top; what a parent settled is taken out below
        above = np.zeros(0, np.uint64)
        for mask, bits in reversed(agreed):
            parent = np.arange(len(mask)) // FAN
            settled = above[parent] if len(above) else np.zeros(len(mask), np.uint64)
            own = mask & ~settled
            self.levels.append((own, bits & own))
            above = mask

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, fingerprint number) at most ``radius`` bits apart, in slices."""
        top = len(self.levels[0][0])
        step = max(1, SLICE // max(top, 1))
        for low in range(0, len(queries), step):
            q = np.repeat(np.arange(low, min(low + step, len(queries))), top)
            yield from self._down(queries, q, np.tile(np.arange(top), len(q) // top), np.zeros(len(q), np.uint8), 0, radius)

    def _down(self, queries, q, node, apart, level, radius):
        mask, bits = self.levels[level]
        apart = apart + np.bitwise_count((queries[q] & mask[node]) ^ bits[node])
        near = apart <= radius
        q, node, apart = q[near], node[near], apart[near]
        if level + 1 == len(self.levels):
            if len(q):
                yield q, node
            return
        width = len(self.levels[level + 1][0])
        for low in range(0, len(q), SLICE // FAN):
            some = slice(low, low + SLICE // FAN)
            child = (node[some][:, None] * FAN + np.arange(FAN)).ravel()
            there = child < width
            yield from self._down(
                queries, np.repeat(q[some], FAN)[there], child[there], np.repeat(apart[some], FAN)[there], level + 1, radius
            )


def spanning_links(fingerprints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smallest) which join the same groups as all links within ``radius``.

    ``fingerprints``: distinct.  A group of any density gives one link a member.
    """
    order = np.argsort(gray_rank(fingerprints), kind="stable")
    ordered = np.asarray(fingerprints, np.uint64)[order]
    group = np.arange(len(ordered))  # each group named by a member, followed up to the root
    for q, other in GrayIndex(ordered).within(ordered, radius):
        later = other > q
        _unite(group, q[later], other[later])
    _flatten(group)
    smallest = np.full(len(ordered), ~np.uint64(0))
    np.minimum.at(smallest, group, ordered)
    root = smallest[group]
    linked = root != ordered
    return ordered[linked], root[linked]


def _flatten(group: np.ndarray) -> None:
    while True:
        up = group[group]
        if (up == group).all():
            return
        group[:] = up


def _unite(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hooks larger roots under smaller ones until every pair has one root."""
    _flatten(group)
    while len(a):
        ra, rb = group[a], group[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(group, np.maximum(ra, rb), np.minimum(ra, rb))
        _flatten(group)
