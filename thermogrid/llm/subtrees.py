"""Suffix subtrees of a group of texts: sorted suffixes, the lengths of their common prefixes, and the deep nodes over them.

The words of all texts stand one after another.  Prefix doubling gives every place an integer for its next 1, 2, 4, ...
words, in the order of those words.  A suffix of at least ``size`` words is a leaf; leaves that agree in ``size`` words are
below one internal node of that depth or more, so only these are sorted on.  Neighbours' common prefixes are found by
comparing integers of halving widths, and the smallest of a node's is the node's depth: the length of the repeat that all
its leaves share, which is maximal to the right.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Nodes:
    """Leaves (places of words) in sorted order; each node's first leaf in that order, and its depth in words."""

    leaves: np.ndarray
    begin: np.ndarray
    depth: np.ndarray
    common: np.ndarray  # of each leaf with the one before it, 0 for the first of a node

    def each(self) -> np.ndarray:
        """How many leaves each node has."""
        return np.diff(np.append(self.begin, len(self.leaves)))


def doubled(h: np.ndarray, most: int) -> list[np.ndarray]:
    """For widths 1, 2, 4, ... up to ``most``: a rank for the words at each place, in their order, equal where they are."""
    ranks, width = [np.unique(h, return_inverse=True)[1].astype(np.int64)], 1
    while width * 2 <= min(most, len(h)):
        last = ranks[-1]
        ranks.append(np.unique(last[: len(last) - width] * np.int64(len(h) + 1) + last[width:], return_inverse=True)[1].astype(np.int64))
        width *= 2
    return ranks


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many words two places have in common, at most ``room``."""
    out = np.zeros(len(a), np.int64)
    # the widest step is taken as often as the longest text can need it
    widths = [len(ranks) - 1] * (int(room.max()) // (1 << len(ranks) - 1) + 1 if len(room) else 0) + list(range(len(ranks) - 2, -1, -1))
    for k in widths:
        rank, width = ranks[k], 1 << k
        last = len(rank) - 1
        step = (out + width <= room) & (rank[np.minimum(a + out, last)] == rank[np.minimum(b + out, last)])
        out += width * step
    return out


def deep_nodes(h: np.ndarray, room: np.ndarray, size: int) -> Nodes:
    """The topmost internal nodes of depth ``size`` or more, over the words ``h`` of which ``room`` are left in their text from each place on."""
    none = np.zeros(0, np.int64)
    leaves = np.flatnonzero(room >= size)
    if not len(leaves):
        return Nodes(none, none, none, none)
    ranks = doubled(h, size)
    width = 1 << len(ranks) - 1
    pair = ranks[-1][leaves] * np.int64(len(h) + 1) + ranks[-1][leaves + size - width]
    _, name, times = np.unique(pair, return_inverse=True, return_counts=True)
    some = times[name] > 1  # a leaf without a companion has no such node above it
    leaves, name = leaves[some], name[some]
    if not len(leaves):
        return Nodes(none, none, none, none)
    # within a node, leaves go by the words behind the first ``size``, as far as those stand in their text
    beyond = np.minimum(room[leaves] - size, width)
    after = np.minimum(leaves + size, len(ranks[-1]) - 1)
    order = np.lexsort((leaves, np.where(beyond >= width, ranks[-1][after], -1), np.where(beyond >= 1, ranks[0][np.minimum(leaves + size, len(h) - 1)], -1), name))
    leaves, name = leaves[order], name[order]
    first = np.ones(len(leaves), bool)
    first[1:] = name[1:] != name[:-1]
    begin = np.flatnonzero(first)
    common = np.zeros(len(leaves), np.int64)
    other = np.flatnonzero(~first)
    common[other] = common_prefix(ranks, leaves[other - 1], leaves[other], np.minimum(room[leaves[other - 1]], room[leaves[other]]))
    depth = np.minimum.reduceat(np.where(first, np.iinfo(np.int64).max, common), begin)
    return Nodes(leaves, begin, depth, common)
