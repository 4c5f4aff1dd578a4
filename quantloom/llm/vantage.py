"""Vantage-point partitioning of 64-bit fingerprints under Hamming distance, in numpy.

A node holds a vantage fingerprint v and a radius r. Points within r of v go inside, others outside. Two points within
``reach`` of each other that are parted have the inner one at more than r - reach from v (triangle bound), so such
inner points go outside as well: every pair then meets in at least one leaf. The same rule routes points to shards
(the upper nodes, fitted on a bounded sample) and joins the pairs inside a shard.
"""

from __future__ import annotations

import numpy as np

#: Up to so many points are compared pair by pair.
LEAF = 384
Tree = tuple | int


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def _radius(d: np.ndarray, reach: int) -> int | None:
    """The radius that gives the smaller larger side, counting the points that go to both; None if none parts them."""
    counts = np.bincount(d, minlength=65).cumsum()
    r = np.arange(65)
    inside = counts[r]
    outside = counts[-1] - np.where(r - reach >= 0, counts[np.maximum(r - reach, 0)], 0)
    worst = np.maximum(inside, outside)
    best = int(np.argmin(worst))
    return best if worst[best] <= 0.9 * len(d) else None


def fit(sample: np.ndarray, shards: int, reach: int) -> tuple[Tree, int]:
    """A tree with at most ``shards`` leaves (numbered from 0) from a sample of distinct fingerprints, and their count."""
    leaves = [sample]
    tree: list = [0]
    where: list[tuple[list, int]] = [(tree, 0)]
    stuck: set[int] = set()
    while len(leaves) < shards and len(stuck) < len(leaves):
        at = max((i for i in range(len(leaves)) if i not in stuck), key=lambda i: len(leaves[i]))
        points = leaves[at]
        d = distances(points, points[0]) if len(points) > 1 else None
        r = None if d is None else _radius(d, reach)
        if r is None:
            stuck.add(at)
            continue
        holder, slot = where[at]
        node: list = [int(points[0]), r, at, len(leaves)]
        holder[slot] = node
        where[at] = (node, 2)
        where.append((node, 3))
        leaves[at] = points[d <= r]
        leaves.append(points[d > r - reach])
    return tree[0], len(leaves)


def route(tree: Tree, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, shard) for every shard a point belongs to."""
    found: list[tuple[np.ndarray, int]] = []
    waiting = [(tree, np.arange(len(points)))]
    while waiting:
        node, at = waiting.pop()
        if isinstance(node, int):
            found.append((at, node))
            continue
        v, r, inside, outside = node
        d = distances(points[at], np.uint64(v))
        waiting += [(inside, at[d <= r]), (outside, at[d > r - reach])]
    return np.concatenate([a for a, _ in found]), np.concatenate([np.full(len(a), s) for a, s in found])


class Union:
    """Disjoint sets over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join many pairs: hook larger roots onto smaller ones until all pairs agree."""
        up = self.up
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        while True:
            y = up[x]
            if (y == x).all():
                return x
            x = up[y]


def _close_pairs(points: np.ndarray, at: np.ndarray, reach: int, sets: Union) -> None:
    p = points[at]
    for i in range(0, len(p), 512):
        a, b = np.nonzero(np.bitwise_count(p[i : i + 512, None] ^ p[None, :]) <= reach)
        keep = a + i < b
        if keep.any():
            sets.link(at[a[keep] + i], at[b[keep]])


def _by_midpoints(points: np.ndarray, at: np.ndarray, sets: Union) -> None:
    """All pairs within 2 bits among points that no vantage parts: such a pair shares a point at one bit or less."""
    p = points[at]
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    keys = (p[:, None] ^ flips[None, :]).ravel()
    who = np.repeat(at, len(flips))
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    same = keys[1:] == keys[:-1]
    sets.link(who[1:][same], who[:-1][same])


def link_close(points: np.ndarray, reach: int = 2) -> np.ndarray:
    """For distinct points, the index of the smallest-index point each is linked to by steps of at most ``reach``."""
    sets = Union(len(points))
    waiting = [np.arange(len(points))]
    while waiting:
        at = waiting.pop()
        if len(at) <= LEAF:
            if len(at) > 1:
                _close_pairs(points, at, reach, sets)
            continue
        d = distances(points[at], points[at[0]])
        r = _radius(d, reach)
        if r is None:
            d = distances(points[at], points[at[int(np.argmax(d))]])  # a far point parts what a central one does not
            r = _radius(d, reach)
        if r is not None:
            waiting += [at[d <= r], at[d > r - reach]]
        elif reach == 2 and len(at) > 4096:
            _by_midpoints(points, at, sets)
        else:
            _close_pairs(points, at, reach, sets)
    return sets.roots(np.arange(len(points)))
