"""Context-tree weighting with byte contexts and binary-decomposed bytes, in numpy.

A byte is eight binary decisions; each decision has its node (1 to 255, the bits so far behind a leading one). For every
node there is a tree over contexts, the bytes before it, most recent first. Each context holds counts (a, b) of zeros
and ones; the Krichevsky-Trofimov probability of its sequence depends on these counts alone. The weighted probability of
a context is the mean of that and of the product over its children, the contexts of one more byte; what went to
children that are not kept is one more child, without children of its own. A kept tree gives, for each decision, the
mixture over all depths that this weighting implies.
"""

from __future__ import annotations

import math

import numpy as np

#: Bytes of context at most. A context of d bytes is packed in the low 8*d bits, the most recent byte lowest; a class,
#: which keeps trees apart, stands above all of them.
DEPTH, CLASS_AT = 5, 40
_HALF = math.log(0.5)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive numbers (Stirling's series after shifting the argument to 8 or more)."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z / 1260)) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Table:
    """An open-addressing map from distinct non-zero 64-bit keys to row numbers, in two arrays."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(len(keys) * 2).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)
        self.rows = np.full(size, -1, np.int32)
        at, left = _mix(keys) & self.mask, np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = keys[left[free]]
            won = self.keys[at[left]] == keys[left]
            self.rows[at[left[won]]] = left[won]
            left = left[~won]
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for those that are not there."""
        at = _mix(keys) & self.mask
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            got = self.keys[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (got != 0)]
            at[left] = (at[left] + np.uint64(1)) & self.mask
        return out


def context_key(depth: int | np.ndarray, context: np.ndarray) -> np.ndarray:
    """One word for a context and its depth (at most 7 bytes of context)."""
    return (np.asarray(depth, np.uint64) + np.uint64(1)) << np.uint64(56) | context.astype(np.uint64)


def mask(depth: int) -> int:
    """The bits of a context of ``depth`` bytes and of its class."""
    return (1 << (8 * depth)) - 1 | 0xFF << CLASS_AT


class ContextTree:
    """Frozen trees, one for each class. ``rows`` are (depth, context, next byte, count) of the kept contexts; every kept context's parent
    is kept, and the root of a class (depth 0) holds all its counts."""

    def __init__(self, depth: np.ndarray, context: np.ndarray, byte: np.ndarray, count: np.ndarray, most: int = DEPTH):
        self.most = most
        key = context_key(depth, context)
        names, who = np.unique(key, return_inverse=True)
        order = np.argsort(names, kind="stable")  # by depth, as the depth stands in the upper bits
        assert (order == np.arange(len(names))).all()
        depths = (names >> np.uint64(56)).astype(np.int64) - 1
        contexts = names & np.uint64((1 << 56) - 1)
        parent = np.full(len(names), -1)
        self.contexts = Table(names)
        deep = depths > 0
        cut = contexts & np.array([mask(max(d - 1, 0)) for d in range(most + 1)], np.uint64)[depths]
        parent[deep] = self.contexts.find(context_key(depths[deep] - 1, cut[deep]))
        # binary nodes: key (context number, node) of 8 decisions for each (context, byte)
        bits = (byte[:, None].astype(np.int64) >> np.arange(7, -1, -1)) & 1
        node = (1 << np.arange(8)) | (byte[:, None].astype(np.int64) >> np.arange(8, 0, -1))
        where = (who[:, None].astype(np.int64) * 256 + node).ravel()
        cells, cell = np.unique(where, return_inverse=True)
        weight = np.repeat(count.astype(np.float64), 8)
        ones = np.bincount(cell, weight * bits.ravel(), len(cells))
        zeros = np.bincount(cell, weight * (1 - bits.ravel()), len(cells))
        of, at_node = cells // 256, cells % 256
        up = np.full(len(cells), -1)
        has = parent[of] >= 0
        up[has] = np.searchsorted(cells, parent[of[has]] * 256 + at_node[has])
        # what kept children hold, and the log of the product of their weighted probabilities
        child_zeros, child_ones, below = np.zeros(len(cells)), np.zeros(len(cells)), np.zeros(len(cells))
        own = log_kt(zeros, ones)
        stop = np.ones(len(cells))  # posterior weight of stopping at this context
        rest = np.stack([zeros, ones], 1)
        for d in range(int(depths.max(initial=0)), -1, -1):
            here = np.flatnonzero(depths[of] == d)
            weighted = own[here].copy()
            inner = (child_zeros[here] + child_ones[here]) > 0
            i = here[inner]
            rest[i] = np.stack([zeros[i] - child_zeros[i], ones[i] - child_ones[i]], 1)
            under = below[i] + log_kt(rest[i, 0], rest[i, 1])
            both = np.logaddexp(own[i], under) + _HALF
            stop[i] = np.exp(own[i] + _HALF - both)
            weighted[inner] = both
            if d:
                np.add.at(child_zeros, up[here], zeros[here])
                np.add.at(child_ones, up[here], ones[here])
                np.add.at(below, up[here], weighted)
        self.own = ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32)
        self.rest = ((rest[:, 1] + 0.5) / (rest.sum(1) + 1)).astype(np.float32)
        self.stop = stop.astype(np.float32)
        self.cells = Table(cells.astype(np.uint64) + np.uint64(1))

    def log2(self, context: np.ndarray, length: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """log2 of the probability of each byte after its context of ``length`` bytes (the tree's depth at most)."""
        n = len(byte)
        path = np.full((self.most + 1, n), -1, np.int64)
        going = np.arange(n)
        for d in range(self.most + 1):
            going = going[length[going] >= d]
            if not len(going):
                break
            cut = context[going] & np.uint64(mask(d))
            path[d, going] = self.contexts.find(context_key(d, cut))
            going = going[path[d, going] >= 0]
        total = np.zeros(n)
        node = np.ones(n, np.int64)
        for k in range(7, -1, -1):
            bit = (byte.astype(np.int64) >> k) & 1
            p = np.full(n, 0.5)  # no counts at all
            met = np.zeros(n, bool)  # a child without counts at this node is no child here
            for d in range(self.most, -1, -1):
                at = np.flatnonzero(path[d] >= 0)
                if not len(at):
                    continue
                cell = self.cells.find((path[d, at] * 256 + node[at]).astype(np.uint64) + np.uint64(1))
                at, cell = at[cell >= 0], cell[cell >= 0]
                under = np.where(met[at], p[at], self.rest[cell])
                met[at] = True
                p[at] = self.stop[cell] * self.own[cell] + (1 - self.stop[cell]) * under
            total += np.log2(np.where(bit == 1, p, 1 - p))
            node = node * 2 + bit
        return total


def positions(words: list[bytes], most: int = DEPTH, end: int = 32, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number, context, context length, byte) of every byte of every word and of the end after it.

    A context reaches back to the start of the word: the end byte of the word before it, and no further. ``classes`` are
    numbers under 256, one for each word.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    e = bytes([end])
    raw = np.frombuffer(e + e.join(words) + e, np.uint8) if words else np.zeros(1, np.uint8)
    who = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(who)) - np.repeat(sizes.cumsum() - sizes, sizes)
    length = np.minimum(place + 1, most)
    context = np.zeros(len(who), np.uint64)
    for d in range(most):
        ok = length > d
        context[ok] |= raw[np.flatnonzero(ok) - d].astype(np.uint64) << np.uint64(8 * d)
    if classes is not None:
        context |= classes.astype(np.uint64)[who] << np.uint64(CLASS_AT)
    return who, context, length, raw[1:]


def grams(streams: list[bytes], most: int = DEPTH, end: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of every byte, first key, number of keys of each stream): a key is the ``most`` bytes before a byte and the
    byte itself, the first highest. Before a stream stand ``most`` end bytes, so every context has its full length."""
    pad = bytes([end]) * most
    raw = np.frombuffer(b"".join([x for s in streams for x in (pad, s)]), np.uint8)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    if not len(raw):
        return np.zeros(0, np.uint64), sizes, sizes
    keys = np.zeros(len(raw) - most, np.uint64)
    for d in range(most + 1):
        keys = keys << np.uint64(8) | raw[d : d + len(keys)]
    inside = np.ones(len(keys), bool)
    ends = (sizes + most).cumsum() - most  # where the keys of a stream end that would read the next one's end bytes
    for d in range(most):
        inside[(ends + d)[ends + d < len(keys)]] = False
    return keys[inside], sizes.cumsum() - sizes, sizes


class Level:
    """Binary cells of the contexts of one depth: names (context above node), counts, and what the weighting makes of
    them. Cells without counts belong to bytes that are scored but were never met in training."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, least: int):
        self.names, self.zeros, self.ones = names, zeros, ones
        whole = np.searchsorted(names, names & ~np.uint64(255) | np.uint64(1))  # node 1 holds the context's count
        self.kept = (zeros + ones)[whole] >= least
        self.there = self.kept & (zeros + ones > 0)

    def weigh(self, child_zeros: np.ndarray, child_ones: np.ndarray, below: np.ndarray) -> None:
        """The weighting, from what the kept contexts of one more byte hold and the log of their product."""
        own = log_kt(self.zeros, self.ones)
        rest = self.zeros - child_zeros, self.ones - child_ones
        inner = child_zeros + child_ones > 0
        both = np.logaddexp(own, below + log_kt(*rest)) + _HALF
        self.weighted = np.where(inner, both, own)
        self.stop = np.where(inner, np.exp(np.minimum(own + _HALF - both, 0)), 1.0)
        self.own = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        self.rest = (rest[1] + 0.5) / (rest[0] + rest[1] + 1)

    def upward(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and logs of the kept cells, summed over the cells of one byte less (numbers ``at``)."""
        k = self.kept
        return tuple(np.bincount(at[k], x[k], n).astype(np.float64, copy=False) for x in (self.zeros, self.ones, self.weighted))  # of nothing: integers

    def mix(self, before: np.ndarray, share: np.ndarray, best: np.ndarray) -> None:
        """The mixture down to here: ``before`` what shallower contexts give and ``share`` what they leave, ``best`` the
        mixture of the parent, which holds where this cell is not there."""
        self.best = np.where(self.there, before + share * (self.stop * self.own + (1 - self.stop) * self.rest), best)
        self.before, self.share = before + share * self.stop * self.own, share * (1 - self.stop)


def shorter(names: np.ndarray, depth: int) -> np.ndarray:
    """Cell names with their contexts cut to ``depth`` bytes."""
    return names & np.uint64((1 << 8 * (depth + 1)) - 1)


def _merge(names: np.ndarray, *values: np.ndarray) -> tuple:
    names, at = np.unique(names, return_inverse=True)
    return names, at, *(np.bincount(at, v, len(names)).astype(np.float64, copy=False) for v in values)


class Branches:
    """The contexts of over ``stem`` bytes of all keys whose contexts end in some set of stems: a part of the tree that
    needs nothing from other parts but what the levels up to ``stem`` bytes say."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, least: int, stem: int, most: int = DEPTH):
        byte = keys & np.uint64(255)
        node = np.uint64(1) << np.arange(8, dtype=np.uint64) | byte[:, None] >> np.arange(8, 0, -1).astype(np.uint64)
        one = (byte[:, None] >> np.arange(7, -1, -1).astype(np.uint64) & np.uint64(1)).ravel().astype(np.float64)
        self.bit, n = one, np.repeat(counts.astype(np.float64), 8)
        names, self.at, zeros, ones = _merge((keys[:, None] & ~np.uint64(255) | node).ravel(), n * (1 - one), n * one)
        self.levels, self.up = [Level(names, zeros, ones, least)], []
        for d in range(most - 1, stem - 1, -1):
            names, at, zeros, ones = _merge(shorter(names, d), zeros, ones)
            self.up.append(at)
            self.levels.append(Level(names, zeros, ones, least))
        none = np.zeros(len(self.levels[0].names))
        self.sums = none, none, none
        for level, at, above in zip(self.levels, self.up, self.levels[1:]):
            level.weigh(*self.sums)
            self.sums = level.upward(at, len(above.names))

    def bits(self, top: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Code length of each key, given the cells of ``stem`` bytes: names, before, share, best."""
        where = np.searchsorted(top[0], self.levels[-1].names)
        before, share, best = (x[where] for x in top[1:])
        for level, at in zip(self.levels[-2::-1], self.up[::-1]):
            level.mix(before[at], share[at], best[at])
            before, share, best = level.before, level.share, level.best
        p = best[self.at]
        return -np.log2(np.where(self.bit == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)


def trunk(names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, sums: tuple, least: int, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, before, share, best) of the cells of ``stem`` bytes, sorted by name, from what all branches sum to."""
    levels, ups = [Level(names, zeros, ones, least)], []
    for d in range(stem - 1, -1, -1):
        names, at, zeros, ones = _merge(shorter(names, d), zeros, ones)
        ups.append(at)
        levels.append(Level(names, zeros, ones, least if d else 0))
    for i, level in enumerate(levels):
        level.weigh(*sums)
        if i < len(ups):
            sums = level.upward(ups[i], len(levels[i + 1].names))
    n = len(levels[-1].names)
    before, share, best = np.zeros(n), np.ones(n), np.full(n, 0.5)  # no counts at all: a half
    levels[-1].mix(before, share, best)
    for level, above, at in zip(levels[-2::-1], levels[:0:-1], ups[::-1]):
        level.mix(above.before[at], above.share[at], above.best[at])
    return levels[0].names, levels[0].before, levels[0].share, levels[0].best
