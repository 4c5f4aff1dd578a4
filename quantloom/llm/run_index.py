"""A run-length index of a repetitive byte collection, in numpy.

The collection's Burrows-Wheeler transform is stored by runs: heads, lengths, and at both ends of every run the text
position and the length of the match with the neighbouring suffix. Inside a run, neighbouring suffixes are preceded by
the same byte, so the match of the suffix one to the left is one longer: the matching statistics of every position
follow from the samples at run ends, and are streamed over the text from these.
"""

from __future__ import annotations

import numpy as np


#: Suffixes that are handled at once, so that what numpy makes besides the results stays small.
BLOCK = 1 << 18


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still tied are sorted again. ``text``: integers >= 0."""
    return sorted_suffixes(text)[0]


def _differ(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each of ``values[order]`` is another one than the one before it; the first is."""
    new = np.ones(len(order), bool)
    for at in range(1, len(order), BLOCK):
        part = values[order[at - 1 : at + BLOCK]]
        new[at : at + BLOCK] = part[1:] != part[:-1]
    return new


def _first_of_group(new: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The place of the first of each one's group."""
    return np.maximum.accumulate(np.where(new, places, 0))


def sorted_suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix array, whether each suffix begins with the same ``width`` symbols as the one before it, width).

    About 20 bytes a symbol are held at once: places are 32-bit, keys are made and compared in place.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, bool), 1
    used = np.zeros(int(text.max()) + 1, bool)
    for at in range(0, n, BLOCK):
        used[text[at : at + BLOCK]] = True
    dense = used.cumsum()  # symbols that occur, from 1 on in their order: more of them fit a key
    bits = int(dense[-1]).bit_length()
    width = 62 // bits
    dense = dense.astype(np.uint16 if bits <= 16 else np.int64)
    symbols = np.concatenate([dense[text[at : at + BLOCK]] for at in range(0, n, BLOCK)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= symbols[k:]
    del symbols
    order = np.argsort(key)  # ties are told apart below, so their order is free
    new = _differ(key, order)
    del key
    order = order.astype(np.int32)
    close = ~new
    first = _first_of_group(new, np.arange(n, dtype=np.int32))
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    for at in range(0, n, BLOCK):
        rank[order[at : at + BLOCK]] = first[at : at + BLOCK]
    del first
    h = width
    last = np.empty(n, bool)
    while True:
        last[:-1], last[-1] = new[1:], True
        tied = np.flatnonzero(~(new & last)).astype(np.int32)
        if not len(tied):
            return order, close, width
        starts = np.flatnonzero(new[tied])
        edges = np.append(np.unique(starts[np.searchsorted(starts, np.arange(0, len(tied), BLOCK), side="right") - 1]), len(tied))
        for low, high in zip(edges.tolist(), edges[1:].tolist()):  # whole groups; ranks that are finer already do no harm
            part = tied[low:high]
            who = order[part]
            both = rank[who].astype(np.int64)
            both <<= 32
            both |= rank[np.minimum(who + h, n)] + 1
            by = np.argsort(both)
            start = _differ(both, by)
            who = who[by]
            order[part] = who
            new[part] = start
            rank[who] = _first_of_group(start, part)
        h *= 2


def match_lengths(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: int = 0) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, of which the first ``known`` symbols are the same; the
    text ends in a symbol of its own."""
    n = len(text)
    out = np.full(len(a), known, np.int32)
    going = np.arange(len(a), dtype=np.int32)
    stride = 16  # most matches are short
    while len(going):
        steps = np.arange(stride)
        for i in range(0, len(going), 1 << 15):
            g = going[i : i + (1 << 15)]
            x, y = a[g] + out[g], b[g] + out[g]
            same = text[np.minimum(x[:, None] + steps, n - 1)] == text[np.minimum(y[:, None] + steps, n - 1)]
            same &= (np.maximum(x, y)[:, None] + steps) < n
            out[g] += np.where(same.all(1), stride, same.argmin(1)).astype(np.int32)
            going[i : i + (1 << 15)] = np.where(same.all(1), g, -1)
        going = going[going >= 0]
        stride = 64
    return out


class RunIndex:
    """Runs of the transform (``heads``, ``lengths``) with samples at run ends: for the first suffix of each run its text
    position and match with the suffix before it, for the last one its position and match with the suffix after it.

    Matches under ``least`` symbols may be sampled as shorter ones: they are not measured where the first symbols differ.
    """

    def __init__(self, text: np.ndarray, least: int = 0):
        order, close, width = sorted_suffixes(text)
        n = len(order)
        self.n = n
        left = np.empty(n, np.int32)  # the symbol before each suffix
        for at in range(0, n, BLOCK):
            left[at : at + BLOCK] = text[order[at : at + BLOCK] - 1]
        left[order == 0] = -1  # nothing stands before the first, which is a run of its own
        edge = np.empty(n, bool)
        edge[0] = True
        edge[1:] = left[1:] != left[:-1]
        starts = np.flatnonzero(edge).astype(np.int32)
        self.heads, self.lengths = left[starts], np.diff(np.append(starts, np.int32(n)))
        del left, edge
        bounds = starts[1:]  # between two runs: the last suffix of one, the first of the next
        before, after = order[bounds - 1], order[bounds]
        match = np.zeros(len(bounds) + 1, np.int32)
        if least >= width:
            measured = np.flatnonzero(close[bounds]).astype(np.int32)
            match[measured] = match_lengths(text, before[measured], after[measured], width)
        else:
            match[:-1] = match_lengths(text, before, after)
        self.first_at, self.last_at = np.append(after, order[0]), np.append(before, order[-1])
        self.first_match = self.last_match = match

    def text(self) -> np.ndarray:
        """The indexed text again, from the runs alone (the transform loses nothing); it ends in 0."""
        left = np.repeat(self.heads, self.lengths)
        after = np.argsort(left, kind="stable")  # the row of the suffix one to the right
        out, row = np.zeros(self.n, np.int64), int(after[0])
        for i in range(self.n - 1):
            row = int(after[row])
            out[i] = left[row]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each text position the longest match of the suffix there with any other suffix, from the samples alone.

        A suffix inside a run has the match of the suffix one to its left in the text, less one: so from each sample the
        match falls by one a step until the next sample.
        """
        return np.maximum(_ramp(self.n, self.first_at, self.first_match), _ramp(self.n, self.last_at, self.last_match))


def _ramp(n: int, at: np.ndarray, match: np.ndarray) -> np.ndarray:
    """Values at sampled positions, one less with every step to the right until the next sample."""
    by = np.argsort(at)
    at = at[by]
    out = np.zeros(n, np.int32)
    out[at[0] :] = np.repeat(at + match[by], np.diff(np.append(at, np.int32(n))))
    out -= np.arange(n, dtype=np.int32)
    return np.maximum(out, 0, out=out)
