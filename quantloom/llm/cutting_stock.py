"""The cutting-stock problem behind packing: column generation over a length histogram, in numpy.

Master program: choose how often to use each pattern (a multiset of lengths that fits a sequence) so that every piece
is covered by the fewest sequences. Pricing: a knapsack over the master's prices, solved by dynamic programming for
all fills at once. The size of all of it depends on the sequence length alone, not on the corpus.

Lengths stand in at most CLASSES classes, each counted as its longest; which they are follows from the histogram, so that
what is lost by rounding up is the least there can be: where no more lengths than that occur, all of them count as they
are. Every sequence is priced in full: that a fill is a power of two shows in exact lengths only, and few fills are.
"""

from __future__ import annotations

import numpy as np


#: Classes of lengths: more of them round less, and make the program larger and more degenerate.
CLASSES = 96


def fill_cost(fill: int, capacity: int) -> int:
    """Padded length of a sequence: its fill if that is a power of two, else the capacity."""
    return fill if fill & (fill - 1) == 0 else capacity


def class_edges(histogram: dict[int, int], classes: int = CLASSES) -> list[int]:
    """The longest length of each class: the cut of the lengths of ``histogram`` into at most so many classes that rounds
    up the fewest ids in all, by dynamic programming over the last class."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), float)
    if len(lengths) <= classes:
        return [int(x) for x in lengths]
    n = np.append(0, np.cumsum([histogram[int(x)] for x in lengths])).astype(float)
    ids = np.append(0, np.cumsum([histogram[int(x)] * x for x in lengths]))
    d = len(lengths)
    # loss[i, j]: ids added if lengths i to j, both included, count as length j
    loss = np.where(np.arange(d)[:, None] <= np.arange(d), lengths * (n[None, 1:] - n[:-1, None]) - (ids[None, 1:] - ids[:-1, None]), np.inf)
    least, firsts = loss[0].copy(), []
    for _ in range(classes - 1):
        total = np.append(0.0, least)[:-1, None] + loss  # classes before i, then one from i to j
        firsts.append(total.argmin(axis=0))
        least = np.minimum(total.min(axis=0), least)
    edges, j = [], d - 1
    for first in reversed(firsts):
        if j < 0:
            break
        edges.append(int(lengths[j]))
        j = int(first[j]) - 1
    if j >= 0:
        edges.append(int(lengths[j]))
    return edges[::-1]


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the highest sum of prices of lengths that add up to exactly c; last[c]: index of one length in it."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0
    last = np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = ends[c]
        if k:
            value = best[c - lengths[:k]] + prices[:k]
            i = int(np.argmax(value))
            if value[i] > best[c]:
                best[c], last[c] = value[i], i
    return best, last


def _pattern(last: np.ndarray, lengths: np.ndarray, c: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while c > 0:
        i = int(last[c])
        out[i] = out.get(i, 0) + 1
        c -= int(lengths[i])
    return out


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 4000) -> list[tuple[dict[int, int], float]]:
    """Patterns ({index of length: count}) with the fractional times each is used, by revised simplex.

    Ends when the master's value is within ``gap`` of the lower bound that pricing gives, or after ``rounds`` pivots:
    any stage of the simplex is a feasible plan, so stopping early costs padding, never a piece.
    """
    m = len(lengths)
    times = np.maximum(1, capacity // lengths)
    basis: list[dict[int, int]] = [{i: int(times[i])} for i in range(m)]
    cost = np.ones(m)
    inverse = np.diag(1.0 / times)
    x = inverse @ demand
    jitter = 1 + 1e-9 * np.arange(m)  # breaks ties between rows, so that degenerate pivots cannot cycle
    for _ in range(rounds):
        best, last = knapsack(cost @ inverse, lengths, capacity)
        fill = int(np.argmax(best))
        if best[fill] <= 1 + gap:  # prices / best are feasible for the dual: a lower bound
            break
        pattern = _pattern(last, lengths, fill)
        direction = sum(inverse[:, i] * n for i, n in pattern.items())
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1) * jitter, np.inf)
        row = int(np.argmin(ratio))
        if not np.isfinite(ratio[row]):
            break
        inverse[row] /= direction[row]
        x_row = x[row] / direction[row]
        direction[row] = 0
        inverse -= np.outer(direction, inverse[row])
        x -= direction * x_row
        x[row] = x_row
        basis[row] = pattern
    return [(p, float(v)) for p, v in zip(basis, x, strict=True) if v > 1e-9]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: count}) with whole times of use that hold exactly the histogram's pieces.

    Fractional uses are rounded down; what is left (at most a pattern's worth for each length) is packed best-fit,
    longest first. Every pattern's count is exact: no sequence holds a gap.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    done: list[tuple[dict[int, int], int]] = []
    if left.get(capacity):
        done.append(({capacity: 1}, left.pop(capacity)))
    if left:
        lengths = np.array(sorted(left))
        demand = np.array([left[int(k)] for k in lengths], float)
        for pattern, times in sorted(column_generation(lengths, demand, capacity), key=lambda p: -p[1]):
            whole = min(int(times + 1e-6), *(left[int(lengths[i])] // n for i, n in pattern.items()))
            if whole > 0:
                done.append(({int(lengths[i]): n for i, n in pattern.items()}, whole))
                for i, n in pattern.items():
                    left[int(lengths[i])] -= n * whole
    room: dict[int, list[dict[int, int]]] = {}
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            space = min((s for s in room if s >= length and room[s]), default=None)
            held = room[space].pop() if space is not None else {}
            held[length] = held.get(length, 0) + 1
            room.setdefault((capacity if space is None else space) - length, []).append(held)
    done += [(held, 1) for held in sum(room.values(), [])]
    return done
