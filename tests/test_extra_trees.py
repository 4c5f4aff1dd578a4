"""Extra-trees importances against trees grown one by one over plain arrays, under the same draws."""

import numpy as np
import pytest

from quantloom.operators import extra_trees as T


def plain(x, y, trees, depth, seed):
    total = np.zeros(x.shape[1])
    for t in range(trees):
        gains, open_ = np.zeros(x.shape[1]), [(1, np.arange(len(y)), 0)]
        while open_:
            node, rows, level = open_.pop()
            if level == depth or np.ptp(y[rows]) == 0:
                continue
            best, chosen, cut = 0.0, -1, 0.0
            for j in range(x.shape[1]):
                low, high = x[rows, j].min(), x[rows, j].max()
                if low < high:
                    c = low + T.draw(seed, t, node, j) * (high - low)
                    a, b = y[rows[x[rows, j] <= c]], y[rows[x[rows, j] > c]]
                    if len(a) and len(b):
                        gain = ((y[rows] - y[rows].mean()) ** 2).sum() - ((a - a.mean()) ** 2).sum() - ((b - b.mean()) ** 2).sum()
                        if gain > best * (1 + 1e-9):
                            best, chosen, cut = gain, j, c
            if chosen >= 0:
                gains[chosen] += best
                right = x[rows, chosen] > cut
                open_ += [(2 * node, rows[~right], level + 1), (2 * node + 1, rows[right], level + 1)]
        total += gains / gains.sum() if gains.sum() else 0
    return total / trees


@pytest.mark.parametrize("seed, trees, depth", [(42, 6, 4), (7, 3, 5), (1, 4, 1)])
def test_equals_plain_trees(spark, seed, trees, depth):
    r = np.random.default_rng(seed)
    x = r.normal(size=(500, 4))
    x[:, 2] = np.round(x[:, 2])
    x[:, 3] = 1.5
    y = 100 + 3 * (x[:, 0] > 0) + x[:, 2] + 0.1 * r.normal(size=500)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 5.0), (1.0, float("nan"), 1.0, 1.0, 5.0), (1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double").repartition(3)
    got = {r.feature: r.importance for r in T.importance(df, ["a", "b", "c", "d"], "y", trees, depth, seed).collect()}
    assert np.allclose([got[f] for f in "abcd"], plain(x, y, trees, depth, seed), atol=1e-9)
    assert abs(sum(got.values()) - 1) < 1e-9 and got["d"] == 0 and got["a"] > got["b"]


def test_nothing_to_split(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, y double")
    assert [r.importance for r in T.importance(df, ["a"], "y").collect()] == [0.0]
    assert [r.importance for r in T.importance(df.limit(0), ["a"], "y").collect()] == [0.0]


def test_draws_are_even():
    u = [T.draw(42, t, n, j) for t in range(20) for n in range(1, 32) for j in range(8)]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02 and len(set(u)) == len(u) and abs(np.var(u) - 1 / 12) < 0.005
