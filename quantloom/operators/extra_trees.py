"""Importance of features by extremely randomised trees (FS07), over whole tables.

At every node each feature draws one threshold, evenly between the least and the greatest value that the node's rows have;
the feature whose threshold parts the target best splits the node. Trees grow level by level, all together: rows never move,
each finds its node of each tree by the splits so far, and one aggregate a level gives the ranges, another the sums on both
sides of the drawn thresholds. What comes to the driver is one row a tree and node, however large the table is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trees, levels of splits, and the seed of the draws: fixed values of the surveyed check, but for its sample.
TREES, DEPTH, SEED = 30, 5, 42
_MASK = (1 << 64) - 1


def draw(seed: int, tree: int, node: int, feature: int) -> float:
    """An even draw from [0, 1) that depends on its place alone, so that any task and any test draws the same."""
    x = (seed * 0x9E3779B97F4A7C15 + tree * 0xBF58476D1CE4E5B9 + node * 0x94D049BB133111EB + feature * 0xD6E8FEB86659FD93) & _MASK
    for k in (30, 27):
        x = ((x ^ (x >> k)) * 0xBF58476D1CE4E5B9) & _MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def _placed(rows: DataFrame, splits: list[dict[int, tuple[int, float]]], level: int) -> DataFrame:
    """``rows`` (x, y) once for each tree whose node of ``level`` they reach, with tree and node (the root is 1)."""
    trees = []
    for t, chosen in enumerate(splits):
        size = 1 << level
        feature = [chosen[n][0] if n in chosen else -1 for n in range(size)]
        cut = [chosen[n][1] if n in chosen else 0.0 for n in range(size)]
        trees.append(F.struct(F.lit(t).alias("tree"), F.lit(feature).alias("feature"), F.lit(cut).cast("array<double>").alias("cut")))

    def step(node: Column, _: Column, t: Column) -> Column:
        f = F.get(t["feature"], node)
        return F.when(f >= 0, 2 * node + (F.get(F.col("x"), f) > F.get(t["cut"], node)).cast("int")).otherwise(F.lit(0))

    dealt = rows.select("x", "y", F.explode(F.array(*trees)).alias("t"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(level)), F.lit(1), lambda n, k: step(n, k, F.col("t"))) if level else F.lit(1)
    return dealt.select(F.col("t.tree").alias("tree"), walk.cast("int").alias("node"), "x", "y").where("node > 0")


def importance(df: DataFrame, features: list[str], target: str, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """(feature, importance): the mean over trees of each feature's share in the tree's drop of squared error (FS07).

    Rows with a null or NaN in a feature or the target are left out. A node of one row, of one value of the target or at
    ``depth`` is a leaf; constant features don't split; of equal gains the feature named first wins. Without any split all
    importances are 0. All rows count: there is no sample.
    """
    values = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    rows = df.select(F.array(*values).alias("x"), F.nanvl(F.col(target).cast("double"), F.lit(None).cast("double")).alias("y"))
    rows = rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    mean = rows.agg(F.avg("y")).first()[0]
    splits: list[dict[int, tuple[int, float]]] = [{} for _ in range(trees)]
    gains = np.zeros((trees, len(features)))
    if mean is not None:
        rows = rows.withColumn("y", F.col("y") - mean)  # sums of squares lose less
        for level in range(depth):
            if not _grow(_placed(rows, splits, level), splits, gains, seed):
                break
    total = gains.sum(axis=1, keepdims=True)
    share = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).mean(axis=0)
    return df.sparkSession.createDataFrame(list(zip(features, map(float, share), strict=True)), "feature string, importance double")


def _grow(placed: DataFrame, splits: list[dict[int, tuple[int, float]]], gains: np.ndarray, seed: int) -> int:
    """Split the nodes of one level; their number."""
    count = gains.shape[1]
    at = lambda j: F.get("x", F.lit(j))
    ranges = placed.groupBy("tree", "node").agg(F.array(*[F.min(at(j)) for j in range(count)]).alias("low"), F.array(*[F.max(at(j)) for j in range(count)]).alias("high"), F.min("y").alias("a"), F.max("y").alias("b"))
    cuts: dict[tuple[int, int], list[float]] = {}
    for r in ranges.collect():  # one row a tree and node
        if r.a < r.b:
            cuts[r.tree, r.node] = [low + draw(seed, r.tree, r.node, j) * (high - low) if low < high else float("inf") for j, (low, high) in enumerate(zip(r.low, r.high, strict=True))]
    if not cuts:
        return 0
    known = F.create_map(*[v for (t, n), c in cuts.items() for v in (F.lit(t * (1 << 16) + n), F.lit(c).cast("array<double>"))])
    open_ = placed.withColumn("cut", F.try_element_at(known, F.col("tree") * (1 << 16) + F.col("node"))).where("cut is not null")
    left = [at(j) <= F.get("cut", F.lit(j)) for j in range(count)]
    sums = open_.groupBy("tree", "node").agg(
        F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"),
        F.array(*[F.count_if(c) for c in left]).alias("nl"), F.array(*[F.sum(F.when(c, F.col("y")).otherwise(0.0)) for c in left]).alias("sl"),
    )
    made = 0
    for r in sums.collect():  # one row a tree and node
        best, chosen = 0.0, -1
        for j, cut in enumerate(cuts[r.tree, r.node]):
            n, s = r.nl[j], r.sl[j]
            if cut < float("inf") and 0 < n < r.n:
                gain = s * s / n + (r.s - s) ** 2 / (r.n - n) - r.s * r.s / r.n
                if gain > best * (1 + 1e-9) + 1e-300:
                    best, chosen = gain, j
        if chosen >= 0:
            splits[r.tree][r.node] = (chosen, cuts[r.tree, r.node][chosen])
            gains[r.tree, chosen] += best
            made += 1
    return made
