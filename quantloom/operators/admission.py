"""Admission of diverse candidates (GA08): a graph of conflicts, and the best-first independent set in it.

Two candidates conflict where they use much the same features or where their returns move together. Taken one by one from
the best, each is admitted if it conflicts with none admitted before. The same set comes out of rounds over whole tables: in
each round all go in that no better undecided candidate stands against, and those that conflict with them go out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.sources.staging import staged

#: Shares of features, and correlations, above which two candidates conflict.
MOST_OVERLAP, MOST_CORRELATION = 0.5, 0.75


def overlap_conflicts(features: DataFrame, most: float = MOST_OVERLAP) -> DataFrame:
    """(a, b, overlap), a < b: pairs of ids whose feature sets have a Jaccard similarity over ``most``. ``features`` has id
    and feature, repeats count once.

    Sets are ordered by rarity. Two sets that similar share a feature among the first of each, as many as the similarity
    leaves room for, so only those are joined, and a feature that all have joins no one. The pairs found are compared whole.
    """
    rows = features.select("id", "feature").where("feature is not null").distinct()
    counted = rows.join(rows.groupBy("feature").agg(F.count("*").alias("_uses")), "feature")
    rarest = Window.partitionBy("id").orderBy("_uses", "feature")
    placed = counted.withColumns({"_place": F.row_number().over(rarest), "_size": F.count("*").over(Window.partitionBy("id"))})
    first = placed.where(F.col("_place") <= F.col("_size") - F.ceil(F.col("_size") * most) + 1)
    left, right = first.select(F.col("id").alias("a"), "feature"), first.select(F.col("id").alias("b"), "feature")
    pairs = left.join(right, "feature").where("a < b").select("a", "b").distinct()
    sets = rows.groupBy("id").agg(F.collect_set("feature").alias("s"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("overlap")).where(F.col("overlap") > most)


def correlations(returns: DataFrame) -> DataFrame:
    """(a, b, corr), a < b, of every two ids' values over all times of the table; a missing or null value is 0, a constant
    series correlates with none. ``returns`` has id, time and value, one row for each.

    The times are dealt out; each task multiplies its part of the matrix of values by itself, and the products, one row a
    pair and task, are summed. Candidates are a few thousand at most: a task holds a square of them.
    """
    ids = [r.id for r in returns.select("id").distinct().orderBy("id").collect()]  # a few thousand names
    place = {x: k for k, x in enumerate(ids)}
    at = returns.groupBy("time").agg(F.collect_list(F.struct("id", "value")).alias("v"))

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, moments, times = len(ids), np.zeros(len(ids)), np.zeros((len(ids), len(ids))), 0
        for frame in frames:
            x = np.zeros((len(frame), n))
            for k, values in enumerate(frame["v"]):
                for v in values:
                    if v["value"] is not None and v["value"] == v["value"]:
                        x[k, place[v["id"]]] = v["value"]
            total, moments, times = total + x.sum(axis=0), moments + x.T @ x, times + len(frame)
        i, j = np.triu_indices(n)
        if times:
            yield pd.DataFrame({"i": i, "j": j, "xy": moments[i, j], "x": total[i], "y": total[j], "n": times})

    sums = at.mapInPandas(products, "i int, j int, xy double, x double, y double, n long").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])
    cov = sums.select("i", "j", (F.col("xy") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n")).alias("c"))
    own = cov.where("i = j").select(F.col("i").alias("k"), F.sqrt(F.when(F.col("c") > 0, F.col("c"))).alias("s"))
    both = cov.where("i < j").join(own.select(F.col("k").alias("i"), F.col("s").alias("si")), "i").join(own.select(F.col("k").alias("j"), F.col("s").alias("sj")), "j")
    names = F.array(*[F.lit(x) for x in ids]) if ids else F.array().cast("array<string>")
    return both.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.coalesce(F.col("c") / F.nullif(F.col("si") * F.col("sj"), F.lit(0.0)), F.lit(0.0)).alias("corr"))


def best_first(candidates: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, score, admitted, rival): the best-first independent set of ``candidates`` (id, score) in the graph of
    ``conflicts`` (a, b), as if they were taken one by one by falling score (nulls last), then id.

    ``rival``: the best admitted candidate that one left out conflicts with. Every round decides all that no better
    undecided one stands against; the best undecided is always among them, so the rounds end, after few where scores and
    conflicts are unrelated.
    """
    order = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("less"), F.col("id").alias("id"))
    nodes = staged(candidates.select("id", "score").withColumn("o", order), "candidates")
    names = nodes.select("id", "o")
    edges = conflicts.select("a", "b").where("a <> b").distinct()
    edges = edges.join(names.select(F.col("id").alias("a"), F.col("o").alias("oa")), "a").join(names.select(F.col("id").alias("b"), F.col("o").alias("ob")), "b")
    up = F.col("oa") < F.col("ob")
    edges = staged(edges.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("worse")).distinct(), "conflicts")
    open_, left, taken = names.select("id"), edges, []
    while not open_.isEmpty():
        now = staged(open_.join(left.select(F.col("worse").alias("id")).distinct(), "id", "left_anti"), "admitted")
        taken.append(now)
        gone = left.join(now.select(F.col("id").alias("better")), "better", "left_semi").select(F.col("worse").alias("id")).distinct()
        open_ = staged(open_.join(now, "id", "left_anti").join(gone, "id", "left_anti"), "undecided")
        left = staged(left.join(open_.select(F.col("id").alias("better")), "better", "left_semi").join(open_.select(F.col("id").alias("worse")), "worse", "left_semi"), "conflicts")
    admitted = taken[0] if taken else names.select("id")
    for t in taken[1:]:
        admitted = admitted.unionByName(t)
    admitted = admitted.withColumn("admitted", F.lit(True))
    against = edges.join(admitted.select(F.col("id").alias("better")), "better", "left_semi").join(names.select(F.col("id").alias("better"), "o"), "better")
    rivals = against.groupBy(F.col("worse").alias("id")).agg(F.min_by("better", "o").alias("rival"))
    return nodes.select("id", "score").join(admitted, "id", "left").join(rivals, "id", "left").select("id", "score", F.coalesce("admitted", F.lit(False)).alias("admitted"), "rival")


def admission(candidates: DataFrame, features: DataFrame, returns: DataFrame, most_overlap: float = MOST_OVERLAP, most_correlation: float = MOST_CORRELATION) -> DataFrame:
    """``best_first`` among candidates that conflict by their features or their returns (GA08). Where ``score`` is the least
    Sortino ratio over the parts, a better newcomer takes the place of one admitted earlier."""
    alike = overlap_conflicts(features, most_overlap).select("a", "b")
    together = correlations(returns).where(F.col("corr") > most_correlation).select("a", "b")
    return best_first(candidates, alike.unionByName(together))
