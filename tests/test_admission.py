"""Admission in rounds against the rule applied one by one."""

import random

import numpy as np
import pytest

from quantloom.operators import admission as A


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    names = [f"s{i}" for i in range(40)]
    sets = {n: {"all"} | {f"f{r.randint(0, 9)}" for _ in range(r.randint(0, 5))} for n in names[:-1]} | {names[-1]: set()}
    score = {n: r.choice([None, 0.5, 1.0, 2.0, 3.0]) for n in names}
    x = np.random.default_rng(seed).normal(size=(60, 40))
    x[:, 10:20] = x[:, :10] + 0.3 * x[:, 10:20]
    x[:, 5] = 1.0
    rows = [(n, t, None if (t + i) % 17 == 0 else float(x[t, i])) for i, n in enumerate(names) for t in range(60)]
    x[[(t, i) for t in range(60) for i in range(40) if (t + i) % 17 == 0][0]] = 0
    for t in range(60):
        for i in range(40):
            if (t + i) % 17 == 0:
                x[t, i] = 0
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.corrcoef(x.T))
    order = sorted(names, key=lambda n: (score[n] is None, -(score[n] or 0), n))
    kept, rival = [], {}
    for n in order:
        against = [k for k in kept if jaccard(sets[n], sets[k]) > 0.5 or corr[names.index(n), names.index(k)] > 0.75]
        if against:
            rival[n] = against[0]
        else:
            kept.append(n)
    got = A.admission(
        spark.createDataFrame([(n, score[n]) for n in names], "id string, score double"),
        spark.createDataFrame([(n, f) for n in names for f in sets[n]] + [(names[0], None)], "id string, feature string"),
        spark.createDataFrame(rows, "id string, time int, value double").repartition(3),
    ).collect()
    assert {g.id for g in got if g.admitted} == set(kept) and {g.id: g.rival for g in got if g.rival} == rival and len(got) == 40


def test_a_chain_is_decided_from_its_best_end(spark):
    nodes = spark.createDataFrame([(f"n{i:02}", float(-i)) for i in range(12)], "id string, score double")
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(11)], "a string, b string")
    assert sorted(r.id for r in A.best_first(nodes, edges).where("admitted").collect()) == [f"n{i:02}" for i in range(0, 12, 2)]
    assert A.best_first(nodes.limit(0), edges).count() == 0 and A.best_first(nodes, edges.limit(0)).where("admitted").count() == 12


def test_a_race_drops_stage_by_stage(spark, monkeypatch):
    """Stages see only those that the ones before left, and each drops for its own reason."""
    from quantloom.operators import evaluation, race

    figures = {  # train return and ratio, validation return and ratio, least path score, genes
        "p": (-1.0, -5.0, -1.0, -5.0, 0.2, 4), "loses": (-1.0, 2.0, 1.0, 2.0, 9.0, 1), "weak": (1.0, -0.5, 1.0, 2.0, 9.0, 1), "fades": (1.0, 2.0, -1.0, 2.0, 9.0, 1), "shaky": (1.0, 2.0, 1.0, 2.0, -0.1, 1),
        "same": (1.0, 2.0, 1.0, 2.0, 0.2, 4), "good": (1.0, 2.0, 1.0, 2.0, 0.9, 2), "best": (1.0, 2.0, 1.0, 2.0, 1.2, 3), "tie": (1.0, 2.0, 1.0, 2.0, 1.2, 3), "q": (0.0, 0.0, 0.0, 0.0, None, 1), "q1": (1.0, 1.0, 1.0, 1.0, 0.0, 0),
    }
    asked = []

    def sound(orders, split, rules, annual):
        names = sorted(r.strategy_id for r in orders.select("strategy_id").distinct().collect())
        asked.append((split, names))
        at = 0 if split == "train" else 2
        return spark.createDataFrame([("x", n, figures[n][at], figures[n][at + 1]) for n in names], "series string, strategy_id string, ret double, sortino double")

    def paths(orders, rules, annual):
        names = sorted(r.strategy_id for r in orders.select("strategy_id").distinct().collect())
        asked.append(("paths", names))
        return spark.createDataFrame([("x", n, figures[n][4]) for n in names], "series string, strategy_id string, cpcv_min double")

    monkeypatch.setattr(race, "_sound", sound)
    monkeypatch.setattr(evaluation, "path_scores", paths)
    orders = spark.createDataFrame([("x", n, 1, 0) for n in figures] + [("x", "stranger", 1, 0)], "series string, strategy_id string, bar_id long, signal int")
    members = spark.createDataFrame([(n, n if n in "pq" else "q" if n == "q1" else "p", figures[n][5]) for n in figures], "strategy_id string, parent string, genes int")
    got = {r.strategy_id: r.verdict for r in race.race(orders, members, None).collect()}
    assert got == {"p": "measured", "q": "measured", "loses": "train", "weak": "train", "fades": "val", "shaky": "paths", "same": "parent", "good": "beaten", "best": "chosen", "tie": "beaten", "q1": "chosen"}
    assert [a for a, _ in asked] == ["train", "val", "paths"] and "p" not in asked[0][1] and "loses" not in asked[1][1] and "fades" not in asked[2][1] and "p" in asked[2][1]
