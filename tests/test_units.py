"""Operators on hand-made cases: ties, edges, gaps, barriers, splits, parsers, streams."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import frames, parsing
from quantloom.operators import asof, bars, chunks, features, portfolio, recursive, search, signals, statistics
from quantloom.operators.simulate import Rules, mutex, play, simulate
from quantloom.streaming import live

FREE = Rules(spread=0, commission=0, least_commission=0, slippage=0, lot=1, account=1, horizon=0, sl_long=1, sl_short=1, tp_long=2, tp_short=2)


def run(signal, price, rules=FREE, high=None, low=None, atr=None, hour=None, weekday=None):
    n = len(signal)
    price = np.array(price, float)
    f = lambda x, d: np.array(x if x is not None else d, float)
    return simulate(np.array(signal, float), price, f(high, price), f(low, price), f(atr, [1] * n), f(hour, [10] * n), f(weekday, [1] * n), rules)


def test_take_profit_and_stop_act_a_bar_later():
    out, trades = run([0, 1, 0, 0, 0], [10, 10, 11, 11, 11], high=[10, 10, 12.5, 11, 11])
    assert trades[0]["reason"] == "target" and trades[0]["exit"] == 3 and abs(out.sum() - 2) < 1e-12
    _, trades = run([0, 1, 0, 0], [10, 10, 10, 10], high=[10, 10, 13, 10], low=[10, 10, 8, 10])
    assert trades[0]["reason"] == "stop" and trades[0]["exit_price"] == 9


def test_time_close_reverse_and_cooldown():
    _, t = run([1, 0, 0, 0, 0], [10] * 5, Rules(**{**FREE.__dict__, "horizon": 2}))
    assert (t[0]["reason"], t[0]["exit"]) == ("time", 2)
    _, t = run([1, 0, 0, 0], [10] * 4, hour=[10, 10, 22, 10])
    assert (t[0]["reason"], t[0]["exit"]) == ("close", 2)
    out, t = run([1, 0, -1, 0], [10, 10.5, 10.2, 10.0])
    assert [x["reason"] for x in t] == ["reverse", "open"] and abs(out.sum() - (0.2 + 0.2)) < 1e-12
    _, t = run([1, 0, 1, 1, 1, 1], [10, 10, 10, 10, 10, 10], Rules(**{**FREE.__dict__, "cooldown": 3}), low=[8, 10, 10, 10, 10, 10])
    assert t[0]["reason"] == "stop" and t[1]["entry"] == 4


def test_limit_orders_fill_or_miss():
    rules = Rules(**{**FREE.__dict__, "limit": 0.5})
    assert run([1, 0, 0], [10, 10, 10], rules)[1] == []
    _, t = run([1, 0, 0], [10, 10, 10], rules, low=[9.4, 10, 10])
    assert t[0]["entry_price"] == 9.5


def test_costs_are_charged_on_changes():
    out, _ = run([1, 0, 0], [10, 10, 10], Rules(**{**FREE.__dict__, "spread": 0.01, "horizon": 1}))
    assert np.allclose(out, [-0.05, -0.05, 0])


def test_mutex_holds_one_position():
    s = np.array([[0, 0], [0, 1], [1, 0], [0, 0], [1, 0], [0, 0]], float)
    rules = Rules(**{**FREE.__dict__, "horizon": 2})
    flat = np.full(6, 10.0)
    _, owner = mutex(s, flat, flat, flat, np.ones(6), np.full(6, 10.0), np.ones(6), [rules, rules])
    assert owner.tolist() == [-1, 1, 1, 1, 0, 0]


def plain_purged_splits(n, folds, tests, embargo):
    """Row sets of each split: a fold after a test fold starts an embargo later, one before it ends an embargo sooner."""
    size, gap = n // folds, int(n * embargo)
    rows = [list(range(i * size, (i + 1) * size if i < folds - 1 else n)) for i in range(folds)]
    for chosen in combinations(range(folds), tests):
        train = []
        for i in sorted(set(range(folds)) - set(chosen)):
            part = rows[i]
            late = any(part[0] > rows[t][-1] and part[0] - rows[t][-1] <= gap + 1 for t in chosen)
            early = any(part[-1] < rows[t][0] and rows[t][0] - part[-1] <= gap + 1 for t in chosen)
            train += part[gap if late else 0 : max(0, len(part) - (gap if early else 0))]
        yield train, sorted(x for t in chosen for x in rows[t])


@pytest.mark.parametrize("n, folds, tests, embargo", [(60, 6, 2, 0.02), (103, 6, 2, 0.01), (50, 5, 2, 0.15), (40, 4, 1, 0.3), (31, 6, 3, 0.1)])
def test_purged_splits(spark, n, folds, tests, embargo):
    rows = statistics.purged_ranges(spark.createDataFrame([("a", n), ("b", n + 7)], "series string, n long"), folds, tests, embargo).where("series = 'a'").collect()
    for k, want in enumerate(plain_purged_splits(n, folds, tests, embargo)):
        for role, w in zip(("train", "test"), want):
            assert sorted(x for r in rows if (r.split, r.role) == (k, role) for x in range(r.start, r.stop)) == w


def test_labels_that_reach_into_a_test_fold_are_purged(spark):
    bars = spark.createDataFrame([("a", i, i * 3) for i in range(60)] + [("b", i, i) for i in range(7)], "series string, k0 long, bar_id long")
    got = statistics.in_purged_splits(bars, ["series"], 6, 2, 0.0, 4, span=50).where("series = 'a'").collect()
    for k, (train, test) in enumerate(plain_purged_splits(60, 6, 2, 0.0)):
        held = {x for x in train if not any(x < b and x + 4 >= b for b in test)}
        assert {r.k0 for r in got if r.split == k and r.role == "train"} == held and all(r.k == r.k0 for r in got)
        assert sorted(r.k0 for r in got if r.split == k and r.role == "test") == test


def test_selection_helpers():
    assert statistics.greedy_redundancy(["a", "b", "c"], {("a", "b"): 0.9, ("b", "c"): 0.1, ("a", "c"): -0.2}) == ["a", "c"]
    d = 1 - np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert statistics.complete_linkage(d, 0.3) == [0, 0, 1]
    assert statistics.walk_forward(1000)[0] == (440, 528)


def test_value_area_ties_go_down():
    assert recursive.value_area(np.array([1.0, 2, 3]), np.array([1.0, 4, 1]), 0.8) == (2.0, 1.0, 2.0)
    c, v = recursive.histogram(np.array([5.0, 5.0]), np.array([1.0, 2.0]), 10)
    assert c.tolist() == [5.0] and v.tolist() == [3.0]


def test_recursions():
    assert np.allclose(recursive.ewm(np.array([1.0, np.nan, 3.0]), 0.5), [1, 1, (0.25 + 3) / 1.25])
    f, s = recursive.fisher(np.array([1.0, 2, 3]), np.array([1.0, 2, 3]), 2)
    assert abs(f[1] - math.atanh(0.33)) < 1e-12 and s[2] == f[1] and s[1] == 0 and np.isnan(f[0]) and np.isnan(s[0])
    assert all(np.isnan(x).all() for x in recursive.fisher(np.ones(3), np.ones(3), 4))
    assert recursive.rs_hurst(np.arange(50.0), 30)[-1] == 0.5


def test_parsers_keep_their_golden_values(spark):
    want = {"0.3%": 0.3, "-0.2%": -0.2, "-16.3K": -16300.0, "2.48T": 2.48e12, "793B": 7.93e11, "450M": 4.5e8, "47.9": 47.9, "50.0": 50.0, "4.18|2.6": 4.18, "": None, "Tentative": None, None: None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: r.v for r in df.select("t", parsing.parse_value(F.col("t")).alias("v")).collect()}
    assert {k: None if v is None else round(v, 6) for k, v in got.items()} == want
    names = {"Core CPI m/m": "core_cpi_m_m", "NFP": "nfp", "10-y Bond Auction": "10_y_bond_auction"}
    got = spark.createDataFrame([(k,) for k in names], "t string").select("t", parsing.event_key(F.col("t")).alias("v"), parsing.impact_level(F.lit("icon icon--ff-impact-red")).alias("i"), parsing.week_start(F.lit("jul14.2025")).alias("w")).collect()
    assert {r.t: r.v for r in got} == names and got[0].i == "High" and got[0].w == dt.date(2025, 7, 14)


def test_asof_edges(spark):
    left = spark.createDataFrame([("a", i) for i in (0, 1, 5, 9)], "k string, t long")
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0), ("a", 5, 3.0), ("b", 0, 9.0), ("a", None, 7.0)], "k string, u long, v double")
    back = {r.t: (r.asof_key, r.v) for r in asof.asof_backward(left, right, "t", "u", ["k"], ["v"]).collect()}
    assert back == {0: (None, None), 1: (1, 1.0), 5: (5, 3.0), 9: (5, 3.0)}
    ahead = {r.t: (r.asof_key, r.v) for r in asof.asof_forward(left, right, "t", "u", ["k"], ["v"]).collect()}
    assert ahead == {0: (1, 1.0), 1: (1, 1.0), 5: (5, 2.0), 9: (None, None)}
    old = {r.t: r.v for r in asof.asof_backward(left, right, "t", "u", ["k"], ["v"], stale=F.col("t") - F.col("asof_key") > 3).collect()}
    assert old[9] is None and old[5] == 3.0


def test_windows_skip_nulls_and_flat_frames(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, None, float("nan"), 4.0, 4.0, 4.0])], "series string, bar_id long, x double").withColumn("x", frames.clean("x"))
    got = df.select("bar_id", frames.rolling("avg", "x", 3, 1).alias("m"), frames.rolling("avg", "x", 3).alias("full"), frames.rolling_corr("x", "x", 3).alias("c"), frames.ffill("x").alias("f")).orderBy("bar_id").collect()
    assert [r.m for r in got] == [1.0, 1.0, 1.0, 4.0, 4.0, 4.0] and [r.full for r in got] == [None] * 5 + [4.0]
    assert all(r.c is None for r in got) and got[2].f == 1.0


def test_backward_fill_reads_each_row_once(spark):
    """No frame that ends with the partition: Spark reads such a one anew for each row, which goes with the square."""
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("a", 4, 7.0), ("a", 5, None), ("b", 1, None)], "series string, bar_id long, x double")
    got = df.withColumn("y", frames.bfill("x"))
    assert {(r.series, r.bar_id): r.y for r in got.collect()} == {("a", 1): 5.0, ("a", 2): 5.0, ("a", 3): 7.0, ("a", 4): 7.0, ("a", 5): None, ("b", 1): None}
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_bars_conserve_volume_and_are_stable_under_appending(spark):
    rows = [("s", dt.datetime(2024, 1, 1, 0, 0, i), i, float(10 + i % 3), float(i % 7)) for i in range(50)]
    schema = "series string, ts timestamp_ntz, seq long, mid double, vol double"
    whole, part = bars.volume_bars(spark.createDataFrame(rows, schema), 10).toPandas(), bars.volume_bars(spark.createDataFrame(rows[:30], schema), 10).toPandas()
    assert whole.volume.sum() == sum(r[4] for r in rows)
    a, b = whole.sort_values("bar_id"), part.sort_values("bar_id")
    assert a.iloc[: len(b) - 1].close.tolist() == b.iloc[:-1].close.tolist()


def test_streamed_bars_do_not_depend_on_batches():
    rows = pd.DataFrame({"ts": range(100), "mid": np.sin(np.arange(100)), "vol": np.arange(100) % 9})
    whole, left = live.close_bars(rows, None, 20)
    parts, state = [], None
    for i in range(0, 100, 7):
        done, state = live.close_bars(rows.iloc[i : i + 7], state, 20)
        parts += done
    assert parts == whole and state == left


def test_strategy_helpers():
    g = {"type": "delta", "feature": "x", "lookback": 1}
    assert [signals.concordance(n) for n in (1, 2, 3, 4, 10)] == [1, 1, 2, 3, 6]
    assert len(signals.unique_genes([g, dict(reversed(g.items()))])) == 1
    assert signals.strategy_hash({"long_genes": [g, {"type": "time"}]}) == signals.strategy_hash({"long_genes": [{"type": "time"}, g]})


POOLS = portfolio.Pools(("ticket_imbalance", "vol_100", "vol_200"), ("regime_premium", "vol_400"), {"vol_100": (1.0, 2.0)})


def test_strategies_are_seeded_and_keep_to_the_grids():
    a, b = (portfolio.sample_strategy(portfolio.rng(5), POOLS, 60) for _ in range(2))
    assert a == b and a["long_genes"] + a["short_genes"]
    made = [portfolio.sample_strategy(portfolio.rng(i), POOLS, 60) for i in range(300)]
    genes = [g for s in made for side in portfolio.SIDES for g in s[side]]
    assert {g["type"] for g in genes} == {k for k, _ in portfolio.SHARES}
    for g in genes:
        for key, grid in portfolio.GRIDS.get(g["type"], {}).items():
            assert g["type"] in ("flux", "proximity") and key == "threshold" or g[key] in grid
    assert all(s["sl"] in portfolio.STOPS and 1 <= max(len(s["long_genes"]), len(s["short_genes"])) <= 4 for s in made)
    child = portfolio.crossover(portfolio.rng(1), made[0], made[1])
    assert child["horizon"] == 60 and portfolio.mutate(portfolio.rng(2), made[3], POOLS)["name"] != made[3]["name"]
    assert portfolio.kin("vol_100", POOLS.triggers) == ["vol_200"]
    assert len(portfolio.variants(made[3], portfolio.rng(3), POOLS)) > 10
    assert portfolio.jaccard({1, 2}, {2, 3}) == 1 / 3
    grid = portfolio.stop_grid([1.0, 2.0], [1.0, 3.0], 1.0)
    assert {"sl": 2.0, "tp": 1.0} not in grid and {"sl": 1.0, "tp": 3.0} in grid
    assert signals.effective({"sl": 2.0, "tp": 3.0, "sl_long": 1.0}, "long") == (1.0, 3.0)


def test_hall_of_fame_and_penalties():
    s = lambda n, f: {"name": n, "hash": n, "fitness": f, "long_genes": [{"type": "zscore", "feature": n}], "short_genes": []}
    fame = search.admitted([], [s("a", 1.0), s("b", -20.0), s("c", 2.0)], 0, 10)
    assert [m["name"] for m in fame] == ["c", "a"] and search.admitted(fame, [s("a", 9.0)], 0, 10) == fame
    assert len(search.admitted(fame, [s("d", 0.0)], 9, 10)) == 2 and len(search.admitted(fame, [s("d", 3.0)], 9, 10, cap=1)) == 1
    p = search.penalties([s("a", 0), s("a", 0) | {"name": "e"}, s("c", 0)])
    assert abs(p["c"] - 0.05) < 1e-12 and abs(p["a"] - (0.05 + 2 / 3 - 0.4)) < 1e-12
    both = {"name": "x", "long_genes": [{"type": "zscore"}], "short_genes": [{"type": "time"}]}
    assert [m["name"] for m in search.one_sided([both])] == ["x", "x_long", "x_short"]
    dead = search.repaired(both, [{"side": "long", "split": "train", "trades": 0, "total_return": 0.0}, {"side": "short", "split": "train", "trades": 5, "total_return": 1.0}])
    assert dead["long_genes"] == [] and dead["short_genes"]
    listed = portfolio.Candidates([{"name": "a", "test_return": 1.0, "test_sortino": 1.0, "cpcv_min": -1.0}, {"name": "b", "test_return": 1.0, "test_sortino": 1.0, "cpcv_p5": 2.0}])
    assert listed.clean() == 1 and [r["name"] for r in listed.listed()] == ["b"]


def test_detailed_simulation_has_its_own_order():
    rules = Rules(**{**FREE.__dict__, "horizon": 2})
    x = ([1, 0, 0, 0], [10, 10, 10, 10])
    low = [10, 8, 10, 10]
    assert run(*x, rules, low=low)[1][0]["reason"] == "stop"
    args = [np.array(v, float) for v in (x[0], x[1], x[1], low, [1] * 4, [10] * 4, [1] * 4)]
    assert play(*args, rules, True)[1][0]["reason"] == "time"
    short = Rules(**{**FREE.__dict__, "sl_short": 5.0})
    args[0], args[2], args[3] = np.array([-1.0, 0, 0, 0]), np.array([10, 11.5, 10, 10.0]), np.full(4, 10.0)
    assert play(*args, short)[1][0]["reason"] == "open" and play(*args, short, True)[1][0]["reason"] == "stop"


def test_features_stand_a_zero_price(spark):
    rows = [("s", i, dt.datetime(2024, 1, 1, 0, i), dt.datetime(2024, 1, 1, 0, i, 30), *([0.0] * 4 if i in (5, 6) else [10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i]), 5.0, 1.0, 0.2, 3) for i in range(40)]
    df = spark.createDataFrame(rows, "series string, bar_id long, time_start timestamp_ntz, time_end timestamp_ntz, open double, high double, low double, close double, volume double, net_aggressor_vol double, ticket_imbalance double, tick_count long")
    df = features.log_return(df)
    for make in (features.standard, features.yang_zhang, features.physics, features.oscillators, features.hurst, features.fractal_dimension, features.microstructure, features.interactions):
        df = make(df, 5)
    assert df.count() == 40 and df.where("bar_id = 39").first()["volatility_5"] is not None


def test_windows_are_the_same_in_chunks(spark):
    rows = [("a", i, float(i * i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, "series string, bar_id long, x double")
    make = lambda d: d.withColumn("m", frames.rolling("avg", "x", 12))
    key = lambda d: sorted(map(tuple, d.select("series", "bar_id", "m").collect()), key=repr)
    assert key(chunks.windowed(df, make, 12)) == key(chunks.windowed(df, make, 12, most=0, rows=40, span=30))


def test_ranks_by_ranges_are_the_same(spark):
    r = np.random.default_rng(5)
    rows = [("s" if i < 300 else "t", i, float(r.integers(0, 40)), float(r.normal()), float(r.normal())) for i in range(700)]
    df = spark.createDataFrame(rows, "series string, bar_id long, a double, b double, y double")
    key = lambda d: sorted((x.feature, x.n, round(x.ic, 9), round(x.stability, 6)) for x in d.collect())
    assert key(statistics.rank_ic(df, ["a", "b"], "y")) == key(statistics.rank_ic(df, ["a", "b"], "y", most=0, span=64))


def test_asof_by_ranges_is_the_same(spark):
    r = np.random.default_rng(3)
    left = spark.createDataFrame([(int(t), i) for i, t in enumerate(r.integers(0, 1000, 200))], "t long, i long")
    right = spark.createDataFrame([(int(t), float(i)) for i, t in enumerate(r.integers(0, 1000, 60))], "u long, v double")
    for f in (asof.asof_backward, asof.asof_forward):
        got = [sorted((x.i, x.asof_key, x.v) for x in f(left, right, "t", "u", [], ["v"], span=s).collect()) for s in (None, 50, 7)]
        assert got[0] == got[1] == got[2]
    pair = {"a": F.when(F.col("v") % 2 == 0, F.col("v")), "b": F.when(F.col("v") % 2 == 1, F.col("v"))}
    got = [sorted((x.i, repr(x.a), repr(x.b)) for x in asof.asof_columns(left, right, "t", "u", [], pair, s).collect()) for s in (None, 50)]
    assert got[0] == got[1]


def test_asof_ahead_reads_each_row_once(spark):
    left = spark.createDataFrame([(1, 0), (5, 1), (5, 2), (12, 3), (40, 4)], "t long, i long")
    right = spark.createDataFrame([(5, 1.0), (5, 2.0), (13, None), (30, 3.0)], "u long, v double")
    for span in (None, 10):
        got = asof.asof_forward(left, right, "t", "u", [], ["v"], span=span)
        assert sorted((r.i, r.asof_key, r.v) for r in got.collect()) == [(0, 5, 1.0), (1, 5, 1.0), (2, 5, 1.0), (3, 13, None), (4, None, None)]
        assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_streams_go_on_where_they_ended(spark, tmp_path):
    row = lambda i: (i, dt.datetime(2024, 1, 1, 0, 0, i), 1, "a", float(10 + i), '{"k": 6}')
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([row(i) for i in range(3)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/one")
    bars_ = lambda: live.volume_bars(live.tick_stream(spark, f"{tmp_path}/in/*"), 10.0)
    assert live.run_once(bars_(), str(tmp_path), name="kept").count() == 1
    spark.createDataFrame([row(i) for i in range(3, 6)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/two")
    got = live.run_once(bars_(), str(tmp_path), name="kept").orderBy("bar_no").collect()
    assert [(x.bar_no, x.open, x.close) for x in got] == [(0, 10.0, 11.0), (1, 12.0, 13.0), (2, 14.0, 15.0)]
    votes = spark.createDataFrame([("s", 9, "x", 0), ("s", 9, "y", -1), ("s", 9, "z", 1)], "series string, bar_id long, strategy_id string, signal int")
    assert live.first_signal(votes, ["x", "z", "y"]).first().strategy_id == "z"
    cooling = spark.createDataFrame([("s", "z")], "series string, strategy_id string")
    assert live.first_signal(votes, ["x", "z", "y"], cooling).first().strategy_id == "y"


def test_chunks_with_a_halo_change_nothing(spark):
    rows = [("a", 3 * i + (i % 2), float(i * i % 17)) for i in range(200)] + [("b", i, float(i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "series string, bar_id long, x double").repartition(3)
    make = lambda d: d.withColumns({"m": frames.rolling("avg", "x", 12), "d": frames.diff("x", 7)}).withColumn("n", frames.rolling("max", "m", 9))
    key = lambda d: sorted(map(tuple, d.select("series", "bar_id", "x", "m", "d", "n").collect()), key=repr)
    assert key(chunks.chunked(df, make, 20, 25, 40)) == key(make(df))
    assert [r.idx for r in chunks.dense_index(df.where("series = 'a'"), 50).orderBy("bar_id").collect()] == list(range(200))
