"""Queries against DuckDB on small tapes of hard values: prices of zero, frames without a slope."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom import plans

KINDS = ("purchase", "click", "view")


def tape(spark, folder, prices, volumes=None):
    """``events`` of one price after the other, of each kind in turn; a tick of 500 is a bar of its own."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 5, KINDS[i % len(KINDS)], float(p), f'{{"k": {volumes[i] if volumes else 500}}}') for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def both(spark, folder, name):
    """(Spark's rows, DuckDB's rows) as sorted texts, NaN and NULL apart."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    text = lambda rows: sorted(tuple("null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    return text(plans.queries()[name](spark, folder).select(*columns).collect()), text(want.fetchall())


def test_intermarket_has_its_sql_at_a_zero_price(spark, tmp_path):
    prices = [0.0 if i in (150, 151, 190) else 20 + i * 7 % 13 for i in range(360)]
    got, want = both(spark, tape(spark, tmp_path, prices), "feat_intermarket")
    assert any("nan" in r for r in want) and got == want


def test_expanding_fill_reads_each_row_once(spark, tmp_path):
    """As its SQL, and no frame that ends with the partition, which Spark reads anew for each row."""
    folder = tape(spark, tmp_path, [20 + i * 7 % 13 for i in range(60)])
    got, want = both(spark, folder, "wn_expanding_fill")
    assert got == want
    plan = plans.queries()["wn_expanding_fill"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_a_search_makes_its_bars_once(spark, tmp_path, monkeypatch):
    """Generations read bars from a table, and orders come from one row of a bar, without a join."""
    from quantloom.operators import search
    from quantloom.plans.signal_queries import STRATEGIES

    folder, given = tape(spark, tmp_path, [20 + i * 7 % 13 for i in range(90)]), []
    monkeypatch.setattr(search, "evolve", lambda bars, *a, **b: given.append(bars) or [])
    plans.queries()["search_evolution"](spark, folder)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(given[0]) and "Join" not in plan(search.orders(given[0], STRATEGIES))
    assert search.orders(given[0], STRATEGIES).count() == len(STRATEGIES) * given[0].count()
    assert {"series", "bar_id", "strategy_id", "signal", "price", "atr", "hour", "weekday"} <= set(search.orders(given[0], STRATEGIES).columns)


def test_a_trade_entered_at_a_price_of_zero_is_a_trade():
    """It keeps its own exit, and no later trade takes the exit of one before it."""
    import numpy as np

    from quantloom.operators.simulate import Rules, play

    rules = Rules(spread=0, commission=0, least_commission=0, slippage=0, lot=1, account=1, horizon=2, sl_long=0, sl_short=0, tp_long=0, tp_short=0)
    price = np.array([5.0, 0.0, 4.0, 6.0, 7.0, 8.0, 9.0, 9.0])
    x = [np.array([0, 1, 0, 0, 0, 1, 0, 0.0]), price, price, price, np.ones(8), np.full(8, 10.0), np.ones(8)]
    trades = play(*x, rules, True)[1]
    assert [(t["entry"], t["exit"], t["entry_price"]) for t in trades] == [(1, 3, 0.0), (5, 7, 8.0)]
