"""Live positions on hand-made ticks: barriers, tightening, sizes, cooldowns, hours."""

import pandas as pd
import pytest

from quantloom.operators.simulate import Rules
from quantloom.streaming.trading import Account

R = Rules(sl_long=1.0, sl_short=2.0, tp_long=2.0, tp_short=1.0, cooldown=2, lot=100.0, account=10_000.0, commission=0.001, least_commission=2.0)
T = pd.Timestamp("2024-01-03 10:00:00")


def test_long_stop_with_costs_and_cooldown():
    a = Account([R], None)
    assert a.bar(T, 50.0, [1], 2.0, 0.01) == [] and a.size == 1.0  # 100 at risk over 100 * 1 * 2, at least one lot
    assert a.tick(T, 48.01) == []
    ((opened, closed, strategy, size, entry, price, reason, pnl, balance),) = a.tick(T, 47.9)
    assert (reason, strategy, size, entry, price) == ("SL", 0, 1.0, 50.0, 47.9)
    assert pnl == pytest.approx(-210 - 5.0 - 4.79) and balance == pytest.approx(10_000 + pnl) and a.waits == [2]
    assert a.bar(T, 50.0, [1], 2.0, 0.01) == [] and a.size == 0 and a.waits == [1]
    a.bar(T, 50.0, [1], 2.0, 0.01)
    assert a.size > 0 and a.waits == [0]


def test_target_short_side_and_tighter_stop():
    a = Account([R], None)
    a.bar(T, 50.0, [-1], 1.0, 0.0)
    assert a.size == -1.0 and a.tick(T, 51.7) == []
    a.bar(T, 51.0, [-1], 1.6, 0.0)  # the range has grown: two ranges become 1.6
    assert a.barrier(51.7) == "SL" and a.barrier(51.5) is None and a.barrier(49.0) == "TP"
    assert a.tick(T, 48.9)[0][6] == "TP" and a.waits == [0]


def test_reversal_first_free_strategy_and_hours():
    a = Account([R, R], None)
    a.bar(T, 50.0, [0, 1], 1.0, 0.0)
    assert a.strategy == 1
    (closed,) = a.bar(T, 50.5, [-1, 1], 1.0, 0.0)
    assert closed[6] == "reverse" and a.size == -1.0 and a.strategy == 0
    late = pd.Timestamp("2024-01-03 22:00:00")
    assert a.bar(late, 50.0, [1, 1], 1.0, 0.0)[0][6] == "close" and a.size == 0
    assert a.bar(pd.Timestamp("2024-01-06 12:00:00"), 50.0, [1, 1], 1.0, 0.0) == [] and a.size == 0


def test_sizes_follow_the_balance_and_state_comes_back():
    a = Account([Rules(sl_long=0.5, lot=100.0, account=60_000.0)], None)
    a.bar(T, 10.0, [1], 4.0, 0.01)
    assert a.size == pytest.approx(600 / (100 * 0.5 * 4.0))
    b = Account(a.rules, a.state())
    assert b.state() == a.state() and b.tick(T, 1.0)[0][6] == "SL"
    a = Account([Rules(sl_long=0.0, lot=100.0, account=60_000.0)], None)
    a.bar(T, 10.0, [1], 1.0, 0.01)
    assert a.size == 4.0 and a.barrier(0.1) is None  # no stop: one range counts, and the bound holds
