"""Positions on the live path (SS07): barriers met at ticks, signals met at bars, as a keyed stateful stream.

A tick row has series, ts, seq, mid; one that closes a bar has also ``votes``, the signal of every strategy in their order,
and ``atr``. At each tick the position is first held against its barriers, then, where a bar closes, against the signals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.operators.simulate import Rules, lots

#: Fixed values of the surveyed live path: share of the balance at risk, bars that a stopped strategy sits out, hours of trade.
RISK, COOLDOWN, FIRST_HOUR, LAST_HOUR = 0.01, 12, 8, 22

TRADES = "series string, opened timestamp, closed timestamp, strategy int, lots double, entry double, exit double, reason string, pnl double, balance double"
_STATE = "size double, entry double, entry_atr double, atr double, strategy int, opened timestamp, balance double, cooldowns string"


class Account:
    """One series' position and balance. Sizes are signed lots; a position has the strategy that opened it."""

    def __init__(self, rules: list[Rules], state: tuple | None) -> None:
        self.rules = rules
        self.size, self.entry, self.entry_atr, self.atr, self.strategy, self.opened, self.balance, waits = state or (0.0, 0.0, 0.0, 0.0, -1, None, rules[0].account, "")
        waits = [int(x) for x in waits.split(",")] if waits else []
        self.waits = waits if len(waits) == len(rules) else [0] * len(rules)

    def state(self) -> tuple:
        return (float(self.size), float(self.entry), float(self.entry_atr), float(self.atr), int(self.strategy), self.opened, float(self.balance), ",".join(map(str, self.waits)))

    def _commission(self, price: float) -> float:
        r = self.rules[0]
        return max(r.least_commission, price * abs(self.size) * r.lot * r.commission)

    def _close(self, price: float, reason: str, ts: pd.Timestamp) -> tuple:
        pnl = (price - self.entry) * self.size * self.rules[0].lot - self._commission(self.entry) - self._commission(price)
        self.balance += pnl
        trade = (self.opened, ts, self.strategy, self.size, self.entry, price, reason, pnl, self.balance)
        self.size, self.entry_atr, self.strategy = 0.0, 0.0, -1
        return trade

    def barrier(self, price: float) -> str | None:
        """``SL`` or ``TP`` if the price has reached it; the stop comes first, and nearer where the range has grown since."""
        if not self.size:
            return None
        if self.entry_atr <= 0:
            if self.atr <= 0:
                return None
            self.entry_atr = self.atr
        r, side = self.rules[self.strategy], math.copysign(1.0, self.size)
        stop, target = (r.sl_long, r.tp_long) if side > 0 else (r.sl_short, r.tp_short)
        if self.atr > 0 and self.atr / self.entry_atr > r.tighten_over:
            stop *= r.tighten
        if stop > 0 and side * price <= side * self.entry - self.entry_atr * stop:
            return "SL"
        if target > 0 and side * price >= side * self.entry + self.entry_atr * target:
            return "TP"
        return None

    def tick(self, ts: pd.Timestamp, price: float) -> list[tuple]:
        reason, strategy = self.barrier(price), self.strategy
        if reason is None:
            return []
        if reason == "SL":
            self.waits[strategy] = self.rules[strategy].cooldown
        return [self._close(price, reason, ts)]

    def bar(self, ts: pd.Timestamp, price: float, votes: list[int], atr: float, risk: float) -> list[tuple]:
        """The bar's first signal of a strategy that isn't sitting out: the same side changes nothing, another one closes
        and opens. Outside the hours of trade a position is closed."""
        self.waits, self.atr = [max(0, w - 1) for w in self.waits], atr
        if not (FIRST_HOUR <= ts.hour < LAST_HOUR and ts.dayofweek < 5):
            return [self._close(price, "close", ts)] if self.size else []
        chosen = next((k for k, v in enumerate(votes) if v and not self.waits[k]), None)
        if chosen is None or votes[chosen] * self.size > 0:
            return []
        closed = [self._close(price, "reverse", ts)] if self.size else []
        r = self.rules[chosen]
        self.size = lots(math.copysign(1.0, votes[chosen]), atr, replace(r, target_risk=self.balance * risk) if risk > 0 else r)
        self.entry, self.entry_atr, self.strategy, self.opened = price, atr, chosen, ts
        return closed


def positions(ticks: DataFrame, rules: list[Rules], risk: float = RISK) -> DataFrame:
    """Closed trades (TRADES) of each series' account, one row each, with the balance after it.

    ``risk``: the share of the balance that a stop may cost, which sets the size within the rules' bounds; 0: one lot. Rows
    of a batch are taken in the order of (ts, seq); a price that is not over zero meets no barrier.
    """
    names = [c.split()[0] for c in TRADES.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        account = Account(rules, state.get if state.exists else None)
        out = []
        for t in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():
            if t.mid > 0:
                out += account.tick(t.ts, t.mid)
            if t.votes is not None:
                out += account.bar(t.ts, t.mid, list(t.votes), t.atr, risk)
        state.update(account.state())
        yield pd.DataFrame([(key[0], *x) for x in out], columns=names)

    return ticks.groupBy("series").applyInPandasWithState(run, TRADES, _STATE, "append", GroupStateTimeout.NoTimeout)
