"""Stateful trade simulation (SM01-SM09): one task for each (series, strategy), events instead of bars.

While a position is open, the bars at which each rule would end it are found with array searches, and the earliest one
is taken; flat stretches are skipped to the next signal. Rules, by precedence at a bar: barriers on the bar before (stop
first), forced close by time of day, time limit, reversal; the detailed form puts forced close and time limit before the
barriers and has one stop and one target for both sides. An exit bar takes no new position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Parameters of a simulation. Distances are in multiples of the entry bar's true range."""

    sl_long: float = 2.0
    sl_short: float = 2.0
    tp_long: float = 4.0
    tp_short: float = 4.0
    horizon: int = 120
    cooldown: int = 0
    limit: float = 0.0
    lot: float = 100_000.0
    account: float = 30_000.0
    spread: float = 5e-5
    commission: float = 2e-5
    least_commission: float = 2.0
    slippage: float = 0.1
    close_hour: int = 22
    tighten_over: float = 1.5
    tighten: float = 0.8
    target_risk: float = 0.0
    least_lots: float = 1.0
    most_lots: float = 4.0


def cost(change: Column | np.ndarray, price, atr, rules: Rules, spread=None):
    """Half spread, commission with a minimum, slippage in true ranges (SM03); zero for no change. Columns or arrays."""
    spread = rules.spread if spread is None else spread
    if isinstance(change, Column):
        value = change * rules.lot * price * 0.5 * spread + F.greatest(F.lit(rules.least_commission), change * rules.lot * price * rules.commission) + rules.slippage * atr * rules.lot * change
        return F.when(change < 1e-6, 0.0).otherwise(value)
    value = change * rules.lot * price * 0.5 * spread + np.maximum(rules.least_commission, change * rules.lot * price * rules.commission) + rules.slippage * atr * rules.lot * change
    return np.where(change < 1e-6, 0.0, value)


def lots(side: float, atr: float, rules: Rules) -> float:
    """Signed size: one lot, or the target risk over the stop distance within bounds (SM04)."""
    if rules.target_risk <= 0:
        return side
    stop = rules.sl_long if side > 0 else rules.sl_short
    size = rules.target_risk / (rules.lot * (stop if stop > 0 else 1.0) * max(atr, 1e-6))
    return side * min(max(size, rules.least_lots), rules.most_lots)


def _first(mask: np.ndarray, at: int) -> int:
    """Index of the first true value, counted from ``at``; a large number if there is none."""
    return at + int(mask.argmax()) if mask.any() else 1 << 60


def _barrier(i: int, side: float, price: float, atr0: float, high: np.ndarray, low: np.ndarray, atr: np.ndarray, until: int, rules: Rules, one_sided: bool = False) -> tuple[int, float, bool]:
    """(bar, price, is a stop) of the first barrier touched by bars i .. until-2, which acts on the bar after."""
    stop, target = (rules.sl_long, rules.tp_long) if side > 0 or one_sided else (rules.sl_short, rules.tp_short)
    h, lo, now = high[i:until], low[i:until], atr[i:until]
    tight = np.where((now > 0) & (atr0 > 0) & (now > rules.tighten_over * atr0), rules.tighten, 1.0) * stop
    stops = price - side * atr0 * tight
    goal = price + side * atr0 * target
    hit_stop = (tight > 0) & ((lo <= stops) if side > 0 else (h >= stops))
    hit_goal = (h >= goal if side > 0 else lo <= goal) & (target > 0)
    at = _first(hit_stop | hit_goal, 0)
    if at >= len(h):
        return 1 << 60, 0.0, False
    return i + at + 1, float(stops[at] if hit_stop[at] else goal), bool(hit_stop[at])


def play(signal: np.ndarray, price: np.ndarray, high: np.ndarray, low: np.ndarray, atr: np.ndarray, hour: np.ndarray, weekday: np.ndarray, rules: Rules, detailed: bool = False) -> tuple[np.ndarray, list[dict], np.ndarray]:
    """(net return of each bar, trades, position held after each bar). ``price`` is where orders of a bar fill; ``atr`` is
    known at that bar. ``detailed`` (SM05): forced close, then time, then barriers; no directional stops; a limit fill's
    better price counts in the trade, not in the bar's return."""
    n = len(signal)
    held, fills, exits = np.zeros(n), np.zeros(n), np.zeros(n)
    closed = (hour >= rules.close_hour) | (weekday >= 5)
    closing = np.flatnonzero(closed)
    wants = np.flatnonzero((signal != 0) & ~closed)
    trades: list[dict] = []
    sized = Rules(**{**rules.__dict__, "sl_short": rules.sl_long}) if detailed else rules
    i, open_from = 0, 0  # next bar to look at, and first bar after a cooldown
    side, entry, fill, size = 0.0, 0, 0.0, 0.0
    while True:
        if side == 0:
            k = np.searchsorted(wants, max(i, open_from))
            if k >= len(wants):
                break
            i = int(wants[k])
            s = float(np.sign(signal[i]))
            fill = price[i] - s * rules.limit * max(atr[i], 1e-6) if rules.limit > 0 else price[i]
            if rules.limit > 0 and not (low[i] <= fill if s > 0 else high[i] >= fill):
                i += 1
                continue
            side, entry, size = s, i, lots(s, atr[i], sized)
            fills[i] = fill
        until = min(n, entry + rules.horizon + 1) if rules.horizon > 0 else n
        c = np.searchsorted(closing, entry + 1)
        forced = int(closing[c]) if c < len(closing) else 1 << 60
        timed = entry + rules.horizon if rules.horizon > 0 else 1 << 60
        turned = _first(np.sign(signal[entry + 1 : until]) == -side, entry + 1)
        bar, level, stopped = _barrier(entry, side, fill, atr[entry], high, low, atr, min(until, n - 1), rules, detailed)
        end = min(bar, forced, timed, turned, n)
        held[entry:end] = size
        if end >= n:
            trades.append({"entry": entry, "exit": n, "side": side, "size": abs(size), "reason": "open", "entry_price": fill, "exit_price": float(price[-1])})
            break
        order = {"close": forced, "time": timed, "barrier": bar} if detailed else {"barrier": bar, "close": forced, "time": timed}
        reason = next((r for r, at in order.items() if at == end), "reverse")
        if reason == "barrier":
            exits[end] = level
            reason = "stop" if stopped else "target"
            if stopped:
                open_from = end + rules.cooldown
        trades.append({"entry": entry, "exit": end, "side": side, "size": abs(size), "reason": reason, "entry_price": fill, "exit_price": level if exits[end] else float(price[end])})
        if reason == "reverse":
            side, entry, fill = -side, end, price[end]
            size = lots(side, atr[end], sized)
            fills[end] = fill
        else:
            side, i = 0.0, end + 1
    before = np.append(0.0, held[:-1])
    last = np.append(price[:1], price[:-1] if detailed else np.where(fills[:-1] != 0, fills[:-1], price[:-1]))
    at = np.where(exits != 0, exits, price)
    change = np.abs(held - before)
    spread = np.where((rules.limit > 0) & (before == 0) & (held != 0), 0.0, rules.spread)
    return (before * rules.lot * (at - last) - cost(change, at, atr, rules, spread)) / rules.account, trades, held


def simulate(signal: np.ndarray, price: np.ndarray, high: np.ndarray, low: np.ndarray, atr: np.ndarray, hour: np.ndarray, weekday: np.ndarray, rules: Rules) -> tuple[np.ndarray, list[dict]]:
    """(net return of each bar, trades)."""
    return play(signal, price, high, low, atr, hour, weekday, rules)[:2]


ORDERS = ("signal", "price", "high", "low", "atr", "hour", "weekday")
TRADE_COLUMNS = "entry_bar long, exit_bar long, side double, size double, reason string, entry_price double, exit_price double, gross double"
AllRules = Rules | dict[str, Rules]


def _arrays(pdf: pd.DataFrame, order: str = "bar_id") -> tuple[pd.DataFrame, list[np.ndarray]]:
    pdf = pdf.sort_values(order)
    return pdf, [pdf[c].to_numpy(float) for c in ORDERS]


def _rules(rules: AllRules, pdf: pd.DataFrame) -> Rules:
    return rules if isinstance(rules, Rules) else rules[pdf["strategy_id"].iat[0]]


def _typed(df: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def net_returns(df: DataFrame, rules: AllRules, keys: tuple[str, ...] = ("series", "strategy_id"), order: str = "bar_id", detailed: bool = False) -> DataFrame:
    """net_ret of each bar of each group of ``keys`` (SM01, SM05, SM06), with the position after it and whether a trade
    was entered from flat. Columns: keys, ``order``, signal, price, high, low, atr, hour, weekday. A group is one
    instrument's history (or a slice of it) under one strategy; rules may differ by strategy_id."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _arrays(pdf, order)
        net, _, held = play(*x, _rules(rules, pdf), detailed)
        return pdf[[*keys, order]].assign(net_ret=net, position=held, entered=(held != 0) & (np.append(0.0, held[:-1]) == 0))
    return df.select(*dict.fromkeys((*keys, "strategy_id", order)), *ORDERS).groupBy(*keys).applyInPandas(run, f"{_typed(df, (*keys, order))}, net_ret double, position double, entered boolean")


def trades(df: DataFrame, rules: AllRules, keys: tuple[str, ...] = ("series", "strategy_id")) -> DataFrame:
    """Trade records of each group (SM05): gross of costs."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _arrays(pdf)
        ids, r = pdf["bar_id"].to_numpy(), _rules(rules, pdf)
        rows = [
            (*(pdf[k].iat[0] for k in keys), int(ids[t["entry"]]), int(ids[min(t["exit"], len(ids) - 1)]), t["side"], t["size"], t["reason"], t["entry_price"], t["exit_price"], t["side"] * t["size"] * r.lot * (t["exit_price"] - t["entry_price"]))
            for t in play(*x, r, True)[1]
        ]
        return pd.DataFrame(rows, columns=[*keys, *[c.split()[0] for c in TRADE_COLUMNS.split(", ")]])
    return df.groupBy(*keys).applyInPandas(run, f"{_typed(df, keys)}, {TRADE_COLUMNS}")


def equity(df: DataFrame, rules: AllRules, account: float, keys: tuple[str, ...] = ("series", "strategy_id")) -> DataFrame:
    """Account value after each bar under the detailed rules (SM05)."""
    w = Window.partitionBy(*keys).orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    return net_returns(df, rules, keys, detailed=True).select(*keys, "bar_id", (account + account * F.sum("net_ret").over(w)).alias("equity"))


def prediction_returns(df: DataFrame) -> DataFrame:
    """signal times the bar's return, for scoring without orders (SM08)."""
    return df.withColumn("net_ret", F.col("signal") * F.col("ret"))


def mutex(signals: np.ndarray, price: np.ndarray, high: np.ndarray, low: np.ndarray, atr: np.ndarray, hour: np.ndarray, weekday: np.ndarray, rules: list[Rules]) -> tuple[np.ndarray, np.ndarray]:
    """One position at a time over several strategies (SM07): (net returns by strategy, owner of each bar or -1).

    The lowest-numbered strategy that wants in takes the lock; it holds through its exit bar, on which nobody enters.
    While it is held, the others' cooldowns stand still. At a bar: the time limit, else the barriers; a forced close
    overrides both. Barriers are met at their tightened distance and exit at the untightened one. No limit orders, no
    reversals; the first bar takes no orders.
    """
    n, m = signals.shape
    owner, total = np.full(n, -1), np.zeros((n, m))
    closed = (hour >= rules[0].close_hour) | (weekday >= 5)
    closing = np.flatnonzero(closed)
    wants = [np.flatnonzero((signals[:, k] != 0) & ~closed) for k in range(m)]
    wait = np.zeros(m, int)  # bars that each strategy still has to sit out, as of the bar before ``i``
    i = 1
    while i < n:
        entries = [int(w[at]) if (at := np.searchsorted(w, i + max(0, wait[k] - 1))) < len(w) else n for k, w in enumerate(wants)]
        entry = min(entries)
        k = entries.index(entry)
        if entry >= n:
            break
        passed = entry - i + (np.arange(m) <= k)  # strategies after the one that enters are not asked on that bar
        wait = np.maximum(wait - passed, 0)
        r, side = rules[k], float(np.sign(signals[entry, k]))
        size, fill, atr0 = lots(side, atr[entry], r), price[entry], atr[entry]
        timed = entry + r.horizon if r.horizon > 0 else 1 << 60
        c = np.searchsorted(closing, entry + 1)
        forced = int(closing[c]) if c < len(closing) else 1 << 60
        bar, _, stopped = _barrier(entry, side, fill, atr0, high, low, atr, min(n - 1, timed), r)
        end = min(bar, timed, forced)
        last = min(end, n - 1)
        at = price[entry + 1 : last + 1].copy()
        if end == bar and end != forced and end != timed and end < n:
            far = (r.sl_long if side > 0 else r.sl_short) if stopped else (r.tp_long if side > 0 else r.tp_short)
            at[-1] = fill - side * atr0 * far if stopped else fill + side * atr0 * far
            if stopped:
                wait[k] = r.cooldown
        total[entry + 1 : last + 1, k] += size * r.lot * (at - price[entry:last]) / r.account
        total[entry, k] -= float(cost(np.array(abs(size)), fill, atr0, r)) / r.account
        if end < n:
            total[end, k] -= float(cost(np.array(abs(size)), at[-1], atr[end], r)) / r.account
        owner[entry : last + 1] = k
        i = end + 1
    return total, owner


def mutex_returns(df: DataFrame, names: list[str], rules: dict[str, Rules], keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """keys, bar_id, strategy_id, net_ret, owns for the strategies ``names``, in their order of precedence, sharing one
    account (SM07). Columns as for ``net_returns``; a group is one instrument's history."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {s: part.sort_values("bar_id") for s, part in pdf.groupby("strategy_id")}
        used = [s for s in names if s in by]
        if not used:
            return pd.DataFrame(columns=[*keys, "bar_id", "strategy_id", "net_ret", "owns"])
        first = by[used[0]]
        x = [first[c].to_numpy(float) for c in ORDERS[1:]]
        net, owner = mutex(np.stack([by[s]["signal"].to_numpy(float) for s in used], axis=1), *x, [rules[s] for s in used])
        return pd.concat([first[[*keys, "bar_id"]].assign(strategy_id=s, net_ret=net[:, k], owns=owner == k) for k, s in enumerate(used)])
    return df.where(F.col("strategy_id").isin(names)).groupBy(*keys).applyInPandas(run, f"{_typed(df, keys)}, bar_id long, strategy_id string, net_ret double, owns boolean")


def signal_runs(signals: DataFrame, horizon: int, keys: tuple[str, ...] = ("series", "strategy_id")) -> DataFrame:
    """entry_bar, exit_bar and duration of each stretch of bars with a signal that ends (SM09): from the first such bar to
    the first without, in bars, ``horizon`` at most."""
    w = Window.partitionBy(*keys).orderBy("bar_id")
    on = F.col("signal") != 0
    placed = signals.select(*keys, "bar_id", on.alias("_on"), F.coalesce(F.lag(on).over(w), F.lit(False)).alias("_was"), (F.row_number().over(w) - 1).alias("_i"))
    edges = placed.where(F.col("_on") != F.col("_was"))
    ends = edges.withColumns({"exit_bar": F.lead("bar_id").over(w), "_end": F.lead("_i").over(w)}).where(F.col("_on") & F.col("_end").isNotNull())
    return ends.select(*keys, F.col("bar_id").alias("entry_bar"), "exit_bar", F.least(F.col("_end") - F.col("_i"), F.lit(horizon)).cast("long").alias("duration"))
