"""Evaluation of strategies over slices of history (EV04-EV17): splits, walk-forward folds, stitched paths, sides.

``orders`` has series, strategy_id, bar_id, signal and the columns of ``simulate.ORDERS``. Slices are tables of cases:
each case (a split, fold or path) of each (series, strategy) is one group of the simulator, so the work is dealt out by
case. Signals act a bar later; where the surveyed system shifts them within the slice, so does ``shifted``.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.frames import ratio
from quantloom.operators.simulate import AllRules, net_returns

KEYS = ("series", "strategy_id")
EPS = 1e-9


def shifted(orders: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Signals a bar later within each group; its first bar has none."""
    return orders.withColumn("signal", F.coalesce(F.lag("signal").over(Window.partitionBy(*keys).orderBy("bar_id")), F.lit(0)))


def placed(orders: DataFrame) -> DataFrame:
    """``k``: the bar's place from 0, and ``n``: the number of bars, by (series, strategy)."""
    w = Window.partitionBy(*KEYS)
    return orders.withColumns({"k": F.row_number().over(w.orderBy("bar_id")) - 1, "n": F.count("*").over(w)})


def in_splits(orders: DataFrame, train: float = 0.6, val: float = 0.8) -> DataFrame:
    """``split``: train, val or test, by share of the bars (SL06)."""
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    return placed(orders).withColumn("split", F.when(F.col("k") < a, "train").when(F.col("k") < b, "val").otherwise("test")).drop("k", "n")


def in_folds(orders: DataFrame, folds: int = 5) -> DataFrame:
    """``fold``: walk-forward test ranges on the first 80 % of the bars (EV05): 11 % each, behind windows of 55 % that start
    11 % apart; a range that would reach beyond the 80 % is moved back. Ranges may overlap."""
    dev = F.floor(F.col("n") * 0.8)
    window, step = F.floor(dev * 0.55), F.floor(dev * 0.11)
    ranges = []
    for f in range(folds):
        stop = F.least(f * step + window + step, dev)
        ranges.append(F.struct(F.lit(f).alias("fold"), (stop - step).alias("a"), stop.alias("b")))
    cases = placed(orders).select("*", F.explode(F.array(*ranges)).alias("r")).where((F.col("k") >= F.col("r.a")) & (F.col("k") < F.col("r.b")))
    return cases.withColumn("fold", F.col("r.fold")).drop("r", "k", "n")


def in_paths(orders: DataFrame, folds: int = 6, tests: int = 2) -> DataFrame:
    """``path``: the bars of each choice of ``tests`` of ``folds`` equal parts, the last part taking the rest (EV07). A
    path's parts follow one another: trades run across the seam."""
    chosen = list(combinations(range(folds), tests))
    of_fold = F.array(*[F.array(*[F.lit(p) for p, c in enumerate(chosen) if f in c]) for f in range(folds)])
    part = F.least(F.floor(F.col("k") / F.greatest(F.floor(F.col("n") / folds), F.lit(1))), F.lit(folds - 1)).cast("int")
    return placed(orders).select("*", F.explode(F.get(of_fold, part)).alias("path")).drop("k", "n")


def _downside(x: str = "net_ret") -> Column:
    return F.sqrt(F.avg(F.pow(F.least(F.col(x), F.lit(0.0)), 2)))


def _ratios(annual: float) -> dict[str, Column]:
    k = F.lit(math.sqrt(annual))
    total = F.sum("net_ret")
    return {
        "total_return": total,
        "sharpe": F.avg("net_ret") / (F.stddev_pop("net_ret") + EPS) * k,
        "sortino": F.avg("net_ret") / F.greatest(_downside(), F.lit(EPS)) * k,
        "stability": F.max("net_ret") / (F.abs(total) + EPS),
        "trades": F.sum(F.col("entered").cast("long")),
    }


def population_table(orders: DataFrame, rules: AllRules, annual: float = 1.0) -> DataFrame:
    """Metrics of each (series, strategy) on each split (EV04): the Sortino ratio counts 60 % where one bar makes over 60 %
    of the total."""
    cases = (*KEYS, "split")
    returns = net_returns(shifted(in_splits(orders), cases), rules, cases)
    made = returns.groupBy(*cases).agg(*[c.alias(n) for n, c in _ratios(annual).items()])
    return made.withColumn("sortino", F.col("sortino") * F.when(F.col("stability") > 0.6, 0.6).otherwise(1.0))


def walk_forward_scores(orders: DataFrame, rules: AllRules, annual: float = 1.0, folds: int = 5) -> DataFrame:
    """score (mean less half the deviation), mean, least and deviation of the folds' Sortino ratios, and mean trades
    (EV05)."""
    cases = (*KEYS, "fold")
    returns = net_returns(shifted(in_folds(orders, folds), cases), rules, cases)
    made = returns.groupBy(*cases).agg(*[c.alias(n) for n, c in _ratios(annual).items()], F.max("net_ret").alias("_best"))
    shaky = (F.col("total_return") > 0) & (F.col("_best") / (F.col("total_return") + EPS) > 0.6)
    each = made.withColumn("sortino", F.coalesce("sortino", F.lit(0.0)) * F.when(shaky, 0.6).otherwise(1.0))
    out = each.groupBy(*KEYS).agg(F.avg("sortino").alias("avg_sortino"), F.min("sortino").alias("min_sortino"), F.stddev_pop("sortino").alias("fold_std"), F.avg("trades").alias("avg_trades"))
    return out.withColumn("score", F.col("avg_sortino") - F.col("fold_std") * 0.5)


def path_scores(orders: DataFrame, rules: AllRules, annual: float = 1.0, folds: int = 6, tests: int = 2) -> DataFrame:
    """5th percentile, median, deviation and least of the Sortino ratios of the stitched paths, each simulated anew
    (EV07). Signals are shifted once, over the whole history."""
    cases = (*KEYS, "path")
    returns = net_returns(in_paths(shifted(orders, KEYS), folds, tests), rules, cases)
    each = returns.groupBy(*cases).agg((F.avg("net_ret") / (_downside() + EPS) * math.sqrt(annual)).alias("sortino"))
    p = lambda q: F.percentile("sortino", F.lit(q))  # noqa: E731  a few dozen paths
    return each.groupBy(*KEYS).agg(p(0.05).alias("cpcv_p5"), p(0.5).alias("cpcv_median"), F.stddev_pop("sortino").alias("cpcv_std"), F.min("sortino").alias("cpcv_min"), F.count("*").alias("paths"))


def in_sides(orders: DataFrame) -> DataFrame:
    """``side``: total, long (short signals out) and short (long signals out)."""
    sides = F.array(*[F.struct(F.lit(n).alias("side"), c.alias("signal")) for n, c in (("total", F.col("signal")), ("long", F.greatest("signal", F.lit(0))), ("short", F.least("signal", F.lit(0))))])
    return orders.select("*", F.explode(sides).alias("r")).withColumns({"side": F.col("r.side"), "signal": F.col("r.signal")}).drop("r")


def side_audit(orders: DataFrame, rules: AllRules, annual: float = 1.0) -> DataFrame:
    """Trades, returns, Sortino ratio and drawdown of all, long and short signals on each split (EV11)."""
    cases = (*KEYS, "split", "side")
    returns = net_returns(in_sides(in_splits(shifted(orders, KEYS))), rules, cases)
    w = Window.partitionBy(*cases).orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("_c", F.sum("net_ret").over(w)).withColumn("_top", F.max("_c").over(w))
    down = _downside()
    return curve.groupBy(*cases).agg(
        F.sum(F.col("entered").cast("long")).alias("trades"),
        F.sum("net_ret").alias("total_return"),
        (F.avg("net_ret") * annual).alias("ann_return"),
        F.when(down < 1e-9, 0.0).otherwise(F.avg("net_ret") * math.sqrt(annual) / F.nullif(down, F.lit(0.0))).alias("sortino"),
        F.min(F.col("_c") - F.col("_top")).alias("max_drawdown"),
    )


def direction_consistency(audit: DataFrame, least: int = 5) -> DataFrame:
    """Whether a side's total turns its sign from train to test, with ``least`` trades in both (EV10); from
    ``side_audit``."""
    def at(side: str, split: str, c: str) -> Column:
        return F.max(F.when((F.col("side") == side) & (F.col("split") == split), F.col(c)))
    cells = {f"{side}_{split}_{short}": at(side, split, c) for side in ("long", "short") for split in ("train", "test") for short, c in (("ret", "total_return"), ("trades", "trades"))}
    made = audit.groupBy(*KEYS).agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in cells.items()])
    def flipped(side: str) -> Column:
        a, b = F.col(f"{side}_train_ret"), F.col(f"{side}_test_ret")
        many = (F.col(f"{side}_train_trades") >= least) & (F.col(f"{side}_test_trades") >= least)
        return many & (F.signum(a) * F.signum(b) < 0)
    out = made.withColumns({"long_flipped": flipped("long"), "short_flipped": flipped("short")})
    return out.withColumn("consistent", ~(F.col("long_flipped") | F.col("short_flipped")))


def refreshed(population: DataFrame, paths: DataFrame) -> DataFrame:
    """One row a (series, strategy) with all its metrics (EV12, EV17): return, Sortino ratio and trades by split, path
    scores, mean and least Sortino ratio, and robust_return, the mean of the three returns."""
    def at(split: str, c: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(c)))
    cells = {f"{s}_{short}": at(s, c) for s in ("train", "val", "test") for short, c in (("return", "total_return"), ("sortino", "sortino"), ("trades", "trades"))}
    made = population.groupBy(*KEYS).agg(*[c.alias(n) for n, c in cells.items()])
    mean = lambda c: (F.col(f"train_{c}") + F.col(f"val_{c}") + F.col(f"test_{c}")) / 3
    least = F.least("train_sortino", "val_sortino", "test_sortino")
    return made.withColumns({"avg_sortino": mean("sortino"), "min_sortino": least, "robust_return": mean("return")}).join(paths.select(*KEYS, "cpcv_p5", "cpcv_min"), list(KEYS), "left")


def top_by(table: DataFrame, metric: str, n: int) -> DataFrame:
    """The ``n`` best rows, a report (EV12, AG14)."""
    return table.orderBy(F.desc_nulls_last(metric), *KEYS).limit(n)


def curves(returns: DataFrame) -> DataFrame:
    """Cumulative return of each (series, strategy) (EV12)."""
    w = Window.partitionBy(*KEYS).orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    return returns.select(*KEYS, "bar_id", F.sum("net_ret").over(w).alias("cumulative"))


def signal_decay(signals: DataFrame, lags: tuple[int, ...], least: int = 100) -> DataFrame:
    """(strategy_id, lag, n, corr): correlation of non-zero signals with forward returns (EV14). ``signals`` has close;
    pairs of fewer than ``least`` rows have no correlation."""
    w = Window.partitionBy(*KEYS).orderBy("bar_id")
    ahead = F.array(*[F.struct(F.lit(k).alias("lag"), (ratio(F.lead("close", k).over(w), "close") - 1).alias("ret")) for k in lags])
    rows = signals.withColumn("_r", ahead).where("signal <> 0").select("strategy_id", F.col("signal").cast("double").alias("signal"), F.explode("_r").alias("r")).select("strategy_id", "signal", "r.lag", "r.ret").where("ret is not null")
    corr = ratio(F.covar_samp("signal", "ret"), F.stddev_samp("signal") * F.stddev_samp("ret"))
    return rows.groupBy("strategy_id", "lag").agg(F.count("*").alias("n"), corr.alias("corr")).withColumn("corr", F.when(F.col("n") >= least, F.col("corr")))


def half_life(decay: DataFrame, least_peak: float = 0.01) -> DataFrame:
    """(strategy_id, peak, half_life): the first lag at which the correlation's size is at most half its peak, the longest
    lag if there is none, 0 without a peak (EV14). Lags are taken in their order."""
    held = decay.where("corr is not null").groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct("lag", F.abs("corr").alias("c")))).alias("_h"))  # a dozen lags
    peak = F.array_max(F.transform("_h", lambda s: s.c))
    first = F.try_element_at(F.filter("_h", lambda s: s.c <= peak / 2), F.lit(1)).getField("lag")
    return held.select("strategy_id", peak.alias("peak"), F.when(peak < least_peak, 0).otherwise(F.coalesce(first, F.array_max(F.transform("_h", lambda s: s.lag)))).cast("int").alias("half_life"))


def strong_pairs(matrix: DataFrame, most: float) -> DataFrame:
    """Pairs of a correlation matrix whose size is over ``most`` (EV16)."""
    return matrix.where(F.abs("corr") > most)
