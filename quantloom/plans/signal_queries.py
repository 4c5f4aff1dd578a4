"""Context columns, genes and votes over volume bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.frames import rounded
from quantloom.operators import signals as S
from quantloom.plans.feature_queries import RET_SQL, lagged, r, returns
from quantloom.plans.registry import query

O = "OVER (PARTITION BY series ORDER BY bar_id)"
W20 = "(PARTITION BY series ORDER BY bar_id ROWS 19 PRECEDING)"
CTX_SQL = f"""{RET_SQL}, c0 AS (SELECT *, row_number() {O} - 1 AS i, count(*) OVER (PARTITION BY series) AS n, coalesce(close - {lagged('close', 5)}, 0) AS d5,
  abs(close - {lagged('close')}) AS step, coalesce(close > {lagged('close')}, false) AS up, greatest(high - low, abs(high - {lagged('close')}), abs(low - {lagged('close')})) AS tr FROM ret),
ctx AS (SELECT *, d5 AS delta_close_5, CASE WHEN n > 10 THEN d5 - coalesce({lagged('d5', 5)}, 0) ELSE 0 END AS flux_close_5,
  CASE WHEN i >= 19 THEN coalesce(regr_slope(close, i) OVER {W20}, 0) ELSE 0 END AS slope_close_20, CASE WHEN i >= 19 THEN coalesce(regr_slope(volume, i) OVER {W20}, 0) ELSE 0 END AS slope_volume_20,
  CASE WHEN i >= 20 AND sum(step) OVER {W20} > 1e-9 THEN abs(close - {lagged('close', 20)}) / sum(step) OVER {W20} ELSE 0 END AS eff_close_20,
  CASE WHEN i >= 19 AND stddev_pop(close) OVER {W20} > 1e-9 THEN (close - avg(close) OVER {W20}) / stddev_pop(close) OVER {W20} ELSE 0 END AS zscore_close_20,
  CASE WHEN i >= 19 AND stddev_pop(close) OVER {W20} * stddev_pop(volume) OVER {W20} > 1e-9 THEN covar_pop(close, volume) OVER {W20} / (stddev_pop(close) OVER {W20} * stddev_pop(volume) OVER {W20}) ELSE 0 END AS corr_20,
  CASE WHEN up THEN i - coalesce(last_value(CASE WHEN NOT up THEN i END IGNORE NULLS) OVER (PARTITION BY series ORDER BY bar_id ROWS UNBOUNDED PRECEDING), -1) ELSE 0 END AS c_up,
  CASE WHEN NOT up THEN i - coalesce(last_value(CASE WHEN up THEN i END IGNORE NULLS) OVER (PARTITION BY series ORDER BY bar_id ROWS UNBOUNDED PRECEDING), -1) ELSE 0 END AS c_down,
  greatest(CASE WHEN i < 50 THEN tr ELSE avg(tr) OVER (PARTITION BY series ORDER BY bar_id ROWS 49 PRECEDING) END, close * 1.5e-4) AS atr_base,
  hour(time_start) AS hr, isodow(time_start) - 1 AS wd FROM c0)"""
KEYS = ["delta_close_5", "flux_close_5", "slope_close_20", "slope_volume_20", "eff_close_20", "zscore_close_20", "corr_close__volume_20", "consecutive_up", "consecutive_down", "atr_base", "hour", "weekday"]


@query(
    "ctx_columns",
    f"""WITH {CTX_SQL} SELECT series, bar_id, {', '.join(r(c, c) for c in ('delta_close_5', 'flux_close_5', 'slope_close_20', 'slope_volume_20', 'eff_close_20', 'zscore_close_20'))},
    {r('corr_20', 'corr_close__volume_20')}, CAST(c_up AS DOUBLE) AS consecutive_up, CAST(c_down AS DOUBLE) AS consecutive_down, {r('atr_base', 'atr_base')}, CAST(hr AS DOUBLE) AS hour, CAST(wd AS DOUBLE) AS weekday FROM ctx""",
)
def ctx_columns(spark, sf_dir):
    df = S.with_context(returns(spark, sf_dir), KEYS)
    return df.select("series", "bar_id", *[rounded(k).alias(k) for k in KEYS])


#: One gene of each type, with the SQL of its predicate over ``ctx`` (None where it isn't a plain expression).
GENES: dict[str, tuple[dict, str | None]] = {
    "zscore": ({"type": "zscore", "feature": "close", "window": 20, "operator": ">", "threshold": 1.0}, "zscore_close_20 > 1.0"),
    "relational": ({"type": "relational", "feature_left": "open", "feature_right": "close", "operator": "<"}, "open < close"),
    "cross": ({"type": "cross", "feature_left": "close", "feature_right": "open", "direction": "above"}, f"close - open > 0 AND lag(close - open) {O} <= 0"),
    "delta": ({"type": "delta", "feature": "close", "lookback": 5, "operator": ">", "threshold": 10.0}, "delta_close_5 > 10"),
    "flux": ({"type": "flux", "feature": "close", "lag": 5, "operator": "<", "threshold": 0.0}, "flux_close_5 < 0"),
    "divergence": ({"type": "divergence", "feature_a": "close", "feature_b": "volume", "window": 20}, "slope_close_20 * slope_volume_20 < 0"),
    "efficiency": ({"type": "efficiency", "feature": "close", "window": 20, "operator": ">", "threshold": 0.05}, "eff_close_20 > 0.05"),
    "correlation": ({"type": "correlation", "feature_a": "volume", "feature_b": "close", "window": 20, "operator": ">", "threshold": 0.1}, "corr_20 > 0.1"),
    "persistence": ({"type": "persistence", "feature": "close", "operator": ">", "threshold": 60.0, "window": 3}, f"count(*) OVER p = 3 AND sum((close > 60)::INT) OVER p = 3"),
    "event": ({"type": "event", "feature": "close", "operator": ">", "threshold": 400.0, "window": 3}, "count(*) OVER p = 3 AND sum((close > 400)::INT) OVER p > 0"),
    "validity": ({"type": "validity", "feature": "close", "operator": ">", "threshold": 100.0, "window": 3, "percentage": 0.7}, "count(*) OVER p = 3 AND sum((close > 100)::INT) OVER p >= 2"),
    "extrema": ({"type": "extrema", "feature": "high", "window": 3, "mode": "max"}, "count(high) OVER p = 3 AND high >= max(high) OVER p"),
    "proximity": ({"type": "proximity", "feature": "low", "window": 3, "mode": "min", "threshold": 0.5}, "count(low) OVER p = 3 AND abs(low - min(low) OVER p) <= 0.5"),
    "squeeze": ({"type": "squeeze", "feature_short": "low", "feature_long": "close", "multiplier": 0.2}, "low < close * 0.2"),
    "consecutive": ({"type": "consecutive", "direction": "up", "operator": ">", "count": 2}, "c_up > 2"),
    "time": ({"type": "time", "mode": "hour", "operator": "<", "value": 12}, "hr < 12"),
    "mean_reversion": ({"type": "mean_reversion", "feature": "close", "window": 20, "threshold": 0.5, "regime_feature": "ticket_imbalance", "regime_threshold": 0.0, "direction": "long"}, "ticket_imbalance > 0 AND zscore_close_20 < -0.5"),
    "seasonality": ({"type": "seasonality", "feature": "seasonal_deviation", "operator": ">", "threshold": 0.0}, "false"),
    "hysteresis": (
        {"type": "hysteresis", "feature": "volume", "operator": ">", "window": 10},
        """i >= 10 AND close > list_last(list_filter(list({'f': volume, 'c': close}) OVER (PARTITION BY series ORDER BY bar_id ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING),
        lambda s: abs(s.f - volume) < greatest(abs(volume) * 0.05, 1e-6))).c""",
    ),
}


@query(
    "gene_predicates",
    f"WITH {CTX_SQL} SELECT series, bar_id, {', '.join(f'coalesce({sql}, false) AS {name}' for name, (_, sql) in GENES.items())} FROM ctx WINDOW p AS (PARTITION BY series ORDER BY bar_id ROWS 2 PRECEDING)",
)
def gene_predicates(spark, sf_dir):
    keys = [k for g, _ in GENES.values() for k in S.needed(g)]
    df = S.with_context(returns(spark, sf_dir), keys)
    have = set(df.columns)
    return df.select("series", "bar_id", *[S.predicate(g, have).alias(n) for n, (g, _) in GENES.items()])


SOFT = {"type": "soft_zscore", "feature": "close", "window": 20, "operator": ">", "threshold": 0.5, "slope": 2.0}


@query("gene_soft_vote", f"WITH {CTX_SQL} SELECT series, bar_id, {r('1 / (1 + exp(-greatest(least(2.0 * (zscore_close_20 - 0.5), 10), -10)))', 'vote')} FROM ctx")
def gene_soft_vote(spark, sf_dir):
    df = S.with_context(returns(spark, sf_dir), S.needed(SOFT))
    return df.select("series", "bar_id", rounded(S.predicate(SOFT, set(df.columns))).alias("vote"))


STRATEGIES = [
    {"name": "trend", "long_genes": [GENES["delta"][0], GENES["relational"][0], GENES["consecutive"][0]], "short_genes": [GENES["flux"][0], GENES["squeeze"][0]], "horizon": 10},
    {"name": "revert", "long_genes": [GENES["mean_reversion"][0]], "short_genes": [GENES["zscore"][0], GENES["zscore"][0]], "horizon": 10},
]
_ALL = {n: f"coalesce({s}, false)::INT" for n, (_, s) in GENES.items()}
SIGNALS_SQL = f"""{CTX_SQL}, voted AS (SELECT series, bar_id, time_start, open, high, low, close, i,
  ({_ALL['delta']} + {_ALL['relational']} + {_ALL['consecutive']} >= 2)::INT - ({_ALL['flux']} + {_ALL['squeeze']} >= 1)::INT AS trend, {_ALL['mean_reversion']} - {_ALL['zscore']} AS revert FROM ctx),
signals AS (SELECT * FROM voted UNPIVOT (signal FOR strategy_id IN (trend, revert)))"""


@query("strategy_votes", f"WITH {SIGNALS_SQL} SELECT series, bar_id, strategy_id, signal::INT AS signal FROM signals")
def strategy_votes(spark, sf_dir):
    return S.signals(returns(spark, sf_dir), STRATEGIES)


@query(
    "strategy_safe_entries",
    f"""WITH {SIGNALS_SQL}, m AS (SELECT *, CASE WHEN hour(time_start) BETWEEN 8 AND 21 AND isodow(time_start) <= 5 AND hour(time_start) < 22 - 10 * 1.5 / 60 THEN signal ELSE 0 END AS safe FROM signals)
    SELECT series, bar_id, strategy_id, safe::INT AS safe, coalesce(lag(safe) OVER (PARTITION BY series, strategy_id ORDER BY bar_id), 0)::INT AS acts FROM m""",
)
def strategy_safe_entries(spark, sf_dir):
    bars = returns(spark, sf_dir)
    s = S.signals(bars, STRATEGIES).join(bars.select("series", "bar_id", "time_start"), ["series", "bar_id"])
    s = s.withColumn("safe", F.when(S.market_hours(s, 10), F.col("signal")).otherwise(0))
    return s.select("series", "bar_id", "strategy_id", "safe", S.next_open("safe", ("series", "strategy_id")).alias("acts"))
