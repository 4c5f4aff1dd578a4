"""Labels, simulation, evaluation and selection over the demonstration strategies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from quantloom.functions.frames import lag, ratio, rounded
from quantloom.operators import features as X
from quantloom.operators import labels as L
from quantloom.operators import signals as S
from quantloom.operators import simulate as M
from quantloom.operators import atlas as AT
from quantloom.operators import evaluation as V
from quantloom.operators import extra_trees as T
from quantloom.operators import statistics as E
from quantloom.operators.chunks import numbered
from quantloom.plans.feature_queries import BARS_SQL, lagged, over, r, returns
from quantloom.plans.registry import ORACLES, query
from quantloom.plans.signal_queries import _ALL, SIGNALS_SQL, STRATEGIES
from quantloom.plans.tape_queries import bars_of
from quantloom.sources.staging import staged

H = 10


@query(
    "label_triple_barrier",
    f"""WITH {BARS_SQL}, t AS (SELECT *, greatest(high - low, abs(high - {lagged('close')}), abs(low - {lagged('close')})) AS tr FROM bars),
    a AS (SELECT *, {over('avg', 'tr', 50)} AS atr0, list(high) OVER f AS hs, list(low) OVER f AS ls, lead(close, {H}) OVER (PARTITION BY series ORDER BY bar_id) AS fin FROM t
    WINDOW f AS (PARTITION BY series ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING)),
    b AS (SELECT *, close + greatest(atr0, close * 1.5 / 1e4) * 1.0 AS up, close - greatest(atr0, close * 1.5 / 1e4) * 0.5 AS down FROM a),
    c AS (SELECT *, list_position(list_transform(hs, lambda x: x >= up), true) AS u, list_position(list_transform(ls, lambda x: x <= down), true) AS d FROM b)
    SELECT series, bar_id, {r("CASE WHEN atr0 IS NOT NULL AND fin IS NOT NULL THEN (CASE WHEN coalesce(u, 0) = 0 AND coalesce(d, 0) = 0 THEN fin WHEN coalesce(u, 0) > 0 AND (coalesce(d, 0) = 0 OR u < d) THEN up ELSE down END - close) / nullif(close, 0) END", 'label')} FROM c""",
)
def label_triple_barrier(spark, sf_dir):
    df = L.triple_barrier(bars_of(spark, sf_dir), H, 1.0, 0.5)
    return df.select("series", "bar_id", rounded("label").alias("label"))


@query("label_forward_returns", f"WITH {BARS_SQL} SELECT series, bar_id, {', '.join(r(f'lead(close, {h}) OVER (PARTITION BY series ORDER BY bar_id) / nullif(close, 0) - 1', f'fwd_{h}') for h in (1, 5, 10))} FROM bars")
def label_forward_returns(spark, sf_dir):
    df = L.forward_returns(bars_of(spark, sf_dir), (1, 5, 10))
    return df.select("series", "bar_id", *[rounded(f"fwd_{h}").alias(f"fwd_{h}") for h in (1, 5, 10)])


RETURNS_SQL = f"""{SIGNALS_SQL}, act AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY series, strategy_id ORDER BY bar_id), 0)
  * coalesce(close / nullif(lag(close) OVER (PARTITION BY series, strategy_id ORDER BY bar_id), 0) - 1, 0) / 100 AS net_ret FROM signals)"""


def _bars(spark, sf_dir):
    """Bars with log returns, written once: signals and what the simulator needs of each bar are both read from them."""
    return staged(returns(spark, sf_dir), "bars")


def _acting(spark, sf_dir):
    bars = _bars(spark, sf_dir).withColumn("ret", F.coalesce(ratio("close", lag("close")) - 1, F.lit(0.0)) / 100)
    s = S.signals(bars, STRATEGIES).withColumn("signal", S.next_open(by=("series", "strategy_id")))
    return s, bars


def _predicted(spark, sf_dir):
    s, bars = _acting(spark, sf_dir)
    return M.prediction_returns(s.join(bars.select("series", "bar_id", "ret"), ["series", "bar_id"]))


@query("sim_prediction_mode", f"WITH {RETURNS_SQL} SELECT strategy_id, series, round(sum(net_ret), 6) AS total, CAST(sum(abs(signal)) AS BIGINT) AS wanted FROM act GROUP BY ALL")
def sim_prediction_mode(spark, sf_dir):
    s, bars = _acting(spark, sf_dir)
    raw = S.signals(returns(spark, sf_dir), STRATEGIES).groupBy("strategy_id", "series").agg(F.sum(F.abs("signal")).alias("wanted"))
    p = _predicted(spark, sf_dir).groupBy("strategy_id", "series").agg(F.round(F.sum("net_ret"), 6).alias("total"))
    return p.join(raw, ["strategy_id", "series"])


@query(
    "eval_metrics",
    f"""WITH {RETURNS_SQL}, c AS (SELECT *, sum(net_ret) OVER w AS c FROM act WINDOW w AS (PARTITION BY series, strategy_id ORDER BY bar_id ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, greatest(max(c) OVER (PARTITION BY series, strategy_id ORDER BY bar_id ROWS UNBOUNDED PRECEDING), 0) AS top FROM c)
    SELECT series, strategy_id, count(*) AS bars, {r('sum(net_ret)', 'total')}, {r('avg(net_ret) / (stddev_pop(net_ret) + 1e-9)', 'sharpe')},
    {r('avg(net_ret) / (sqrt(avg(pow(least(net_ret, 0), 2))) + 1e-9)', 'sortino', 4)}, {r('min(c - top)', 'drawdown')},
    {r('avg(net_ret) / (sqrt(avg(pow(least(net_ret, 0), 2))) + 1e-9) * CASE WHEN max(net_ret) / (abs(sum(net_ret)) + 1e-9) > 0.6 THEN 0.6 ELSE 1.0 END', 'adjusted', 4)} FROM d GROUP BY series, strategy_id""",
)
def eval_metrics(spark, sf_dir):
    m = E.metrics(_predicted(spark, sf_dir), ["series", "strategy_id"])
    return m.select("series", "strategy_id", "bars", *[rounded(c, 4 if c in ("sortino", "adjusted") else 6).alias(c) for c in ("total", "sharpe", "sortino", "drawdown", "adjusted")])


@query(
    "eval_hamming",
    f"""WITH {SIGNALS_SQL} SELECT a.strategy_id AS a, b.strategy_id AS b, count(*) FILTER (a.signal <> b.signal) AS differ, count(*) AS bars
    FROM signals a JOIN signals b ON a.series = b.series AND a.bar_id = b.bar_id AND a.strategy_id < b.strategy_id GROUP BY 1, 2""",
)
def eval_hamming(spark, sf_dir):
    return E.hamming(S.signals(returns(spark, sf_dir), STRATEGIES), [x["name"] for x in STRATEGIES])


FEATURES = ["ticket_imbalance", "volume", "open", "high", "low"]
LONG_SQL = f"""{BARS_SQL}, fw AS (SELECT *, lead(close, 5) OVER (PARTITION BY series ORDER BY bar_id) / nullif(close, 0) - 1 AS y FROM bars),
  long AS (SELECT series, bar_id, y, feature, value FROM (SELECT series, bar_id, y, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)} FROM fw) UNPIVOT (value FOR feature IN ({', '.join(FEATURES)})) WHERE y IS NOT NULL)"""


def _labelled(spark, sf_dir):
    return L.forward_returns(bars_of(spark, sf_dir), (5,)).withColumnRenamed("fwd_5", "y0")


_IC = "covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0)"


@query(
    "select_rank_ic",
    f"""WITH {LONG_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry, row_number() OVER (PARTITION BY feature ORDER BY series, bar_id) - 1 AS place, count(*) OVER (PARTITION BY feature) AS size FROM long),
    f AS (SELECT feature, least(floor(place / greatest(floor(size / 5), 1)), 4) AS fold, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS c FROM k GROUP BY 1, 2),
    s AS (SELECT feature, abs(avg(c)) / (stddev_pop(c) + 1e-6) AS stability FROM f GROUP BY 1)
    SELECT feature, count(*) AS n, {r(_IC, 'ic')}, {r('max(stability)', 'stability', 4)} FROM k JOIN s USING (feature) GROUP BY feature""",
)
def select_rank_ic(spark, sf_dir):
    return E.rank_ic(_labelled(spark, sf_dir), FEATURES, "y0").select("feature", "n", rounded("ic").alias("ic"), rounded("stability", 4).alias("stability"))


#: Two-sided p-value of Student's t by Simpson's rule over the density from 0 to |t|.
_T_SQL = """1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * t / 3 / 4000 * list_sum(list_transform(range(0, 4001), lambda i:
  (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2)))"""


@query(
    "select_gates",
    f"""WITH i AS ({ORACLES['select_rank_ic'].replace(r(_IC, 'ic'), _IC + ' AS ic')}), t AS (SELECT *, abs(ic) * sqrt((n - 2) / greatest(1 - ic * ic, 1e-12)) AS t, CAST(n - 2 AS DOUBLE) AS df FROM i), p AS (SELECT *, {_T_SQL} AS p FROM t)
    SELECT feature, n, round(ic, 5) + 0.0 AS ic, round(greatest(p, 0), 9) + 0.0 AS p, CASE WHEN coalesce(abs(ic), 0) < 0.005 THEN 'ic' WHEN coalesce(p, 1) > 0.05 THEN 'p' WHEN coalesce(stability, 0) < 0.25 THEN 'stability' ELSE 'keep' END AS verdict FROM p""",
)
def select_gates(spark, sf_dir):
    g = E.gates(E.rank_ic(_labelled(spark, sf_dir), FEATURES, "y0"))
    return g.select("feature", "n", rounded("ic", 5).alias("ic"), rounded("p", 9).alias("p"), "verdict")


#: The normal law below z by Simpson's rule over its density from 0 to |z|.
_CDF_SQL = """0.5 + sign(z) * least(abs(z), 40) / 3 / 4000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 4001), lambda i:
  (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(least(abs(z), 40) * i / 4000, 2) / 2)))"""


@query(
    "eval_deflated_sharpe",
    f"""WITH {RETURNS_SQL}, m AS (SELECT series, strategy_id, count(net_ret) AS bars, avg(net_ret) AS m, stddev_pop(net_ret) AS s FROM act GROUP BY 1, 2),
    c AS (SELECT series, strategy_id, any_value(bars) AS bars, any_value(m) AS m, any_value(s) AS s, avg(pow(net_ret - m, 3)) / nullif(pow(any_value(s), 3), 0) AS skew, avg(pow(net_ret - m, 4)) / nullif(pow(any_value(s), 4), 0) AS kurtosis FROM act JOIN m USING (series, strategy_id) GROUP BY 1, 2),
    d AS (SELECT *, CASE WHEN s > 0 THEN m / s * sqrt(252) ELSE 0 END AS sharpe, (SELECT count(DISTINCT strategy_id) FROM act) AS trials FROM c),
    z AS (SELECT *, sharpe / sqrt((1 - coalesce(skew, 0) * sharpe / sqrt(252) + (coalesce(kurtosis, 3) - 1) / 4 * sharpe * sharpe / 252) / (bars - 1) * 252) - CASE WHEN trials < 2 THEN 0 ELSE sqrt(2 * ln(trials)) END AS z FROM d)
    SELECT series, strategy_id, bars, {r('sharpe', 'sharpe')}, {r('skew', 'skew', 5)}, {r('kurtosis', 'kurtosis', 4)}, {r(_CDF_SQL, 'deflated', 9)} FROM z""",
)
def eval_deflated_sharpe(spark, sf_dir):
    """Sharpe ratios deflated by the number of strategies tried (EV08)."""
    t = E.deflated_table(_predicted(spark, sf_dir), ["series", "strategy_id"], len(STRATEGIES), 252)
    return t.select("series", "strategy_id", "bars", *[rounded(c, d).alias(c) for c, d in (("sharpe", 6), ("skew", 5), ("kurtosis", 4), ("deflated", 9))])


def purged_sql(horizon: int) -> str:
    """Scores on purged splits: bars by bar, against the test folds of each split."""
    return f"""WITH {RETURNS_SQL}, k AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY series, strategy_id) AS n FROM act WINDOW w AS (PARTITION BY series, strategy_id ORDER BY bar_id)),
    pairs AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS split, x, y FROM range(6) AS p(x), range(6) AS q(y) WHERE x < y),
    j AS (SELECT k.*, split, x, y, n // 6 AS size, CAST(floor(n * 0.02) AS BIGINT) AS gap, least(k // greatest(n // 6, 1), 5) AS fold FROM k, pairs),
    e AS (SELECT *, fold IN (x, y) AS tested, fold * size AS a, CASE WHEN fold < 5 THEN (fold + 1) * size ELSE n END - 1 AS b FROM j),
    t AS (SELECT *, [x * size, y * size] AS ta, [(x + 1) * size - 1, CASE WHEN y < 5 THEN (y + 1) * size ELSE n END - 1] AS tb FROM e),
    v AS (SELECT *, len(list_filter(tb, lambda u: a > u AND a - u <= gap + 1)) > 0 AS after, len(list_filter(ta, lambda u: b < u AND u - b <= gap + 1)) > 0 AS before,
      {horizon} > 0 AND len(list_filter([1, 2], lambda u: k < tb[u] + 1 AND k + {horizon} >= ta[u])) > 0 AS reaches FROM t),
    c AS (SELECT *, CASE WHEN tested THEN 'test' WHEN k >= a + CASE WHEN after THEN gap ELSE 0 END AND k <= b - CASE WHEN before THEN gap ELSE 0 END AND NOT reaches THEN 'train' END AS role FROM v)
    SELECT series, strategy_id, split, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'test') AS test_rows,
    {', '.join(r(f"coalesce(avg(net_ret) FILTER (role = '{s}') / nullif(stddev_pop(net_ret) FILTER (role = '{s}'), 0), 0)", f'{s}_sharpe') for s in ('train', 'test'))} FROM c GROUP BY ALL"""


def _purged(spark, sf_dir, horizon):
    t = E.purged_scores(_predicted(spark, sf_dir), ["series", "strategy_id"], embargo=0.02, horizon=horizon)
    return t.select("series", "strategy_id", "split", "train_rows", "test_rows", rounded("train_sharpe").alias("train_sharpe"), rounded("test_sharpe").alias("test_sharpe"))


@query("eval_purged_splits", purged_sql(0))
def eval_purged_splits(spark, sf_dir):
    """Train and test scores on the fifteen purged splits, an embargo of 2 % at test folds (EV06)."""
    return _purged(spark, sf_dir, 0)


@query("eval_purged_labels", purged_sql(10))
def eval_purged_labels(spark, sf_dir):
    """The same without training bars whose labels, ten bars long, reach into a test fold."""
    return _purged(spark, sf_dir, 10)


@query(
    "select_decile_ic",
    f"""WITH {LONG_SQL}, e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{', '.join(str(i / 10) for i in range(11))}]))) AS edges FROM long GROUP BY 1),
    b AS (SELECT long.feature, greatest(len(list_filter(edges, lambda x: x < value)) - 1, 0) AS bin, avg(y) AS mean_y FROM long JOIN e ON long.feature = e.feature GROUP BY 1, 2)
    SELECT feature, {r('covar_samp(bin, mean_y) / nullif(stddev_samp(bin) * stddev_samp(mean_y), 0)', 'ic')}, count(*) AS bins FROM b GROUP BY feature""",
)
def select_decile_ic(spark, sf_dir):
    return E.decile_ic(_labelled(spark, sf_dir), FEATURES, "y0").select("feature", rounded("ic").alias("ic"), "bins")


@query(
    "select_best_horizon",
    f"""WITH {BARS_SQL}, fw AS (SELECT *, {', '.join(f'lead(close, {h}) OVER (PARTITION BY series ORDER BY bar_id) / nullif(close, 0) - 1 AS fwd_{h}' for h in (1, 5, 10))} FROM bars),
    c AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, 'fwd_{h}' AS horizon, covar_samp({f}, fwd_{h}) / nullif(stddev_samp(CASE WHEN fwd_{h} IS NOT NULL THEN {f} END) * stddev_samp(fwd_{h}), 0) AS corr, count(fwd_{h}) AS n FROM fw" for f in FEATURES for h in (1, 5, 10))})
    SELECT feature, arg_max(horizon, (abs(corr), horizon)) AS horizon, {r('arg_max(corr, (abs(corr), horizon))', 'corr')} FROM c WHERE n >= 100 GROUP BY feature""",
)
def select_best_horizon(spark, sf_dir):
    df = L.forward_returns(bars_of(spark, sf_dir), (1, 5, 10))
    return E.best_horizon(df, FEATURES, ["fwd_1", "fwd_5", "fwd_10"], 100).select("feature", "horizon", rounded("corr").alias("corr"))


def _raw_orders(spark, sf_dir):
    """Orders of the demonstration strategies; signals act on the bar they come from."""
    made = _bars(spark, sf_dir)
    bars = S.with_context(made, ["atr_base", "hour", "weekday"])
    bars = bars.withColumn("atr", F.coalesce(lag("atr_base"), F.col("atr_base"))).withColumn("price", F.col("open"))
    s = S.signals(made, STRATEGIES)
    return s.join(bars.select("series", "bar_id", "price", "high", "low", "close", "atr", "hour", "weekday"), ["series", "bar_id"])


def _orders(spark, sf_dir):
    return V.shifted(_raw_orders(spark, sf_dir), V.KEYS)


RULES = M.Rules(sl_long=0.5, sl_short=0.5, tp_long=1.0, tp_short=1.0, horizon=10, cooldown=3, lot=1.0, account=1000.0)
ORDERS_SQL = f"""{SIGNALS_SQL}, orders0 AS (SELECT s.series, s.strategy_id, s.bar_id, CAST(s.signal AS DOUBLE) AS signal, c.open AS price, c.high, c.low, c.close,
  coalesce(lag(c.atr_base) OVER (PARTITION BY s.series, s.strategy_id ORDER BY s.bar_id), c.atr_base) AS atr, c.hr AS hour, c.wd AS weekday,
  row_number() OVER (PARTITION BY s.series, s.strategy_id ORDER BY s.bar_id) - 1 AS k, count(*) OVER (PARTITION BY s.series, s.strategy_id) AS n FROM signals s JOIN ctx c ON s.series = c.series AND s.bar_id = c.bar_id),
acting AS (SELECT * REPLACE (coalesce(lag(signal) OVER (PARTITION BY series, strategy_id ORDER BY bar_id), 0) AS signal) FROM orders0)"""


def slice_sql(view: str, source: str, keys: list[str], shift: bool = False) -> str:
    """``view``: ``source`` with i, the place in its slice, and the signal shifted within it if wished."""
    w = f"(PARTITION BY {', '.join(keys)} ORDER BY bar_id)"
    signal = f"coalesce(lag(signal) OVER {w}, 0)" if shift else "signal"
    return f"{view} AS (SELECT * REPLACE ({signal} AS signal), CAST(row_number() OVER {w} - 1 AS BIGINT) AS i FROM {source})"


def sim_sql(view: str, source: str, keys: list[str], detailed: bool = False, sl: str | float | None = None, tp: str | float | None = None) -> str:
    """The simulation under RULES as a recursion over the bars of each group of ``source``: {view}_s has the state after
    each bar, {view} the net returns."""
    k, ks = ", ".join(keys), lambda t: ", ".join(f"{t}.{c}" for c in keys)
    first = "NOT closed AND NOT late AND " if detailed else ""
    before_time = "" if detailed else "NOT hs AND NOT hg AND "
    R = RULES
    return f"""{view}_d AS (SELECT *, lag(high) OVER g AS h1, lag(low) OVER g AS l1, lag(atr) OVER g AS a1, hour >= {R.close_hour} OR weekday >= 5 AS closed FROM {source} WINDOW g AS (PARTITION BY {k} ORDER BY i)),
{view}_s AS (SELECT {k}, bar_id, i, CASE WHEN closed THEN 0 ELSE sign(signal) END AS pos, price AS ep, atr AS ea, CAST(0 AS BIGINT) AS ei, CAST(0 AS BIGINT) AS cd, CAST(0 AS DOUBLE) AS ex,
  CASE WHEN closed OR signal = 0 THEN 0 ELSE price END AS fill, '' AS reason FROM {view}_d WHERE i = 0
  UNION ALL
  SELECT {k}, bar_id, i, CASE WHEN gone THEN 0 WHEN turn OR enter THEN sign(signal) ELSE p END, CASE WHEN turn OR enter THEN price ELSE ep END, CASE WHEN turn OR enter THEN atr ELSE ea END, CASE WHEN turn OR enter THEN i ELSE ei END,
    CASE WHEN hs THEN {R.cooldown} ELSE cd END, CASE WHEN hs THEN ep - p * ea * tight WHEN hg THEN ep + p * ea * goal ELSE 0 END, CASE WHEN turn OR enter THEN price ELSE 0 END,
    CASE WHEN hs THEN 'stop' WHEN hg THEN 'target' WHEN gone AND closed THEN 'close' WHEN gone THEN 'time' WHEN turn THEN 'reverse' ELSE '' END
  FROM (SELECT *, p <> 0 AND NOT gone AND signal <> 0 AND sign(signal) <> p AS turn, p = 0 AND NOT closed AND signal <> 0 AND cd = 0 AS enter
    FROM (SELECT *, p <> 0 AND (hs OR hg OR closed OR late) AS gone
      FROM (SELECT *, {first}hs0 AS hs, {first}NOT hs0 AND hg0 AS hg FROM (SELECT *, p <> 0 AND i - ei >= {R.horizon} AS late,
        p <> 0 AND tight > 0 AND CASE WHEN p > 0 THEN l1 <= ep - ea * tight ELSE h1 >= ep + ea * tight END AS hs0, p <> 0 AND goal > 0 AND CASE WHEN p > 0 THEN h1 >= ep + ea * goal ELSE l1 <= ep - ea * goal END AS hg0
        FROM (SELECT d.*, s.pos AS p, s.ep, s.ea, s.ei, greatest(s.cd - 1, 0) AS cd, CASE WHEN d.a1 > 0 AND s.ea > 0 AND d.a1 > {R.tighten_over} * s.ea THEN {R.tighten} ELSE 1.0 END * {R.sl_long if sl is None else sl} AS tight, {R.tp_long if tp is None else tp} AS goal
          FROM {view}_s s JOIN {view}_d d ON {' AND '.join(f's.{c} = d.{c}' for c in keys)} AND d.i = s.i + 1))))) q),
{view} AS (SELECT *, (before * {R.lot} * (xp - last) - CASE WHEN abs(pos - before) < 1e-6 THEN 0 ELSE abs(pos - before) * {R.lot} * xp * 0.5 * {R.spread} + greatest({R.least_commission}, abs(pos - before) * {R.lot} * xp * {R.commission})
  + {R.slippage} * atr * {R.lot} * abs(pos - before) END) / {R.account} AS net_ret, before = 0 AND pos <> 0 AS entered FROM (SELECT {ks('s')}, s.bar_id, s.i, s.pos, s.fill, s.reason, s.ex, d.price, d.atr, coalesce(lag(s.pos) OVER g, 0) AS before,
  CASE WHEN s.ex <> 0 THEN s.ex ELSE d.price END AS xp, coalesce({"lag(d.price) OVER g" if detailed else "CASE WHEN lag(s.fill) OVER g <> 0 THEN lag(s.fill) OVER g ELSE lag(d.price) OVER g END"}, d.price) AS last
  FROM {view}_s s JOIN {view}_d d ON {' AND '.join(f's.{c} = d.{c}' for c in keys)} AND s.i = d.i WINDOW g AS (PARTITION BY {ks('s')} ORDER BY s.i)))"""


SK = ["series", "strategy_id"]
_W = "WITH RECURSIVE "


@query("sim_barrier_returns", f"{_W}{ORDERS_SQL}, {slice_sql('whole', 'acting', SK)}, {sim_sql('sim', 'whole', SK)} SELECT series, strategy_id, bar_id, round(net_ret, 6) + 0.0 AS net_ret, CAST(pos AS DOUBLE) AS position FROM sim")
def sim_barrier_returns(spark, sf_dir):
    return M.net_returns(_orders(spark, sf_dir), RULES).select("series", "strategy_id", "bar_id", rounded("net_ret").alias("net_ret"), "position")


_TRADES_SQL = """e AS (SELECT *, row_number() OVER (PARTITION BY series, strategy_id ORDER BY i) AS m FROM sim WHERE fill <> 0), x AS (SELECT *, row_number() OVER (PARTITION BY series, strategy_id ORDER BY i) AS m FROM sim WHERE reason <> ''),
  z AS (SELECT series, strategy_id, max(bar_id) AS bar_id, arg_max(price, i) AS price FROM sim GROUP BY 1, 2)"""


@query(
    "sim_trades",
    f"""{_W}{ORDERS_SQL}, {slice_sql('whole', 'acting', SK)}, {sim_sql('sim', 'whole', SK, True)}, {_TRADES_SQL},
    t AS (SELECT e.series, e.strategy_id, e.bar_id AS entry_bar, coalesce(x.bar_id, z.bar_id) AS exit_bar, CAST(e.pos AS DOUBLE) AS side, coalesce(x.reason, 'open') AS reason, e.fill AS entry_price, coalesce(x.xp, z.price) AS exit_price
    FROM e LEFT JOIN x ON e.series = x.series AND e.strategy_id = x.strategy_id AND e.m = x.m JOIN z ON e.series = z.series AND e.strategy_id = z.strategy_id)
    SELECT series, strategy_id, entry_bar, exit_bar, side, reason, entry_price, round(exit_price, 6) AS exit_price, round(side * (exit_price - entry_price), 6) + 0.0 AS gross FROM t""",
)
def sim_trades(spark, sf_dir):
    t = M.trades(_orders(spark, sf_dir), RULES)
    return t.select("series", "strategy_id", "entry_bar", "exit_bar", "side", "reason", "entry_price", F.round("exit_price", 6).alias("exit_price"), rounded("gross").alias("gross"))


_PLACES_SQL = "places AS (SELECT series, bar_id, row_number() OVER (PARTITION BY series ORDER BY bar_id) - 1 AS place, CAST(time_start AS TIMESTAMP) AS time, close FROM bars)"
_ATLAS_SQL = f"""tr AS ({{trades}}), tp AS (SELECT tr.series, strategy_id, side, reason, a.place AS entry_place, b.place AS exit_place FROM tr JOIN places a ON a.series = tr.series AND a.bar_id = tr.entry_bar JOIN places b ON b.series = tr.series AND b.bar_id = tr.exit_bar),
  late AS (SELECT tp.*, n FROM tp JOIN (SELECT series, count(*) AS n FROM places GROUP BY 1) c ON c.series = tp.series WHERE entry_place >= floor(n * 0.6)),
  nt AS (SELECT *, row_number() OVER (PARTITION BY series, strategy_id ORDER BY entry_place, exit_place) AS trade FROM late QUALIFY trade <= 50),
  ar AS (SELECT nt.*, p.place, p.time, p.close FROM nt JOIN places p ON p.series = nt.series AND p.place >= entry_place - 30 AND p.place < exit_place + 30)"""


def _atlas(spark, sf_dir):
    """Trades that begin after the training part, with the bars around them."""
    bars = numbered(bars_of(spark, sf_dir), ["series"], [F.floor(F.col("bar_id") / 200_000)], ["bar_id"], "place")
    bars = bars.select("series", "bar_id", "place", F.col("time_start").alias("time"), "close")
    t = M.trades(_orders(spark, sf_dir), RULES)
    for end in ("entry", "exit"):
        t = t.join(bars.select("series", F.col("bar_id").alias(f"{end}_bar"), F.col("place").alias(f"{end}_place")), ["series", f"{end}_bar"])
    sizes = bars.groupBy("series").agg(F.count("*").alias("n"))
    late = t.join(sizes, "series").where(F.col("entry_place") >= F.floor(F.col("n") * 0.6)).select("series", "strategy_id", "entry_bar", "exit_bar", "entry_place", "exit_place", "side", "reason")
    return AT.around(AT.numbered_trades(late), bars)


_TRADES_ONLY = "SELECT e.series, e.strategy_id, e.bar_id AS entry_bar, coalesce(x.bar_id, z.bar_id) AS exit_bar, CAST(e.pos AS DOUBLE) AS side, coalesce(x.reason, 'open') AS reason FROM e LEFT JOIN x ON e.series = x.series AND e.strategy_id = x.strategy_id AND e.m = x.m JOIN z ON e.series = z.series AND e.strategy_id = z.strategy_id"
_ATLAS = f"{_W}{ORDERS_SQL}, {slice_sql('whole', 'acting', SK)}, {sim_sql('sim', 'whole', SK, True)}, {_TRADES_SQL}, {_PLACES_SQL}, {_ATLAS_SQL.format(trades=_TRADES_ONLY)}"


@query(
    "report_trade_atlas",
    f"""{_ATLAS} SELECT series, strategy_id, trade, side, place, time, close, place - entry_place AS "offset", place BETWEEN entry_place AND exit_place AS active,
    CASE WHEN place = entry_place THEN 'ENTRY' WHEN place = exit_place THEN upper(reason) END AS mark FROM ar""",
)
def report_trade_atlas(spark, sf_dir):
    """Each late trade with thirty bars before and after it (GA14)."""
    return _atlas(spark, sf_dir).select("series", "strategy_id", "trade", "side", "place", F.col("time").cast("timestamp_ntz").alias("time"), "close", "offset", "active", "mark")


@query("report_atlas_frames", f"{_ATLAS}, fr AS (SELECT series, strategy_id, trade, count(*) AS bars, min(close) AS a, max(close) AS b FROM ar GROUP BY 1, 2, 3) SELECT series, strategy_id, trade, bars, {r('a - CASE WHEN b > a THEN b - a ELSE a * 0.001 END * 0.15', 'bottom')}, {r('b + CASE WHEN b > a THEN b - a ELSE a * 0.001 END * 0.15', 'top')} FROM fr")
def report_atlas_frames(spark, sf_dir):
    """The price frame of each late trade's chart (GA14)."""
    f = AT.frames(_atlas(spark, sf_dir))
    return f.select("series", "strategy_id", "trade", "bars", rounded("bottom").alias("bottom"), rounded("top").alias("top"))


@query("sim_equity", f"{_W}{ORDERS_SQL}, {slice_sql('whole', 'acting', SK)}, {sim_sql('sim', 'whole', SK, True)} SELECT series, strategy_id, bar_id, round(1000.0 + 1000.0 * sum(net_ret) OVER (PARTITION BY series, strategy_id ORDER BY i ROWS UNBOUNDED PRECEDING), 4) AS equity FROM sim")
def sim_equity(spark, sf_dir):
    return M.equity(_orders(spark, sf_dir), RULES, RULES.account).withColumn("equity", F.round("equity", 4))


def mutex_sql(source: str = "acting", keys: tuple[str, ...] = ("series",)) -> str:
    """The shared account under RULES for the strategies trend (first) and revert, by group of ``keys``."""
    k = ", ".join(keys)
    R = RULES
    price = lambda x: f"{R.lot} * {x} * 0.5 * {R.spread} + greatest({R.least_commission}, {R.lot} * {x} * {R.commission}) + {R.slippage} * atr * {R.lot}"
    return f"""md0 AS (SELECT {k}, bar_id, price, high, low, atr, hour, weekday, max(CASE WHEN strategy_id = 'trend' THEN signal END) AS g0, max(CASE WHEN strategy_id = 'revert' THEN signal END) AS g1 FROM {source} GROUP BY ALL),
md AS (SELECT *, row_number() OVER g - 1 AS i, lag(high) OVER g AS h1, lag(low) OVER g AS l1, lag(atr) OVER g AS a1, lag(price) OVER g AS p1, hour >= {R.close_hour} OR weekday >= 5 AS closed FROM md0 WINDOW g AS (PARTITION BY {k} ORDER BY bar_id)),
ms AS (SELECT {k}, bar_id, CAST(i AS BIGINT) AS i, -1 AS own, CAST(0 AS DOUBLE) AS pos, price AS ep, atr AS ea, CAST(0 AS BIGINT) AS ei, CAST(0 AS BIGINT) AS c0, CAST(0 AS BIGINT) AS c1, CAST(0 AS DOUBLE) AS net, -1 AS who FROM md WHERE i = 0
  UNION ALL
  SELECT {k}, bar_id, i, CASE WHEN gone THEN -1 WHEN e0 THEN 0 WHEN e1 THEN 1 ELSE own END, CASE WHEN gone THEN 0 WHEN e0 THEN sign(g0) WHEN e1 THEN sign(g1) ELSE p END, CASE WHEN e0 OR e1 THEN price ELSE ep END, CASE WHEN e0 OR e1 THEN atr ELSE ea END,
    CASE WHEN e0 OR e1 THEN i ELSE ei END, CASE WHEN stopped AND own = 0 THEN {R.cooldown} WHEN p = 0 OR own = 0 THEN greatest(c0 - 1, 0) ELSE c0 END,
    CASE WHEN stopped AND own = 1 THEN {R.cooldown} WHEN own = 1 OR (p = 0 AND NOT e0) THEN greatest(c1 - 1, 0) ELSE c1 END,
    (p * {R.lot} * (xp - p1) - CASE WHEN gone OR e0 OR e1 THEN {price('xp')} ELSE 0 END) / {R.account}, CASE WHEN p <> 0 THEN own WHEN e0 THEN 0 WHEN e1 THEN 1 ELSE -1 END
  FROM (SELECT *, CASE WHEN stopped THEN ep - p * ea * {R.sl_long} WHEN hg AND NOT closed THEN ep + p * ea * {R.tp_long} ELSE price END AS xp, p = 0 AND NOT closed AND g1 <> 0 AND c1 <= 1 AND NOT e0 AS e1
    FROM (SELECT *, p <> 0 AND (late OR hs OR hg OR closed) AS gone, hs AND NOT closed AS stopped, p = 0 AND NOT closed AND g0 <> 0 AND c0 <= 1 AS e0
      FROM (SELECT *, NOT late AND hs0 AS hs, NOT late AND NOT hs0 AND hg0 AS hg FROM (SELECT *, p <> 0 AND i - ei >= {R.horizon} AS late,
        p <> 0 AND CASE WHEN p > 0 THEN l1 <= ep - ea * tight ELSE h1 >= ep + ea * tight END AS hs0, p <> 0 AND CASE WHEN p > 0 THEN h1 >= ep + ea * {R.tp_long} ELSE l1 <= ep - ea * {R.tp_long} END AS hg0
        FROM (SELECT d.*, s.own, s.pos AS p, s.ep, s.ea, s.ei, s.c0, s.c1, CASE WHEN d.a1 > 0 AND s.ea > 0 AND d.a1 > {R.tighten_over} * s.ea THEN {R.tighten} ELSE 1.0 END * {R.sl_long} AS tight FROM ms s JOIN md d ON {' AND '.join(f's.{c} = d.{c}' for c in keys)} AND d.i = s.i + 1))))) q)"""


@query("sim_mutex", f"{_W}{ORDERS_SQL}, {mutex_sql()} SELECT series, bar_id, who AS owner, round(net, 6) + 0.0 AS net_ret FROM ms")
def sim_mutex(spark, sf_dir):
    m = M.mutex_returns(_orders(spark, sf_dir), ["trend", "revert"], {"trend": RULES, "revert": RULES})
    owner = F.coalesce(F.max(F.when(F.col("owns"), F.when(F.col("strategy_id") == "trend", 0).otherwise(1))), F.lit(-1))
    return m.groupBy("series", "bar_id").agg(owner.alias("owner"), rounded(F.sum("net_ret")).alias("net_ret"))


_RUNS_SQL = """r0 AS (SELECT *, row_number() OVER w - 1 AS i, signal <> 0 AS on_, coalesce(lag(signal) OVER w <> 0, false) AS was FROM signals WINDOW w AS (PARTITION BY series, strategy_id ORDER BY bar_id)),
  r1 AS (SELECT *, lead(bar_id) OVER w AS exit_bar, lead(i) OVER w AS j FROM r0 WHERE on_ <> was WINDOW w AS (PARTITION BY series, strategy_id ORDER BY bar_id)),
  runs AS (SELECT series, strategy_id, bar_id AS entry_bar, exit_bar, least(j - i, 5) AS duration FROM r1 WHERE on_ AND j IS NOT NULL)"""


@query("sim_durations", f"WITH {SIGNALS_SQL}, {_RUNS_SQL} SELECT * FROM runs")
def sim_durations(spark, sf_dir):
    return M.signal_runs(S.signals(returns(spark, sf_dir), STRATEGIES), 5)


@query("eval_durations", f"WITH {SIGNALS_SQL}, {_RUNS_SQL} SELECT strategy_id, round(avg(duration), 6) AS mean, quantile_cont(duration, 0.5) AS median, max(duration) AS longest, count(*) AS n FROM runs GROUP BY 1")
def eval_durations(spark, sf_dir):
    d = M.signal_runs(S.signals(returns(spark, sf_dir), STRATEGIES), 5)
    return d.groupBy("strategy_id").agg(F.round(F.avg("duration"), 6).alias("mean"), F.percentile("duration", F.lit(0.5)).alias("median"), F.max("duration").alias("longest"), F.count("*").alias("n"))


@query(
    "sim_costs",
    f"""WITH {BARS_SQL} SELECT series, bar_id, {r('CASE WHEN tick_count < 1e-6 THEN 0 ELSE tick_count * close * 0.5 * 5e-5 + greatest(2.0, tick_count * close * 2e-5) + 0.1 * (high - low) * tick_count END', 'cost', 8)} FROM bars""",
)
def sim_costs(spark, sf_dir):
    b = bars_of(spark, sf_dir)
    return b.select("series", "bar_id", rounded(M.cost(F.col("tick_count").cast("double"), F.col("close"), F.col("high") - F.col("low"), RULES), 8).alias("cost"))


_DOWN = "sqrt(avg(pow(least(net_ret, 0), 2)))"
_SPLIT = "CASE WHEN k < floor(n * 0.6) THEN 'train' WHEN k < floor(n * 0.8) THEN 'val' ELSE 'test' END"
POPULATION_SQL = f"""{ORDERS_SQL}, sp AS (SELECT *, {_SPLIT} AS split FROM orders0), {slice_sql('cut', 'sp', [*SK, 'split'], True)}, {sim_sql('sim', 'cut', [*SK, 'split'])},
  pt AS (SELECT series, strategy_id, split, sum(net_ret) AS total_return, avg(net_ret) / (stddev_pop(net_ret) + 1e-9) AS sharpe, max(net_ret) / (abs(sum(net_ret)) + 1e-9) AS stability, CAST(sum(entered::INT) AS BIGINT) AS trades,
  avg(net_ret) / greatest({_DOWN}, 1e-9) * CASE WHEN max(net_ret) / (abs(sum(net_ret)) + 1e-9) > 0.6 THEN 0.6 ELSE 1.0 END AS sortino FROM sim GROUP BY 1, 2, 3)"""


@query("eval_population", f"{_W}{POPULATION_SQL} SELECT series, strategy_id, split, trades, {', '.join(r(c, c, 5) for c in ('total_return', 'sharpe', 'sortino', 'stability'))} FROM pt")
def eval_population(spark, sf_dir):
    t = V.population_table(_raw_orders(spark, sf_dir), RULES)
    return t.select("series", "strategy_id", "split", "trades", *[rounded(c, 5).alias(c) for c in ("total_return", "sharpe", "sortino", "stability")])


@query(
    "eval_walk_forward",
    f"""{_W}{ORDERS_SQL}, dv AS (SELECT *, floor(n * 0.8) AS dev FROM orders0), st AS (SELECT *, floor(dev * 0.11) AS step, floor(dev * 0.55) AS win FROM dv), fo AS (SELECT *, unnest(range(0, 5)) AS fold FROM st),
    fr AS (SELECT *, least(fold * step + win + step, dev) AS stop FROM fo), fi AS (SELECT * FROM fr WHERE k >= stop - step AND k < stop), {slice_sql('cut', 'fi', [*SK, 'fold'], True)}, {sim_sql('sim', 'cut', [*SK, 'fold'])},
    f AS (SELECT series, strategy_id, fold, avg(net_ret) / greatest({_DOWN}, 1e-9) * CASE WHEN sum(net_ret) > 0 AND max(net_ret) / (sum(net_ret) + 1e-9) > 0.6 THEN 0.6 ELSE 1.0 END AS s, sum(entered::INT) AS t FROM sim GROUP BY 1, 2, 3)
    SELECT series, strategy_id, {r('avg(s) - stddev_pop(s) * 0.5', 'score', 5)}, {r('avg(s)', 'avg_sortino', 5)}, {r('min(s)', 'min_sortino', 5)}, {r('stddev_pop(s)', 'fold_std', 5)}, {r('avg(t)', 'avg_trades')} FROM f GROUP BY 1, 2""",
)
def eval_walk_forward(spark, sf_dir):
    t = V.walk_forward_scores(_raw_orders(spark, sf_dir), RULES)
    return t.select("series", "strategy_id", *[rounded(c, 5).alias(c) for c in ("score", "avg_sortino", "min_sortino", "fold_std")], rounded("avg_trades").alias("avg_trades"))


_PATHS = [(p, f) for p, c in enumerate(combinations(range(6), 2)) for f in c]
PATHS_SQL = f"""pf AS (SELECT * FROM (VALUES {', '.join(map(str, _PATHS))}) v(path, fold)), ap AS (SELECT a.*, path FROM acting a JOIN pf ON pf.fold = least(floor(k / greatest(floor(n / 6), 1)), 5)),
  {slice_sql('stitched', 'ap', [*SK, 'path'])}, {sim_sql('psim', 'stitched', [*SK, 'path'])}, each_path AS (SELECT series, strategy_id, path, avg(net_ret) / ({_DOWN} + 1e-9) AS s FROM psim GROUP BY 1, 2, 3),
  cp AS (SELECT series, strategy_id, quantile_cont(s, 0.05) AS cpcv_p5, quantile_cont(s, 0.5) AS cpcv_median, stddev_pop(s) AS cpcv_std, min(s) AS cpcv_min, count(*) AS paths FROM each_path GROUP BY 1, 2)"""


@query("eval_cpcv_paths", f"{_W}{ORDERS_SQL}, {PATHS_SQL} SELECT series, strategy_id, {', '.join(r(c, c, 5) for c in ('cpcv_p5', 'cpcv_median', 'cpcv_std', 'cpcv_min'))}, paths FROM cp")
def eval_cpcv_paths(spark, sf_dir):
    t = V.path_scores(_raw_orders(spark, sf_dir), RULES)
    return t.select("series", "strategy_id", *[rounded(c, 5).alias(c) for c in ("cpcv_p5", "cpcv_median", "cpcv_std", "cpcv_min")], "paths")


AUDIT_SQL = f"""{ORDERS_SQL}, sides AS (SELECT * REPLACE (CASE side WHEN 'long' THEN greatest(signal, 0) WHEN 'short' THEN least(signal, 0) ELSE signal END AS signal), {_SPLIT} AS split FROM (SELECT *, unnest(['total', 'long', 'short']) AS side FROM acting)),
  {slice_sql('cut', 'sides', [*SK, 'split', 'side'])}, {sim_sql('sim', 'cut', [*SK, 'split', 'side'])},
  cum AS (SELECT *, sum(net_ret) OVER w AS c FROM sim WINDOW w AS (PARTITION BY series, strategy_id, split, side ORDER BY i ROWS UNBOUNDED PRECEDING)), top AS (SELECT *, c - max(c) OVER (PARTITION BY series, strategy_id, split, side ORDER BY i ROWS UNBOUNDED PRECEDING) AS dd FROM cum),
  au AS (SELECT series, strategy_id, split, side, CAST(sum(entered::INT) AS BIGINT) AS trades, sum(net_ret) AS total_return, avg(net_ret) * 252 AS ann_return, CASE WHEN {_DOWN} < 1e-9 THEN 0 ELSE avg(net_ret) * sqrt(252) / {_DOWN} END AS sortino, min(dd) AS max_drawdown FROM top GROUP BY 1, 2, 3, 4)"""


@query("eval_sides", f"{_W}{AUDIT_SQL} SELECT series, strategy_id, split, side, trades, {', '.join(r(c, c, 4) for c in ('total_return', 'ann_return', 'sortino', 'max_drawdown'))} FROM au")
def eval_sides(spark, sf_dir):
    t = V.side_audit(_raw_orders(spark, sf_dir), RULES, 252)
    return t.select("series", "strategy_id", "split", "side", "trades", *[rounded(c, 4).alias(c) for c in ("total_return", "ann_return", "sortino", "max_drawdown")])


def _cell(side: str, split: str, c: str) -> str:
    return f"coalesce(max({c}) FILTER (side = '{side}' AND split = '{split}'), 0)"


@query(
    "eval_direction",
    f"""{_W}{AUDIT_SQL}, d AS (SELECT series, strategy_id, {', '.join(f"{_cell(s, t, c)} AS {s}_{t}_{n}" for s in ('long', 'short') for t in ('train', 'test') for n, c in (('ret', 'total_return'), ('trades', 'trades')))} FROM au GROUP BY 1, 2),
    f AS (SELECT *, {', '.join(f"{s}_train_trades >= 3 AND {s}_test_trades >= 3 AND sign({s}_train_ret) * sign({s}_test_ret) < 0 AS {s}_flipped" for s in ('long', 'short'))} FROM d)
    SELECT series, strategy_id, {r('long_train_ret', 'long_train_ret', 5)}, {r('short_test_ret', 'short_test_ret', 5)}, long_train_trades, short_test_trades, long_flipped, short_flipped, NOT (long_flipped OR short_flipped) AS consistent FROM f""",
)
def eval_direction(spark, sf_dir):
    d = V.direction_consistency(V.side_audit(_raw_orders(spark, sf_dir), RULES), 3)
    return d.select("series", "strategy_id", rounded("long_train_ret", 5).alias("long_train_ret"), rounded("short_test_ret", 5).alias("short_test_ret"), "long_train_trades", "short_test_trades", "long_flipped", "short_flipped", "consistent")


def _at(split: str, c: str) -> str:
    return f"max({c}) FILTER (split = '{split}')"


@query(
    "eval_refresh",
    f"""{_W}{POPULATION_SQL}, {PATHS_SQL}, w AS (SELECT series, strategy_id, {', '.join(f"{_at(s, c)} AS {s}_{n}" for s in ('train', 'val', 'test') for n, c in (('return', 'total_return'), ('sortino', 'sortino'), ('trades', 'trades')))} FROM pt GROUP BY 1, 2)
    SELECT w.series, w.strategy_id, train_trades, {r('(train_return + val_return + test_return) / 3', 'robust_return', 5)}, {r('(train_sortino + val_sortino + test_sortino) / 3', 'avg_sortino', 5)}, {r('least(train_sortino, val_sortino, test_sortino)', 'min_sortino', 5)},
    {r('cpcv_p5', 'cpcv_p5', 5)}, {r('cpcv_min', 'cpcv_min', 5)} FROM w JOIN cp ON w.series = cp.series AND w.strategy_id = cp.strategy_id ORDER BY (train_sortino + val_sortino + test_sortino) / 3 DESC LIMIT 6""",
)
def eval_refresh(spark, sf_dir):
    o = _raw_orders(spark, sf_dir)
    t = V.top_by(V.refreshed(V.population_table(o, RULES), V.path_scores(o, RULES)), "avg_sortino", 6)
    return t.select("series", "strategy_id", "train_trades", *[rounded(c, 5).alias(c) for c in ("robust_return", "avg_sortino", "min_sortino", "cpcv_p5", "cpcv_min")])


@query("eval_curves", f"{_W}{ORDERS_SQL}, {slice_sql('whole', 'acting', SK)}, {sim_sql('sim', 'whole', SK)} SELECT series, strategy_id, bar_id, round(sum(net_ret) OVER (PARTITION BY series, strategy_id ORDER BY i ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cumulative FROM sim")
def eval_curves(spark, sf_dir):
    return V.curves(M.net_returns(_orders(spark, sf_dir), RULES)).withColumn("cumulative", rounded("cumulative"))


_DECAY = (1, 2, 5, 10, 20)
DECAY_SQL = f"""{SIGNALS_SQL}, dr AS (SELECT strategy_id, CAST(signal AS DOUBLE) AS s, {', '.join(f'lead(close, {k}) OVER w / nullif(close, 0) - 1 AS f{k}' for k in _DECAY)} FROM signals WINDOW w AS (PARTITION BY series, strategy_id ORDER BY bar_id)),
  dl AS ({' UNION ALL '.join(f"SELECT strategy_id, {k} AS lag, s, f{k} AS f FROM dr WHERE s <> 0 AND f{k} IS NOT NULL" for k in _DECAY)}),
  dc AS (SELECT strategy_id, lag, count(*) AS n, CASE WHEN count(*) >= 20 THEN covar_samp(s, f) / nullif(stddev_samp(s) * stddev_samp(f), 0) END AS corr FROM dl GROUP BY 1, 2)"""


def _decayed(spark, sf_dir):
    bars = returns(spark, sf_dir)
    return V.signal_decay(S.signals(bars, STRATEGIES).join(bars.select("series", "bar_id", "close"), ["series", "bar_id"]), _DECAY, 20)


@query("eval_decay", f"WITH {DECAY_SQL} SELECT strategy_id, lag, n, {r('corr', 'corr')} FROM dc")
def eval_decay(spark, sf_dir):
    return _decayed(spark, sf_dir).withColumn("corr", rounded("corr"))


@query(
    "eval_half_life",
    f"""WITH {DECAY_SQL}, pk AS (SELECT strategy_id, max(abs(corr)) AS peak, max(lag) AS longest FROM dc WHERE corr IS NOT NULL GROUP BY 1), ha AS (SELECT dc.strategy_id, min(lag) AS lag FROM dc JOIN pk USING (strategy_id) WHERE abs(corr) <= peak / 2 GROUP BY 1)
    SELECT pk.strategy_id, {r('peak', 'peak')}, CAST(CASE WHEN peak < 0.01 THEN 0 ELSE coalesce(ha.lag, longest) END AS INT) AS half_life FROM pk LEFT JOIN ha USING (strategy_id)""",
)
def eval_half_life(spark, sf_dir):
    return V.half_life(_decayed(spark, sf_dir)).withColumn("peak", rounded("peak"))


@query(
    "eval_return_correlation",
    f"""WITH {RETURNS_SQL}, w AS (SELECT strategy_id, bar_id, max(net_ret) FILTER (series = 'click') AS click, max(net_ret) FILTER (series = 'purchase') AS purchase, max(net_ret) FILTER (series = 'view') AS view FROM act GROUP BY 1, 2),
    m AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END), 0) AS corr FROM w" for a, b in (('click', 'purchase'), ('click', 'view'), ('purchase', 'view')))})
    SELECT a, b, {r('corr', 'corr')} FROM m WHERE abs(corr) > 0.001""",
)
def eval_return_correlation(spark, sf_dir):
    from quantloom.operators.cleaning import correlation_matrix

    names = ["click", "purchase", "view"]
    wide = _predicted(spark, sf_dir).groupBy("strategy_id", "bar_id").agg(*[F.max(F.when(F.col("series") == n, F.col("net_ret"))).alias(n) for n in names])
    return V.strong_pairs(correlation_matrix(wide, names), 0.001).withColumn("corr", rounded("corr"))


@query(
    "eval_raw_votes",
    f"""WITH {SIGNALS_SQL} SELECT c.series, c.bar_id, round(({_ALL['delta']} + {_ALL['relational']} + {_ALL['consecutive']} - {_ALL['flux']} - {_ALL['squeeze']}) / 3.0, 6) + 0.0 AS net FROM ctx c""",
)
def eval_raw_votes(spark, sf_dir):
    return S.raw_votes(returns(spark, sf_dir), STRATEGIES[0]).select("series", "bar_id", rounded("net").alias("net"))


@query(
    "eval_clusters",
    f"""WITH {SIGNALS_SQL}, w AS (SELECT series, bar_id, max(signal) FILTER (strategy_id = 'trend') AS a, max(signal) FILTER (strategy_id = 'revert') AS b FROM signals GROUP BY 1, 2), c AS (SELECT coalesce(covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0), 0) AS c FROM w)
    SELECT strategy_id, CAST(CASE WHEN 1 - abs(c) <= 0.3 THEN 0 ELSE place END AS INT) AS cluster, CASE WHEN 1 - abs(c) <= 0.3 THEN strategy_id = 'revert' ELSE true END AS best FROM c, (VALUES ('trend', 0), ('revert', 1)) v(strategy_id, place)""",
)
def eval_clusters(spark, sf_dir):
    return E.cluster_signals(S.signals(returns(spark, sf_dir), STRATEGIES), ["trend", "revert"], {"trend": 0.1, "revert": 0.2})


_STRONG = f"WITH i AS ({ORACLES['select_rank_ic']}), "


@query(
    "select_redundancy",
    f"""{_STRONG}{BARS_SQL}, m AS (SELECT {', '.join(f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0) AS {a}_{b}" for j, a in enumerate(FEATURES) for b in FEATURES[j + 1 :])} FROM bars),
    p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, abs({a}_{b}) AS c FROM m UNION ALL SELECT '{b}', '{a}', abs({a}_{b}) FROM m" for j, a in enumerate(FEATURES) for b in FEATURES[j + 1 :])}),
    o AS (SELECT feature, row_number() OVER (ORDER BY abs(ic) DESC, feature) AS k FROM i), rec AS (SELECT feature, k, [feature] AS kept FROM o WHERE k = 1 UNION ALL
    SELECT o.feature, o.k, CASE WHEN coalesce((SELECT max(c) FROM p WHERE p.a = o.feature AND list_contains(rec.kept, p.b)), 0) <= 0.85 THEN list_append(rec.kept, o.feature) ELSE rec.kept END FROM rec JOIN o ON o.k = rec.k + 1)
    SELECT unnest(kept) AS feature, unnest(range(0, len(kept))) AS place FROM rec WHERE k = 5""".replace("WITH i AS", "WITH RECURSIVE i AS", 1),
)
def select_redundancy(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    ic = E.rank_ic(df, FEATURES, "y0").withColumn("ic", rounded("ic"))
    return E.without_redundant(df, ic, FEATURES, ["series", "bar_id"])


@query(
    "select_horizons",
    f"""WITH {BARS_SQL}, fw AS (SELECT *, {', '.join(f'lead(close, {h}) OVER (PARTITION BY series ORDER BY bar_id) / nullif(close, 0) - 1 AS fwd_{h}' for h in (1, 5, 10))} FROM bars),
    c AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {h} AS horizon, abs(covar_samp({f}, fwd_{h}) / nullif(stddev_samp(CASE WHEN fwd_{h} IS NOT NULL THEN {f} END) * stddev_samp(fwd_{h}), 0)) AS c FROM fw" for f in FEATURES for h in (1, 5, 10))})
    SELECT feature, count(*) FILTER (c > 0.05) AS horizons, count(*) FILTER (c > 0.05) > 0 AS useful FROM c GROUP BY 1""",
)
def select_horizons(spark, sf_dir):
    """Features that correlate over 0.05 with the return of a horizon, by horizon, and those that are useful in none (FS06)."""
    from quantloom.operators.cleaning import correlations_to

    df = L.forward_returns(bars_of(spark, sf_dir), (1, 5, 10))
    kept = {h: correlations_to(df, f"fwd_{h}", FEATURES).where(F.abs("corr") > 0.05).select(F.col("column").alias("feature")) for h in (1, 5, 10)}
    return E.across_horizons(kept, FEATURES)


@query("select_horizon_counts", f"WITH b AS ({ORACLES['select_best_horizon']}) SELECT horizon, count(*) AS n FROM b GROUP BY 1")
def select_horizon_counts(spark, sf_dir):
    """How many features have each best horizon (AG08)."""
    df = L.forward_returns(bars_of(spark, sf_dir), (1, 5, 10))
    return E.best_horizon(df, FEATURES, ["fwd_1", "fwd_5", "fwd_10"], 100).groupBy("horizon").agg(F.count("*").alias("n"))


@query("select_forest_importance")
def select_forest_importance(spark, sf_dir):
    """Thirty extra-trees of five levels over all labelled bars (FS07)."""
    return T.importance(_labelled(spark, sf_dir), FEATURES, "y0")
