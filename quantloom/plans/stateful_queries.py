"""Recursive features and streams, each beside its SQL. Streams run once over the landed file."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from quantloom.functions.frames import rounded
from quantloom.operators import features as X
from quantloom.operators import recursive as R
from quantloom.operators import signals as S
from quantloom.operators.simulate import Rules
from quantloom.plans.feature_queries import BARS_SQL, lagged, over, r
from quantloom.plans.registry import query
from quantloom.plans.tape_queries import TICKS_SQL, bars_of
from quantloom.sources.tape import ticks as tape_ticks
from quantloom.streaming import live as V
from quantloom.streaming import resume as RS
from quantloom.streaming import trading as TR

_REC = "WITH RECURSIVE "


def rnd(df, **digits):
    return df.select(*[rounded(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@query(
    "feat_fisher_transform",
    f"""{_REC}{BARS_SQL}, m AS (SELECT series, bar_id, row_number() OVER w - 1 AS i, (high + low) / 2 AS mid, min((high + low) / 2) OVER f AS lo, max((high + low) / 2) OVER f AS hi FROM bars
    WINDOW w AS (PARTITION BY series ORDER BY bar_id), f AS (PARTITION BY series ORDER BY bar_id ROWS 19 PRECEDING)),
    s AS (SELECT series, bar_id, i, CAST(0 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS g FROM m WHERE i = 0 UNION ALL
    SELECT series, bar_id, i, v, atanh(v) + 0.5 * before, before FROM (SELECT *, CASE WHEN abs(u) > 0.99 THEN sign(u) * 0.999 ELSE u END AS v FROM (
    SELECT m.series, m.bar_id, m.i, s.f AS before, 0.33 * CASE WHEN hi > lo THEN 2 * (mid - lo) / (hi - lo) - 1 ELSE 0 END + 0.67 * s.v AS u FROM s JOIN m ON s.series = m.series AND m.i = s.i + 1)))
    SELECT series, bar_id, {r('CASE WHEN i > 0 AND n >= 20 THEN f END', 'fisher', 5)}, {r('CASE WHEN i > 0 AND n >= 20 THEN g END', 'fisher_signal', 5)} FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM s)""",
)
def feat_fisher_transform(spark, sf_dir):
    return rnd(R.fisher_transform(bars_of(spark, sf_dir), 20), fisher=5, fisher_signal=5)


def _decay(h: int) -> str:
    a = 2 / (4 * h / math.log(2) + 1)
    return f"sum(pow({1 - a!r}, x.i - y.i) * y.v) / sum(pow({1 - a!r}, x.i - y.i))"


@query(
    "feat_news_decay",
    f"""WITH {BARS_SQL}, x AS (SELECT series, bar_id, ticket_imbalance AS v, row_number() OVER (PARTITION BY series ORDER BY bar_id) AS i FROM bars)
    SELECT x.series, x.bar_id, {', '.join(r(_decay(h), f'news_impact_decay_{h}h') for h in (2, 4, 8))} FROM x JOIN x y ON x.series = y.series AND y.i <= x.i GROUP BY 1, 2""",
)
def feat_news_decay(spark, sf_dir):
    return rnd(R.news_decay(bars_of(spark, sf_dir), "ticket_imbalance"), news_impact_decay_2h=6, news_impact_decay_4h=6, news_impact_decay_8h=6)


@query(
    "feat_spread_hurst",
    f"""WITH {BARS_SQL}, a AS (SELECT series, bar_id, close - {lagged('close')} AS d FROM bars), b AS (SELECT series, bar_id, list(d) FILTER (d IS NOT NULL) OVER (PARTITION BY series ORDER BY bar_id ROWS 99 PRECEDING) AS d FROM a),
    c AS (SELECT *, len(d) AS n, list_avg(d) AS m, list_stddev_pop(d) AS s FROM b), e AS (SELECT *, list_transform(range(1, n + 1), lambda k: list_sum(list_slice(d, 1, k)) - k * m) AS y FROM c),
    f AS (SELECT series, bar_id, CASE WHEN n >= 20 AND s > 0 AND list_max(y) > list_min(y) THEN greatest(least(ln((list_max(y) - list_min(y)) / s) / ln(n), 1), 0) ELSE 0.5 END AS h FROM e)
    SELECT series, bar_id, {r('h', 'hurst', 5)}, {r(f"coalesce(h - {lagged('h', 50)}, 0.5)", 'hurst_delta', 5)} FROM f""",
)
def feat_spread_hurst(spark, sf_dir):
    return rnd(R.spread_hurst(bars_of(spark, sf_dir), "close", 100), hurst=5, hurst_delta=5)


def area_sql(view: str, source: str, keys: str) -> str:
    """vpoc, val and vah of ``source`` (keys, lo, width, vols) by widening step by step; needs WITH RECURSIVE."""
    return f"""{view}_r AS (SELECT {keys}, lo, width, vols, list_position(vols, list_max(vols)) AS p, list_position(vols, list_max(vols)) AS a, list_position(vols, list_max(vols)) AS b, list_max(vols) AS inside, 0.7 * list_sum(vols) AS goal FROM {source}
  UNION ALL SELECT {keys}, lo, width, vols, p, CASE WHEN up THEN a ELSE a - 1 END, CASE WHEN up THEN b + 1 ELSE b END, inside + CASE WHEN up THEN vols[b + 1] ELSE vols[a - 1] END, goal
  FROM (SELECT *, CASE WHEN b < len(vols) THEN vols[b + 1] ELSE -1 END > CASE WHEN a > 1 THEN vols[a - 1] ELSE -1 END AS up FROM {view}_r WHERE inside < goal AND (a > 1 OR b < len(vols))) q),
{view} AS (SELECT {keys}, any_value(lo + (p - 0.5) * width) AS vpoc, any_value(lo) + (min(a) - 0.5) * any_value(width) AS val, any_value(lo) + (max(b) - 0.5) * any_value(width) AS vah FROM {view}_r GROUP BY {keys})"""


def day_sql(bins: int) -> str:
    """dp: the histogram of each series and day over ``bins`` bins."""
    return f"""dd AS (SELECT series, CAST(time_start AS DATE) AS day, close, volume FROM bars), de AS (SELECT series, day, min(close) AS dlo, max(close) AS dhi, sum(volume) AS day_vol FROM dd GROUP BY 1, 2),
  db AS (SELECT dd.series, dd.day, CASE WHEN dhi > dlo THEN least(CAST(trunc((close - dlo) / (dhi - dlo) * {bins}) AS INT), {bins - 1}) ELSE 0 END AS k, sum(volume) AS v FROM dd JOIN de USING (series, day) GROUP BY 1, 2, 3),
  dk AS (SELECT series, day, dlo, dhi, day_vol, unnest(range(0, CASE WHEN dhi > dlo THEN {bins} ELSE 1 END)) AS k FROM de),
  dp AS (SELECT dk.series, dk.day, any_value(dlo) AS dlo, any_value(dhi) AS dhi, any_value(day_vol) AS day_vol, any_value(dlo) AS lo, any_value(dhi - dlo) / {bins} AS width, list(coalesce(v, 0) ORDER BY dk.k) AS vols FROM dk LEFT JOIN db ON dk.series = db.series AND dk.day = db.day AND dk.k = db.k GROUP BY 1, 2)"""


_AREA = {"vpoc": 7, "val": 7, "vah": 7}
_AREA_SQL = ", ".join(r(c, c, 7) for c in _AREA)


@query("feat_daily_profile", f"{_REC}{BARS_SQL}, {day_sql(200)}, {area_sql('va', 'dp', 'series, day')} SELECT series, CAST(day AS VARCHAR) AS day, {_AREA_SQL}, day_vol FROM va JOIN dp USING (series, day)")
def feat_daily_profile(spark, sf_dir):
    d = R.daily_profiles(bars_of(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))
    return rnd(d.select("series", "day", *_AREA, "day_vol"), **_AREA)


_CONTEXT = {"prev_vpoc": 7, "dist_to_vpoc": 5, "dist_to_val": 5, "dist_to_vah": 5, "dist_to_day_open": 5}


@query(
    "feat_profile_context",
    f"""{_REC}{BARS_SQL}, {day_sql(200)}, {area_sql('va', 'dp', 'series, day')}, pv AS (SELECT series, day, lag(vpoc) OVER w AS pp, lag(val) OVER w AS pl, lag(vah) OVER w AS ph FROM va WINDOW w AS (PARTITION BY series ORDER BY day)),
    j AS (SELECT b.*, CAST(time_start AS DATE) AS day, coalesce(pp, close) AS prev_vpoc, coalesce(pl, close) AS prev_val, coalesce(ph, close) AS prev_vah FROM bars b LEFT JOIN pv ON b.series = pv.series AND CAST(b.time_start AS DATE) = pv.day),
    o AS (SELECT *, first_value(open) OVER (PARTITION BY series, day ORDER BY bar_id) AS day_open FROM j), z AS (SELECT *, CASE WHEN day_open > prev_vah THEN 1 WHEN day_open < prev_val THEN -1 ELSE 0 END AS open_zone FROM o)
    SELECT series, bar_id, {r('prev_vpoc', 'prev_vpoc', 7)}, open_zone, CAST(close BETWEEN prev_val AND prev_vah AS DOUBLE) AS in_value_area,
    CAST(bool_or(open_zone = 1 AND low <= prev_vah OR open_zone = -1 AND high >= prev_val) OVER (PARTITION BY series, day ORDER BY bar_id ROWS UNBOUNDED PRECEDING) AS INT) AS reentered_value,
    {', '.join(r(f'(close - prev_{c}) / nullif(prev_{c}, 0)', f'dist_to_{c}', 5) for c in ('vpoc', 'val', 'vah'))}, {r('(close - day_open) / nullif(day_open, 0)', 'dist_to_day_open', 5)} FROM z""",
)
def feat_profile_context(spark, sf_dir):
    b = bars_of(spark, sf_dir)
    df = R.profile_context(b, R.daily_profiles(b))
    return rnd(df.select("series", "bar_id", "open_zone", "in_value_area", "reentered_value", *_CONTEXT), **_CONTEXT)


def composite_sql(days: int) -> str:
    return f"""{day_sql(100)}, di AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS i FROM dp), cr AS (SELECT x.series, x.day, x.i, min(y.dlo) AS lo, max(y.dhi) AS hi FROM di x JOIN di y ON x.series = y.series AND y.i BETWEEN x.i - {days} AND x.i - 1 WHERE x.i > {days} GROUP BY 1, 2, 3),
  ce AS (SELECT cr.series, cr.day, cr.lo, cr.hi, y.dlo, y.dhi, unnest(range(0, len(y.vols))) AS k, unnest(y.vols) AS v FROM cr JOIN di y ON cr.series = y.series AND y.i BETWEEN cr.i - {days} AND cr.i - 1 WHERE cr.hi > cr.lo AND y.dhi > y.dlo),
  cb AS (SELECT series, day, CAST(greatest(least(trunc((dlo + (k + 0.5) * (dhi - dlo) / 100 - lo) / ((hi - lo) / 100)), 99), 0) AS INT) AS k, sum(v) AS v FROM ce GROUP BY 1, 2, 3), ck AS (SELECT series, day, lo, hi, unnest(range(0, 100)) AS k FROM cr WHERE hi > lo),
  cp AS (SELECT ck.series, ck.day, any_value(lo) AS lo, any_value(hi - lo) / 100 AS width, list(coalesce(v, 0) ORDER BY ck.k) AS vols FROM ck LEFT JOIN cb ON ck.series = cb.series AND ck.day = cb.day AND ck.k = cb.k GROUP BY 1, 2 HAVING sum(coalesce(v, 0)) > 0)"""


@query("feat_composite_profile", f"{_REC}{BARS_SQL}, {composite_sql(5)}, {area_sql('va', 'cp', 'series, day')} SELECT series, CAST(day AS VARCHAR) AS day, {_AREA_SQL} FROM va")
def feat_composite_profile(spark, sf_dir):
    return rnd(R.composite_profiles(R.daily_profiles(bars_of(spark, sf_dir), 100), 5).withColumn("day", F.col("day").cast("string")), **_AREA)


_F = "last_value({} IGNORE NULLS) OVER (PARTITION BY b.series ORDER BY bar_id ROWS UNBOUNDED PRECEDING)"


@query(
    "feat_composite_context",
    f"""{_REC}{BARS_SQL}, {composite_sql(5)}, {area_sql('va', 'cp', 'series, day')}, j AS (SELECT b.series, b.bar_id, close, coalesce({_F.format('vpoc')}, close) AS p, coalesce({_F.format('val')}, close) AS l, coalesce({_F.format('vah')}, close) AS h
    FROM bars b LEFT JOIN va ON b.series = va.series AND CAST(b.time_start AS DATE) = va.day) SELECT series, bar_id, {r('p', 'weekly_vpoc', 7)}, CAST(close BETWEEN l AND h AS DOUBLE) AS weekly_in_value, {r('(close - p) / nullif(p, 0)', 'dist_to_weekly_vpoc', 5)} FROM j""",
)
def feat_composite_context(spark, sf_dir):
    b = bars_of(spark, sf_dir)
    df = R.composite_context(b, R.composite_profiles(R.daily_profiles(b, 100), 5), "weekly")
    return rnd(df.select("series", "bar_id", "weekly_vpoc", "weekly_in_value", "dist_to_weekly_vpoc"), weekly_vpoc=7, dist_to_weekly_vpoc=5)


_DEV = {"dev_vpoc": 7, "dev_val": 7, "dev_vah": 7, "dev_va_width": 5, "price_vs_dev_vpoc": 5}


@query(
    "feat_developing_profile",
    f"""{_REC}{BARS_SQL}, e AS (SELECT series, bar_id, CAST(time_start AS DATE) AS day, close, volume FROM bars), g AS (SELECT x.series, x.bar_id, min(y.close) AS lo, max(y.close) AS hi FROM e x JOIN e y ON x.series = y.series AND x.day = y.day AND y.bar_id <= x.bar_id GROUP BY 1, 2),
    h AS (SELECT g.series, g.bar_id, CASE WHEN hi > lo THEN least(CAST(trunc((y.close - lo) / (hi - lo) * 50) AS INT), 49) ELSE 0 END AS k, sum(y.volume) AS v FROM g JOIN e x ON g.series = x.series AND g.bar_id = x.bar_id JOIN e y ON x.series = y.series AND x.day = y.day AND y.bar_id <= x.bar_id GROUP BY 1, 2, 3),
    gk AS (SELECT series, bar_id, lo, hi, unnest(range(0, CASE WHEN hi > lo THEN 50 ELSE 1 END)) AS k FROM g),
    hp AS (SELECT gk.series, gk.bar_id, any_value(lo) AS lo, any_value(hi - lo) / 50 AS width, list(coalesce(v, 0) ORDER BY gk.k) AS vols FROM gk LEFT JOIN h ON gk.series = h.series AND gk.bar_id = h.bar_id AND gk.k = h.k GROUP BY 1, 2),
    {area_sql('va', 'hp', 'series, bar_id')} SELECT series, bar_id, {r('vpoc', 'dev_vpoc', 7)}, {r('val', 'dev_val', 7)}, {r('vah', 'dev_vah', 7)}, {r('(vah - val) / nullif(close, 0)', 'dev_va_width', 5)}, {r('(close - vpoc) / nullif(vpoc, 0)', 'price_vs_dev_vpoc', 5)},
    CAST(close BETWEEN val AND vah AS DOUBLE) AS in_dev_value FROM va JOIN e USING (series, bar_id)""",
)
def feat_developing_profile(spark, sf_dir):
    return rnd(R.developing_profile(bars_of(spark, sf_dir)), **_DEV)


@query(
    "stream_minute_bars",
    f"""WITH {TICKS_SQL} SELECT series, date_trunc('minute', ts) AS bar_start, arg_min(mid, (ts, seq)) AS open, max(mid) AS high, min(mid) AS low,
    arg_max(mid, (ts, seq)) AS close, sum(vol) AS volume FROM ticks GROUP BY series, date_trunc('minute', ts)""",
)
def stream_minute_bars(spark, sf_dir):
    bars = V.minute_bars(V.tick_stream(spark, f"{sf_dir}/events.parque[t]"))
    return V.run_once(bars, V.shared_folder(spark), "update", ["series", "bar_start"]).withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query("stream_latest", f"WITH {TICKS_SQL} SELECT series, max(ts) AS ts, arg_max(mid, (ts, seq)) AS mid FROM ticks GROUP BY series")
def stream_latest(spark, sf_dir):
    last = V.latest(V.tick_stream(spark, f"{sf_dir}/events.parque[t]"))
    return V.run_once(last, V.shared_folder(spark), "update", ["series"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_bars_sql(ticks: str = "ticks", p: str = "") -> str:
    """{p}sb: volume bars that close with the tick that reaches the threshold, by recursion over ``ticks``."""
    return f"""{p}tk AS (SELECT *, CASE WHEN vol > 0 THEN vol ELSE 1 END AS v1, coalesce(sign(mid - lag(mid) OVER w), 0) AS way, row_number() OVER w AS i FROM {ticks} WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
  {p}st AS (SELECT series, i, CAST(0 AS BIGINT) AS no, v1 AS total FROM {p}tk WHERE i = 1 UNION ALL SELECT k.series, k.i, CASE WHEN s.total >= 500 THEN s.no + 1 ELSE s.no END, CASE WHEN s.total >= 500 THEN k.v1 ELSE s.total + k.v1 END FROM {p}st s JOIN {p}tk k ON s.series = k.series AND k.i = s.i + 1),
  {p}sk AS (SELECT k.*, s.no, row_number() OVER (PARTITION BY k.series, s.no ORDER BY k.i) AS j FROM {p}tk k JOIN {p}st s ON k.series = s.series AND k.i = s.i),
  {p}sb AS (SELECT series, no AS bar_no, min(ts) AS time_start, max(ts) AS time_end, arg_min(mid, i) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, i) AS close, sum(v1) AS volume, sum(CASE WHEN j > 1 THEN v1 * way ELSE 0 END) AS net_vol, count(*) AS ticks FROM {p}sk GROUP BY 1, 2 HAVING sum(v1) >= 500)"""


STREAM_BARS_SQL = f"{TICKS_SQL}, {stream_bars_sql()}"


@query("stream_volume_bars", f"{_REC}{STREAM_BARS_SQL} SELECT * FROM sb")
def stream_volume_bars(spark, sf_dir):
    b = V.run_once(V.volume_bars(V.tick_stream(spark, f"{sf_dir}/events.parque[t]"), 500.0), V.shared_folder(spark))
    return b.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("time_start", "time_end")})


def _live_features(df):
    return X.interactions(X.log_return(df), 20)


@query(
    "stream_features",
    f"""{_REC}{STREAM_BARS_SQL}, b AS (SELECT *, bar_no AS bar_id FROM sb), v AS (SELECT series, bar_id, close, {r(f"close / nullif(({over('sum', 'close * volume', 20)}) / nullif({over('sum', 'volume', 20)}, 0), 0) - 1", 'vwap_diff_20')} FROM b)
    SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY series ORDER BY bar_id DESC) = 1""",
)
def stream_features(spark, sf_dir):
    """Features of the newest bar of each series, computed anew on the last 4000 bars with every batch (SS05)."""
    bars = RS.live_bars(V.tick_stream(spark, f"{sf_dir}/events.parque[t]"), 500.0, window=True)
    out = V.run_once(bars, V.shared_folder(spark), keys=["series"], each=V.on_window(_live_features), rocks=True)
    return out.select("series", "bar_id", "close", rounded("vwap_diff_20").alias("vwap_diff_20"))


LIVE = [
    {"name": "up", "long_genes": [{"type": "relational", "feature_left": "open", "feature_right": "close", "operator": "<"}], "short_genes": []},
    {"name": "down", "long_genes": [], "short_genes": [{"type": "relational", "feature_left": "open", "feature_right": "close", "operator": ">"}]},
]


@query(
    "stream_signals",
    f"""{_REC}{STREAM_BARS_SQL}, n AS (SELECT * FROM sb QUALIFY row_number() OVER (PARTITION BY series ORDER BY bar_no DESC) = 1)
    SELECT series, bar_no AS bar_id, CASE WHEN open < close THEN 'up' ELSE 'down' END AS strategy_id, CASE WHEN open < close THEN 1 ELSE -1 END AS signal FROM n WHERE open <> close""",
)
def stream_signals(spark, sf_dir):
    """The first strategy with a signal on the newest bar (SS06)."""
    bars = RS.live_bars(V.tick_stream(spark, f"{sf_dir}/events.parque[t]"), 500.0, window=True)
    return V.run_once(bars, V.shared_folder(spark), each=V.on_window(lambda df: V.first_signal(S.signals(df, LIVE), [s["name"] for s in LIVE])), rocks=True)


#: Two strategies with stops of their own; a bar closes at every seventh tick, and its votes and range come from that tick.
LIVE_RULES = [Rules(sl_long=1.0, sl_short=1.5, tp_long=1.5, tp_short=2.0, cooldown=12, lot=100.0, account=60_000.0), Rules(sl_long=0.8, sl_short=0.8, tp_long=1.0, tp_short=1.0, cooldown=3, lot=100.0, account=60_000.0)]
_A, _B = LIVE_RULES
_COMM = lambda p: f"greatest({_A.least_commission}, {p} * abs(size) * {_A.lot} * {_A.commission})"


@query(
    "stream_positions",
    f"""{_REC}{TICKS_SQL}, tk AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, seq) AS i, seq % 7 = 0 AS bar, CASE WHEN vol > 70 THEN 1 WHEN vol < 20 THEN -1 ELSE 0 END AS v0, CASE WHEN vol BETWEEN 30 AND 50 THEN 1 WHEN vol BETWEEN 50 AND 60 THEN -1 ELSE 0 END AS v1, 2.0 + vol / 10 AS rg,
      hour(ts) >= 8 AND hour(ts) < 22 AND isodow(ts) <= 5 AS open FROM ticks),
    z AS (SELECT series, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS size, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS ea, CAST(0 AS DOUBLE) AS ca, -1 AS st, CAST(NULL AS TIMESTAMP) AS opened, CAST({_A.account} AS DOUBLE) AS bal, 0 AS c0, 0 AS c1, CAST(NULL AS STRUCT(opened TIMESTAMP, closed TIMESTAMP, strategy INT, lots DOUBLE, entry DOUBLE, "exit" DOUBLE, reason VARCHAR, pnl DOUBLE, balance DOUBLE)) AS t FROM ticks GROUP BY series
    UNION ALL SELECT series, i, CASE WHEN enter THEN want * least(greatest(bal2 * 0.01 / ({_A.lot} * sl2 * greatest(rg, 1e-6)), 1), 4) WHEN gone THEN 0 ELSE size END, CASE WHEN enter THEN mid ELSE entry END, CASE WHEN enter THEN rg WHEN gone THEN 0 ELSE ea END, CASE WHEN bar THEN rg ELSE ca END,
      CASE WHEN enter THEN pick WHEN gone THEN -1 ELSE st END, CASE WHEN enter THEN ts ELSE opened END, bal2, d0, d1,
      CASE WHEN gone THEN {{'opened': opened, 'closed': ts, 'strategy': st, 'lots': size, 'entry': entry, 'exit': mid, 'reason': reason, 'pnl': pnl, 'balance': bal2}} END FROM (
    SELECT *, bar AND open AND want <> 0 AND (size = 0 OR gone OR want * size < 0) AS enter, CASE WHEN pick = 0 THEN CASE WHEN want > 0 THEN {_A.sl_long} ELSE {_A.sl_short} END ELSE {_B.sl_long} END AS sl2, bal + CASE WHEN gone THEN pnl ELSE 0 END AS bal2 FROM (
    SELECT *, hit <> '' OR (bar AND size <> 0 AND (NOT open OR want * size < 0)) AS gone, CASE WHEN hit <> '' THEN hit WHEN NOT open THEN 'close' ELSE 'reverse' END AS reason, (mid - entry) * size * {_A.lot} - {_COMM('entry')} - {_COMM('mid')} AS pnl FROM (
    SELECT *, CASE WHEN v0 <> 0 AND d0 = 0 THEN 0 WHEN v1 <> 0 AND d1 = 0 THEN 1 ELSE -1 END AS pick, CASE WHEN v0 <> 0 AND d0 = 0 THEN v0 WHEN v1 <> 0 AND d1 = 0 THEN v1 ELSE 0 END AS want FROM (
    SELECT *, greatest(CASE WHEN hit = 'SL' AND st = 0 THEN {_A.cooldown} ELSE c0 END - CASE WHEN bar THEN 1 ELSE 0 END, 0) AS d0, greatest(CASE WHEN hit = 'SL' AND st = 1 THEN {_B.cooldown} ELSE c1 END - CASE WHEN bar THEN 1 ELSE 0 END, 0) AS d1 FROM (
    SELECT *, CASE WHEN size = 0 OR mid <= 0 THEN '' WHEN sign(size) * mid <= sign(size) * entry - ea * stop THEN 'SL' WHEN sign(size) * mid >= sign(size) * entry + ea * goal THEN 'TP' ELSE '' END AS hit FROM (
    SELECT k.*, z.size, z.entry, z.ea, z.ca, z.st, z.opened, z.bal, z.c0, z.c1, CASE WHEN z.st = 0 THEN CASE WHEN size > 0 THEN {_A.sl_long} ELSE {_A.sl_short} END ELSE {_B.sl_long} END * CASE WHEN ca > 0 AND ca > {_A.tighten_over} * ea THEN {_A.tighten} ELSE 1 END AS stop, CASE WHEN z.st = 0 THEN CASE WHEN size > 0 THEN {_A.tp_long} ELSE {_A.tp_short} END ELSE {_B.tp_long} END AS goal
    FROM z JOIN tk k ON k.series = z.series AND k.i = z.i + 1)))))))
    SELECT series, t.opened, t.closed, t.strategy, {r('t.lots', 'lots', 5)}, t.entry, t."exit" AS exit, t.reason, {r('t.pnl', 'pnl', 4)}, {r('t.balance', 'balance', 4)} FROM z WHERE t IS NOT NULL""",
)
def stream_positions(spark, sf_dir):
    """Trades of an account on the live path: barriers at ticks, signals at bars, sizes by risk (SS07)."""
    v, bar = F.col("vol"), F.col("seq") % 7 == 0
    votes = F.array(F.when(v > 70, 1).when(v < 20, -1).otherwise(0), F.when(v.between(30, 50), 1).when(v.between(50, 60), -1).otherwise(0))
    ticks = V.tick_stream(spark, f"{sf_dir}/events.parque[t]").where("mid is not null").withColumns({"votes": F.when(bar, votes), "atr": F.when(bar, 2.0 + v / 10)})
    p = V.run_once(TR.positions(ticks, LIVE_RULES), V.shared_folder(spark))
    return p.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("opened", "closed")} | {"lots": rounded("lots", 5), "pnl": rounded("pnl", 4), "balance": rounded("balance", 4)})


#: Where the restart queries cut the tape, and when they start again.
CUT, AGAIN = "2024-01-17 05:00:00", "2024-01-17 12:30:00"
_LIVE = ["series", "bar_no", "time_start", "time_end", "open", "high", "low", "close", "volume", "net_vol", "ticks"]


def _restarted(spark, sf_dir, **limits):
    """Bars of a stream that stopped at CUT, without its state, and was started anew at AGAIN over the whole tape."""
    folder = V.shared_folder(spark)
    first = V.run_once(RS.live_bars(V.tick_stream(spark, f"{sf_dir}/events.parque[t]").where(F.col("ts") < CUT), 500.0), folder, rocks=True)
    history = tape_ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    gap = RS.missing_ticks(history, first, AGAIN, **limits)
    place = f"{folder}/state-{uuid.uuid4().hex}"
    RS.warm_state(first, gap, 500.0).write.parquet(place)
    start = spark.read.schema(RS.STATE_SCHEMA).parquet(place)
    rest = V.tick_stream(spark, f"{sf_dir}/events.parque[t]")
    if limits.get("most", RS.MOST_GAP) is not None:  # a stream that comes live later has not the ticks of the gap
        rest = rest.where(F.col("ts") >= F.lit(AGAIN).cast("timestamp") - F.expr(f"INTERVAL {RS.TAIL}"))
    again = V.run_once(RS.live_bars(rest, 500.0, start=start), folder, rocks=True)
    out = first.select(_LIVE).unionByName(start.where("kind = 'gap'").select(_LIVE)).unionByName(again.select(_LIVE))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("time_start", "time_end")})


@query("stream_restart", f"{_REC}{STREAM_BARS_SQL} SELECT * FROM sb")
def stream_restart(spark, sf_dir):
    """A stream cut in the middle and started again with state from its bars and the ticks since (SS09): one run's bars.
    The second run is given the whole tape again; what has been taken is dropped."""
    return _restarted(spark, sf_dir, most=None)


@query(
    "stream_gap_fill",
    f"""{_REC}{TICKS_SQL}, early AS (SELECT * FROM ticks WHERE ts < TIMESTAMP '{CUT}'), {stream_bars_sql('early', 'e')},
    ends AS (SELECT esk.series, max({{'ts': ts, 'seq': seq}}) AS last FROM esk JOIN esb ON esk.series = esb.series AND esk.no = esb.bar_no GROUP BY 1),
    kept AS (SELECT ticks.* FROM ticks LEFT JOIN ends ON ticks.series = ends.series WHERE last IS NULL OR {{'ts': ts, 'seq': seq}} <= last OR ts >= TIMESTAMP '{AGAIN}' - INTERVAL 2 HOUR),
    {stream_bars_sql('kept')} SELECT * FROM sb""",
)
def stream_gap_fill(spark, sf_dir):
    """The same where the gap is longer than two hours, of which the last two alone are filled."""
    return _restarted(spark, sf_dir)
