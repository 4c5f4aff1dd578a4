"""Feature families over volume bars, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantloom.functions import frames as W
from quantloom.functions.frames import rounded
from quantloom.operators import features as X
from quantloom.operators.chunks import chunked, windowed
from quantloom.plans.registry import ORACLES, query
from quantloom.plans.tape_queries import BARS_SQL, BOOK_SQL, bars_of, book_bars_of

N = 25


def over(f: str, x: str, n: int = N, least: int | None = None) -> str:
    w = f"OVER (PARTITION BY series ORDER BY bar_id ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {f}({x}) {w} END"


def lagged(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY series ORDER BY bar_id)"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def ln(a: str, b: str) -> str:
    """Logarithm of a / b where that is above zero."""
    return f"CASE WHEN {a} / nullif({b}, 0) > 0 THEN ln({a} / nullif({b}, 0)) END"


RET_SQL = f"{BARS_SQL}, ret AS (SELECT *, CASE WHEN close / nullif({lagged('close')}, 0) > 0 THEN ln(close / nullif({lagged('close')}, 0)) END AS log_ret FROM bars)"


def returns(spark, sf_dir):
    return X.log_return(bars_of(spark, sf_dir))


def after(df, make, halo):
    """Columns that ``make`` adds to bars, with log returns; in chunks where the bars are many."""
    return windowed(df, lambda d: make(X.log_return(d)), halo + 1)


def out(df, names, digits=6):
    return df.select("series", "bar_id", *[rounded(n, digits).alias(n) if dict(df.dtypes)[n] == "double" else F.col(n) for n in names])


@query(
    "feat_standard",
    f"""WITH {RET_SQL}, s1 AS (SELECT *, 0.5 * pow(CASE WHEN high / nullif(low, 0) > 0 THEN ln(high / nullif(low, 0)) END, 2) - {2 * math.log(2) - 1} * pow(CASE WHEN close / nullif(open, 0) > 0 THEN ln(close / nullif(open, 0)) END, 2) AS gk, abs(close - {lagged('close')}) AS path,
    {over('avg', 'log_ret')} AS m, CASE WHEN log_ret > 0 THEN log_ret END AS up, CASE WHEN log_ret < 0 THEN log_ret END AS down FROM ret),
    s2 AS (SELECT *, sqrt(greatest({over('avg', 'gk')}, 0)) AS vol, CASE WHEN {over('sum', 'path')} = 0 THEN 0 ELSE abs(close - {lagged('close', N)}) / ({over('sum', 'path')}) END AS eff,
    coalesce({over('stddev_samp', 'up', N, 2)}, 0) AS su, coalesce({over('stddev_samp', 'down', N, 2)}, 0) AS sd, log_ret - m AS c FROM s1),
    s2b AS (SELECT * REPLACE (CASE WHEN {over('avg', 'gk')} IS NOT NULL THEN vol END AS vol) FROM s2),
    s3 AS (SELECT *, {over('avg', 'vol', 1000, 100)} AS vn, c * {lagged('c')} AS cc, c * c AS c2 FROM s2b),
    s4 AS (SELECT *, ({over('sum', 'cc')}) / nullif({over('sum', 'c2')}, 0) AS ac FROM s3)
    SELECT series, bar_id, {r(over('sum', 'log_ret'), 'velocity_25')}, {r('vol', 'volatility_25')}, {r('eff * vol / nullif(vn, 0)', 'trend_strength_25')}, {r('ac', 'autocorr_25')},
    {r('su / CASE WHEN sd = 0 THEN 1 ELSE sd END', 'vol_asymmetry_25')}, coalesce(ac > 0.1, false) AS regime_trending_25, coalesce(ac < -0.05, false) AS regime_reverting_25 FROM s4""",
)
def feat_standard(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.standard(d, N), 1060), ["velocity_25", "volatility_25", "trend_strength_25", "autocorr_25", "vol_asymmetry_25", "regime_trending_25", "regime_reverting_25"])


@query("feat_chunked_windows", ORACLES["feat_standard"])
def feat_chunked_windows(spark, sf_dir):
    """feat_standard in chunks with a halo: its frames, the 1000-bar norm and the lags add up to less than 1060 bars."""
    names = ["velocity_25", "volatility_25", "trend_strength_25", "autocorr_25", "vol_asymmetry_25", "regime_trending_25", "regime_reverting_25"]
    return out(chunked(bars_of(spark, sf_dir), lambda df: X.standard(X.log_return(df), N), 1060, 1200, 50), names)


@query("wn_bias_moments", f"WITH {RET_SQL} SELECT series, bar_id, {r(over('skewness', 'log_ret'), 'skew_25', 4)}, {r(over('kurtosis', 'log_ret'), 'kurt_25', 4)} FROM ret")
def wn_bias_moments(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.standard(d, N), 1060), ["skew_25", "kurt_25"], 4)


@query(
    "feat_oscillators",
    f"""WITH {BARS_SQL}, s1 AS (SELECT *, greatest(high - low, coalesce(abs(high - {lagged('close')}), high - low)) AS tr, abs(high - {lagged('low')}) AS vp, abs(low - {lagged('high')}) AS vm,
    (high + low) / 2 AS md, (high + low + close) / 3 AS typ FROM bars),
    s2 AS (SELECT *, (md - {lagged('md')}) / nullif(volume / nullif(high - low, 0), 0) AS eo, CASE WHEN typ - {lagged('typ')} > 0 THEN typ * volume ELSE 0 END AS pos,
    CASE WHEN typ - {lagged('typ')} < 0 THEN typ * volume ELSE 0 END AS neg, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS cf FROM s1)
    SELECT series, bar_id, {r(f"100.0 / log10({N}) * log10(({over('sum', 'tr')}) / nullif(({over('max', 'high')}) - ({over('min', 'low')}), 0))", 'chop_25')},
    {r(f"(({over('sum', 'vp')}) - ({over('sum', 'vm')})) / nullif({over('sum', 'tr')}, 0)", 'vortex_25')}, {r(over('avg', 'eo'), 'eom_25')},
    {r(f"100 - 100 / (1 + ({over('sum', 'pos')}) / nullif({over('sum', 'neg')}, 0))", 'mfi_25')}, {r(f"({over('sum', 'cf')}) / nullif({over('sum', 'volume')}, 0)", 'cmf_25')} FROM s2""",
)
def feat_oscillators(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.oscillators(d, N), 30), ["chop_25", "vortex_25", "eom_25", "mfi_25", "cmf_25"])


@query(
    "feat_event_decay",
    f"""WITH {BARS_SQL}, s1 AS (SELECT *, {over('max', 'high', 100)} AS top, {over('stddev_samp', 'close', 50)} AS sd, row_number() OVER (PARTITION BY series ORDER BY bar_id) AS i FROM bars),
    s2 AS (SELECT *, coalesce(high >= top - 1e-9, false) AS hit FROM s1)
    SELECT series, bar_id, {r('coalesce((top - close) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 0)', 'pullback_ratio_100')},
    CAST(i - last_value(CASE WHEN hit THEN i END IGNORE NULLS) OVER (PARTITION BY series ORDER BY bar_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bars_since_high_100 FROM s2""",
)
def feat_event_decay(spark, sf_dir):
    return out(X.event_decay(bars_of(spark, sf_dir), 100).withColumn("bars_since_high_100", F.col("bars_since_high_100").cast("long")), ["pullback_ratio_100", "bars_since_high_100"])


@query(
    "feat_physics",
    f"""WITH {RET_SQL}, s0 AS (SELECT *, {over('avg', 'close')} AS ma FROM ret), s1 AS (SELECT *, 0.5 * volume * log_ret * log_ret AS k, 0.5 * volume * pow((close - ma) / nullif(ma, 0), 2) AS u,
    abs(log_ret) / nullif(volume * close, 0) AS ky, volume * (log_ret - {lagged('log_ret')}) AS fo, volume * (log_ret - {lagged('log_ret')}) * log_ret AS pw FROM s0),
    s2 AS (SELECT *, {over('avg', 'ky')} AS kl, {over('avg', 'k')} AS ke, {over('avg', 'u')} AS pe, CASE WHEN ({over('var_samp', 'log_ret')}) > 0 THEN 0.5 * ln(2 * pi() * exp(1) * ({over('var_samp', 'log_ret')})) END AS en FROM s1),
    s3 AS (SELECT *, ke - pe AS l FROM s2)
    SELECT series, bar_id, {r('en', 'entropy_25')}, {r(f"en - {lagged('en')}", 'entropy_roc_25')}, {r('kl * 1e6', 'kyle_lambda_25', 4)}, {r(f"kl / nullif({lagged('kl')}, 0) - 1", 'kyle_lambda_roc_25')},
    {r('l', 'lagrangian_25', 5)}, {r('ke + pe', 'hamiltonian_25', 5)}, {r('ke', 'market_energy_25', 5)}, {r('pe', 'potential_energy_25', 5)}, {r(over('avg', 'pw'), 'market_power_25', 5)},
    {r(over('avg', 'fo'), 'market_force_25', 5)}, {r(over('sum', 'l'), 'market_action_25', 4)} FROM s3""",
)
def feat_physics(spark, sf_dir):
    df = after(bars_of(spark, sf_dir), lambda d: X.physics(d, N), 80).withColumn("kyle_lambda_25", F.col("kyle_lambda_25") * 1e6)
    digits = {"entropy_25": 6, "entropy_roc_25": 6, "kyle_lambda_25": 4, "kyle_lambda_roc_25": 6, "lagrangian_25": 5, "hamiltonian_25": 5, "market_energy_25": 5, "potential_energy_25": 5, "market_power_25": 5, "market_force_25": 5, "market_action_25": 4}
    return df.select("series", "bar_id", *[rounded(n, d).alias(n) for n, d in digits.items()])


@query("feat_efficiency_ratio", f"WITH {BARS_SQL}, s AS (SELECT *, abs(close - {lagged('close')}) AS step FROM bars) SELECT series, bar_id, {r(f"abs(close - {lagged('close', N)}) / nullif({over('sum', 'step')}, 0)", 'efficiency_ratio_25')} FROM s")
def feat_efficiency_ratio(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.efficiency_ratio(d, N), 30), ["efficiency_ratio_25"])


_LAGS = (2, 4, 8, 16, 32, 64)
_XS = [math.log(k) for k in _LAGS]
_M = sum(_XS) / 6
_D = sum((x - _M) ** 2 for x in _XS)


@query(
    "feat_hurst",
    f"WITH {BARS_SQL}, s1 AS (SELECT *, {', '.join(f'close - {lagged(chr(99) + chr(108) + chr(111) + chr(115) + chr(101), k)} AS d{k}' for k in _LAGS)} FROM bars), s2 AS (SELECT *, {', '.join('ln(nullif(' + over('stddev_samp', f'd{k}') + f', 0)) AS s{k}' for k in _LAGS)} FROM s1) "
    + f"SELECT series, bar_id, {r('h', 'hurst_25')}, {r('h - ' + lagged('h'), 'hurst_roc_25')} FROM (SELECT *, {' + '.join(f's{k} * {(x - _M) / _D}' for k, x in zip(_LAGS, _XS, strict=True))} AS h FROM s2)",
)
def feat_hurst(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.hurst(d, N), 100), ["hurst_25", "hurst_roc_25"])


@query(
    "feat_fractal_dimension",
    f"""WITH {BARS_SQL}, s AS (SELECT series, bar_id, list(close) OVER w AS x, min(close) OVER w AS lo, max(close) OVER w - min(close) OVER w AS span FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_id ROWS {N - 1} PRECEDING))
    SELECT series, bar_id, {r('v', 'fdi_25')}, {r('v - ' + lagged('v'), 'fdi_roc_25')} FROM (SELECT series, bar_id, {f"CASE WHEN len(x) = {N} THEN CASE WHEN span > 0 THEN 1 + (ln(list_sum(list_transform(range(1, {N}), lambda i: sqrt(pow((x[i + 1] - x[i]) / span, 2) + {(1 / (N - 1)) ** 2})))) + ln(2)) / ln({2 * (N - 1)}) ELSE 1.0 END END"} AS v FROM s)""",
)
def feat_fractal_dimension(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.fractal_dimension(d, N), 30), ["fdi_25", "fdi_roc_25"])


@query(
    "feat_microstructure",
    f"""WITH {RET_SQL}, s AS (SELECT *, epoch_us(time_end) / 1e6 - epoch_us(time_start) / 1e6 AS dur, abs(net_aggressor_vol) AS av, CASE WHEN log_ret IS NOT NULL THEN ticket_imbalance END AS ti FROM ret)
    SELECT series, bar_id, round(dur, 3) AS bar_duration, {r(over('avg', 'ticket_imbalance'), 'flow_trend_25')},
    {r(f"(ticket_imbalance - ({over('avg', 'ticket_imbalance')})) / CASE WHEN ({over('stddev_samp', 'ticket_imbalance')}) = 0 THEN 1 ELSE ({over('stddev_samp', 'ticket_imbalance')}) END", 'flow_shock_25')},
    {r(f"CASE WHEN count(log_ret) OVER w >= {N} THEN covar_samp(log_ret, ti) OVER w / nullif(stddev_samp(log_ret) OVER w * stddev_samp(ti) OVER w, 0) END", 'price_flow_corr_25')},
    {r(over('avg', 'dur'), 'duration_trend_25', 3)}, {r(f"({over('sum', 'av')}) / nullif({over('sum', 'CASE WHEN volume = 0 THEN 1 ELSE volume END')}, 0)", 'vpin_25')} FROM s WINDOW w AS (PARTITION BY series ORDER BY bar_id ROWS {N - 1} PRECEDING)""",
)
def feat_microstructure(spark, sf_dir):
    df = after(bars_of(spark, sf_dir), lambda d: X.microstructure(d, N), 30)
    return df.select("series", "bar_id", F.round("bar_duration", 3).alias("bar_duration"), *[rounded(c).alias(c) for c in ("flow_trend_25", "flow_shock_25", "price_flow_corr_25", "vpin_25")], rounded("duration_trend_25", 3).alias("duration_trend_25"))


@query("feat_deltas", f"WITH {BARS_SQL} SELECT series, bar_id, {', '.join(r(f'{c} - {lagged(c, k)}', f'delta_{c}_{k}') for c in ('ticket_imbalance', 'volume') for k in (25, 50, 100))} FROM bars")
def feat_deltas(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.deltas(d, ["ticket_imbalance", "volume"]), 100), [f"delta_{c}_{k}" for c in ("ticket_imbalance", "volume") for k in (25, 50, 100)])


@query(
    "feat_seasonality",
    f"""WITH {RET_SQL}, s AS (SELECT *, hour(time_end) AS h, {over('avg', 'abs(log_ret)', 40, 10)} AS busy FROM ret),
    t AS (SELECT *, list(busy) FILTER (busy IS NOT NULL) OVER (PARTITION BY series ORDER BY bar_id ROWS 499 PRECEDING) AS x, CASE WHEN h <= 7 THEN 0.0 WHEN h <= 12 THEN 1.0 WHEN h <= 16 THEN 2.0 WHEN h <= 22 THEN 3.0 ELSE 4.0 END AS sb FROM s)
    SELECT series, bar_id, {r('sin(h * 2 * pi() / 24)', 'hour_sin')}, {r('cos(h * 2 * pi() / 24)', 'hour_cos')}, CAST(sb AS DOUBLE) AS session_bucket,
    {r("sb * coalesce(CASE WHEN busy IS NOT NULL AND len(x) >= 100 THEN (len(list_filter(x, lambda v: v < busy)) + (len(list_filter(x, lambda v: v = busy)) + 1) / 2) / len(x) END, 0)", 'intraday_regime')} FROM t""",
)
def feat_seasonality(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), X.seasonality, 545), ["hour_sin", "hour_cos", "session_bucket", "intraday_regime"])


_H = [(k, v) for k, v in enumerate(X.hilbert_weights()) if v]


@query(
    "feat_sine_wave",
    f"""WITH {BARS_SQL}, s AS (SELECT *, coalesce(close - ({over('avg', 'close')}), 0) AS x FROM bars), p AS (SELECT series, bar_id, atan2({' + '.join(f"coalesce({lagged('x', k)}, 0) * {v!r}" for k, v in _H)}, {lagged('x', 30)}) AS p FROM s)
    SELECT series, bar_id, {r('sin(p)', 'sine_25')}, {r('sin(p + pi() / 4)', 'leadsine_25')} FROM p""",
)
def feat_sine_wave(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.sine_wave(d, N), 90), ["sine_25", "leadsine_25"])


@query(
    "feat_fisher_information",
    f"""WITH {RET_SQL}, a AS (SELECT *, {over('avg', 'log_ret')} AS m, {over('stddev_pop', 'log_ret')} AS s FROM ret), b AS (SELECT *, {lagged('m')} AS m1, {lagged('s')} AS s1 FROM a),
    c AS (SELECT series, bar_id, CASE WHEN m1 - {lagged('m1')} IS NOT NULL THEN CASE WHEN s1 < 1e-9 THEN 0 ELSE sqrt(pow((m1 - {lagged('m1')}) / s1, 2) + 2 * pow((s1 - {lagged('s1')}) / s1, 2)) END END AS v FROM b)
    SELECT series, bar_id, {r('v', 'fisher_info_velocity_25')}, {r(f"v - {lagged('v')}", 'fisher_info_accel_25')} FROM c""",
)
def feat_fisher_information(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.fisher_information(d, N), 40), ["fisher_info_velocity_25", "fisher_info_accel_25"])


_FW = X.fractional_weights(0.2)


@query(
    "feat_fractional_difference",
    f"""WITH {BARS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY bar_id) AS i FROM bars), w AS (SELECT unnest([{', '.join(repr(x) for x in _FW)}]) AS v, unnest(range(0, {len(_FW)})) AS l)
    SELECT a.series, a.bar_id, CASE WHEN a.i >= {len(_FW)} THEN round((SELECT sum(b.close * w.v) FROM k b JOIN w ON b.i = a.i - w.l WHERE b.series = a.series), 5) + 0.0 END AS frac_diff FROM k a""",
)
def feat_fractional_difference(spark, sf_dir):
    """Weights down to 1e-4: hundreds of taps, so series shorter than that have none."""
    return out(after(bars_of(spark, sf_dir), X.fractional_difference, len(_FW)), ["frac_diff"], 5)


_FS = X.fractional_weights(0.2, 5e-3)


@query("feat_fractional_short", f"WITH {BARS_SQL} SELECT series, bar_id, {r(' + '.join(f'{lagged(chr(99) + chr(108) + chr(111) + chr(115) + chr(101), k) if k else chr(99) + chr(108) + chr(111) + chr(115) + chr(101)} * {v!r}' for k, v in enumerate(_FS)), 'frac_diff', 5)} FROM bars")
def feat_fractional_short(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.fractional_difference(d, 0.2, 5e-3), len(_FS)), ["frac_diff"], 5)


@query(
    "feat_yang_zhang",
    f"""WITH {BARS_SQL}, s AS (SELECT *, {ln('open', lagged('close'))} AS a, {ln('close', 'open')} AS b, {ln('high', 'open')} * {ln('high', 'close')} + {ln('low', 'open')} * {ln('low', 'close')} AS c FROM bars)
    SELECT series, bar_id, {r(f"sqrt(({over('var_samp', 'a')}) + 0.34 * ({over('var_samp', 'b')}) + 0.66 * ({over('avg', 'c')}))", 'yang_zhang_25')} FROM s""",
)
def feat_yang_zhang(spark, sf_dir):
    return out(after(bars_of(spark, sf_dir), lambda d: X.yang_zhang(d, N), 30), ["yang_zhang_25"])


def _interacting(df):
    for make in (X.standard, X.physics, X.hurst, X.fractal_dimension, X.microstructure, X.interactions):
        df = make(df, N)
    return df


def _sub(name: str, view: str) -> str:
    """The oracle of another query as a table expression."""
    return f"{view} AS ({ORACLES[name]})"


@query(
    "feat_interactions",
    f"""WITH {_sub('feat_standard', 'st')}, {_sub('feat_physics', 'ph')}, {_sub('feat_hurst', 'hu')}, {_sub('feat_fractal_dimension', 'fd')}, {_sub('feat_microstructure', 'mi')}, {BARS_SQL},
    v AS (SELECT series, bar_id, close / nullif(({over('sum', 'close * volume')}) / nullif({over('sum', 'volume')}, 0), 0) - 1 AS vw FROM bars)
    SELECT series, bar_id, round(vw, 3) + 0.0 AS vwap_diff_25, round((hurst_25 - 0.5) * trend_strength_25, 3) + 0.0 AS hurst_trend_25, round((fdi_25 - 1.5) * volatility_25, 3) + 0.0 AS fdi_vol_25,
    round(market_energy_25 * flow_trend_25, 2) + 0.0 AS energy_flow_25, round(velocity_25 / CASE WHEN entropy_25 = 0 THEN 1 ELSE entropy_25 END, 3) + 0.0 AS clean_trend_25,
    round(market_energy_25 / nullif(entropy_25, 0), 1) + 0.0 AS market_temperature_25
    FROM v JOIN st USING (series, bar_id) JOIN ph USING (series, bar_id) JOIN hu USING (series, bar_id) JOIN fd USING (series, bar_id) JOIN mi USING (series, bar_id)""",
)
def feat_interactions(spark, sf_dir):
    """Rounded coarsely: the oracle multiplies columns that are already rounded."""
    df = after(bars_of(spark, sf_dir), _interacting, 1100)
    digits = {"vwap_diff_25": 3, "hurst_trend_25": 3, "fdi_vol_25": 3, "energy_flow_25": 2, "clean_trend_25": 3, "market_temperature_25": 1}
    base = {"hurst_25": 6, "trend_strength_25": 6, "fdi_25": 6, "volatility_25": 6, "market_energy_25": 5, "flow_trend_25": 6, "velocity_25": 6, "entropy_25": 6}
    cut = df.select("series", "bar_id", "close", "volume", "vwap_diff_25", *[rounded(c, d).alias(c) for c, d in base.items()])
    again = X.interactions(cut.drop("vwap_diff_25"), N)
    return again.select("series", "bar_id", *[rounded(c, d).alias(c) for c, d in digits.items()])


@query(
    "feat_book",
    f"""WITH {BOOK_SQL}, a AS (SELECT *, CASE WHEN close / nullif({lagged('close')}, 0) > 0 THEN ln(close / nullif({lagged('close')}, 0)) END AS lr, tick_ofi / CASE WHEN volume = 0 THEN 1 ELSE volume END AS o,
    (avg_bid_size - avg_ask_size) / CASE WHEN avg_bid_size + avg_ask_size = 0 THEN 1 ELSE avg_bid_size + avg_ask_size END AS p,
    (avg_ask_price - avg_bid_price) / CASE WHEN avg_ask_price + avg_bid_price = 0 THEN 1 ELSE (avg_ask_price + avg_bid_price) / 2 END AS sp, abs(net_aggressor_vol) AS av, CASE WHEN volume = 0 THEN 1 ELSE volume END AS v1 FROM book),
    b AS (SELECT *, ticket_imbalance * p AS al, CASE WHEN lr IS NOT NULL THEN p END AS p1, CASE WHEN p IS NOT NULL THEN lr END AS l1 FROM a)
    SELECT series, bar_id, {r(over('avg', 'o'), 'ofi_trend_25')}, {r(f"(o - ({over('avg', 'o')})) / CASE WHEN ({over('stddev_samp', 'o')}) = 0 THEN 1 ELSE ({over('stddev_samp', 'o')}) END", 'ofi_shock_25', 5)},
    {r('p', 'pres_imbalance')}, {r(over('avg', 'p'), 'pres_trend_25')}, {r('sp', 'avg_spread')},
    {r(f"CASE WHEN count(l1) OVER w >= {N} THEN covar_samp(l1, p1) OVER w / nullif(stddev_samp(l1) OVER w * stddev_samp(p1) OVER w, 0) END", 'price_pressure_corr_25', 5)},
    {r(over('avg', 'al'), 'order_book_alignment_25')}, {r(f"({over('avg', 'sp')}) * ({over('sum', 'av')}) / nullif({over('sum', 'v1')}, 0)", 'liquidity_friction_25')}
    FROM b WINDOW w AS (PARTITION BY series ORDER BY bar_id ROWS {N - 1} PRECEDING)""",
)
def feat_book(spark, sf_dir):
    df = after(book_bars_of(spark, sf_dir), lambda d: X.book(X.microstructure(d, N), N), 40)
    digits = {"ofi_trend_25": 6, "ofi_shock_25": 5, "pres_imbalance": 6, "pres_trend_25": 6, "avg_spread": 6, "price_pressure_corr_25": 5, "order_book_alignment_25": 6, "liquidity_friction_25": 6}
    return df.select("series", "bar_id", *[rounded(c, d).alias(c) for c, d in digits.items()])


@query(
    "wn_time_range",
    f"""WITH {BARS_SQL} SELECT series, bar_id, count(*) OVER w AS bars_6h, {r('avg(close) OVER w', 'mean_6h')}, max(high) OVER w AS high_6h FROM bars
    WINDOW w AS (PARTITION BY series ORDER BY time_end RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""",
)
def wn_time_range(spark, sf_dir):
    w = W.time_frame(6 * 3600)
    return bars_of(spark, sf_dir).select("series", "bar_id", F.count("*").over(w).alias("bars_6h"), rounded(F.avg("close").over(w)).alias("mean_6h"), F.max("high").over(w).alias("high_6h"))


@query(
    "wn_quantile_rank",
    f"""WITH {BARS_SQL}, s AS (SELECT *, list(close) OVER w AS x FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_id ROWS {N - 1} PRECEDING))
    SELECT series, bar_id, {r(f"CASE WHEN len(x) >= {N} THEN list_aggregate(x, 'quantile_cont', 0.1) END", 'q10')}, {r(f"CASE WHEN len(x) >= {N} THEN (len(list_filter(x, lambda v: v < close)) + (len(list_filter(x, lambda v: v = close)) + 1) / 2) / len(x) END", 'pct_rank')} FROM s""",
)
def wn_quantile_rank(spark, sf_dir):
    return bars_of(spark, sf_dir).select("series", "bar_id", rounded(W.rolling_quantile("close", N, 0.1)).alias("q10"), rounded(W.rolling_pct_rank("close", N)).alias("pct_rank"))


@query(
    "wn_expanding_fill",
    f"""WITH {BARS_SQL}, s AS (SELECT *, CASE WHEN bar_id % 3 = 0 THEN close END AS x FROM bars) SELECT series, bar_id,
    {r('CASE WHEN count(x) OVER u >= 5 THEN avg(x) OVER u END', 'mean_u', 8)}, {r('CASE WHEN count(x) OVER u >= 5 THEN stddev_samp(x) OVER u END', 'std_u')},
    last_value(x IGNORE NULLS) OVER u AS filled, first_value(x IGNORE NULLS) OVER (PARTITION BY series ORDER BY bar_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backfilled,
    sum(volume) OVER u AS cum_volume, max(high) OVER u AS run_high FROM s WINDOW u AS (PARTITION BY series ORDER BY bar_id ROWS UNBOUNDED PRECEDING)""",
)
def wn_expanding_fill(spark, sf_dir):
    s = bars_of(spark, sf_dir).withColumn("x", F.when(F.col("bar_id") % 3 == 0, F.col("close")))
    return s.select("series", "bar_id", rounded(W.expanding("avg", "x", 5), 8).alias("mean_u"), rounded(W.expanding("stddev_samp", "x", 5)).alias("std_u"), W.ffill("x").alias("filled"), W.bfill("x").alias("backfilled"), F.sum("volume").over(W.upto()).alias("cum_volume"), F.max("high").over(W.upto()).alias("run_high"))


@query(
    "wn_rank_average",
    f"WITH {BARS_SQL} SELECT series, bar_id, rank() OVER (PARTITION BY series ORDER BY tick_count) + (count(*) OVER (PARTITION BY series, tick_count) - 1) / 2 AS avg_rank FROM bars",
)
def wn_rank_average(spark, sf_dir):
    return bars_of(spark, sf_dir).select("series", "bar_id", W.average_rank("tick_count", "series").alias("avg_rank"))


@query(
    "wn_masks_slope",
    f"""WITH {BARS_SQL}, s AS (SELECT *, coalesce(close > {lagged('close')}, false) AS up FROM bars) SELECT series, bar_id,
    CASE WHEN count(*) OVER w >= 10 THEN CAST(sum(up::INT) OVER w AS BIGINT) END AS ups_10, CASE WHEN count(*) OVER w >= 10 THEN sum(up::INT) OVER w = 10 ELSE false END AS all_10,
    CASE WHEN count(*) OVER w >= 10 THEN sum(up::INT) OVER w > 0 ELSE false END AS any_10, {r('CASE WHEN count(close) OVER w >= 10 THEN regr_slope(close, bar_id) OVER w END', 'slope_10')},
    {r(f"(close - ({over('avg', 'close', 10, 5)})) / CASE WHEN ({over('stddev_samp', 'close', 10, 5)}) = 0 THEN 1 ELSE ({over('stddev_samp', 'close', 10, 5)}) END", 'z_10')}
    FROM s WINDOW w AS (PARTITION BY series ORDER BY bar_id ROWS 9 PRECEDING)""",
)
def wn_masks_slope(spark, sf_dir):
    s = bars_of(spark, sf_dir).withColumn("up", F.coalesce(F.col("close") > W.lag("close"), F.lit(False)))
    n = W.rolling_count(F.col("up"), 10)
    return s.select("series", "bar_id", n.alias("ups_10"), F.coalesce(n == 10, F.lit(False)).alias("all_10"), F.coalesce(n > 0, F.lit(False)).alias("any_10"), rounded(W.rolling_slope("close", 10)).alias("slope_10"), rounded(W.rolling_z("close", 10, 5)).alias("z_10"))
