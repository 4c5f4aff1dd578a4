"""Feature families on bars (F001-F008, F031-F037, F050-F065, F081-F085), as staged selects.

Every function takes bars with series and bar_id and adds columns; windows that need other windows come in a later
select, never looped one column at a time. Warm-ups are NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import frames as W
from quantloom.functions.frames import bars_since, diff, fir, frame, lag, positive_log, ratio, rolling, rolling_corr, rolling_kurt, rolling_pct_rank, rolling_skew, rolling_z


def log_return(df: DataFrame) -> DataFrame:
    """``log_ret``: ln(close / close before) (F001)."""
    return df.withColumn("log_ret", positive_log(ratio("close", lag("close"))))


def standard(df: DataFrame, w: int, norm: int = 1000, norm_least: int = 100) -> DataFrame:
    """F002-F008 for one window: velocity, volatility, trend strength, skew, kurt, autocorrelation, asymmetry, regimes."""
    range2, body2 = F.pow(positive_log(ratio("high", "low")), 2), F.pow(positive_log(ratio("close", "open")), 2)
    gk = 0.5 * range2 - (2 * math.log(2) - 1) * body2
    path = F.abs(diff("close"))
    one = df.withColumns({"_gk": gk, "_path": path, "_mean": rolling("avg", "log_ret", w), "_up": F.when(F.col("log_ret") > 0, F.col("log_ret")), "_down": F.when(F.col("log_ret") < 0, F.col("log_ret"))})
    least = max(2, w // 10)
    total = rolling("sum", "_path", w)
    up, down = (F.coalesce(rolling("stddev_samp", x, w, least), F.lit(0.0)) for x in ("_up", "_down"))
    centred = F.col("log_ret") - F.col("_mean")
    two = one.withColumns(
        {
            f"velocity_{w}": rolling("sum", "log_ret", w),
            f"volatility_{w}": F.sqrt(W.clip(rolling("avg", "_gk", w), 0.0, math.inf)),
            "_eff": F.when(total == 0, 0.0).otherwise(F.abs(diff("close", w)) / F.nullif(total, F.lit(0.0))),
            f"skew_{w}": rolling_skew("log_ret", w),
            f"kurt_{w}": rolling_kurt("log_ret", w),
            f"vol_asymmetry_{w}": up / F.when(down == 0, 1.0).otherwise(down),
            "_c": centred,
        }
    )
    three = two.withColumns({"_vol_norm": rolling("avg", f"volatility_{w}", norm, norm_least), "_cc": F.col("_c") * lag("_c"), "_c2": F.col("_c") * F.col("_c")})
    return three.withColumns(
        {f"trend_strength_{w}": F.col("_eff") * ratio(f"volatility_{w}", "_vol_norm"), f"autocorr_{w}": ratio(rolling("sum", "_cc", w), rolling("sum", "_c2", w))}
    ).withColumns({f"regime_trending_{w}": F.coalesce(F.col(f"autocorr_{w}") > 0.1, F.lit(False)), f"regime_reverting_{w}": F.coalesce(F.col(f"autocorr_{w}") < -0.05, F.lit(False))}).drop("_gk", "_path", "_mean", "_up", "_down", "_eff", "_c", "_vol_norm", "_cc", "_c2")


def oscillators(df: DataFrame, w: int) -> DataFrame:
    """Chop, vortex, ease of movement, money flow index and Chaikin money flow (F031-F035)."""
    h, lo, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    typical = (h + lo + c) / 3
    one = df.withColumns({"_tr": F.greatest(h - lo, F.coalesce(F.abs(h - lag("close")), h - lo)), "_vp": F.abs(h - lag("low")), "_vm": F.abs(lo - lag("high")), "_mid": (h + lo) / 2, "_typ": typical})
    move = diff("_mid")
    flow = F.col("_typ") * v
    two = one.withColumns({"_eom": ratio(move, ratio(v, h - lo)), "_pos": F.when(diff("_typ") > 0, flow).otherwise(0.0), "_neg": F.when(diff("_typ") < 0, flow).otherwise(0.0), "_cmf": F.coalesce(ratio((c - lo) - (h - c), h - lo), F.lit(0.0)) * v})
    tr = rolling("sum", "_tr", w)
    spread = rolling("max", "high", w) - rolling("min", "low", w)
    neg = rolling("sum", "_neg", w)
    return two.withColumns(
        {
            f"chop_{w}": F.lit(100.0 / math.log10(w)) * F.when(ratio(tr, spread) > 0, F.log10(ratio(tr, spread))),
            f"vortex_{w}": ratio(rolling("sum", "_vp", w) - rolling("sum", "_vm", w), tr),
            f"eom_{w}": rolling("avg", "_eom", w),
            f"mfi_{w}": 100 - 100 / (1 + ratio(rolling("sum", "_pos", w), neg)),
            f"cmf_{w}": ratio(rolling("sum", "_cmf", w), rolling("sum", "volume", w)),
        }
    ).drop("_tr", "_vp", "_vm", "_mid", "_typ", "_eom", "_pos", "_neg", "_cmf")


def event_decay(df: DataFrame, w: int) -> DataFrame:
    """Pullback from the rolling high in units of deviation (F036) and bars since that high (F037)."""
    top = rolling("max", "high", w)
    std = rolling("stddev_samp", "close", 50)
    unit = F.when(std == 0, 1.0).otherwise(std)
    index = F.row_number().over(W.ordered())
    one = df.withColumns({f"pullback_ratio_{w}": F.coalesce((top - F.col("close")) / unit, F.lit(0.0)), "_at": F.coalesce(F.col("high") >= top - 1e-9, F.lit(False)), "_i": index})
    return one.withColumn(f"bars_since_high_{w}", bars_since(F.col("_at"), "_i")).drop("_at", "_i")


def fractional_weights(d: float, cut: float = 1e-4) -> list[float]:
    """Weights of fractional differencing of order d until they fall to ``cut``."""
    out = [1.0]
    while abs(nxt := -out[-1] * (d - len(out) + 1) / len(out)) > cut:
        out.append(nxt)
    return out


def physics(df: DataFrame, w: int) -> DataFrame:
    """Entropy, price impact, energies, action, power and force, with their steps (F052-F054, F056)."""
    v, r, c = F.col("volume"), F.col("log_ret"), F.col("close")
    mean = rolling("avg", "close", w)
    one = df.withColumns({"_k": 0.5 * v * r * r, "_u": 0.5 * v * F.pow((c - mean) / F.nullif(mean, F.lit(0.0)), 2), "_kyle": ratio(F.abs(r), v * c), "_force": v * diff("log_ret")})
    var = rolling("var_samp", "log_ret", w)
    two = one.withColumns(
        {
            f"entropy_{w}": F.when(var > 0, 0.5 * F.ln(2 * math.pi * math.e * var)),
            f"kyle_lambda_{w}": rolling("avg", "_kyle", w),
            f"market_energy_{w}": rolling("avg", "_k", w),
            f"potential_energy_{w}": rolling("avg", "_u", w),
            f"market_power_{w}": rolling("avg", F.col("_force") * r, w),
            f"market_force_{w}": rolling("avg", "_force", w),
        }
    )
    k, u = F.col(f"market_energy_{w}"), F.col(f"potential_energy_{w}")
    three = two.withColumns({f"lagrangian_{w}": k - u, f"hamiltonian_{w}": k + u, f"entropy_roc_{w}": diff(f"entropy_{w}"), f"kyle_lambda_roc_{w}": W.pct_change(f"kyle_lambda_{w}")})
    return three.withColumn(f"market_action_{w}", rolling("sum", f"lagrangian_{w}", w)).drop("_k", "_u", "_kyle", "_force")


def efficiency_ratio(df: DataFrame, w: int) -> DataFrame:
    """Displacement over path of close (F056)."""
    one = df.withColumn("_step", F.abs(diff("close")))
    return one.withColumn(f"efficiency_ratio_{w}", ratio(F.abs(diff("close", w)), rolling("sum", "_step", w))).drop("_step")


def hurst(df: DataFrame, w: int, lags: tuple[int, ...] = (2, 4, 8, 16, 32, 64)) -> DataFrame:
    """Slope of ln std_W(close - close lagged) on ln lag, and its step (F051)."""
    one = df.withColumns({f"_d{k}": diff("close", k) for k in lags})
    two = one.withColumns({f"_s{k}": positive_log(rolling("stddev_samp", f"_d{k}", w)) for k in lags})
    xs = [math.log(k) for k in lags]
    mean = sum(xs) / len(xs)
    slope = sum((F.col(f"_s{k}") * F.lit((x - mean) / sum((y - mean) ** 2 for y in xs)) for k, x in zip(lags, xs, strict=True)), F.lit(0.0))
    three = two.withColumn(f"hurst_{w}", slope).drop(*[f"_d{k}" for k in lags], *[f"_s{k}" for k in lags])
    return three.withColumn(f"hurst_roc_{w}", diff(f"hurst_{w}"))


def fractal_dimension(df: DataFrame, w: int) -> DataFrame:
    """Sevcik dimension of each window of close, normalised in the window; a flat window has dimension 1 (F055)."""
    held = F.collect_list("close").over(frame(w))
    one = df.withColumn("_x", held)
    low, span = F.array_min("_x"), F.array_max("_x") - F.array_min("_x")
    scaled = F.transform("_x", lambda x: (x - low) / span)
    steps = F.zip_with(F.slice(scaled, 2, w - 1), F.slice(scaled, 1, w - 1), lambda a, b: F.sqrt((a - b) * (a - b) + F.lit((1.0 / (w - 1)) ** 2)))
    length = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    value = F.when(span > 0, 1 + (F.ln(length) + math.log(2)) / math.log(2 * (w - 1))).otherwise(1.0)
    return one.withColumn(f"fdi_{w}", F.when(F.size("_x") == w, value)).drop("_x").withColumn(f"fdi_roc_{w}", diff(f"fdi_{w}"))


def interactions(df: DataFrame, w: int) -> DataFrame:
    """Products and ratios of other families, only where their columns exist (F057)."""
    have = set(df.columns)
    vwap = ratio(rolling("sum", F.col("close") * F.col("volume"), w), rolling("sum", "volume", w))
    made: dict[str, Column] = {f"vwap_diff_{w}": ratio("close", vwap) - 1}
    x = lambda name: F.col(f"{name}_{w}")
    for name, reads, value in (
        ("hurst_trend", ("hurst", "trend_strength"), lambda: (x("hurst") - 0.5) * x("trend_strength")),
        ("fdi_vol", ("fdi", "volatility"), lambda: (x("fdi") - 1.5) * x("volatility")),
        ("energy_flow", ("market_energy", "flow_trend"), lambda: x("market_energy") * x("flow_trend")),
        ("clean_trend", ("velocity", "entropy"), lambda: x("velocity") / F.when(x("entropy") == 0, 1.0).otherwise(x("entropy"))),
        ("market_temperature", ("market_energy", "entropy"), lambda: ratio(x("market_energy"), x("entropy"))),
    ):
        if {f"{c}_{w}" for c in reads} <= have:
            made[f"{name}_{w}"] = value()
    return df.withColumns(made)


def _volume() -> Column:
    return F.when(F.col("volume") == 0, 1.0).otherwise(F.col("volume"))


def microstructure(df: DataFrame, w: int) -> DataFrame:
    """Flow trend and shock, flow correlation, duration and VPIN (F060, F061, F063, F065)."""
    seconds = F.unix_micros(F.col("time_end").cast("timestamp")) / 1e6 - F.unix_micros(F.col("time_start").cast("timestamp")) / 1e6
    one = df.withColumns({"bar_duration": seconds, "_abs": F.abs("net_aggressor_vol"), "_v": _volume()})
    return one.withColumns(
        {
            f"flow_trend_{w}": rolling("avg", "ticket_imbalance", w),
            f"flow_shock_{w}": rolling_z("ticket_imbalance", w),
            f"price_flow_corr_{w}": rolling_corr("log_ret", "ticket_imbalance", w),
            f"duration_trend_{w}": rolling("avg", "bar_duration", w),
            f"vpin_{w}": ratio(rolling("sum", "_abs", w), rolling("sum", "_v", w)),
        }
    ).drop("_abs", "_v")


def book(df: DataFrame, w: int) -> DataFrame:
    """Order-book features of bars with the optional columns (F061, F062, F064, F065): order flow, pressure, alignment,
    spread and friction (mean spread times VPIN, where ``microstructure`` came before)."""
    total, mid = F.col("avg_bid_size") + F.col("avg_ask_size"), (F.col("avg_ask_price") + F.col("avg_bid_price")) / 2
    unit = lambda c: F.when(c == 0, 1.0).otherwise(c)
    one = df.withColumns({"_ofi": F.col("tick_ofi") / _volume(), "pres_imbalance": (F.col("avg_bid_size") - F.col("avg_ask_size")) / unit(total), "avg_spread": (F.col("avg_ask_price") - F.col("avg_bid_price")) / unit(mid)})
    made = {
        f"ofi_trend_{w}": rolling("avg", "_ofi", w),
        f"ofi_shock_{w}": rolling_z("_ofi", w),
        f"pres_trend_{w}": rolling("avg", "pres_imbalance", w),
        f"price_pressure_corr_{w}": rolling_corr("log_ret", "pres_imbalance", w),
        f"order_book_alignment_{w}": rolling("avg", F.col("ticket_imbalance") * F.col("pres_imbalance"), w),
    }
    if f"vpin_{w}" in df.columns:
        made[f"liquidity_friction_{w}"] = rolling("avg", "avg_spread", w) * F.col(f"vpin_{w}")
    return one.withColumns(made).drop("_ofi")


def deltas(df: DataFrame, columns: list[str], spans: tuple[int, ...] = (25, 50, 100)) -> DataFrame:
    """delta_{column}_{k} for each column and span, in one select (F083)."""
    return df.select("*", *[diff(c, k).alias(f"delta_{c}_{k}") for c in columns for k in spans])


def seasonality(df: DataFrame, time: str = "time_end") -> DataFrame:
    """Hour on the circle, session bucket and intraday regime (F084, F085)."""
    hour = F.hour(F.col(time).cast("timestamp"))
    angle = hour * F.lit(2 * math.pi / 24)
    session = F.when(hour <= 7, 0.0).when(hour <= 12, 1.0).when(hour <= 16, 2.0).when(hour <= 22, 3.0).otherwise(4.0)
    one = df.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "session_bucket": session, "_busy": rolling("avg", F.abs("log_ret"), 40, 10)})
    two = one.withColumn("_rank", rolling_pct_rank("_busy", 500, 100))
    return two.withColumn("intraday_regime", F.col("session_bucket") * F.coalesce("_rank", F.lit(0.0))).drop("_busy", "_rank")


def hilbert_weights(taps: int = 61) -> list[float]:
    """A Hamming-windowed Hilbert transformer, by lag."""
    half = taps // 2
    out = []
    for k in range(taps):
        n = k - half
        ideal = 0.0 if n % 2 == 0 else 2 / (math.pi * n)
        out.append(ideal * (0.54 - 0.46 * math.cos(2 * math.pi * k / (taps - 1))))
    return out


def sine_wave(df: DataFrame, w: int, taps: int = 61) -> DataFrame:
    """Sine and lead sine of the phase of close less its mean, from a FIR Hilbert transformer (F081); NULL until the delayed
    value exists, half the taps from the start."""
    one = df.withColumn("_x", F.coalesce(F.col("close") - rolling("avg", "close", w), F.lit(0.0)))
    quadrature = sum((F.coalesce(lag("_x", k), F.lit(0.0)) * F.lit(v) for k, v in enumerate(hilbert_weights(taps)) if v), F.lit(0.0))
    phase = F.atan2(quadrature, lag("_x", taps // 2))
    two = one.withColumn("_p", phase)
    return two.withColumns({f"sine_{w}": F.sin("_p"), f"leadsine_{w}": F.sin(F.col("_p") + math.pi / 4)}).drop("_x", "_p")


def fisher_information(df: DataFrame, w: int) -> DataFrame:
    """Velocity and acceleration of the mean and deviation of returns on the Fisher metric (F082); windows end a bar
    before."""
    one = df.withColumns({"_m": rolling("avg", "log_ret", w), "_s": rolling("stddev_pop", "log_ret", w)})
    m, s = lag("_m"), lag("_s")
    two = one.withColumns({"_m1": m, "_s1": s})
    dm, ds = diff("_m1"), diff("_s1")
    speed = F.when(F.col("_s1") < 1e-9, 0.0).otherwise(F.sqrt(F.pow(dm / F.col("_s1"), 2) + 2 * F.pow(ds / F.col("_s1"), 2)))
    three = two.withColumn(f"fisher_info_velocity_{w}", F.when(dm.isNotNull(), speed))
    return three.withColumn(f"fisher_info_accel_{w}", diff(f"fisher_info_velocity_{w}")).drop("_m", "_s", "_m1", "_s1")


def fractional_difference(df: DataFrame, d: float = 0.2, cut: float = 1e-4) -> DataFrame:
    """frac_diff: close filtered by fractional weights (F050)."""
    return df.withColumn("frac_diff", fir("close", fractional_weights(d, cut)))


def yang_zhang(df: DataFrame, w: int) -> DataFrame:
    """Yang-Zhang volatility with the common weight of 0.34 (F056)."""
    part = lambda a, b: positive_log(ratio(a, b))
    one = df.withColumns({"_on": part("open", lag("close")), "_oc": part("close", "open"), "_rs": part("high", "open") * part("high", "close") + part("low", "open") * part("low", "close")})
    k = 0.34
    return one.withColumn(f"yang_zhang_{w}", F.sqrt(rolling("var_samp", "_on", w) + k * rolling("var_samp", "_oc", w) + (1 - k) * rolling("avg", "_rs", w))).drop("_on", "_oc", "_rs")


