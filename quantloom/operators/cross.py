"""Features that align several series (F010-F044, F086-F093): correlators, news, calendar, surprises, macro, positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.frames import bfill, clip, diff, ffill, ieee_log, ieee_ratio, lag, pct_change, positive_log, ratio, rolling, rolling_beta, rolling_corr, rolling_quantile, rolling_z
from quantloom.operators.asof import DAY, asof_backward, asof_columns, asof_forward


def correlator_price(bars: DataFrame, tape: DataFrame, name: str, by: list[str] | None = None, at: str = "time_end", span: int = DAY) -> DataFrame:
    """price_{name}: the correlator's latest price at each bar's end (F020). ``tape`` has ts and price.

    Bars of all series look into one tape: both are scanned in ranges of ``span`` microseconds, in parallel.
    """
    keyed = tape.select(*(by or []), F.col("ts").alias("_ts"), F.col("price").alias(f"price_{name}"))
    return asof_backward(bars, keyed, at, "_ts", by or [], [f"price_{name}"], span=span).drop("asof_key")


def correlator_interval(bars: DataFrame, tape: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """price_{name} and price_{name}_start: the correlator's latest prices at each bar's end and start (F010, F020)."""
    both = correlator_price(bars, tape, f"{name}_start", by, "time_start")
    return correlator_price(both, tape, name, by)


def residual(df: DataFrame, name: str, w: int = 200) -> DataFrame:
    """beta_{name} and residual_{name}: own return over the bar less the lagged beta times the correlator's return over
    the same interval (F010). Needs ``correlator_interval``."""
    one = df.withColumns({"_own": positive_log(ratio("close", "open")), "_other": positive_log(ratio(f"price_{name}", f"price_{name}_start"))})
    two = one.withColumn("_beta", rolling_beta("_own", "_other", w)).withColumn("_lagged", lag("_beta"))
    made = {f"beta_{name}": F.coalesce("_lagged", F.lit(0.0)), f"residual_{name}": F.coalesce(F.col("_own") - F.col("_lagged") * F.col("_other"), F.lit(0.0))}
    return two.withColumns(made).drop("_own", "_other", "_beta", "_lagged")


def minute_grid(df: DataFrame, ts: str, value: str, order: list[str]) -> DataFrame:
    """(series, minute, value): the last value of each minute, on every minute from the first to the last, filled from
    before. One row a minute and series."""
    last = df.groupBy("series", F.date_trunc("minute", F.col(ts).cast("timestamp")).alias("minute")).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    ends = last.groupBy("series").agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    spine = ends.select("series", F.explode(F.sequence("a", "b", F.expr("interval 1 minute"))).alias("minute"))
    w = Window.partitionBy("series").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(last, ["series", "minute"], "left").select("series", "minute", F.last("_v", ignorenulls=True).over(w).alias(value))


LEAD = ("trend_30m", "corr_regime_60m", "beta_60m", "vol_ratio_30m", "divergence_30m")


def lead_lag(bars: DataFrame, tape: DataFrame, short: int = 30, long: int = 60) -> DataFrame:
    """LEAD columns of a leading market on a one-minute grid, as of each bar's end (F011); zero while they warm up.

    ``tape`` has ts, seq and price. Frames run over the minutes that both markets have.
    """
    own = minute_grid(bars, "time_end", "close", ["time_end", "bar_id"])
    lead = minute_grid(tape.withColumn("series", F.lit("lead")), "ts", "price", ["ts", "seq"]).select("minute", "price")
    grid = own.join(lead, "minute").withColumn("bar_id", F.unix_seconds("minute") / 60)
    one = grid.withColumns({"_r": positive_log(ratio("close", lag("close"))), "_o": positive_log(ratio("price", lag("price"))), "_t": pct_change("close", short), "trend_30m": pct_change("price", short)})
    two = one.withColumns({"_sr": rolling("stddev_samp", "_r", short), "_so": rolling("stddev_samp", "_o", short)})
    three = two.withColumns(
        {
            "corr_regime_60m": rolling_corr("_r", "_o", long),
            "beta_60m": rolling_beta("_r", "_o", long),
            "vol_ratio_30m": ratio("_sr", "_so"),
            "divergence_30m": ratio("_t", "_sr") - ratio("trend_30m", "_so"),
        }
    )
    found = three.select("series", "minute", *LEAD)
    joined = asof_backward(bars.withColumn("_end", F.col("time_end").cast("timestamp")), found, "_end", "minute", ["series"], list(LEAD), span=DAY)
    return joined.drop("asof_key", "_end").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in LEAD})


def dollar_coherence(df: DataFrame, together: str, against: str, w: int = 100) -> DataFrame:
    """usd_coherence: half the difference of two correlators' correlations (F025). Needs ``intermarket`` of both."""
    return df.withColumn(f"usd_coherence_{w}", (F.col(f"corr_{w}_{together}") - F.col(f"corr_{w}_{against}")) / 2)


def risk_on(df: DataFrame, equities: str, bonds: str, k: int = 50) -> DataFrame:
    """risk_on_momentum: sign of the equities' log change over k bars less that of the bonds' (F029)."""
    move = lambda c: F.signum(positive_log(ratio(f"price_{c}", lag(f"price_{c}", k))))
    return df.withColumn("risk_on_momentum", move(equities) - move(bonds))


def curve_difference(df: DataFrame, a: str, b: str, name: str, k: int = 50) -> DataFrame:
    """Differences of two curves' deltas over k and 2k bars (F030). Needs ``spread_family`` of both."""
    return df.withColumns({f"{name}_delta_{n}": F.col(f"{a}_delta_{n}") - F.col(f"{b}_delta_{n}") for n in (k, 2 * k)})


def yield_curves(df: DataFrame, long: str, short: str, other: str, z: int = 400) -> DataFrame:
    """de_curve (long less short yield) and the z-score of the spread to another long yield (F044).

    Yields are filled forward, then backward, then with zero, within a series; the backward fill looks ahead, as in the
    surveyed system, and only where a yield's first value comes after the first bar.
    """
    filled = df.withColumns({f"_{c}": F.coalesce(ffill(f"price_{c}"), bfill(f"price_{c}"), F.lit(0.0)) for c in (long, short, other)})
    one = filled.withColumns({"de_curve": F.col(f"_{long}") - F.col(f"_{short}"), "_spread": F.col(f"_{other}") - F.col(f"_{long}")})
    return one.withColumn(f"spread_z_{z}", rolling_z("_spread", z)).drop("_spread", *[f"_{c}" for c in (long, short, other)])


def log_move(x: str) -> Column:
    """Logarithmic change from the bar before, NULL where a price is zero (rule N2)."""
    return positive_log(ratio(x, lag(x)))


def ieee_move(x: str) -> Column:
    """The same by IEEE 754: infinite or NaN at a zero price, so that all statistics of frames that hold it are NaN."""
    return ieee_log(ieee_ratio(x, lag(x)))


def intermarket(df: DataFrame, name: str, w: int = 50, move: Callable[[str], Column] = log_move) -> DataFrame:
    """Correlation, relative strength and divergence with one correlator (F022-F024), and its level scores (F021)."""
    price = f"price_{name}"
    one = df.withColumns({"_r": move("close"), "_o": move(price), "_rs": ratio("close", price)})
    def unit(x: str) -> Column:
        s = rolling("stddev_samp", x, w)
        return F.when(s == 0, 1.0).otherwise(s)
    return one.withColumns(
        {
            f"corr_{w}_{name}": F.coalesce(rolling_corr("_r", "_o", w), F.lit(0.0)),
            f"rel_strength_z_{name}": rolling_z("_rs", w),
            f"divergence_{w}_{name}": F.col("_r") / unit("_r") - F.col("_o") / unit("_o"),
            f"zscore_{w}_{name}": rolling_z(price, w),
            f"smoothed_level_{w}_{name}": rolling("avg", price, w),
            f"vol_of_vol_{name}_{w}": rolling("stddev_samp", "_o", w),
        }
    ).drop("_r", "_o", "_rs")


def spread_family(df: DataFrame, a: str, b: str, name: str, z: int = 400, k: int = 50) -> DataFrame:
    """Level, z-score, two deltas and the acceleration of a spread (F026)."""
    one = df.withColumn(name, F.col(a) - F.col(b))
    two = one.withColumns({f"{name}_z": rolling_z(name, z), f"{name}_delta_{k}": diff(name, k), f"{name}_delta_{2 * k}": diff(name, 2 * k)})
    return two.withColumn(f"{name}_accel_{k}", diff(f"{name}_delta_{k}", k))


def news(df: DataFrame, volume: str, tone: str, short: int = 96, long: int = 2880) -> DataFrame:
    """Relative news volume, volume-weighted tone and their product (F040, F041)."""
    base = rolling("avg", volume, long, 1)
    one = df.withColumns({"news_rvol": rolling("avg", volume, short, 1) / F.when(base == 0, 1.0).otherwise(base), "_tv": F.col(tone) * F.col(volume)})
    trend = ratio(rolling("sum", "_tv", short, 1), rolling("sum", volume, short, 1))
    return one.withColumn("news_sentiment_trend", trend).withColumn("news_sentiment_impact", F.col("news_sentiment_trend") * F.col("news_rvol")).drop("_tv")


NEWS = (
    "news_vol_eur", "news_tone_eur", "news_vol_usd", "news_tone_usd", "global_tone", "global_polarity", "panic_score", "conflict_intensity", "epu_total", "epu_usd", "epu_eur", "epu_diff",
    "inflation_vol", "central_bank_tone", "energy_crisis_eur", "total_vol",
)


def news_table(rows: DataFrame, by: str, masks: dict[str, Column], least: int = 5, panic: float = -2.0) -> DataFrame:
    """NEWS columns for each time ``by`` (F043, SRC02, SRC03): one aggregation of masked counts and tone sums, then the
    panic score over the table of times (one row a day or quarter of an hour).

    ``rows`` has tone and polarity; ``masks`` has eur, usd, local, conflict, epu, inflation, bank and energy. A mean of
    nothing is 0. The panic score is the polarity turned round where the tone's z-score against all times so far is
    under ``panic``; times before the ``least``-th take its mean and deviation.
    """
    m = {k: F.coalesce(v, F.lit(False)) for k, v in masks.items()}
    some = lambda n: F.when(n == 0, 1).otherwise(n)
    total = lambda mask: F.coalesce(F.sum(F.when(mask, F.col("tone"))), F.lit(0.0))
    n = {k: F.count_if(v) for k, v in m.items()}
    made = rows.groupBy(by).agg(
        n["eur"].alias("news_vol_eur"),
        (total(m["eur"]) / some(n["eur"])).alias("news_tone_eur"),
        n["usd"].alias("news_vol_usd"),
        (total(m["usd"]) / some(n["usd"])).alias("news_tone_usd"),
        (F.coalesce(F.sum("tone"), F.lit(0.0)) / F.count("*")).alias("global_tone"),
        (F.coalesce(F.sum("polarity"), F.lit(0.0)) / F.count("*")).alias("global_polarity"),
        n["conflict"].alias("conflict_intensity"),
        n["epu"].alias("epu_total"),
        F.count_if(m["epu"] & m["usd"]).alias("epu_usd"),
        F.count_if(m["epu"] & m["local"]).alias("epu_eur"),
        n["inflation"].alias("inflation_vol"),
        (total(m["bank"]) / some(n["bank"])).alias("central_bank_tone"),
        F.count_if(m["energy"] & m["eur"]).alias("energy_crisis_eur"),
    )
    past = Window.partitionBy(F.lit(0)).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)  # one row a time
    ahead = Window.partitionBy(F.lit(0)).orderBy(by).rowsBetween(0, Window.unboundedFollowing)
    enough = F.count("global_tone").over(past) >= least
    one = made.withColumns({"_m": F.when(enough, F.avg("global_tone").over(past)), "_s": F.when(enough, F.stddev_samp("global_tone").over(past))})
    mean, std = (F.coalesce(F.first(c, ignorenulls=True).over(ahead), F.lit(d)) for c, d in (("_m", 0.0), ("_s", 1.0)))
    score = ratio(F.col("global_tone") - mean, std)
    return one.withColumns({"panic_score": F.when(score < panic, -F.col("global_polarity")).otherwise(0.0), "epu_diff": F.col("epu_usd") - F.col("epu_eur"), "total_vol": F.col("news_vol_eur") + F.col("news_vol_usd")}).select(by, *NEWS)


def calendar(bars: DataFrame, events: DataFrame, minutes_per_bar: float = 1.5, span: int = DAY) -> DataFrame:
    """Distance to the next and the last scheduled event (F086). ``events``: ts, kind (number); bars need time_end.

    minutes_to_shock is the time since the last event, or the negative time to the next one, whichever is nearer, within
    180 either way.
    """
    right = events.select(F.col("ts").alias("_ts"), F.col("kind"))
    ahead = asof_forward(bars, right, "time_end", "_ts", [], ["kind"], "_next", span=span).withColumnRenamed("asof_key", "_n")
    both = asof_backward(ahead, right, "time_end", "_ts", [], ["kind"], "_last", span=span).withColumnRenamed("asof_key", "_p")

    def minutes(a: str, b: str) -> Column:
        return (F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / 6e7

    to, since = minutes("_n", "time_end"), minutes("time_end", "_p")
    far = F.lit(9999.0)
    near = F.when(F.coalesce(since, far) < F.coalesce(to, far), F.coalesce(since, far)).otherwise(-F.coalesce(to, far))
    bars_to, bars_since = F.coalesce(to / minutes_per_bar, far), F.coalesce(since / minutes_per_bar, far)
    one = both.withColumn("minutes_to_shock", clip(near, -180.0, 180.0))
    return one.withColumns(
        {
            "shock_decay": 1 / (1 + F.abs("minutes_to_shock") / 10),
            "bars_to_event": clip(bars_to, 0.0, 500.0).cast("int"),
            "bars_since_event": clip(bars_since, 0.0, 500.0).cast("int"),
            "pre_event_tension": F.coalesce(clip(1 - to / 120, 0.0, 1.0), F.lit(0.0)),
            "post_event_phase": (bars_since <= 30).cast("int"),
            "pending_event_type": F.when(to <= 240, F.col("kind_next")).otherwise(0),
        }
    ).drop("_n", "_p", "kind_next", "kind_last")


def surprises(events: DataFrame) -> DataFrame:
    """surprise_z: (actual - forecast) over the deviation of the prior surprises of the same event (at least two),
    within 5 either way (F087). ``events``: event_key, ts, actual, forecast."""
    w = Window.partitionBy("event_key").orderBy("ts", "actual", "forecast").rowsBetween(Window.unboundedPreceding, -1)
    one = events.withColumn("surprise", F.col("actual") - F.col("forecast"))
    prior = F.when(F.count("surprise").over(w) >= 2, F.stddev_pop("surprise").over(w))
    return one.withColumn("surprise_z", F.coalesce(clip(ratio("surprise", prior), -5.0, 5.0), F.lit(0.0)))


def surprise_features(bars: DataFrame, scored: DataFrame, names: dict[str, str], span: int = DAY) -> DataFrame:
    """{name}_surprise_z of each event key as of the bar's end, zero before the first, with econ_surprise_magnitude (mean
    size) and usd_eur_surprise_diff (mean of usd_ less mean of eur_ names) (F087). ``scored``: ts, event_key, surprise_z."""
    columns = {f"{n}_surprise_z": F.when(F.col("event_key") == k, F.coalesce("surprise_z", F.lit(0.0))) for k, n in names.items()}
    joined = asof_columns(bars, scored, "time_end", "ts", [], columns, span).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})
    mean = lambda cs: sum((F.col(c) for c in cs), F.lit(0.0)) / len(cs)
    usd, eur = [c for c in columns if c.startswith("usd_")], [c for c in columns if c.startswith("eur_")]
    made = {"econ_surprise_magnitude": sum((F.abs(c) for c in columns), F.lit(0.0)) / len(columns)}
    return joined.withColumns(made | ({"usd_eur_surprise_diff": mean(usd) - mean(eur)} if usd and eur else {}))


def macro(daily: DataFrame) -> DataFrame:
    """Scores on a daily table (F088): per column z over 60 days, trend over 10, delta over 20. series is the column name,
    bar_id the day number; value the level."""
    return daily.withColumns({"zscore_60d": rolling_z("value", 60, 30), "trend_10d": F.col("value") - rolling("avg", "value", 10), "delta_20d": diff("value", 20)})


MACRO = {
    "net_liq_zscore_60d": ("net_liquidity_bil", "z", 60), "credit_stress_zscore_60d": ("credit_spread", "z", 60), "inflation_expectations_trend": ("inflation_breakeven", "d", 20), "vix_zscore_60d": ("vix", "z", 60),
    "vix_trend_10d": ("vix", "d", 10), "nfci_level": ("financial_conditions", "level", 0), "nfci_delta_4w": ("financial_conditions", "d", 20), "rate_diff_zscore_60d": ("usd_eur_rate_diff", "z", 60),
    "rate_diff_delta_20d": ("usd_eur_rate_diff", "d", 20),
}


def macro_features(daily: DataFrame) -> DataFrame:
    """The MACRO columns whose levels exist, on a daily table (F088). series groups, bar_id orders the days."""
    kinds = {"z": lambda c, k: ratio(F.col(c) - rolling("avg", c, k), rolling("stddev_samp", c, k)), "d": diff, "level": lambda c, _: F.col(c)}
    return daily.withColumns({n: kinds[kind](c, k) for n, (c, kind, k) in MACRO.items() if c in daily.columns})


def attach_daily(bars: DataFrame, daily: DataFrame, names: list[str], lag_days: int = 1) -> DataFrame:
    """Daily columns on bars: the values of ``lag_days`` before the bar's day, filled from earlier bars (J03, J05).
    ``daily`` has day (date)."""
    known = daily.select(F.date_add("day", lag_days).alias("_day"), *names)
    joined = bars.withColumn("_day", F.to_date("time_start")).join(known, "_day", "left").drop("_day")
    return joined.withColumns({n: ffill(n) for n in names})


def positioning(weekly: DataFrame) -> DataFrame:
    """Weekly positions (F089, F093): net, sentiment, z over 52 and 156 weeks, change, extreme at the 10 and 90 % quantile.
    Needs series, bar_id (week), longs, shorts."""
    total = F.col("longs") + F.col("shorts")
    one = weekly.withColumns({"net": F.col("longs") - F.col("shorts"), "sentiment": (F.col("longs") - F.col("shorts")) / F.when(total == 0, 1.0).otherwise(total)})
    low, high = rolling_quantile("sentiment", 52, 0.1, 20), rolling_quantile("sentiment", 52, 0.9, 20)
    return one.withColumns(
        {
            "net_zscore_1y": rolling_z("net", 52, 10),
            "net_zscore_3y": rolling_z("net", 156, 30),
            "net_change_1w": diff("net"),
            "sentiment_extreme": F.when(F.col("sentiment") >= high, 1).when(F.col("sentiment") <= low, -1).otherwise(0),
        }
    )


def auctions(table: DataFrame) -> DataFrame:
    """z of bid-to-cover and of the tail over 20 auctions of a tenor, at least 5 (F090). series is the tenor."""
    return table.withColumns({"btc_zscore": rolling_z("btc", 20, 5), "tail_zscore": rolling_z("tail", 20, 5)})


TENORS = ("2y", "5y", "10y", "30y")


def auction_features(bars: DataFrame, scored: DataFrame, tenors: tuple[str, ...] = TENORS, span: int = DAY) -> DataFrame:
    """auction_btc_zscore_{tenor} and auction_tail_zscore_{tenor} as of the bar's end, zero before the first, with their
    means over tenors as demand and stress (F090). ``scored``: ts, tenor, btc_zscore, tail_zscore."""
    columns = {f"auction_{k}_zscore_{t}": F.when(F.col("tenor") == t, F.coalesce(f"{k}_zscore", F.lit(0.0))) for t in tenors for k in ("btc", "tail")}
    joined = asof_columns(bars, scored, "time_end", "ts", [], columns, span).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})
    mean = lambda k: sum((F.col(f"auction_{k}_zscore_{t}") for t in tenors), F.lit(0.0)) / len(tenors)
    return joined.withColumns({"auction_stress_aggregate": mean("tail"), "auction_demand_aggregate": mean("btc")})


def vix_features(df: DataFrame, price: str = "close") -> DataFrame:
    """Trend over 400 and score over 2000 bars (F091)."""
    return df.withColumns({"vix_trend_400": pct_change(price, 400), "vix_zscore_2000": rolling_z(price, 2000, 200)})


def net_liquidity(assets: Column, treasury: Column, repo: Column) -> Column:
    """Assets in billions less treasury account and reverse repo (F092)."""
    return assets / 1000 - treasury - repo


def rate_differential(fed: Column, ecb: Column) -> Column:
    """Policy rate of one bank less the other's (F092)."""
    return fed - ecb
