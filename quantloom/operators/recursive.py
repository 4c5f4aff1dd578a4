"""Operators whose state is recursive or greedy (F027, F042, F070-F073, F080, WN13, WN20): one ordered scan by group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.frames import clean, ffill, ratio


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponentially weighted mean with finite-history weights: sum (1-a)^k x / sum (1-a)^k over what is there (WN13)."""
    out, top, bottom = np.full(len(x), np.nan), 0.0, 0.0
    for i, v in enumerate(x):
        top, bottom = top * (1 - alpha), bottom * (1 - alpha)
        if v == v:
            top, bottom = top + v, bottom + 1
        if bottom > 0:
            out[i] = top / bottom
    return out


def fisher(high: np.ndarray, low: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Fisher transform of the smoothed place of the mid price in its range, and the value before it (F080, WN20).

    The first bar has neither, the second follows on zero; a series shorter than the window has none (NaN)."""
    mid = (high + low) / 2
    if len(mid) < w:
        return np.full(len(mid), np.nan), np.full(len(mid), np.nan)
    out, v = np.zeros(len(mid)), 0.0
    for i in range(1, len(mid)):
        part = mid[max(0, i - w + 1) : i + 1]
        span = part.max() - part.min()
        place = 2 * (mid[i] - part.min()) / span - 1 if span > 0 else 0.0
        v = 0.33 * place + 0.67 * v
        v = math.copysign(0.999, v) if abs(v) > 0.99 else v
        out[i] = math.atanh(v) + 0.5 * out[i - 1]
    before = np.append(np.nan, out[:-1])
    return np.append(np.nan, out[1:]), before


def _rs(d: np.ndarray) -> np.ndarray:
    """Rescaled-range exponents of rows of steps, within [0, 1]; 0.5 for rows without spread."""
    std = d.std(axis=1)
    c = (d - d.mean(axis=1, keepdims=True)).cumsum(axis=1)
    spread = c.max(axis=1) - c.min(axis=1)
    fine = (std > 0) & (spread > 0)
    out = np.full(len(d), 0.5)
    out[fine] = np.clip(np.log(spread[fine] / std[fine]) / math.log(d.shape[1]), 0.0, 1.0)
    return out


def rs_hurst(x: np.ndarray, w: int, least: int = 20) -> np.ndarray:
    """Rescaled-range exponent of the steps in each window, within [0, 1]; 0.5 where there are too few (F027)."""
    step = np.diff(x, prepend=np.nan)
    out = np.full(len(x), 0.5)
    whole = ~np.isnan(step)
    if len(x) > w:
        views = np.lib.stride_tricks.sliding_window_view(step, w)
        full = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(whole, w).all(axis=1))
        for at in range(0, len(full), 4096):
            out[full[at : at + 4096] + w - 1] = _rs(views[full[at : at + 4096]])
    else:
        full = np.zeros(0, np.int64)
    for i in np.setdiff1d(np.arange(len(x)), full + w - 1):  # windows that are short, or hold a gap
        d = step[max(0, i - w + 1) : i + 1]
        d = d[~np.isnan(d)]
        if len(d) >= least:
            out[i] = _rs(d[None, :])[0]
    return out


def histogram(price: np.ndarray, volume: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin centres, volume in each bin) over the prices' own range; one bin for a single price."""
    low, high = price.min(), price.max()
    if high <= low:
        return np.array([low]), np.array([volume.sum()])
    at = np.minimum(((price - low) / (high - low) * bins).astype(int), bins - 1)
    width = (high - low) / bins
    return low + (np.arange(bins) + 0.5) * width, np.bincount(at, volume, bins)


def value_area(centres: np.ndarray, volume: np.ndarray, share: float = 0.7) -> tuple[float, float, float]:
    """(point of control, low, high): from the fullest bin outwards, the fuller neighbour first, the lower one on ties,
    until ``share`` of the volume is inside."""
    at = int(volume.argmax())
    a = b = at
    inside, goal = volume[at], share * volume.sum()
    while inside < goal and (a > 0 or b < len(volume) - 1):
        below = volume[a - 1] if a > 0 else -1.0
        above = volume[b + 1] if b < len(volume) - 1 else -1.0
        if below >= above:
            a -= 1
            inside += below
        else:
            b += 1
            inside += above
    return float(centres[at]), float(centres[a]), float(centres[b])


def by_series(df: DataFrame, columns: dict[str, str], make, schema: str) -> DataFrame:
    """One ordered scan for each series: ``make`` maps arrays to named arrays. A series is one instrument's bars."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_id")
        return pdf[["series", "bar_id"]].assign(**make(**{k: pdf[c].to_numpy(float) for k, c in columns.items()}))
    return df.select("series", "bar_id", *columns.values()).groupBy("series").applyInPandas(run, f"series string, bar_id long, {schema}")


def fisher_transform(df: DataFrame, w: int) -> DataFrame:
    def make(high, low):
        f, s = fisher(high, low, w)
        return {"fisher": f, "fisher_signal": s}
    made = by_series(df, {"high": "high", "low": "low"}, make, "fisher double, fisher_signal double")
    return made.withColumns({c: clean(c) for c in ("fisher", "fisher_signal")})


def news_decay(df: DataFrame, impact: str, hours: tuple[int, ...] = (2, 4, 8), per_hour: int = 4) -> DataFrame:
    """Decayed news impact for half-lives in hours (F042): span = per_hour * hours / ln 2, alpha = 2 / (span + 1)."""
    alphas = {f"news_impact_decay_{h}h": 2 / (per_hour * h / math.log(2) + 1) for h in hours}
    return by_series(df, {"x": impact}, lambda x: {k: ewm(x, a) for k, a in alphas.items()}, ", ".join(f"{k} double" for k in alphas))


def spread_hurst(df: DataFrame, column: str, w: int, delta: int = 50) -> DataFrame:
    """hurst of a spread and its change over ``delta`` bars, 0.5 where there is none (F027)."""
    def make(x):
        h = rs_hurst(x, w)
        change = np.full(len(h), 0.5)
        change[delta:] = h[delta:] - h[:-delta] if len(h) > delta else change[delta:]
        return {"hurst": h, "hurst_delta": change}
    return by_series(df, {"x": column}, make, "hurst double, hurst_delta double")


PROFILE = "series string, day date, vpoc double, val double, vah double, day_vol double, day_low double, day_high double, volumes array<double>"


def daily_profiles(bars: DataFrame, bins: int = 200) -> DataFrame:
    """Volume profile of each series and day (F070): a day's bars are one group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf["close"].to_numpy(float)
        c, v = histogram(p, pdf["volume"].to_numpy(float), bins)
        poc, low, high = value_area(c, v)
        return pd.DataFrame([(pdf["series"].iat[0], pdf["day"].iat[0], poc, low, high, v.sum(), p.min(), p.max(), v.tolist())], columns=[x.split()[0] for x in PROFILE.split(", ")])
    return bars.select("series", F.to_date("time_start").alias("day"), "close", "volume").groupBy("series", "day").applyInPandas(run, PROFILE)


def composite_profiles(profiles: DataFrame, days: int, bins: int = 100) -> DataFrame:
    """Value area of the ``days`` profiles before each day (F073): volumes go to the bin of the common range that holds
    their own bin's centre. Days without so many before them have none; a series' days are one group (a row a day)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        lows, highs, volumes = pdf["day_low"].to_numpy(), pdf["day_high"].to_numpy(), pdf["volumes"].to_numpy()
        rows = []
        for i in range(days, len(pdf)):
            low, high = lows[i - days : i].min(), highs[i - days : i].max()
            if high <= low:
                continue
            width, total = (high - low) / bins, np.zeros(bins)
            for k in range(i - days, i):
                v = np.asarray(volumes[k], float)
                if highs[k] > lows[k]:
                    centres = lows[k] + (np.arange(len(v)) + 0.5) * (highs[k] - lows[k]) / len(v)
                    np.add.at(total, np.clip(((centres - low) / width).astype(int), 0, bins - 1), v)
            if total.sum() > 0:
                rows.append((pdf["series"].iat[0], pdf["day"].iat[i], *value_area(low + (np.arange(bins) + 0.5) * width, total)))
        return pd.DataFrame(rows, columns=["series", "day", "vpoc", "val", "vah"])
    return profiles.groupBy("series").applyInPandas(run, "series string, day date, vpoc double, val double, vah double")


def composite_context(bars: DataFrame, composites: DataFrame, name: str) -> DataFrame:
    """{name}_vpoc, _val, _vah of the bar's day, filled from before, else the close; whether the close is inside, and its
    distance to the control price as a share (F073)."""
    known = composites.select("series", "day", *[F.col(c).alias(f"{name}_{c}") for c in ("vpoc", "val", "vah")])
    joined = bars.withColumn("day", F.to_date("time_start")).join(known, ["series", "day"], "left").drop("day")
    joined = joined.withColumns({f"{name}_{c}": F.coalesce(ffill(f"{name}_{c}"), "close") for c in ("vpoc", "val", "vah")})
    inside = F.col("close").between(F.col(f"{name}_val"), F.col(f"{name}_vah"))
    return joined.withColumns({f"{name}_in_value": inside.cast("double"), f"dist_to_{name}_vpoc": ratio(F.col("close") - F.col(f"{name}_vpoc"), f"{name}_vpoc")})


def developing_areas(p: np.ndarray, v: np.ndarray, bins: int = 50) -> list[tuple[float, float, float]]:
    """The value area after each bar of a day. The histogram is made anew only where the day's range grows."""
    out, low, high, held = [], math.inf, -math.inf, np.zeros(1)
    for i in range(len(p)):
        if p[i] < low or p[i] > high:
            low, high = min(low, p[i]), max(high, p[i])
            centres, held = histogram(p[: i + 1], v[: i + 1], bins)
        elif high > low:
            held[min(int((p[i] - low) / (high - low) * bins), bins - 1)] += v[i]
        else:
            held[0] += v[i]
        out.append(value_area(centres, held))
    return out


def developing_profile(bars: DataFrame, bins: int = 50) -> DataFrame:
    """The value area of each day so far, at every bar, with its width, the close's distance to its control price, both as
    shares, and whether the close is inside (F072)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_id")
        areas = developing_areas(pdf["close"].to_numpy(float), pdf["volume"].to_numpy(float), bins)
        return pdf[["series", "bar_id", "close"]].assign(**{n: [a[k] for a in areas] for k, n in enumerate(("dev_vpoc", "dev_val", "dev_vah"))})
    keyed = bars.select("series", F.to_date("time_start").alias("day"), "bar_id", "close", "volume")
    made = keyed.groupBy("series", "day").applyInPandas(run, "series string, bar_id long, close double, dev_vpoc double, dev_val double, dev_vah double")
    return made.select(
        *("series", "bar_id", "dev_vpoc", "dev_val", "dev_vah"),
        ratio(F.col("dev_vah") - F.col("dev_val"), "close").alias("dev_va_width"),
        ratio(F.col("close") - F.col("dev_vpoc"), "dev_vpoc").alias("price_vs_dev_vpoc"),
        F.col("close").between(F.col("dev_val"), F.col("dev_vah")).cast("double").alias("in_dev_value"),
    )


def profile_context(bars: DataFrame, profiles: DataFrame) -> DataFrame:
    """Zones and distances (as shares) against the profile of the trading day before (F071)."""
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("day")
    before = profiles.select("series", "day", *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("vpoc", "val", "vah", "day_vol")])
    day = Window.partitionBy("series", "day").orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumn("day", F.to_date("time_start")).join(before, ["series", "day"], "left")
    df = df.withColumns({f"prev_{c}": F.coalesce(f"prev_{c}", "close") for c in ("vpoc", "val", "vah")}).withColumn("day_open", F.first("open").over(day))
    zone = F.when(F.col("day_open") > F.col("prev_vah"), 1).when(F.col("day_open") < F.col("prev_val"), -1).otherwise(0)
    df = df.withColumns({"in_value_area": F.col("close").between(F.col("prev_val"), F.col("prev_vah")).cast("double"), "open_zone": zone})
    back = ((F.col("open_zone") == 1) & (F.col("low") <= F.col("prev_vah"))) | ((F.col("open_zone") == -1) & (F.col("high") >= F.col("prev_val")))
    far = lambda c: ratio(F.col("close") - F.col(c), c)
    return df.withColumns({"reentered_value": F.bool_or(back).over(day).cast("int"), **{f"dist_to_{c}": far(f"prev_{c}") for c in ("vpoc", "val", "vah")}, "dist_to_day_open": far("day_open")})
