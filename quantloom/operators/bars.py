"""Bar construction, BAR01-BAR12. Batch only; the streaming forms are in ``quantloom.streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.frames import ratio


#: Optional tick columns, and what a bar holds of them: fixed names of the surveyed bars.
OPTIONAL = {
    "ofi": ("tick_ofi", F.sum), "spread": ("tick_spread", F.avg), "bid_size": ("avg_bid_size", F.avg), "ask_size": ("avg_ask_size", F.avg), "bid": ("avg_bid_price", F.avg), "ask": ("avg_ask_price", F.avg),
}


def bar_numbers(ticks: DataFrame, threshold: float, span: str = "1 hour") -> DataFrame:
    """``ticks`` with bar_id and signed volume, without ordering a whole series in one task.

    A two-pass prefix sum: volume and last price of each time range of ``span`` (one small row a range), carried over the
    ranges; then every range is numbered by itself.
    """
    ranged = ticks.withColumn("_range", F.window(F.col("ts").cast("timestamp"), span)["start"])
    ends = ranged.groupBy("series", "_range").agg(F.sum("vol").alias("_vol"), F.max_by("mid", F.struct("ts", "seq")).alias("_mid"))
    past = Window.partitionBy("series").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("series", "_range", F.coalesce(F.sum("_vol").over(past), F.lit(0.0)).alias("_base"), F.last("_mid").over(past).alias("_before"))
    w = Window.partitionBy("series", "_range").orderBy("ts", "seq")
    step = F.col("mid") - F.coalesce(F.lag("mid").over(w), "_before")
    cumulative = F.col("_base") + F.coalesce(F.sum("vol").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    marked = ranged.join(carried, ["series", "_range"]).withColumns({"signed": F.coalesce(F.signum(step), F.lit(0.0)) * F.col("vol"), "bar_id": F.floor(cumulative / F.lit(float(threshold))).cast("long")})
    return marked.drop("_range", "_base", "_before")


def volume_bars(ticks: DataFrame, threshold: float, span: str = "1 hour") -> DataFrame:
    """Volume-clock bars (BAR01-BAR05): bar_id = floor(cumulative volume / threshold) by series.

    The tick that crosses a threshold opens the next bar, and ids can be skipped. The signed volume takes the price
    step across bar edges; the first tick of a series has none. Of the columns in OPTIONAL those that exist are aggregated
    too (BAR04).
    """
    place = F.struct("ts", "seq")
    more = [how(c).alias(name) for c, (name, how) in OPTIONAL.items() if c in ticks.columns]
    bars = bar_numbers(ticks, threshold, span).groupBy("series", "bar_id").agg(
        F.min("ts").alias("time_start"),
        F.max("ts").alias("time_end"),
        F.min_by("mid", place).alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        F.max_by("mid", place).alias("close"),
        F.sum("vol").alias("volume"),
        F.sum("signed").alias("net_aggressor_vol"),
        F.count("*").alias("tick_count"),
        *more,
    )
    return bars.withColumn("ticket_imbalance", F.when(F.col("volume") == 0, 0.0).otherwise(F.col("net_aggressor_vol") / F.nullif("volume", F.lit(0.0))))


def volume_bars_sql(threshold: float) -> str:
    """The same bars as common table expressions over ``ticks``."""
    return f"""signed AS (SELECT *, coalesce(sign(mid - lag(mid) OVER (PARTITION BY series ORDER BY ts, seq)), 0) * vol AS signed,
  CAST(floor(sum(vol) OVER (PARTITION BY series ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / {float(threshold)}) AS BIGINT) AS bar_id FROM ticks),
bars AS (SELECT series, bar_id, min(ts) AS time_start, max(ts) AS time_end, arg_min(mid, (ts, seq)) AS open, max(mid) AS high,
  min(mid) AS low, arg_max(mid, (ts, seq)) AS close, sum(vol) AS volume, sum(signed) AS net_aggressor_vol, count(*) AS tick_count,
  CASE WHEN sum(vol) = 0 THEN 0.0 ELSE sum(signed) / sum(vol) END AS ticket_imbalance FROM signed GROUP BY series, bar_id)"""


def order_flow(quotes: DataFrame) -> DataFrame:
    """Mid, spread and order-flow imbalance of quotes (BAR06, BAR07).

    Bid side: a higher bid adds its size, an equal one the change of size, a lower one takes the size before; the ask
    side mirrors it. The first quote of a series has imbalance 0. Columns: series, ts, seq, bid, ask, bid_size, ask_size.
    """
    w = Window.partitionBy("series").orderBy("ts", "seq")
    b, a, bs, as_ = (F.lag(c).over(w) for c in ("bid", "ask", "bid_size", "ask_size"))
    bid = F.when(F.col("bid") > b, F.col("bid_size")).when(F.col("bid") == b, F.col("bid_size") - bs).otherwise(-bs)
    ask = F.when(F.col("ask") < a, F.col("ask_size")).when(F.col("ask") == a, F.col("ask_size") - as_).otherwise(-as_)
    return quotes.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid"), "ofi": F.coalesce(bid - ask, F.lit(0.0))})


def tick_stats(ticks: DataFrame) -> DataFrame:
    """Per bar: ofi sum, mean spread, std, first and last mid (BAR08). Needs series, bar_id, ts, seq, ofi, spread, mid."""
    place = F.struct("ts", "seq")
    return ticks.groupBy("series", "bar_id").agg(
        F.sum("ofi").alias("tick_ofi"), F.avg("spread").alias("tick_spread"), F.stddev_samp("mid").alias("mid_std"), F.min_by("mid", place).alias("mid_first"), F.max_by("mid", place).alias("mid_last")
    )


def time_bars(ticks: DataFrame, width: str = "1 minute") -> DataFrame:
    """Tumbling time bars; empty ones are left out (BAR09)."""
    place = F.struct("ts", "seq")
    w = F.window(F.col("ts").cast("timestamp"), width)
    return ticks.groupBy("series", w.alias("w")).agg(
        F.min_by("mid", place).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", place).alias("close"), F.sum("vol").alias("volume")
    ).select("series", F.col("w.start").cast("timestamp_ntz").alias("bar_start"), "open", "high", "low", "close", "volume")


def filled_grid(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Last price on a regular time grid with gaps filled from before (BAR10). One row for each series and step."""
    unit = width.split()[1]
    place = F.struct("ts", "seq")
    last = ticks.groupBy("series", F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("t")).agg(F.max_by("mid", place).alias("last"))
    ends = last.groupBy("series").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spine = ends.select("series", F.explode(F.sequence("a", "b", F.expr(f"interval {width}"))).alias("t"))
    w = Window.partitionBy("series").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    filled = spine.join(last, ["series", "t"], "left").withColumn("price", F.last("last", ignorenulls=True).over(w))
    return filled.select("series", F.col("t").cast("timestamp_ntz").alias("t"), "price", F.col("last").isNull().alias("was_gap"))


def bar_end_times(bars: DataFrame, low: float = 58.0, high: float = 62.0, sample: int = 1000, least: int = 100) -> DataFrame:
    """Shift bar starts to bar ends where a series looks like one-minute bars (BAR12): the median of its first ``sample``
    gaps is in [low, high] seconds and it has more than ``least`` rows. Columns series, ts; adds shifted ts and flag."""
    w = Window.partitionBy("series").orderBy("ts")
    gaps = bars.withColumns({"gap": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.lag(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).over(w), "rn": F.row_number().over(w)})
    flags = gaps.groupBy("series").agg(F.percentile(F.when(F.col("rn") <= sample, F.col("gap")), F.lit(0.5)).alias("median_gap"), F.count("*").alias("n"))
    flags = flags.select("series", "median_gap", (F.col("median_gap").between(low, high) & (F.col("n") > least)).alias("shifted"))
    moved = F.when(F.col("shifted"), F.col("ts") + F.expr("interval 60 seconds")).otherwise(F.col("ts"))
    return bars.join(flags, "series").withColumn("ts_end", moved)


def imbalance(signed: str, volume: str):
    return F.coalesce(ratio(signed, volume), F.lit(0.0))
