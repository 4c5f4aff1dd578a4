"""The trade atlas (GA14): every trade with the bars around it, as rows that a chart can be drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bars before the entry and after the exit, trades of a strategy, and bars of a bucket.
CONTEXT, MOST_TRADES, BUCKET = 30, 50, 256


def numbered_trades(trades: DataFrame, keys: tuple[str, ...] = ("series", "strategy_id"), most: int | None = MOST_TRADES) -> DataFrame:
    """``trade``: the trade's number from 1 within ``keys``, by entry; the first ``most`` only (a report), None for all."""
    made = trades.withColumn("trade", F.row_number().over(Window.partitionBy(*keys).orderBy("entry_bar", "exit_bar")).cast("long"))
    return made if most is None else made.where(F.col("trade") <= most)


def around(trades: DataFrame, bars: DataFrame, context: int = CONTEXT, bucket: int = BUCKET) -> DataFrame:
    """The columns of ``trades`` (series, entry_place, exit_place, ...) once for each bar of its series from ``context``
    places before the entry up to ``context`` after the exit, the last of which is left out, with the bar's place, time
    and close; ``offset`` counts from the entry, ``active`` marks the bars of the trade, ``mark`` its entry and exit.

    ``bars`` has series, place (from 0, without gaps), time and close. Both sides meet by buckets of places: a trade goes
    to the few that it touches, a bar is in one, so each pair comes once and only overlapping ones are made.
    """
    low, high = F.greatest(F.col("entry_place") - context, F.lit(0)), F.col("exit_place") + context - 1
    spread = trades.withColumns({"_low": low, "_high": high})
    spread = spread.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / bucket), F.floor(F.col("_high") / bucket))))
    dealt = bars.select("series", "place", "time", "close", F.floor(F.col("place") / bucket).alias("_bucket"))
    rows = spread.join(dealt, ["series", "_bucket"]).where(F.col("place").between(F.col("_low"), F.col("_high"))).drop("_bucket", "_low", "_high")
    active = F.col("place").between(F.col("entry_place"), F.col("exit_place"))
    mark = F.when(F.col("place") == F.col("entry_place"), "ENTRY").when(F.col("place") == F.col("exit_place"), F.upper("reason"))
    return rows.withColumns({"offset": F.col("place") - F.col("entry_place"), "active": active, "mark": mark})


def frames(rows: DataFrame, keys: tuple[str, ...] = ("series", "strategy_id", "trade"), margin: float = 0.15) -> DataFrame:
    """(keys, bars, bottom, top): the price range of each trade's bars, with ``margin`` of it on both sides; a flat range
    counts as a thousandth of the price."""
    made = rows.groupBy(*keys).agg(F.count("*").alias("bars"), F.min("close").alias("_a"), F.max("close").alias("_b"))
    span = F.when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a")).otherwise(F.col("_a") * 0.001)
    return made.select(*keys, "bars", (F.col("_a") - span * margin).alias("bottom"), (F.col("_b") + span * margin).alias("top"))
