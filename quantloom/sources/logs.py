"""Trades from the log of the live path (SRC18): lines in file order, events, closed trades, the last lines.

Files of a log may be split anywhere. A line's place is its file, the offset of its split and its number there; what a
split adds to the count of entries is carried to the next ones, one small row a split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.sources.staging import staged

#: Fixed forms of the log's lines: time up to the first comma, then what happened.
ENTRY = r"VIRTUAL ENTRY: (BUY|SELL) ([\d\.]+) lots .*?Strat (.*?) @ ([\d\.]+)"
EXIT = r"VIRTUAL EXIT: (.*?) @ ([\d\.]+)"
PNL = r"Trade PnL: \$([-+]?[\d\.,]+)"

_PLACE = ["file", "block", "at"]


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): the lines of text files with their places, which order them."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def last_lines(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """(number, line) of the last ``n`` lines of a log, without the white space around them, in order."""
    last = placed_lines(spark, path).orderBy(*[F.desc(c) for c in _PLACE]).limit(n)
    return last.select(F.row_number().over(Window.orderBy(*_PLACE)).cast("long").alias("number"), F.trim("line").alias("line"))  # n rows


def trade_events(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """place, time, kind (ENTRY, EXIT, PNL), side, lots, strategy, reason, price, pnl of the lines that tell of trades.

    Times are those of ``zone`` made UTC; lines whose time can't be read are left out. A line is the first of the three
    kinds that it matches; numbers that can't be read are NULL.
    """
    rows = placed_lines(spark, path)
    part = lambda pattern, k: F.regexp_extract("line", pattern, k)
    number = lambda text: F.regexp_replace(text, ",", "").try_cast("double")
    kind = F.when(F.col("line").rlike(ENTRY), "ENTRY").when(F.col("line").rlike(EXIT), "EXIT").when(F.col("line").rlike(PNL), "PNL")
    time = F.to_utc_timestamp(F.try_to_timestamp(F.split("line", ",")[0]), zone)
    rows = rows.select(*_PLACE, "line", kind.alias("kind"), time.alias("time")).where("kind is not null and time is not null")
    of = lambda name, value: F.when(F.col("kind") == name, value)
    return rows.select(
        F.struct(*_PLACE).alias("place"), "time", "kind", of("ENTRY", part(ENTRY, 1)).alias("side"), of("ENTRY", number(part(ENTRY, 2))).alias("lots"), of("ENTRY", part(ENTRY, 3)).alias("strategy"),
        of("EXIT", F.trim(part(EXIT, 1))).alias("reason"), F.coalesce(of("ENTRY", number(part(ENTRY, 4))), of("EXIT", number(part(EXIT, 2)))).alias("price"), of("PNL", number(part(PNL, 1))).alias("pnl"),
    )


def _cycles(events: DataFrame) -> DataFrame:
    """``cycle``: the number of entries up to each event, from 1; events before the first entry go."""
    events = staged(events.withColumns({"file": F.col("place.file"), "block": F.col("place.block")}), "log-events")
    entries = F.count_if(F.col("kind") == "ENTRY")
    splits = events.groupBy("file", "block").agg(entries.alias("_n"))
    past = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split of a file
    base = splits.select("file", "block", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_base"))
    here = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_here", F.sum((F.col("kind") == "ENTRY").cast("int")).over(here)).join(base, ["file", "block"]).withColumn("cycle", F.col("_base") + F.col("_here")).where("cycle > 0").drop("_base", "_here", "file", "block")


def closed_trades(events: DataFrame) -> DataFrame:
    """One row a closed trade of ``trade_events``: entry_time, side, lots, strategy, entry_price, exit_time, exit_price,
    reason, pnl.

    An entry opens a trade and drops one still open. Exits close it; the first profit line after an exit ends it, and
    until then a later exit replaces an earlier one. Exits without a trade and profits before an exit are passed over. A
    trade closed without a readable profit line has pnl 0.
    """
    w = Window.partitionBy("cycle").orderBy("place")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = _cycles(events).withColumn("_exits", F.sum((F.col("kind") == "EXIT").cast("int")).over(upto))
    ends = (F.col("kind") == "PNL") & (F.col("_exits") > 0)
    rows = rows.withColumn("_ended", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0))).where("_ended = 0")

    def last(kind: str, *columns: str) -> Column:
        return F.max_by(F.struct(*columns), F.when(F.col("kind") == kind, F.col("place")))

    made = rows.groupBy("cycle").agg(
        last("ENTRY", "time", "side", "lots", "strategy", "price").alias("e"), F.count_if(F.col("kind") == "EXIT").alias("_n"), last("EXIT", "time", "price", "reason").alias("x"), F.max(F.when(ends, F.col("pnl"))).alias("pnl")
    ).where("_n > 0")
    return made.select(
        F.col("e.time").alias("entry_time"), "e.side", "e.lots", "e.strategy", F.col("e.price").alias("entry_price"), F.col("x.time").alias("exit_time"), F.col("x.price").alias("exit_price"), "x.reason", F.coalesce("pnl", F.lit(0.0)).alias("pnl")
    )
