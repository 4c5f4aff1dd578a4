"""Labels: triple barriers (LB01) and forward returns (LB02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.frames import lag, ordered, ratio, rolling


def triple_barrier(bars: DataFrame, horizon: int, tp: float = 4.0, sl: float = 2.0, atr_window: int = 50, floor_bps: float = 1.5) -> DataFrame:
    """``label``: the return at the barrier touched first within ``horizon`` bars (the lower one if both in one bar), or
    at the horizon. NULL for the last ``horizon`` bars and while the mean true range is not full."""
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))
    one = bars.withColumn("_tr", tr).withColumn("_atr", rolling("avg", "_tr", atr_window))
    ahead = ordered().rowsBetween(1, horizon)
    path = F.collect_list(F.struct("high", "low")).over(ahead)
    atr = F.greatest(F.col("_atr"), F.col("close") * floor_bps / 1e4)
    two = one.withColumns({"_path": path, "_up": F.col("close") + atr * tp, "_down": F.col("close") - atr * sl, "_end": F.lead("close", horizon).over(ordered())})
    up = F.array_position(F.transform("_path", lambda b: b.high >= F.col("_up")), True)
    down = F.array_position(F.transform("_path", lambda b: b.low <= F.col("_down")), True)
    at = F.when((up == 0) & (down == 0), F.col("_end")).when((up > 0) & ((down == 0) | (up < down)), F.col("_up")).otherwise(F.col("_down"))
    ready = F.col("_atr").isNotNull() & F.col("_end").isNotNull()
    return two.withColumn("label", F.when(ready, ratio(at - F.col("close"), "close"))).drop("_tr", "_atr", "_path", "_up", "_down", "_end")


def forward_returns(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """fwd_{h}: close h bars later over close, less one."""
    return bars.withColumns({f"fwd_{h}": ratio(F.lead("close", h).over(ordered()), "close") - 1 for h in horizons})
