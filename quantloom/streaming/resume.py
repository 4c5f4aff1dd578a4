"""Live bars that survive a restart (SS05, SS09): warm-up from history, gap fill, and a bounded ring of bars in state.

State is keyed by series and held in RocksDB: the open bar, the last tick taken, and the last KEEP bars in a ring, slot by
bar number. A stream that starts anew gets it from batch history as its initial state; ticks that come again are told by
their place (ts, seq) and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantloom.streaming.live import close_bars

#: Bars of a series that features may look back on.
KEEP = 4000
#: A gap shorter than the first is none; of a longer one only the last part is filled, up to shortly before now.
LEAST_GAP, MOST_GAP, TAIL = "300 seconds", "2 hours", "30 seconds"

_BAR = "bar_no long, time_start timestamp, time_end timestamp, seq_end long, open double, high double, low double, close double, volume double, net_vol double, ticks long"
_BARS = ["bar_no", "time_start", "time_end", "seq_end", "open", "high", "low", "close", "volume", "net_vol", "ticks"]
#: Bars as they leave the stream; ``fresh`` ones closed in this batch.
LIVE_SCHEMA = f"series string, {_BAR}, fresh boolean"
#: Rows that a stream starts from: bars of a series, and its open bar (kind `open`; ticks 0: none is open).
STATE_SCHEMA = f"series string, kind string, {_BAR}"


class LiveBars(StatefulProcessor):
    """Closes a bar with the tick that brings its volume to ``threshold`` (BAR11), and keeps the last ``keep`` ones.

    With ``window`` it returns all bars kept of each series that closed one in the batch, else the closed ones alone. The
    work of a batch depends on its ticks and on ``keep``, not on what came before.
    """

    def __init__(self, threshold: float, keep: int = KEEP, window: bool = False) -> None:
        self.threshold, self.keep, self.window = threshold, keep, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _BAR)
        self.ring = handle.getMapState("ring", "slot long", _BAR)

    def _put(self, bar: tuple) -> None:
        self.ring.updateValue((int(bar[0]) % self.keep,), bar)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        for kind, *bar in initialState[["kind", *_BARS]].itertuples(index=False):
            bar = (int(bar[0]), _time(bar[1]), _time(bar[2]), int(bar[3]), *(float(x) for x in bar[4:10]), int(bar[10]))
            if kind == "open":
                self.open.update(bar)
            else:
                self._put(bar)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        done, left = next_bars(pd.concat(list(rows)), held, self.threshold)
        if left is not None:
            self.open.update(left)
        for bar in done:
            self._put(bar)
        fresh = {b[0] for b in done}
        out = sorted(tuple(v) for v in self.ring.values()) if self.window and done else done
        if out:
            yield pd.DataFrame([(key[0], *b, b[0] in fresh) for b in out], columns=["series", *_BARS, "fresh"])

    def close(self) -> None:
        pass


def _time(x: object) -> pd.Timestamp | None:
    return None if pd.isna(x) else pd.Timestamp(x).to_pydatetime()


def next_bars(ticks: pd.DataFrame, held: tuple | None, threshold: float) -> tuple[list[tuple], tuple | None]:
    """Bars that ``ticks`` (ts, seq, mid, vol) close, and the open one, as tuples of a bar's columns.

    ``held`` is the open bar before them; its time_end and seq_end are the last tick taken, even where it has no ticks.
    Ticks up to there have been taken before: they are left out, and repeated ones count once.
    """
    ticks = ticks.sort_values(["ts", "seq"]).drop_duplicates(["ts", "seq"])
    if held is not None and held[2] is not None:
        last = pd.Timestamp(held[2])
        ticks = ticks[(ticks["ts"] > last) | ((ticks["ts"] == last) & (ticks["seq"] > held[3]))]
    if not len(ticks):
        return [], held
    state = None
    if held is not None:
        no, start, end, _, first, high, low, close, volume, net, n = held
        state = (no, start, end, first, high, low, close, volume, net, n)
    done, left = close_bars(ticks, state, threshold)
    places = ticks["seq"].to_numpy()
    at = -(held[10] if held is not None else 0)
    out = []
    for no, start, end, first, high, low, close, volume, net, n in done:
        at += n
        out.append((int(no), _time(start), _time(end), int(places[at - 1]), float(first), float(high), float(low), float(close), float(volume), float(net), int(n)))
    no, start, end, first, high, low, close, volume, net, n = left
    return out, (int(no), _time(start), _time(end), int(places[-1]), float(first), float(high), float(low), float(close), float(volume), float(net), int(n))


def live_bars(ticks: DataFrame, threshold: float, keep: int = KEEP, window: bool = False, start: DataFrame | None = None) -> DataFrame:
    """The stream of bars (LIVE_SCHEMA) of a stream of ticks; ``start``: rows of STATE_SCHEMA to begin from. Run it with
    ``live.run_once(..., rocks=True)``, or in a session whose state store is RocksDB."""
    grouped = ticks.select("series", "ts", "seq", "mid", "vol").groupBy("series")
    return grouped.transformWithStateInPandas(LiveBars(threshold, keep, window), LIVE_SCHEMA, "Append", "None", initialState=start.groupBy("series") if start is not None else None)


def missing_ticks(history: DataFrame, bars: DataFrame, now: str | None = None, least: str = LEAST_GAP, most: str | None = MOST_GAP, tail: str = TAIL) -> DataFrame:
    """The ticks of ``history`` that a restart at ``now`` has to take: those after the last bar of each series.

    Where the last bar ended less than ``least`` before now there is no gap. Of a gap longer than ``most`` (None: no limit)
    only that last part is filled. Ticks less than ``tail`` before now are left to the stream. Series without bars start at
    their first tick. Without ``now`` all ticks count.
    """
    ends = bars.groupBy("series").agg(F.max(F.struct("time_end", "seq_end")).alias("e"))
    joined = history.join(ends, "series", "left").where(F.col("e").isNull() | (F.struct("ts", "seq") > F.struct("e.time_end", "e.seq_end")))
    if now is None:
        return joined.drop("e")
    at = F.lit(now).cast("timestamp")
    rows = joined.where((F.col("ts") < at - F.expr(f"INTERVAL {tail}")) & (F.col("e").isNull() | (F.col("e.time_end") <= at - F.expr(f"INTERVAL {least}"))))
    if most is not None:
        rows = rows.where(F.col("e").isNull() | (F.col("ts") >= at - F.expr(f"INTERVAL {most}")))
    return rows.drop("e")


def warm_state(bars: DataFrame, gap: DataFrame, threshold: float, keep: int = KEEP) -> DataFrame:
    """The state to start from (STATE_SCHEMA): the last ``keep`` bars of each series, those that the ticks of ``gap`` close
    (kind `gap`: not written yet), and the open bar they leave.

    ``bars`` has the columns of LIVE_SCHEMA; bars that stand there twice count once. Only the last bar of a series and the
    ticks after it are taken in order, so the work follows the gap and not the history. Numbers go on from the last bar.
    """
    newest = Window.partitionBy("series").orderBy(F.desc("bar_no"))
    kept = bars.select("series", *_BARS).dropDuplicates(["series", "bar_no"])
    kept = kept.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep)
    last = kept.where("_n = 1").drop("_n")

    def run(key: tuple, ends: pd.DataFrame, ticks: pd.DataFrame) -> pd.DataFrame:
        held = None
        if len(ends):
            e = ends.iloc[0]
            held = (int(e["bar_no"]) + 1, None, _time(e["time_end"]), int(e["seq_end"]), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
        done, left = next_bars(ticks, held, threshold)
        rows = [(key[0], "gap", *b) for b in done] + ([(key[0], "open", *left)] if left is not None else [])
        return pd.DataFrame(rows, columns=["series", "kind", *_BARS])

    made = last.groupBy("series").cogroup(gap.select("series", "ts", "seq", "mid", "vol").groupBy("series")).applyInPandas(run, STATE_SCHEMA)
    return kept.select("series", F.lit("bar").alias("kind"), *_BARS).unionByName(made)
