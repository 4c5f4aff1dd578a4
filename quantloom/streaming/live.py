"""Structured Streaming forms of the live path (SS01-SS09): bars on a clock and on volume, snapshots, positions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TICK_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
BAR_SCHEMA = "series string, bar_no long, time_start timestamp, time_end timestamp, open double, high double, low double, close double, volume double, net_vol double, ticks long"
_STATE = "bar_no long, start timestamp, end timestamp, open double, high double, low double, last double, volume double, net double, ticks long"


def shared_folder(spark: SparkSession) -> str:
    """The folder of tables and checkpoints that all executors share: ``spark.checkpoint.dir``. A local session that names
    none gets a folder of its own; on a cluster the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or tempfile.mkdtemp(prefix="quantloom-")).rstrip("/")


def tick_stream(spark: SparkSession, path: str, files: int = 1, newest_days: int | None = None) -> DataFrame:
    """Ticks from landed files (SS01, SS08): each file is listed once, exactly, by the checkpoint; ``files`` bounds a batch
    as a buffer's count does, the trigger of the query bounds it in time. With ``newest_days``, files older than so many
    days before the newest one are left out."""
    reader = spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", files)
    raw = (reader.option("maxFileAge", f"{newest_days}d") if newest_days else reader).parquet(path)
    return raw.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("mid"), F.from_json("props", "k string")["k"].cast("double").alias("vol"))


def minute_bars(ticks: DataFrame, late: str = "1 minute") -> DataFrame:
    """Tumbling bars with a watermark (SS02); rows later than ``late`` are dropped."""
    place = F.struct("ts", "seq")
    return ticks.withWatermark("ts", late).groupBy("series", F.window("ts", "1 minute").alias("w")).agg(
        F.min_by("mid", place).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", place).alias("close"), F.sum("vol").alias("volume")
    ).select("series", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def close_bars(rows: pd.DataFrame, state: tuple | None, threshold: float) -> tuple[list[tuple], tuple | None]:
    """Bars that ``rows`` (ts, mid, vol in order) close, and the state of the open one (BAR11).

    A bar closes with the tick that brings its volume to the threshold, and the count starts again from zero; a tick of
    zero volume counts one; the signed volume starts anew with each bar.
    """
    done: list[tuple] = []
    no, start, end, first, high, low, last, total, net, n = state or (0, None, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
    for ts, mid, vol in zip(rows["ts"], rows["mid"], rows["vol"], strict=True):
        vol = vol if vol > 0 else 1.0
        if n == 0:
            start, first, high, low, net = ts, mid, mid, mid, 0.0
        else:
            net += vol * ((mid > last) - (mid < last))
        high, low, last, end, total, n = max(high, mid), min(low, mid), mid, ts, total + vol, n + 1
        if total >= threshold:
            done.append((no, start, end, first, high, low, last, total, net, n))
            no, total, n = no + 1, 0.0, 0
    return done, (no, start, end, first, high, low, last, total, net, n)


def volume_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    """Volume-clock bars as a keyed stream (SS03): state is one open bar a series."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        done, left = close_bars(rows, state.get if state.exists else None, threshold)
        state.update(left)
        yield pd.DataFrame([(key[0], *d) for d in done], columns=[c.split()[0] for c in BAR_SCHEMA.split(", ")])
    return ticks.groupBy("series").applyInPandasWithState(run, BAR_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def latest(ticks: DataFrame) -> DataFrame:
    """Latest value of each series (SS04), in update mode."""
    return ticks.groupBy("series").agg(F.max_by(F.struct("ts", "mid"), F.struct("ts", "seq")).alias("v")).select("series", "v.ts", "v.mid")


def on_window(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int, str], DataFrame]:
    """A batch step that computes ``make`` on the bars that a batch brings, which are the last ones of each series that
    closed one (``resume.live_bars`` with ``window``), and returns the rows of the newest bar of each series (SS05). It
    reads nothing but the batch."""
    def each(batch: DataFrame, number: int, place: str) -> DataFrame:
        held = batch.drop("fresh").withColumnRenamed("bar_no", "bar_id")
        newest = held.groupBy("series").agg(F.max("bar_id").alias("bar_id"))
        return make(held).join(newest, ["series", "bar_id"], "left_semi")
    return each


def first_signal(signals: DataFrame, names: list[str], cooling: DataFrame | None = None) -> DataFrame:
    """Of each series' bar the first strategy in the order of ``names`` that has a signal (SS06), without those that
    ``cooling`` (series, strategy_id) names: one row a series at most."""
    open_ = signals.where("signal <> 0")
    open_ = open_.join(cooling, ["series", "strategy_id"], "left_anti") if cooling is not None else open_
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("strategy_id"))
    best = open_.groupBy("series", "bar_id").agg(F.min_by(F.struct("strategy_id", "signal"), place).alias("b"))
    return best.select("series", "bar_id", "b.strategy_id", "b.signal")


#: The state store that keyed state with collections needs.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None, each: Callable[[DataFrame, int, str], DataFrame] | None = None, name: str | None = None, rocks: bool = False) -> DataFrame:
    """Run a stream over what is there and return its table. In update mode the last version of each key stays. ``rocks``:
    its state is held in RocksDB, whatever the session's other streams use.

    ``each`` may replace a batch before it is written. Batches are written under their number, so a batch that is run
    again overwrites itself. With a ``name`` the stream goes on where its last run ended (SS09): state, files seen and
    tables are those of that name.
    """
    spark, place = stream.sparkSession, f"{folder}/stream-{name or uuid.uuid4().hex}"
    def write(batch: DataFrame, number: int) -> None:
        (each(batch, number, place) if each else batch).write.mode("overwrite").parquet(f"{place}/out/batch={number}")
    before = spark.conf.get(ROCKS[0], None)
    try:
        if rocks:
            spark.conf.set(*ROCKS)
        running = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    finally:  # a query keeps the setting that it was started with
        if rocks:
            spark.conf.set(ROCKS[0], before) if before is not None else spark.conf.unset(ROCKS[0])
    running.awaitTermination()
    out = spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out")
    if not keys:
        return out.drop("batch")
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")
