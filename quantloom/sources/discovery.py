"""Discovery of quarter-hour files (SS08, SRC19): a ledger of stamps taken, a lag that new files must be older than, and a
window that files older than it drop out of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Fixed values of the surveyed poller: files of the last five minutes wait, files older than two days are let be.
LAG, WINDOW, STEP = "5 minutes", "2 days", 15
_STAMP = "yyyyMMddHHmmss"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(stamp, path): one file a 14-digit stamp in the paths under ``path``, the least in order. Nothing but the listing is
    read; a folder without files has none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    except AnalysisException:
        return spark.createDataFrame([], "stamp string, path string")
    stamps = files.select(F.regexp_extract("path", r"(\d{14})(?!.*\d{14})", 1).alias("stamp"), "path").where("stamp <> ''")
    return stamps.groupBy("stamp").agg(F.min("path").alias("path"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(stamp): the stamps that earlier cycles have taken."""
    try:
        return spark.read.schema("stamp string, cycle long").parquet(path).select("stamp").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "stamp string")


def states(found: DataFrame, taken: DataFrame, now: str, lag: str = LAG, window: str = WINDOW, step: int = STEP) -> DataFrame:
    """(stamp, path, state) of every stamp that is listed or due at ``now``.

    Due are the quarter hours from ``window`` before the cutoff up to it, both rounded down; the cutoff is ``lag`` before
    now. ``seen``: in the ledger. ``new``: due and listed. ``missing``: due and not listed, to be looked for again.
    ``early``: newer than the cutoff. ``late``: older than the window. ``off``: between, but on no quarter hour.
    """
    spark = found.sparkSession
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {lag}")
    floor = lambda t: F.timestamp_seconds(F.floor(F.unix_timestamp(t) / (60 * step)) * (60 * step))
    ends = spark.range(1).select(cutoff.alias("c"), (cutoff - F.expr(f"INTERVAL {window}")).alias("a"))
    ends = ends.select("a", "c", floor(F.col("a")).alias("first"), floor(F.col("c")).alias("last"))
    due = ends.select(F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {step} MINUTES"))).alias("t")).select(F.date_format("t", _STAMP).alias("stamp"), F.lit(True).alias("due"))
    at = F.try_to_timestamp("stamp", F.lit(_STAMP))
    rows = found.join(due, "stamp", "full").join(taken.select("stamp", F.lit(True).alias("taken")), "stamp", "left")
    state = F.when(F.col("taken"), "seen").when(F.col("due") & F.col("path").isNotNull(), "new").when(F.col("due"), "missing").when(at > cutoff, "early")
    return rows.select("stamp", "path", state.when(at < cutoff - F.expr(f"INTERVAL {window}"), "late").otherwise("off").alias("state"))


def take(spark: SparkSession, path: str, ledger_path: str, now: str, read, cycle: int, **limits: str) -> DataFrame | None:
    """One cycle: ``read(paths)`` of the new files, and their stamps in the ledger; None where nothing is new.

    The ledger is written under the number of the cycle, so a cycle that is run again takes the same stamps anew and not
    twice. The window bounds the number of paths.
    """
    taken = spark.read.schema("stamp string, cycle long").parquet(ledger_path).where(F.col("cycle") != cycle).select("stamp").distinct() if not ledger(spark, ledger_path).isEmpty() else ledger(spark, ledger_path)
    new = states(listed(spark, path), taken, now, **limits).where("state = 'new'").select("stamp", "path").orderBy("stamp").collect()  # as many as quarter hours in the window
    if not new:
        return None
    spark.createDataFrame([(r.stamp,) for r in new], "stamp string").write.mode("overwrite").parquet(f"{ledger_path}/cycle={cycle}")
    return read([r.path for r in new])
