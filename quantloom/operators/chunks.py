"""Windows over one very long series, in parallel: chunks that overlap by a halo.

A series is cut into chunks of ``rows`` rows by a dense row index; each chunk also gets the ``halo`` rows before it, so
that every bounded frame of at most halo + 1 rows is whole, and these rows are dropped afterwards. The index itself is a
two-pass prefix sum: counts of coarse key ranges, then row numbers inside each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, span: int, order: str = "bar_id", name: str = "idx") -> DataFrame:
    """``name``: the row's place in its series from 0, without sorting a series in one task. ``span`` is the width of the
    ranges of ``order`` (a number) that one task numbers; the table of range counts is as long as there are ranges."""
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(span)).cast("long"))
    sizes = ranged.groupBy("series", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("series").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("series", "_range", F.coalesce(before, F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("series", "_range").orderBy(order)) - 1
    return ranged.withColumn("_place", place).join(firsts, ["series", "_range"]).withColumn(name, F.col("_first") + F.col("_place")).drop("_range", "_place", "_first")


def chunked(df: DataFrame, make: Callable[[DataFrame], DataFrame], halo: int, rows: int, span: int) -> DataFrame:
    """``make(df)`` computed chunk by chunk: the same rows and columns as the unchunked result where ``make`` uses frames
    that end at the current row and reach back at most ``halo`` rows in all (nested frames add up). ``halo`` <= ``rows``.
    """
    if halo > rows:
        raise ValueError("a chunk must hold its halo")
    indexed = dense_index(df, span)
    own = F.floor(F.col("idx") / rows).cast("long")
    lends = (F.col("idx") % rows >= rows - halo) if halo else F.lit(False)
    homes = F.when(lends, F.array(own, own + 1)).otherwise(F.array(own))
    spread = indexed.select("*", F.explode(homes).alias("_chunk")).withColumns({"_series": F.col("series"), "_keep": F.col("_chunk") == own})
    spread = spread.withColumn("series", F.concat_ws("#", F.col("series").cast("string"), F.col("_chunk").cast("string")))
    done = make(spread).where("_keep").withColumn("series", F.col("_series"))
    return done.drop("_series", "_keep", "_chunk", "idx")


def numbered(df: DataFrame, by: list[str], ranges: list[Column], order: list[str], name: str) -> DataFrame:
    """``name``: the row's place from 0 among those of ``by``, in the order of ``ranges`` and, within a range, of ``order``.
    Ranges are numbered in parallel; their sizes, one small row a range, are summed before."""
    ranged = df.withColumn("_range", F.struct(*[c.alias(f"r{i}") for i, c in enumerate(ranges)]))
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    past = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(firsts, [*by, "_range"]).withColumn(name, F.col("_first") + F.col("_place")).drop("_range", "_place", "_first")


def average_ranks(df: DataFrame, x: str, by: str, name: str, parts: int = 64) -> DataFrame:
    """``name``: rank of x from 1 with ties averaged within ``by``, without ordering a group in one task.

    Approximate quantiles, one row a group, cut each group into ``parts`` ranges of values; equal values share a range, so
    the ranks are exact whatever the cuts are. ``x`` has no nulls.
    """
    cuts = df.groupBy(by).agg(F.percentile_approx(x, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("_cuts"))
    ranged = df.join(F.broadcast(cuts), by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")
    sizes = ranged.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    past = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(by, "_range", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_first"))
    here = F.rank().over(Window.partitionBy(by, "_range").orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(by, "_range", x)) - 1) / 2
    return ranged.withColumn("_rank", here).join(firsts, [by, "_range"]).withColumn(name, F.col("_first") + F.col("_rank")).drop("_range", "_rank", "_first")


def size_of(df: DataFrame) -> int:
    """Spark's own estimate of a table's bytes: no action."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: A table up to this size (Spark's own estimate, no action) is ordered by series in whole; a larger one in chunks.
WHOLE_BYTES = 256 << 20
CHUNK_ROWS, CHUNK_SPAN = 200_000, 200_000


def windowed(df: DataFrame, make: Callable[[DataFrame], DataFrame], halo: int, most: int | None = None, rows: int | None = None, span: int | None = None) -> DataFrame:
    """``make(df)`` for frames that reach back at most ``halo`` rows in all: by series where the table is small, else in
    chunks of ``rows``. Both give the same rows."""
    if size_of(df) <= (WHOLE_BYTES if most is None else most):
        return make(df)
    rows = max(halo, CHUNK_ROWS if rows is None else rows)
    return chunked(df, make, halo, rows, CHUNK_SPAN if span is None else span)
