"""Adapters: driver tables as engine inputs. ``events`` is the tick tape, one series for each event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, ts, seq, mid, vol): SRC01 with the price chosen, nulls dropped, and a total order (ts, seq) by series."""
    e = table(spark, sf_dir, "events")
    vol = F.from_json("props", "k string")["k"].cast("double")
    return e.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("mid"), vol.alias("vol"), F.col("user_id")).where("mid is not null")


TICKS_SQL = """ticks AS (SELECT event_type AS series, ts, event_id AS seq, value AS mid,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS vol, user_id FROM events WHERE value IS NOT NULL)"""
