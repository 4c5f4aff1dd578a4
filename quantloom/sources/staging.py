"""Tables written once to the folder that all executors share, so that loops don't grow a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quantloom.streaming.live import shared_folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read back: a lost executor costs a read, and several readers share the work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
