"""Tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from aerolith.sinks.shared import scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    What a session has stored lies in a folder of its own, which ``aerolith.sinks.shared.clear`` deletes."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
