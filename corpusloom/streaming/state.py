"""Windows over events, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of values by window and type."""
    given = events.withColumn("ts", F.col("ts").cast("timestamp"))
    given = given.withWatermark("ts", late) if given.isStreaming else given
    return given.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
