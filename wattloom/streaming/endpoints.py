"""Ten-minute endpoints of a stream, with a watermark; the jobs themselves read what this has written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_endpoints(events: DataFrame, late: str = "1 hour", step: str = "10 minutes") -> DataFrame:
    """(series_id, ts, power): the sum of each interval under the time of its end, once it can no longer change."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = events.groupBy(F.window("ts", step), F.col("event_type").alias("series_id")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("power"))
    return sums.select("series_id", F.col("window.end").alias("ts"), F.col("power").cast("double").alias("power"))
