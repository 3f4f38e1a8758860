"""From endpoints to averages of intervals, in the calendar frame (00:00 to 24:00) and the shifted one (00:10 to 00:10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SLOTS


def _by_time(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("day_no", "slot")


def interval_averages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """avg_power of each interval and the source of its left end: the endpoint before, on the first day its own last one."""
    last = F.max(F.when(F.col("slot") == SLOTS, F.col("power"))).over(Window.partitionBy(*keys, "day_no"))
    before = F.lag("power").over(_by_time(keys))
    left = F.coalesce(before, last)
    source = F.when(F.col("slot") > 1, "inside").when(before.isNull(), "own_midnight").otherwise("day_before")
    return rows.withColumns({"avg_power": (left + F.col("power")) / 2, "left_source": source})


def shifted_averages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """avg_power of the interval from each endpoint to the next; the last of all has none."""
    return rows.withColumn("avg_power", (F.col("power") + F.lead("power").over(_by_time(keys))) / 2)


def boundaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per day, what may be known of the next day's first endpoint: a week before it, and the mean of the last 7 days."""
    by_day = Window.partitionBy(*keys).orderBy("day_no")
    first = rows.where("slot = 1")
    return first.select(*keys, "day", "day_no", F.lag("power", 6).over(by_day).alias("weekly"), F.avg("power").over(by_day.rowsBetween(-7, -1)).alias("mean7"))


def cross_day_ratio(rows: DataFrame, keys: list[str], window: int = 28) -> DataFrame:
    """Median and number of the last fully observed ratios of the next day's first endpoint to the day's last; those end two days before."""
    days = rows.groupBy(*keys, "day_no").agg(F.max(F.when(F.col("slot") == 1, F.col("power"))).alias("first"), F.max(F.when(F.col("slot") == SLOTS, F.col("power"))).alias("last"))
    by_day = Window.partitionBy(*keys).orderBy("day_no")
    days = days.withColumn("ratio", F.when(F.col("last") > 1e-8, F.lead("first").over(by_day) / F.col("last")))
    past = by_day.rowsBetween(-window - 1, -2)
    return days.select(*keys, "day_no", F.percentile("ratio", 0.5).over(past).alias("ratio"), F.count("ratio").over(past).alias("samples"))


def standardized(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """avg_power of predicted endpoints (pred) in the shifted frame.

    The next day's first endpoint is what boundaries() knows of it at the day's start: for load the
    week before, for solar output (target pv) the mean of the last 7 days.
    """
    w = Window.partitionBy(*keys, "day_no").orderBy("slot")
    known = bounds.select(*keys, "day_no", F.when(F.col("target") == "pv", F.col("mean7")).otherwise(F.col("weekly")).alias("_next"))
    rows = rows.join(known, [*keys, "day_no"])
    right = F.when(F.col("slot") == SLOTS, F.col("_next")).otherwise(F.lead("pred").over(w))
    return rows.withColumn("avg_power", (F.col("pred") + right) / 2).drop("_next")
