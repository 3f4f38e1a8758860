"""Scenarios and margins from past forecast errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SLOTS, not_negative


def residual_scenarios(rows: DataFrame, keys: list[str], n: int = 8) -> DataFrame:
    """Forecast (pred) plus the error of the same slot on each of the last n days; all targets take the same day, so errors stay paired."""
    past = rows.where("pred is not null").select(*keys, "slot", F.col("day_no").alias("_past"), (F.col("power") - F.col("pred")).alias("_error"))
    ask = rows.where("pred is not null").withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_past", F.col("day_no") - F.col("scenario"))
    return ask.join(past, [*keys, "slot", "_past"]).withColumn("value", not_negative(F.col("pred") + F.col("_error"))).drop("_past", "_error")


def ratio_scenarios(rows: DataFrame, keys: list[str], n: int = 8) -> DataFrame:
    """The same for prices, by the logarithm of the ratio: always positive."""
    past = rows.where("pred > 0 and power > 0").select(*keys, "slot", F.col("day_no").alias("_past"), F.log(F.col("power") / F.col("pred")).alias("_error"))
    ask = rows.where("pred > 0").withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_past", F.col("day_no") - F.col("scenario"))
    return ask.join(past, [*keys, "slot", "_past"]).withColumn("value", F.col("pred") * F.exp("_error")).drop("_past", "_error")


def quantile_margin(rows: DataFrame, keys: list[str], q: float = 0.9, days: int = 28) -> DataFrame:
    """Forecast plus a quantile of its past errors in the same slot."""
    past = Window.partitionBy(*keys, "slot").orderBy("day_no").rangeBetween(-days, -1)
    rows = rows.withColumn("_error", F.col("power") - F.col("pred"))
    return rows.withColumn("margin", F.percentile("_error", q).over(past)).withColumn("covered", F.col("pred") + F.col("margin")).drop("_error")


def boundary_methods(base: DataFrame, rows: DataFrame, weekly: DataFrame, ratio: DataFrame, keys: list[str], trees: DataFrame | None = None) -> DataFrame:
    """(keys, day, day_no, base, method, object, pred, power) of every base model and way to forecast the next day's first endpoint.

    base: (keys, day_no, slot, base, pred). Ways: the week before, the usual ratio to the base model's last
    endpoint and, if given, trees (keys, day_no, pred). Objects: that endpoint, and the mean of it and the
    day's last one. The last day has no next and is left out.
    """
    by_day = Window.partitionBy(*keys).orderBy("day_no")
    first = rows.where("slot = 1").select(*keys, "day", "day_no", F.lead("power").over(by_day).alias("_next"))
    last = rows.where(F.col("slot") == SLOTS).select(*keys, "day_no", F.col("power").alias("_end"))
    models = base.where(F.col("slot") == SLOTS).select(*keys, "day_no", "base", F.col("pred").alias("_last"))
    known = first.join(last, [*keys, "day_no"]).join(weekly.select(*keys, "day_no", "weekly"), [*keys, "day_no"]).join(ratio.select(*keys, "day_no", "ratio"), [*keys, "day_no"])
    if trees is None:
        known = known.withColumn("trees", F.lit(None).cast("double"))
    else:
        known = known.join(trees.select(*keys, "day_no", F.col("pred").alias("trees")), [*keys, "day_no"])
    both = models.join(known, [*keys, "day_no"]).selectExpr("*", "stack(3, 'weekly', weekly, 'ratio', ratio * _last, 'trees', trees) as (method, _pred)")
    both = both.selectExpr(*keys, "day", "day_no", "base", "method", "stack(2, 'endpoint', _pred, _next, 'interval', (_last + _pred) / 2, (_end + _next) / 2) as (object, pred, power)")
    return both.where("power is not null and pred is not null")
