"""Checks as tables: a row per violation or per series, never an exception inside a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SLOTS


def check_shape(rows: DataFrame, keys: list[str]) -> DataFrame:
    day = rows.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"))
    return day.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("rows"), F.count_if(F.col("n") != SLOTS).alias("bad_days"))


def check_contiguous(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between measured slots (rows: day_no, slot), longest first counted."""
    at = F.col("day_no") * SLOTS + F.col("slot")
    gap = at - F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return rows.withColumn("gap", gap).groupBy(*keys).agg(F.count_if(F.col("gap") != 1).alias("gaps"), F.max("gap").alias("longest"))


def check_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    x = F.col(value)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.count_if(F.isnan(x)).alias("nans"), F.count_if(x < 0).alias("negative"))


def check_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_release(issues: DataFrame) -> DataFrame:
    return issues.groupBy("series_id", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("release_hour").isin(0, 6, 12, 18)).alias("odd")).withColumn("ok", (F.col("n") == 4) & (F.col("odd") == 0))


def check_roundtrip(computed: DataFrame, path: str, part: str, key: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """What was written against what was computed, per partition (directories part=... under path).

    n: computed rows; missing: of these, not found again; extra: found only; changed: further apart than the tolerance, or a null on one side; off: the largest difference.
    A partition that is gone counts with all its rows.
    """
    kept = computed.select(*dict.fromkeys([part, *key]), F.col(value).alias("_computed"), F.lit(True).alias("_here"))
    found = computed.sparkSession.read.schema(computed.select(*dict.fromkeys([part, *key]), value).schema).parquet(path)
    both = found.select(*dict.fromkeys([part, *key]), F.col(value).alias("_found"), F.lit(True).alias("_there")).join(kept, list(dict.fromkeys([part, *key])), "full")
    off = F.abs(F.col("_found") - F.col("_computed"))
    here, there = F.col("_here").isNotNull(), F.col("_there").isNotNull()
    other = (off > tolerance) | (F.col("_found").isNull() != F.col("_computed").isNull())
    return both.groupBy(part).agg(F.count_if(here).alias("n"), F.count_if(here & ~there).alias("missing"), F.count_if(there & ~here).alias("extra"), F.count_if(here & there & other).alias("changed"), F.max(off).alias("off"))


def check_weights(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per row: whether no weight is below 0, and whether they sum to 1."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumns({"fine": F.forall("weights", lambda x: x >= 0), "whole": F.abs(total - 1) < tolerance}).drop("weights")


def pair_completeness(daily: DataFrame, kinds: int = 8) -> DataFrame:
    return daily.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mask").alias("strategies")).where((F.col("n") != kinds) | (F.col("strategies") != kinds))


def series_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Days that only one of two tables has."""
    x, y = (t.select("series_id", "day").distinct() for t in (a, b))
    return x.join(y, ["series_id", "day"], "left_anti").withColumn("only_in", F.lit("first")).unionByName(y.join(x, ["series_id", "day"], "left_anti").withColumn("only_in", F.lit("second")))


def against_profile(rows: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of each slot over all days beside what a daily profile (slot, and a column per target) gives, and the largest difference."""
    given = profile.selectExpr("slot", "stack(2, 'load', load, 'pv', pv) as (target, given)")
    means = rows.groupBy(*keys, "slot").agg(F.avg("power").alias("mean")).join(F.broadcast(given), ["target", "slot"])  # 288 rows
    means = means.withColumn("off", F.col("mean") - F.col("given"))
    return means.withColumn("most_off", F.max(F.abs("off")).over(Window.partitionBy(*keys))).select(*keys, "slot", "mean", "given", "off", "most_off")
