"""Power tables from general ones: events become endpoints, orders daily costs of strategies.

All are dense: every series has every day and slot, with 0 where nothing was measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import SLOTS, STEP

#: What counts as solar output, and the slots in which the sun shines (fixed values).
SOLAR_TYPES, SUN_FROM, SUN_TO = ("view", "click"), 37, 108


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(x: str):
    return F.sum(F.col(x).cast("decimal(18,2)")).cast("double")


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.hour("ts") * 60 + F.minute("ts")
    return _table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), (F.floor(minute / STEP) + 1).cast("int").alias("slot"), "value")


def span(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """First and last day of the events, as subqueries: no job of their own, and one for all that read the same table."""
    days = _table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    return days.agg(F.min("day")).scalar(), days.agg(F.max("day")).scalar()


def dense(rows: DataFrame, keys: list[str], first: Column, last: Column, value: str = "power") -> DataFrame:
    """(keys, day, day_no, slot, value) with every slot of every day from first to last; rows has at most one row of each.

    Every row is unfolded up to the next of its series (the first also from the start), so the work grows with the slots and no task holds a series.
    """
    by, at = Window.partitionBy(*keys).orderBy("_at"), F.datediff("day", first) * SLOTS + F.col("slot")
    end = (F.datediff(last, first) + 1) * SLOTS
    rows = rows.select(*keys, at.cast("int").alias("_at"), F.col(value).alias("_value"))
    begins = F.when(F.lag("_at").over(by).isNull(), F.lit(1)).otherwise(F.col("_at"))
    ends = F.coalesce(F.lead("_at").over(by) - 1, end)
    out = rows.withColumns({"_begins": begins, "_ends": ends}).select(*keys, "_at", "_value", F.explode(F.sequence("_begins", "_ends")).alias("_slot"))
    day_no = ((F.col("_slot") - 1) / SLOTS).cast("int")
    return out.select(*keys, F.date_add(first, day_no).alias("day"), day_no.alias("day_no"), ((F.col("_slot") - 1) % SLOTS + 1).alias("slot"), F.when(F.col("_slot") == F.col("_at"), F.col("_value")).otherwise(0.0).alias(value))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, day, day_no, slot, power): a series per event type."""
    rows = _binned(spark, sf_dir).groupBy(F.col("event_type").alias("series_id"), "day", "slot").agg(_money("value").alias("power"))
    return dense(rows, ["series_id"], *span(spark, sf_dir))


def _user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binned(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("series_id"), "day", "slot").agg(_money("value").alias("power"))


def user_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a series per user: many series."""
    return dense(_user_rows(spark, sf_dir), ["series_id"], *span(spark, sf_dir))


def user_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, day_no, slot, power) of the users where there is any: a slot without a row has 0."""
    return _user_rows(spark, sf_dir).select("series_id", F.datediff("day", span(spark, sf_dir)[0]).alias("day_no"), "slot", "power")


def days(spark: SparkSession, sf_dir: str) -> Column:
    """The number of days from the first to the last of the events."""
    first, last = span(spark, sf_dir)
    return F.datediff(last, first) + 1


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, series_id, day, day_no, slot, power): load and solar output (pv) of one site where there is any: with gaps."""
    rows = _binned(spark, sf_dir)
    solar = F.col("event_type").isin(*SOLAR_TYPES) & F.col("slot").between(SUN_FROM, SUN_TO)
    rows = rows.withColumn("target", F.explode(F.when(solar, F.array(F.lit("load"), F.lit("pv"))).otherwise(F.array(F.lit("load")))))
    rows = rows.groupBy("target", F.lit("site").alias("series_id"), "day", "slot").agg(_money("value").alias("power"))
    return rows.select("target", "series_id", "day", F.datediff("day", span(spark, sf_dir)[0]).alias("day_no"), "slot", "power")


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every slot."""
    return dense(measured(spark, sf_dir), ["target", "series_id"], *span(spark, sf_dir))


def issues(spark: SparkSession, sf_dir: str, pv: DataFrame | None = None) -> DataFrame:
    """(series_id, issue_at, day, day_no, release_hour, leads): 24 hourly values per release from the third day on, known at its time.

    Half the output a day before the target and half that at the time of issue: the hours of the last day, as a window over hourly rows sees them.
    pv: the site's output, where it has been computed already.
    """
    first, last = span(spark, sf_dir)
    hourly = (pv or site(spark, sf_dir).where("target = 'pv'")).where("slot % 6 = 0").selectExpr("series_id", "day_no * 144 + slot as issue_at", "power")
    past = Window.partitionBy("series_id").orderBy("issue_at").rowsBetween(-23, 0)
    rows = hourly.withColumn("_past", F.collect_list("power").over(past)).where("issue_at % 36 = 0 and issue_at >= 288")
    day_no = F.expr("int(issue_at div 144)")
    rows = rows.withColumns({"day_no": day_no, "day": F.date_add(first, day_no)}).where(F.col("day") <= last)
    return rows.select("series_id", "issue_at", "day", "day_no", F.expr("int(issue_at % 144 div 6)").alias("release_hour"), F.transform("_past", lambda x: 0.5 * x + 0.5 * F.col("power")).alias("leads"))


def price(slot: Column) -> Column:
    return F.lit(0.4) + F.when(slot.between(49, 126), 0.3).otherwise(0.0) + 0.001 * (slot % 7)


def price_profile(spark: SparkSession) -> DataFrame:
    """(slot, price) of a day: 144 rows."""
    slots = spark.range(1, SLOTS + 1).select(F.col("id").cast("int").alias("slot"))
    return slots.withColumn("price", price(F.col("slot")))


def daily_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, price, load, pv) of the site's first day: the profile that a day is planned with where nothing else is known."""
    rows = site(spark, sf_dir).where("day_no = 0").groupBy("slot").agg(*[F.max(F.when(F.col("target") == t, F.col("power"))).alias(t) for t in ("load", "pv")])
    return rows.join(F.broadcast(price_profile(spark)), "slot").select("slot", "price", "load", "pv")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, series_id, day, day_no, slot, power): a price series per slot, the profile raised by a thousandth per kW of load."""
    load = site(spark, sf_dir).where("target = 'load'").join(F.broadcast(price_profile(spark)), "slot")
    return load.select(F.lit("price").alias("target"), "series_id", "day", "day_no", "slot", (F.col("price") * (1 + F.col("power") / 1000)).alias("power"))


def planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, day, day_no, slot, price, load, pv) with load and pv in kWh of the slot."""
    wide = site(spark, sf_dir).groupBy("series_id", "day", "day_no", "slot").pivot("target", ["load", "pv"]).agg(F.first("power"))
    return wide.select("series_id", "day", "day_no", "slot", price(F.col("slot")).alias("price"), (F.col("load") / 6).alias("load"), (F.col("pv") / 6).alias("pv"))


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, mask, cost): daily cash cost of the eight strategies; mask bits 1, 2, 4 stand for the releases."""
    rows = _table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 8).cast("int").alias("mask"), F.to_date("o_orderdate").alias("day")).agg(_money("o_totalprice").alias("cost"))
    days = rows.select("day").distinct().withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return days.join(rows, ["day", "mask"], "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, day, day_no, total): extended prices by return flag and ship date, dense."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("day")).agg(_money("l_extendedprice").alias("total"))
    span = rows.agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first is not null")
    days = span.select("first", F.explode(F.sequence("first", "last")).alias("day")).select("day", F.datediff("day", "first").alias("day_no"))
    return rows.select("series_id").distinct().join(F.broadcast(days)).join(rows, ["series_id", "day"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
