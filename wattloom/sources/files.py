"""Readers and writers of power tables in files: wide sheets, forecast issues, strategy costs, predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import SLOTS, STEP, label_of_minute, minute_of_label
from .strict import PLACE, filled_down, read_strict

LABELS = [f"{k * STEP // 60:02d}:{k * STEP % 60:02d}" for k in range(1, SLOTS + 1)]
WIDE = {"series_id": "string", "day": "date"} | dict.fromkeys(LABELS, "double")
STRATEGY = {"window_date": "date", "cash_cost_yuan": "double", "emergency_kwh": "double"}
PROFILE = {"time": "string", "price": "double", "load": "double", "pv": "double"}
LEADS = [f"h{k}" for k in range(1, 25)]
ISSUES = {"date": "date", "release": "string"} | dict.fromkeys(LEADS, "double")


def unpivot_power(wide: DataFrame, keys: tuple = ("series_id", "day")) -> DataFrame:
    """(keys, slot, ts, power) from one column per endpoint, headed by its label."""
    labels = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(list(keys), labels, "label", "power").withColumn("slot", (minute_of_label(F.col("label")) / STEP).cast("int"))
    return long.select(*keys, "slot", (F.col("day").cast("timestamp") + F.make_dt_interval(mins=F.col("slot") * STEP)).alias("ts"), "power")


def read_power_wide(spark: SparkSession, path: str) -> DataFrame:
    return unpivot_power(power_wide(spark, path)[0])


def power_wide(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A sheet of a row per series and day, and what of its files does not fit: other headers, empty cells, no numbers, power below 0."""
    rows, rejected = read_strict(spark, path, WIDE, not_negative=LABELS)
    return rows.drop(*PLACE), rejected


def pivot_power(rows: DataFrame, keys: tuple = ("series_id", "day")) -> DataFrame:
    """One column per slot, named by its label; the slots are given, so nothing is counted first."""
    wide = rows.groupBy(*keys).pivot("slot", list(range(1, SLOTS + 1))).agg(F.first("power"))
    return wide.toDF(*keys, *LABELS)


def read_issues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(series_id, issue_ts, day, release_hour, leads) of the files under path/series_id=.../, and what of them does not fit.

    A row has a release "H:MM" and 24 values; an empty date is the one above it in the file.
    """
    rows, rejected = read_strict(spark, path, ISSUES, required=["release", *LEADS], not_negative=LEADS)
    rows = filled_down(rows, "date").withColumn("release_hour", F.split("release", ":")[0].try_cast("int"))
    odd = F.when(F.col("date").isNull(), "date: empty").when(F.col("release_hour").isNull() | ~F.col("release_hour").isin(0, 6, 12, 18), "release: unknown")
    rows = rows.withColumn("_odd", odd)
    rejected = rejected.unionByName(rows.where("_odd is not null").select("_file", F.col("_odd").alias("reason"), F.concat_ws(",", F.col("date").cast("string"), "release").alias("row")))
    at = (F.col("date").cast("timestamp") + F.make_dt_interval(hours=F.col("release_hour"))).alias("issue_ts")
    series = F.regexp_extract("_file", r"series_id=([^/]+)/", 1).alias("series_id")
    return rows.where("_odd is null").select(series, at, F.col("date").alias("day"), "release_hour", F.array(*LEADS).alias("leads")), rejected


def write_issues(rows: DataFrame, path: str) -> None:
    """(series_id, day, release_hour, issue_at, leads) as read_issues() reads it: a file per series in the order of issues, the date only where it changes."""
    first = F.row_number().over(Window.partitionBy("series_id", "day").orderBy("issue_at")) == 1
    cells = rows.select("series_id", "issue_at", F.when(first, F.col("day")).alias("date"), F.format_string("%d:00", "release_hour").alias("release"), *[F.col("leads")[k].alias(c) for k, c in enumerate(LEADS)])
    cells.repartition("series_id").sortWithinPartitions("series_id", "issue_at").drop("issue_at").write.partitionBy("series_id").csv(path, header=True)


def read_strategy_daily(spark: SparkSession, folder: str, masks: dict[str, int]) -> DataFrame:
    return strategy_daily(spark, folder, masks)[0]


def strategy_daily(spark: SparkSession, folder: str, masks: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(strategy, mask, day, cost, emergency) from a CSV file per strategy, named after it, or a folder strategy=name of such files, and (strategy, reason, n): what of them does not fit.

    Besides rejected rows and headers: files of other names ("unknown"), strategies without any row ("missing"), and strategies with fewer days than another ("dates", n of them).
    """
    rows, rejected = read_strict(spark, folder, STRATEGY)
    path = F.col("_file")
    name = F.when(path.contains("strategy="), F.regexp_extract(path, r"strategy=([^/]+)/", 1)).otherwise(F.regexp_extract(path, r"([^/]+)\.csv$", 1)).alias("strategy")
    mask = F.create_map(*[F.lit(x) for kv in masks.items() for x in kv])
    rows = rows.select("*", name)
    known = rows.where(mask[F.col("strategy")].isNotNull())
    out = known.select("strategy", mask[F.col("strategy")].alias("mask"), F.col("window_date").alias("day"), F.col("cash_cost_yuan").alias("cost"), F.col("emergency_kwh").alias("emergency"))
    days = out.groupBy("strategy").agg(F.countDistinct("day").alias("days"))
    asked = spark.createDataFrame([(x,) for x in masks], "strategy string")  # as many as there are names
    less = days.agg(F.max("days")).scalar() - F.col("days")
    uneven = days.where(less > 0).select("strategy", F.lit("dates").alias("reason"), less.alias("n"))
    faults = rejected.select(name, "reason").groupBy("strategy", "reason").agg(F.count(F.lit(1)).alias("n"))
    unknown = rows.where(mask[F.col("strategy")].isNull()).groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).select("strategy", F.lit("unknown").alias("reason"), "n")
    missing = asked.join(days, "strategy", "left_anti").select("strategy", F.lit("missing").alias("reason"), F.lit(0).cast("long").alias("n"))
    return out, faults.unionByName(unknown).unionByName(missing).unionByName(uneven)


def write_predictions(rows: DataFrame, path: str) -> None:
    """Parquet by model and target, so that reading one prunes the others."""
    rows.write.partitionBy("model", "target").parquet(path)


def read_predictions(spark: SparkSession, path: str, model: str, target: str, first: str, last: str) -> DataFrame:
    rows = spark.read.parquet(path).where((F.col("model") == model) & (F.col("target") == target))
    return rows.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def write_daily_profile(rows: DataFrame, path: str) -> None:
    """(slot, price, load, pv) under the labels of the slots."""
    rows.select(label_of_minute(F.col("slot") * STEP).alias("time"), "price", "load", "pv").coalesce(1).write.csv(path, header=True)


def read_daily_profile(spark: SparkSession, path: str) -> DataFrame:
    """(slot, price, load, pv) from a CSV file with a row per endpoint."""
    rows = read_strict(spark, path, PROFILE, not_negative=["price", "load", "pv"])[0]
    return rows.select((minute_of_label(F.col("time")) / STEP).cast("int").alias("slot"), "price", "load", "pv")


def write_strategy_daily(rows: DataFrame, folder: str, names: dict[int, str]) -> None:
    """A CSV file per strategy from (mask, day, cost, emergency)."""
    for mask, name in names.items():
        out = rows.where(F.col("mask") == mask).select(F.col("day").alias("window_date"), F.col("cost").alias("cash_cost_yuan"), F.col("emergency").alias("emergency_kwh"))
        write_csv(out, f"{folder}/strategy={name}")


def write_csv(rows: DataFrame, path: str) -> None:
    """A single CSV file, for what is small (a strategy has a row per day)."""
    rows.coalesce(1).write.csv(path, header=True)


def write_long(rows: DataFrame, path: str) -> None:
    """A long table as CSV with a header, a file per task."""
    rows.write.csv(path, header=True)


def write_wide(rows: DataFrame, path: str) -> None:
    """One column per endpoint, as read_power_wide() reads it."""
    pivot_power(rows).write.csv(path, header=True)


_marked: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder where driver and executors share one: under spark.checkpoint.dir, or the warehouse where that is unset. It goes when the driver's JVM ends.

    A cluster whose executors would each write to their own disk is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if root.startswith("file:") and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _marked.add(own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows, computed once: written as Parquet into a shared folder and read from there."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bucketed(rows: DataFrame, name: str, key: str, order: list[str], buckets: int | None = None, dealt: bool = True) -> DataFrame:
    """The same as a table bucketed by key and sorted in it: windows, aggregates and joins by the key need no exchange any more.

    dealt: a file per bucket; otherwise (few large rows) no exchange, and each task writes its rows' buckets.
    """
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    rows = rows.repartition(n, key) if dealt else rows
    rows.write.bucketBy(n, key).sortBy(key, *order).option("path", scratch(spark, name)).saveAsTable(table)
    return spark.table(table)
