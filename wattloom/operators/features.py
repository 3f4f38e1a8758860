"""What a forecast may know: lags, rolling statistics and profiles that end the day before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SLOTS, calendar


def by_slot(keys: list[str]):
    return Window.partitionBy(*keys, "slot").orderBy("day_no")


def lags(rows: DataFrame, keys: list[str], days: tuple = (1, 2, 7, 14)) -> DataFrame:
    return rows.withColumns({f"lag{n}": F.lag("power", n).over(by_slot(keys)) for n in days})


def sparse_lags(rows: DataFrame, keys: list[str], days: tuple = (1, 2, 7, 14)) -> DataFrame:
    """The same for series with gaps: what the slot had exactly so many days before, null where nothing was measured; no grid is made."""
    return rows.withColumns({f"lag{n}": F.max("power").over(by_slot(keys).rangeBetween(-n, -n)) for n in days})


def rolling(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and population deviations of the last 7 and 14 days, and the median of 7."""
    w = by_slot(keys)
    out = {f"{name}{n}": f("power").over(w.rowsBetween(-n, -1)) for n in (7, 14) for name, f in (("mean", F.avg), ("std", F.stddev_pop))}
    return rows.withColumns(out | {"median7": F.percentile("power", 0.5).over(w.rowsBetween(-7, -1))})


def tree_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The 18 inputs of the tree models: calendar, lags and rolling statistics."""
    return rolling(lags(rows, keys), keys).withColumns(calendar(F.col("day"), F.col("slot")))


def daily_total_features(totals: DataFrame, keys: list[str]) -> DataFrame:
    """The 14 inputs per day from (day, day_no, total): lags, means and deviations, trend, and the calendar."""
    w = Window.partitionBy(*keys).orderBy("day_no")
    out = {f"lag{n}": F.lag("total", n).over(w) for n in (1, 2, 3, 7, 14)}
    out |= {f"{name}{n}": f("total").over(w.rowsBetween(-n, -1)) for n in (7, 14) for name, f in (("mean", F.avg), ("std", F.stddev_pop))}
    return totals.withColumns(out).withColumn("trend", (F.col("lag1") - F.col("lag3")) / 2).withColumns(_of_day(F.col("day")))


def _of_day(day) -> dict:
    dates = calendar(day, F.lit(1))
    return {k: dates[k] for k in ("year_sin", "year_cos", "week_sin", "week_cos")}


def boundary_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The 21 inputs per day for the first endpoint of the next day, known at the day's start.

    Lags, means and deviations of the first endpoint, the last five endpoints of the day before, mean and
    deviation of that day and of 7 days, and the calendar of the next day.
    """
    last = {f"back{k}": F.max(F.when(F.col("slot") == SLOTS - k, F.col("power"))) for k in range(5)}
    days = rows.groupBy(*keys, "day", "day_no").agg(
        F.max(F.when(F.col("slot") == 1, F.col("power"))).alias("first"), *[c.alias(n) for n, c in last.items()],
        F.sum("power").alias("sum"), F.sum(F.col("power") * F.col("power")).alias("squares"), F.count("power").alias("n"),
    )
    w = Window.partitionBy(*keys).orderBy("day_no")
    spread = lambda n, s, q: F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    n, s, q = (F.sum(c).over(w.rowsBetween(-7, -1)) for c in ("n", "sum", "squares"))
    n1, s1, q1 = (F.lag(c, 1).over(w) for c in ("n", "sum", "squares"))
    out = {f"lag{k}": F.lag("first", k).over(w) for k in (1, 2, 7, 14)}
    out |= {f"first_{name}{k}": f("first").over(w.rowsBetween(-k, -1)) for k in (7, 14) for name, f in (("mean", F.avg), ("std", F.stddev_pop))}
    out |= {f"b{k}": F.lag(f"back{k}", 1).over(w) for k in range(5)}
    out |= {"day_mean": s1 / n1, "day_std": spread(n1, s1, q1), "week_mean": s / n, "week_std": spread(n, s, q)} | _of_day(F.date_add("day", 1))
    return days.select(*keys, "day_no", *[c.alias(k) for k, c in out.items()])


BOUNDARY_COLUMNS = [
    "lag1", "lag2", "lag7", "lag14", "first_mean7", "first_std7", "first_mean14", "first_std14", "b4", "b3", "b2", "b1", "b0", "day_mean", "day_std", "week_mean", "week_std",
    "week_sin", "week_cos", "year_sin", "year_cos",
]


def shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """share of the day's total in each slot; null on days without any."""
    total = F.sum("power").over(Window.partitionBy(*keys, "day_no"))
    return rows.withColumn("share", F.when(total > 1e-8, F.col("power") / total))


def _normalised(rows: DataFrame, keys: list[str], share) -> DataFrame:
    """profile: what share gives, as parts of 1; uniform where it gives nothing."""
    whole = F.sum("_raw").over(Window.partitionBy(*keys, "day_no"))
    return rows.withColumn("_raw", share).withColumn("profile", F.when(whole > 1e-8, F.col("_raw") / whole).otherwise(F.lit(1.0 / SLOTS))).drop("_raw")


def normalized_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The mean share of a slot. Load: of the last four same weekdays, of the last 7 days where there is none yet. Solar output (target pv): of the last 7 days."""
    rows, w = shares(rows, keys), by_slot(keys)
    past = F.filter(F.array(*[F.lag("share", n).over(w) for n in (7, 14, 21, 28)]), lambda x: x.isNotNull())
    weekly = F.when(F.size(past) > 0, F.aggregate(past, F.lit(0.0), lambda a, x: a + x) / F.size(past))
    daily = F.avg("share").over(w.rowsBetween(-7, -1))
    return _normalised(rows, keys, F.when((F.col("target") == "pv") | F.lag("slot", 7).over(w).isNull(), daily).otherwise(weekly))


def weighted_profile(rows: DataFrame, keys: list[str], oldest: float = 0.65, days: int = 7) -> DataFrame:
    """The same of the last days that have a total, weighted from `oldest` geometrically up to 1 for the newest."""
    rows = shares(rows, keys).withColumn("_past", F.collect_list("share").over(by_slot(keys).rowsBetween(-days, -1)))
    n = F.size("_past")
    weight = lambda i: F.when(n > 1, F.pow(F.lit(oldest), (n - 1 - i) / (n - 1))).otherwise(F.lit(oldest))
    sums = F.aggregate(F.transform("_past", lambda x, i: x * weight(i)), F.lit(0.0), lambda a, x: a + x)
    weights = F.aggregate(F.transform("_past", lambda x, i: weight(i) + 0 * x), F.lit(0.0), lambda a, x: a + x)
    return _normalised(rows, keys, F.when(n > 0, sums / weights)).drop("_past")


def smoothed(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Weights 1, 2, 3, 2, 1 over the slots of a day, zero beyond its ends."""
    w = Window.partitionBy(*keys, "day_no").orderBy("slot")
    near = [F.lag(value, 2, 0.0).over(w), 2 * F.lag(value, 1, 0.0).over(w), 3 * F.col(value), 2 * F.lead(value, 1, 0.0).over(w), F.lead(value, 2, 0.0).over(w)]
    return rows.withColumn(out, sum(near[1:], near[0]) / 9)


def shape_residual_median(rows: DataFrame, keys: list[str], days: int = 28) -> DataFrame:
    """Median over the last days of what each slot lies above the straight line between the ends of its hour."""
    w = Window.partitionBy(*keys).orderBy("day_no", "slot")
    place = F.col("slot") % 6
    left = F.coalesce(*[F.when(place == k, F.lag("power", k).over(w)) for k in range(1, 6)])
    right = F.coalesce(*[F.when(place == k, F.lead("power", 6 - k).over(w)) for k in range(1, 6)])
    rows = rows.withColumn("residual", F.when(place > 0, F.col("power") - (left + (right - left) * place / 6)))
    past = by_slot(keys).rangeBetween(-days, -1)
    return rows.withColumn("shape", F.percentile("residual", 0.5).over(past))
