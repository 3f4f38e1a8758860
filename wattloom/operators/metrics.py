"""Accuracy tables, as aggregate expressions that any grouping can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _percent(x: Column, y: Column) -> Column:
    return 100 * x / F.when(y != 0, y)


def basic(actual: str = "power", pred: str = "pred") -> list[Column]:
    e, a = F.col(pred) - F.col(actual), F.col(actual)
    day = a > 1
    return [
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), _percent(F.sum(F.abs(e)), F.sum(F.abs(a))).alias("wape"), F.avg(e).alias("bias"),
        F.avg(F.when(day, F.abs(e))).alias("daylight_mae"), _percent(F.sum(F.when(day, F.abs(e))), F.sum(F.when(day, a))).alias("daylight_wape"),
    ]


def r2(actual: str = "power", pred: str = "pred") -> Column:
    e, a = F.col(pred) - F.col(actual), F.col(actual)
    spread = F.sum(a * a) - F.sum(a) * F.sum(a) / F.count(a)
    return (1 - F.sum(e * e) / F.when(spread != 0, spread)).alias("r2")


def by_group(rows: DataFrame, group: list[str]) -> DataFrame:
    return rows.where("pred is not null").groupBy(*group).agg(*basic())


def extended(rows: DataFrame, group: list[str]) -> DataFrame:
    """With R2, errors of daily energy and peak, and the share (in %) of daylight slots forecast too high."""
    rows = rows.where("pred is not null")
    day = rows.groupBy(*group, "day").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in ("power", "pred")], *[F.max(c).alias(f"_m_{c}") for c in ("power", "pred")])
    energy, off = F.col("_s_power") / 6, F.abs(F.col("_s_pred") - F.col("_s_power")) / 6
    daily = day.groupBy(*group).agg((100 * F.avg(off / F.greatest(energy, F.lit(1e-8)))).alias("energy_mape"), F.avg(off).alias("energy_mae"), F.avg(F.abs(F.col("_m_pred") - F.col("_m_power"))).alias("peak_mae"))
    slots = rows.groupBy(*group).agg(*basic(), r2(), (100 * F.avg(F.when(F.col("power") > 1, (F.col("pred") > F.col("power")).cast("double")))).alias("over_rate"))
    return slots.join(daily, group)


def boundary(group: list[str], rows: DataFrame) -> DataFrame:
    """Errors of (power, pred): n, MAE, RMSE, WAPE, bias, MAPE (of at least 1e-8) and R2."""
    e, a = F.col("pred") - F.col("power"), F.col("power")
    mape = (100 * F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(1e-8)))).alias("mape")
    return rows.where("power is not null and pred is not null").groupBy(*group).agg(*basic()[:5], mape, r2())


def versions(rows: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Old against new forecasts of the same target (truth, old, new), at several levels in one pass; shares in %.

    A new error counts as better if it is smaller at all, also where both count as equal.
    """
    columns = list(dict.fromkeys(c for g in groups for c in g))
    old, new = F.abs(F.col("old") - F.col("truth")), F.abs(F.col("new") - F.col("truth"))
    equal = F.abs(new - old) <= 1e-8 + 1e-5 * old
    rows = rows.withColumns({"_old": old, "_new": new, "_equal": equal.cast("double"), "_better": (new < old).cast("double")})
    e = [F.count(F.lit(1)).alias("n")]
    for v in ("old", "new"):
        e += [F.avg(f"_{v}").alias(f"{v}_mae"), F.sqrt(F.avg(F.col(f"_{v}") * F.col(f"_{v}"))).alias(f"{v}_rmse"), F.avg(F.col(v) - F.col("truth")).alias(f"{v}_bias")]
        all_, off = F.sum(F.abs("truth")), F.sum(f"_{v}")
        e.append(F.when(all_ != 0, 100 * off / F.when(all_ != 0, all_)).when(off == 0, 0.0).alias(f"{v}_wape"))
    e += [(100 * F.avg("_better")).alias("share_better"), (100 * F.avg("_equal")).alias("share_equal")]
    out = rows.groupingSets([[F.col(c) for c in g] for g in groups], *columns).agg(*e)
    gain = F.when(F.col("old_mae") == 0, F.when(F.col("new_mae") == 0, 0.0)).otherwise(100 * (F.col("old_mae") - F.col("new_mae")) / F.col("old_mae"))
    return out.withColumn("improvement", gain)


def undefined(table: DataFrame) -> DataFrame:
    """Rows of versions() for which a percentage has no value, with fault: "improvement" (the old error is 0, the new one is not) or "wape" (all truth is 0, an error is not)."""
    fault = F.when(F.col("improvement").isNull(), "improvement").when(F.col("old_wape").isNull() | F.col("new_wape").isNull(), "wape")
    return table.withColumn("fault", fault).where("fault is not null")


def verdict(table: DataFrame) -> DataFrame:
    """Which version is better: the new one from 0.5 % on; else both are equal within 0.5 % or 1 kW; else the old one."""
    close = (F.abs(F.col("improvement")) < 0.5) | (F.abs(F.col("old_mae") - F.col("new_mae")) < 1)
    return table.withColumn("verdict", F.when(F.col("improvement") >= 0.5, "new").when(close, "equal").otherwise("old"))


def ranked(table: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by)))
