"""Day-ahead forecasts. A forecast of a day reads only days before it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import not_negative
from .backtests import Factory, Origins, backtest, boosted, importances
from .features import BOUNDARY_COLUMNS, boundary_features, by_slot, daily_total_features, normalized_profile, smoothed, tree_features, weighted_profile


def baseline(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Load: the same slot a week before. Solar output (target pv): the mean of the last 7 days."""
    w = by_slot(keys)
    mean = not_negative(F.avg("power").over(w.rowsBetween(-7, -1)))
    return rows.withColumn("pred", F.when(F.col("target") == "pv", mean).otherwise(F.lag("power", 7).over(w)))


def candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = by_slot(keys)
    return rows.withColumns({f"c{i}": F.lag("power", n).over(w) for i, n in enumerate((1, 2, 7))} | {"c3": F.avg("power").over(w.rowsBetween(-7, -1))})


def quantile_of(sorted_values, q: float):
    """Linear interpolation between the values of a sorted array."""
    at = (F.size(sorted_values) - 1) * q
    low = F.get(sorted_values, F.floor(at).cast("int"))
    high = F.get(sorted_values, F.least(F.floor(at).cast("int") + 1, F.size(sorted_values) - 1))
    return low + (high - low) * (at - F.floor(at))


def clear_sky_envelope(rows: DataFrame, keys: list[str], days: int = 42, q: float = 0.9) -> DataFrame:
    """A smooth upper curve of the day: high quantiles of the older and newer half of the history, carried on by their slope from the middle of the newer half."""
    rows = rows.withColumn("_past", F.collect_list("power").over(by_slot(keys).rowsBetween(-days, -1)))
    n = F.size("_past")
    split = F.greatest(F.lit(7), F.floor(n / 2).cast("int"))
    old_n = F.least(n, F.when(n - split < 5, F.greatest(F.lit(5), F.floor(n / 2).cast("int"))).otherwise(n - split))
    new_n = F.least(n, split)
    rows = rows.withColumns({"_old": F.array_sort(F.slice("_past", F.lit(1), old_n)), "_new": F.array_sort(F.slice("_past", n - new_n + 1, new_n))})
    old, new = quantile_of(F.col("_old"), q), quantile_of(F.col("_new"), q)
    span = F.greatest(F.lit(1.0), (old_n + new_n) / 2)
    limit = F.greatest(F.lit(2.0), 0.02 * F.greatest(new, F.lit(1.0)))
    slope = F.greatest(-limit, F.least(limit, (new - old) / span))
    rows = rows.withColumns({"_high": F.array_max("_past"), "_recent": new, "_ahead": F.when(n > 0, not_negative(new + slope * (new_n + 1) / 2))})
    rows = smoothed(rows.withColumn("_ahead", F.coalesce("_ahead", F.lit(0.0))), keys, "_ahead", "_smooth")
    capped = F.least("_smooth", F.greatest(1.15 * F.col("_high"), F.col("_recent")))
    return rows.withColumn("envelope", F.when(F.col("_high") < 1, 0.0).otherwise(capped)).drop("_past", "_old", "_new", "_high", "_recent", "_ahead", "_smooth")


def clear_sky_forecast(rows: DataFrame, keys: list[str], days: int = 7, oldest: float = 0.55) -> DataFrame:
    """The envelope times the weighted mean of the last days' shares of theirs."""
    rows = clear_sky_envelope(rows, keys)
    rows = rows.withColumn("_ratio", F.when(F.col("envelope") > 1, F.least(F.lit(1.25), not_negative(F.col("power") / F.col("envelope")))).otherwise(0.0))
    w, weights = by_slot(keys), [oldest ** (k / (days - 1)) for k in range(days)]
    parts = [F.coalesce(F.lag("_ratio", k + 1).over(w), F.lit(0.0)) * x for k, x in enumerate(weights)]
    return rows.withColumn("pred", F.least(F.col("envelope") * sum(parts[1:], parts[0]) / sum(weights), 1.1 * F.col("envelope"))).drop("_ratio")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def simplex_weights(gram: pd.Series, target: pd.Series) -> pd.Series:
    """Non-negative least squares for four candidates from their sums of products, by all active sets; scaled to 1, or a quarter each.

    All rows of a batch are solved together, one active set after another.
    """
    a, b = np.full((len(gram), 4, 4), np.nan), np.full((len(gram), 4), np.nan)
    at = np.triu_indices(4)
    for i, (g, t) in enumerate(zip(gram, target, strict=True)):
        if g is not None and t is not None:
            a[i][at], b[i] = np.array(g, float), np.array(t, float)
            a[i].T[at] = a[i][at]
    fine = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    best, found = np.zeros(len(a)), np.zeros((len(a), 4))
    for k in range(1, 5):
        for some in combinations(range(4), k):
            s = list(some)
            part, right = a[fine][:, s][:, :, s], b[fine][:, s]
            x = (np.linalg.pinv(part, rcond=1e-13, hermitian=True) @ right[:, :, None])[:, :, 0]
            gain = 2 * (x * right).sum(axis=1) - np.einsum("ni,nij,nj->n", x, part, x)
            better = (x >= 0).all(axis=1) & (gain > best[fine] + 1e-12)
            rows = np.flatnonzero(fine)[better]
            best[rows] = gain[better]
            found[rows] = 0.0
            found[np.ix_(rows, s)] = x[better]
    total = found.sum(axis=1, keepdims=True)
    return pd.Series(list(np.where(total > 1e-12, found / np.maximum(total, 1e-300), 0.25)))


def adaptive_weights(rows: DataFrame, keys: list[str], days: int = 28) -> DataFrame:
    """Per day, the weights of the four candidates that fitted the last days best; 28 days of slots become 14 running sums."""
    rows = candidates(rows, keys).where("day_no >= 7")
    c = [F.col(f"c{i}") for i in range(4)]
    counts = (F.col("power") > 1) | (F.greatest(*c) > 1)
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = {f"g{k}": F.sum(F.when(counts, c[i] * c[j]).otherwise(0.0)) for k, (i, j) in enumerate(pairs)} | {f"t{i}": F.sum(F.when(counts, c[i] * F.col("power")).otherwise(0.0)) for i in range(4)}
    daily = rows.groupBy(*keys, "day_no").agg(*[x.alias(n) for n, x in sums.items()])
    past = Window.partitionBy(*keys).orderBy("day_no").rowsBetween(-days, -1)
    run = {n: F.sum(n).over(past) for n in sums}
    daily = daily.select(*keys, "day_no", F.array(*[run[f"g{k}"] for k in range(10)]).alias("gram"), F.array(*[run[f"t{i}"] for i in range(4)]).alias("product"))
    return daily.select(*keys, "day_no", simplex_weights("gram", "product").alias("weights"))


def adaptive_forecast(rows: DataFrame, keys: list[str]) -> DataFrame:
    weights = adaptive_weights(rows, keys)
    out = candidates(rows, keys).join(weights, [*keys, "day_no"])
    return out.withColumn("pred", not_negative(sum((F.col(f"c{i}") * F.col("weights")[i] for i in range(1, 4)), F.col("c0") * F.col("weights")[0])))


TREE_COLUMNS = ["lag1", "lag2", "lag7", "lag14", "mean7", "std7", "mean14", "std14", "median7", "slot_share", "slot_sin", "slot_cos", "weekday_share", "weekend", "week_sin", "week_cos", "year_sin", "year_cos"]
TOTAL_COLUMNS = ["lag1", "lag2", "lag3", "lag7", "lag14", "mean7", "std7", "mean14", "std14", "trend", "year_sin", "year_cos", "week_sin", "week_cos"]


def tree_backtest(rows: DataFrame, keys: list[str], first_day: int, every: int = 1, factory: Factory | None = None, at_once: int = 8) -> DataFrame:
    """rows with pred: a model per target on the 18 inputs of each slot (boosted trees by default), refitted every `every` days, for every day from first_day on."""
    origins = Origins(tree_features(rows, keys).where("day_no >= 14"), [*keys, "day_no", "slot"], TREE_COLUMNS, "power", first_day, every)
    return rows.join(backtest(origins, factory or boosted(), at_once), [*keys, "day_no", "slot"])


def energy_profile(rows: DataFrame, keys: list[str], first_day: int, every: int = 1, factory: Factory | None = None, at_once: int = 8) -> DataFrame:
    """Daily totals by a model on their 14 inputs, spread over the weighted profile."""
    totals = rows.groupBy(*keys, "day", "day_no").agg(F.sum("power").alias("total"))
    origins = Origins(daily_total_features(totals, keys).where("day_no >= 14"), [*keys, "day_no"], TOTAL_COLUMNS, "total", first_day, every)
    days = backtest(origins, factory or boosted(rounds=100, depth=3, least=4, rows=0.9, columns=0.9), at_once).withColumnRenamed("pred", "day_total")
    return weighted_profile(rows, keys).join(days, [*keys, "day_no"]).withColumn("pred", F.col("profile") * F.col("day_total"))


def boundary_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The 21 boundary features of each day from 14 on with `next`, the next day's first endpoint (null on the last day)."""
    by_day = Window.partitionBy(*keys).orderBy("day_no")
    label = rows.where("slot = 1").select(*keys, "day_no", F.lead("power").over(by_day).alias("next"))
    return boundary_features(rows, keys).join(label, [*keys, "day_no"]).where("day_no >= 14")


def boundary_origins(rows: DataFrame, keys: list[str], first_day: int, every: int = 1) -> Origins:
    """The last label known at a day's start is that of two days before."""
    return Origins(boundary_rows(rows, keys), [*keys, "day_no"], BOUNDARY_COLUMNS, "next", first_day, every, known_before=1)


def boundary_factory(rounds: int = 100) -> Factory:
    """Trees of the boundary study: shallow, since there is one row per series and day."""
    return boosted(rounds=rounds, depth=2, least=3, rows=0.9, columns=0.9)


def boundary_trees(rows: DataFrame, keys: list[str], first_day: int, every: int = 1, factory: Factory | None = None, at_once: int = 8) -> DataFrame:
    """(keys, day_no, pred): the next day's first endpoint."""
    return backtest(boundary_origins(rows, keys, first_day, every), factory or boundary_factory(), at_once)


def boundary_importances(rows: DataFrame, keys: list[str], first_day: int, every: int = 1, factory: Factory | None = None, at_once: int = 8) -> DataFrame:
    """(feature, weight): mean over the models of all origins."""
    return importances(boundary_origins(rows, keys, first_day, every), BOUNDARY_COLUMNS, factory or boundary_factory(), at_once)


def seasonal_totals(totals: DataFrame, keys: list[str], first_day: int, every: int = 30) -> DataFrame:
    """One-day-ahead totals by least squares on the last day, the last week and their errors, refitted every `every` days; one series per group."""
    schema = ", ".join(f"{k} string" for k in keys) + ", day_no int, pred double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_no")
        y, days = pdf["total"].to_numpy(float), pdf["day_no"].to_numpy()
        out, fit, e = [], None, np.zeros(len(y))
        for i in range(max(first_day, 16), len(y)):
            if fit is None or (i - first_day) % every == 0:
                t = np.arange(8, i)
                long = np.column_stack([np.ones(len(t)), y[t - 1], y[t - 7], y[t - 8]])
                e = np.zeros(len(y))
                e[t] = y[t] - long @ np.linalg.lstsq(long, y[t], rcond=None)[0]
                short = np.column_stack([np.ones(len(t)), y[t - 1], y[t - 7], y[t - 8], e[t - 1]])
                fit = np.linalg.lstsq(short, y[t], rcond=None)[0]
            row = np.array([1.0, y[i - 1], y[i - 7], y[i - 8], e[i - 1]])
            out.append(max(0.0, float(row @ fit)))
            e[i] = y[i] - row @ fit
        some = pdf.iloc[max(first_day, 16) :]
        return pd.DataFrame({k: some[k] for k in keys} | {"day_no": days[max(first_day, 16) :], "pred": out})

    return totals.select(*keys, "day_no", "total").groupBy(*keys).applyInPandas(run, schema)


def seasonal_profile(rows: DataFrame, keys: list[str], first_day: int) -> DataFrame:
    """Seasonal totals spread over the normalised profile."""
    totals = rows.groupBy(*keys, "day_no").agg(F.sum("power").alias("total"))
    found = seasonal_totals(totals, keys, first_day).withColumnRenamed("pred", "day_total")
    return normalized_profile(rows, keys).join(found, [*keys, "day_no"]).withColumn("pred", F.col("profile") * F.col("day_total"))

