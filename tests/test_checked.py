"""Strict sources, orders of rows, as-of issues, observed pairs, output read back, one partitioning, and backtests with estimators."""

import datetime as dt
import random
import re

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wattloom.operators import features as X
from wattloom.operators import forecasts as P
from wattloom.operators import metrics as M
from wattloom.operators import quality as Q
from wattloom.operators import releases as R
from wattloom.operators.backtests import Origins, backtest, boosted, forest
from wattloom.plans.checked import day_ahead, intraday
from wattloom.sources import files
from wattloom.sources.strict import filled_down, read_strict

KEYS = ["target", "series_id"]
DAY = dt.date(2024, 1, 1)
COLUMNS = {"day": "date", "name": "string", "x": "double", "n": "int"}


def series(spark, days, power, target="load", name="s"):
    return spark.createDataFrame([(target, name, DAY + dt.timedelta(d), d, k, float(power(d, k))) for d in range(days) for k in range(1, 145)], "target string, series_id string, day date, day_no int, slot int, power double")


def test_what_does_not_fit_is_reported(spark, tmp_path):
    (tmp_path / "good.csv").write_text("﻿day,name,x,n\n2024-01-01,a,1.5,2\n 2024-01-02 ,,-2,\n", encoding="utf-8")
    (tmp_path / "rows.csv").write_text("day,name,x,n\n2024-01-03,b,abc,2\n2024-01-03,b,NaN,2\n2024-13-01,b,1,2\n2024-01-03,b,1\n2024-01-03,b,1,2,3\n2024-01-03,b,,2\n,b,1,2\n2024-01-04,c,0,1.5\n2024-01-05,d,7,1\n")
    (tmp_path / "swapped.csv").write_text("name,day,x,n\na,2024-01-01,1,2\n")
    (tmp_path / "short.csv").write_text("day,name,x\n2024-01-01,a,1\n")
    (tmp_path / "headless.csv").write_text("2024-01-01,a,1,2\n")
    rows, rejected = read_strict(spark, str(tmp_path), COLUMNS, required=["day", "x"], not_negative=["n"])
    assert sorted((str(r.day), r.name, r.x, r.n) for r in rows.collect()) == [("2024-01-01", "a", 1.5, 2), ("2024-01-02", None, -2.0, None), ("2024-01-05", "d", 7.0, 1)]
    got = sorted((r._file.rpartition("/")[2], r.reason) for r in rejected.collect())
    assert got == sorted([("headless.csv", "header"), ("short.csv", "header"), ("swapped.csv", "header")] + [("rows.csv", x) for x in ("x: no double", "x: no double", "day: no date", "cells", "cells", "x: empty", "day: empty", "n: no int")])
    below = read_strict(spark, str(tmp_path / "good.csv"), COLUMNS, required=[], not_negative=["x"])
    assert [(r.reason, r.row.strip()) for r in below[1].collect()] == [("x: below 0", "2024-01-02 ,,-2,")]


@pytest.mark.parametrize("split", ["128m", "300b"])
def test_dates_are_filled_down_over_splits(spark, tmp_path, split):
    """The same for one split and for many; the order is that of the file."""
    rng, want, lines = random.Random(3), [], ["date,release"]
    day = DAY
    for i in range(400):
        day = day + dt.timedelta(1) if rng.random() < 0.1 else day
        shown = i == 0 or day != want[-1][0]
        lines.append(f"{day if shown else ''},{i}")
        want.append((day, i))
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("date,release\n,7\n2024-05-01,8\n,9\n")
    settings = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows, rejected = read_strict(spark, str(tmp_path), {"date": "date", "release": "int"}, required=["release"])
        if split == "300b":
            assert rows.select("_file", "_block").distinct().count() > 8
        got = filled_down(rows, "date").select(F.regexp_extract("_file", r"(\w)\.csv", 1).alias("f"), "date", "release").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.date, r.release) for r in got if r.f == "a") == sorted(want) and rejected.count() == 0
    assert sorted((str(r.date), r.release) for r in got if r.f == "b") == [("2024-05-01", 8), ("2024-05-01", 9), ("None", 7)]


def test_issue_files(spark, tmp_path):
    rows = [("s", at, DAY + dt.timedelta(d), d, h, [float(d + k) for k in range(24)]) for d in range(3) for h in (0, 6, 12, 18) for at in [d * 144 + h * 6]]
    frame = spark.createDataFrame(rows, "series_id string, issue_at int, day date, day_no int, release_hour int, leads array<double>")
    files.write_issues(frame, str(tmp_path / "i"))
    got, rejected = files.read_issues(spark, str(tmp_path / "i"))
    assert sorted((r.series_id, r.day, r.release_hour, r.leads) for r in got.collect()) == [(r[0], r[2], r[4], r[5]) for r in rows] and rejected.count() == 0
    text = next((tmp_path / "i" / "series_id=s").glob("*.csv")).read_text().splitlines()
    assert len(text) == 13 and [x.split(",")[0] for x in text[1:6]] == ["2024-01-01", "", "", "", "2024-01-02"]


ISSUE = "series_id string, issue_at int, day date, day_no int, release_hour int, leads array<double>"


def test_newest_issue_at_or_before(spark):
    """Issues at uneven times, one exactly at a start, one too late; values on the lines through the knots."""
    issues = spark.createDataFrame([("s", 10, DAY, 0, 0, [6.0] * 24), ("s", 17, DAY, 0, 0, [12.0 * (h + 1) for h in range(24)]), ("s", 500, DAY, 0, 0, [1.0] * 24), ("t", 0, DAY, 0, 0, [5.0] * 24)], ISSUE)
    truth = spark.createDataFrame([(x, k, 0.0) for x in "st" for k in range(600)], "series_id string, at int, power double")
    starts = spark.createDataFrame([("s", k) for k in (0, 9, 10, 16, 17, 18, 22, 23, 160, 161, 499)] + [("t", 3), ("u", 1)], "series_id string, at int")
    got = {(r.series_id, r.at): (r.issue_at, r.pred and round(r.pred, 9)) for r in R.latest_issue(issues, truth, starts).collect()}
    assert got["s", 0] == got["s", 9] == got["u", 1] == (None, None)
    assert got["s", 10] == (10, 0.5) and got["s", 16] == (10, 6.0)  # from 0 at 10 to 6 at 16, then level
    assert got["s", 17] == (17, 1.0) and got["s", 18] == (17, 3.0) and got["s", 22] == (17, 11.0) and got["s", 23] == (17, 13.0)
    assert got["s", 160] == (17, 2 * 143.5) and got["s", 161] == (17, None) and got["s", 499] == (17, None)
    assert got["t", 3] == (0, round((2.5 + 5 * 4 / 6) / 2, 9))


def test_pairs_that_cannot_be_made_are_counted(spark):
    issues = spark.createDataFrame([("s", 36 * k, DAY, 0, h, [float(k)] * 24) for k, h in ((0, 0), (1, 6), (3, 18))], ISSUE)
    truth = spark.createDataFrame([("s", k, 1.0) for k in range(0, 400, 6) if k != 48], "series_id string, at int, power double")
    pairs = R.observed_pairs(issues, truth)
    faults = {(r.issue_at, r.fault): r["count"] for r in pairs.groupBy("issue_at", "fault").count().collect()}
    assert faults == {(0, "issue"): 18, (36, None): 17, (36, "truth"): 1, (108, "issue"): 6}
    seen = Observation("pairs")
    whole = R.counted(pairs, seen)
    assert whole.count() == 17 == R.hourly_pairs(issues, truth).count()
    assert seen.get == {"asked": 42, "missing_issue": 24, "missing_truth": 1}
    table = M.versions(spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 0.0, 1.0, 1.0), ("c", 2.0, 1.0, 1.0), ("d", 0.0, 0.0, 0.0)], "g string, truth double, old double, new double"), [["g"]])
    assert {r.g: r.fault for r in M.undefined(table).collect()} == {"a": "improvement", "b": "wape"}


def test_output_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(p, k, None if k == 3 else float(k)) for p in "abc" for k in range(5)], "p string, k int, v double")
    path = str(tmp_path / "out")
    rows.where("p <> 'c'").withColumn("v", F.when(F.expr("p = 'b' and k = 2"), 2.5).when(F.expr("p = 'b' and k = 3"), 9.0).otherwise(F.col("v"))).where("not (p = 'b' and k = 4)").unionByName(
        spark.createDataFrame([("d", 1, 1.0), ("a", 9, 1.0)], rows.schema)).write.partitionBy("p").parquet(path)
    got = {r.p: tuple(r)[1:] for r in Q.check_roundtrip(rows, path, "p", ["k"], "v").collect()}
    assert got == {"a": (5, 0, 1, 0, 0.0), "b": (5, 1, 0, 2, 0.5), "c": (5, 5, 0, 0, None), "d": (0, 0, 1, 0, None)}


def test_lags_over_gaps(spark):
    rows = series(spark, 20, lambda d, k: 1000 * d + k).where("slot < 4 and day_no not in (3, 9) and not (slot = 2 and day_no % 2 = 0)")
    held = {(r.day_no, r.slot): r.power for r in rows.collect()}
    for r in X.sparse_lags(rows, KEYS).collect():
        assert all(r[f"lag{n}"] == held.get((r.day_no - n, r.slot)) for n in (1, 2, 7, 14))


def test_profile_depends_on_the_target(spark):
    """Load: the same weekday of four weeks; solar output: the last seven days."""
    power = lambda d, k: 10.0 if d % 7 == 0 and k <= 72 or d % 7 != 0 and k > 72 else 0.0  # noqa: E731  every seventh day is another
    got = {(t, r.day_no, r.slot): r.profile for t in ("load", "pv") for r in X.normalized_profile(series(spark, 30, power, t), KEYS).where("slot in (1, 100) and day_no in (3, 28)").collect()}
    assert abs(got["load", 28, 1] - 1 / 72) < 1e-12 and got["load", 28, 100] == 0
    assert abs(got["pv", 28, 1] - 1 / 72 / 7) < 1e-12 and abs(got["pv", 28, 100] - 6 / 72 / 7) < 1e-12
    assert got["load", 3, 1] == got["pv", 3, 1] > 0  # no week before: the days there are


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange (?:hash|range|Single|RoundRobin)", plan))


def test_one_partitioning_for_many_series(spark):
    rng = random.Random(1)
    rows = None
    for name in "abc":
        shift = rng.randrange(50)
        one = series(spark, 10, lambda d, k, shift=shift: (d * 31 + k * 17 + shift) % 101, name=name)
        rows = one if rows is None else rows.unionByName(one)
    found = day_ahead(rows, KEYS, buckets=3)
    assert exchanges(found) == 0
    got = {(r.series_id, r.model): r for r in found.collect()}
    assert len(got) == 12 and all(got[x, "baseline"].n == 3 * 144 and got[x, "yesterday"].n == 9 * 144 for x in "abc")
    alone = P.baseline(rows, KEYS).where("series_id = 'b' and pred is not null").agg(F.avg(F.abs(F.col("pred") - F.col("power"))).alias("m")).head().m
    assert abs(got["b", "baseline"].mae - alone) < 1e-9


def test_day_ahead_needs_no_empty_slots(spark):
    """Rows with power alone give what all rows give, for a series with power on few days, too; nine days, of which the last has none."""
    dense = series(spark, 9, lambda d, k: (d * 31 + k * 17) % 11 if (d + k) % 4 == 0 and d < 8 else 0, name="a").unionByName(series(spark, 9, lambda d, k: 5 if (d, k) in ((0, 144), (2, 1)) else 0, name="b"))
    shown = lambda found: sorted((r.series_id, r.model, r.n, round(r.mae, 9), round(r.rmse, 9), round(r.bias, 9)) for r in found.collect())
    got = shown(day_ahead(dense.where("power > 0"), KEYS, buckets=2, days=F.lit(9)))
    assert len(got) == 8 and got == shown(day_ahead(dense, KEYS, buckets=2))
    base = P.candidates(P.baseline(dense, KEYS), KEYS).selectExpr("series_id", "power", "stack(3, 'baseline', pred, 'yesterday', c0, 'mean7', c3) as (model, pred)")
    assert [r for r in got if r[1] != "interval"] == shown(M.by_group(base, ["series_id", "model"]))


def test_no_shuffle_within_the_intraday_workload(spark):
    """Once rows are bucketed; choices of a series are those that it has alone."""
    names = "abc"
    rows = None
    for i, name in enumerate(names):
        one = series(spark, 12, lambda d, k, i=i: (d * (7 + i) + k * 3) % 23 + 10 * (k > 40), "pv", name)
        rows = one if rows is None else rows.unionByName(one)
    issues = lambda held: held.where("slot % 36 = 0 and day_no between 2 and 10").selectExpr("series_id", "day_no * 144 + slot as issue_at", "day", "int((day_no * 144 + slot) div 144) as day_no", "int(slot % 144 div 6) as release_hour", "transform(sequence(1, 24), h -> power + h) as leads")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = intraday(rows, issues, buckets=3)
        assert exchanges(found) == 0
        got = sorted(map(tuple, found.collect()))
        alone = sorted(map(tuple, intraday(rows.where("series_id = 'b'"), issues, buckets=1).collect()))
        assert len(got) == 3 * len(alone) > 90 and [r for r in got if r[0] == "b"] == alone
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_no_broadcast_of_many_series(spark):
    """Nothing that grows with the series goes through the driver, though the bucketed table is small enough in its files."""
    rows = series(spark, 12, lambda d, k: (d * 7 + k * 3) % 23 + 10 * (k > 40), "pv", "a")
    issues = lambda held: held.where("slot % 36 = 0 and day_no between 2 and 10").selectExpr("series_id", "day_no * 144 + slot as issue_at", "day", "int((day_no * 144 + slot) div 144) as day_no", "int(slot % 144 div 6) as release_hour", "transform(sequence(1, 24), h -> power + h) as leads")
    try:
        found = intraday(rows, issues, buckets=2)
        assert exchanges(found) == 0 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 9 * 4
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_origins_read_their_days_without_copies(spark):
    """Training rows of an origin are a filter of the table: no exchange, no more rows than there are; forecasts are those of copies made by a join."""
    rows = series(spark, 20, lambda d, k: (d * 7 + k * 3) % 11 + (5 if k > 40 else 0)).unionByName(series(spark, 20, lambda d, k: (d * 5 + k) % 7, name="t"))
    features = X.tree_features(rows, KEYS).where("day_no >= 14")
    origins = Origins(features, [*KEYS, "day_no", "slot"], P.TREE_COLUMNS, "power", 16, every=2)
    assert origins.all == [("load", 16), ("load", 18)]
    for target, origin in origins.all:
        training = origins.training(target, origin)
        assert exchanges(training) == 0 and training.count() == 2 * 144 * (origin - 14)
    factory = forest(trees=4, depth=3)
    got = {(r.series_id, r.day_no, r.slot): r.pred for r in backtest(origins, factory).collect()}
    assert len(got) == 2 * 4 * 144
    copies = features.select("day_no").distinct().where("day_no in (16, 18)").withColumnRenamed("day_no", "origin").join(origins.table, F.expr("day_no < origin"))
    for origin in (16, 18):
        model = factory("features", "power").fit(copies.where(F.col("origin") == origin).select("features", "power").coalesce(1))
        for r in model.transform(origins.asked("load", origin)).collect():
            assert abs(got[r.series_id, r.day_no, r.slot] - max(0.0, r.pred)) < 1.5  # samples of rows differ with their order


def test_any_estimator_and_better_than_the_baseline(spark):
    """Days take turns, so a week before is always the wrong day; models find the lags of two and fourteen days."""
    rng = random.Random(4)
    rows = series(spark, 24, lambda d, k: 50 + 20 * (d % 2) + 10 * (k > 70) + rng.random())
    base = P.baseline(rows, KEYS).where("day_no >= 18").agg(F.avg(F.abs(F.col("pred") - F.col("power"))).alias("m")).head().m
    linear = lambda features, label: LinearRegression(featuresCol=features, labelCol=label, predictionCol="pred", regParam=0.1)
    for factory in (linear, boosted(rounds=12, depth=3, rate=0.3)):
        found = P.tree_backtest(rows, KEYS, 18, every=3, factory=factory)
        assert found.count() == 6 * 144
        assert found.agg(F.avg(F.abs(F.col("pred") - F.col("power"))).alias("m")).head().m < base


def test_importances_are_mean_gains(spark):
    """The next day's first endpoint is twice the day before's last one: that feature takes all of the weight there is."""
    rng = random.Random(2)
    last = [rng.randrange(2) * 50.0 for _ in range(40)]
    rows = series(spark, 40, lambda d, k: last[d] if k == 144 else 2 * last[d - 2] if k == 1 and d > 1 else 1.0)
    got = {r.feature: r.weight for r in P.boundary_importances(rows, KEYS, 30, every=5, factory=boosted(rounds=3, depth=1, least=1, rows=1.0, columns=1.0)).collect()}
    assert set(got) == set(P.BOUNDARY_COLUMNS) and abs(sum(got.values()) - 1) < 1e-9 and max(got, key=got.get) == "b0"
