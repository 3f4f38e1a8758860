"""Operators on hand-made series with numbers worked out by hand, and registered queries against DuckDB."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from wattloom.functions import columns as C
from wattloom.operators import economics as E
from wattloom.operators import features as X
from wattloom.operators import forecasts as P
from wattloom.operators import intervals as I
from wattloom.operators import metrics as M
from wattloom.operators import quality as Q
from wattloom.operators import releases as R
from wattloom.operators.backtests import boosted
from wattloom.plans import registry
from wattloom.sources import files
from wattloom.streaming.endpoints import stream_endpoints

SF = "/root/testdata/sf0.001"
KEYS = ["target", "series_id"]
DAY = dt.date(2024, 1, 1)


def series(spark, days, power, target="load"):
    return spark.createDataFrame([(target, "s", DAY + dt.timedelta(d), d, k, float(power(d, k))) for d in range(days) for k in range(1, 145)], "target string, series_id string, day date, day_no int, slot int, power double")


def test_labels(spark):
    frame = spark.createDataFrame([("00:10",), ("7:20",), (" 24:00 ",), ("0:00+1",), ("00:00+1",), ("x",)], "l string")
    assert [r[0] for r in frame.select(C.minute_of_label(F.col("l"))).collect()] == [10, 440, 1440, 1440, 1440, None]
    frame = spark.createDataFrame([(1,), (144,)], "slot int")
    assert [tuple(r) for r in frame.select(C.interval_label(F.col("slot")), C.shifted_label(F.col("slot"))).collect()] == [("00:00-00:10", "00:10-00:20"), ("23:50-24:00", "+1 00:00-+1 00:10")]


def test_interval_averages_of_the_first_and_second_day(spark):
    got = {(r.day_no, r.slot): r for r in I.interval_averages(series(spark, 2, lambda d, k: k), KEYS).collect()}
    assert got[0, 1].avg_power == (144 + 1) / 2 and got[0, 1].left_source == "own_midnight"
    assert got[1, 1].avg_power == (144 + 1) / 2 and got[1, 1].left_source == "day_before"
    assert all(got[0, k].avg_power == k - 0.5 for k in range(2, 145))


def test_equal_days(spark):
    rows = X.rolling(X.lags(series(spark, 16, lambda d, k: k), KEYS), KEYS).where("day_no = 15")
    assert rows.where("lag1 <> slot or lag14 <> slot or abs(mean7 - slot) > 1e-9 or std14 > 1e-9 or median7 <> slot").count() == 0
    m = M.by_group(P.baseline(series(spark, 16, lambda d, k: k), KEYS), ["target"]).head()
    assert (m.n, m.mae, m.rmse, m.wape) == (9 * 144, 0, 0, 0)


@pytest.mark.parametrize("job", ["baseline", "clear_sky", "adaptive", "trees", "energy"])
def test_forecasts_see_nothing_of_their_day(spark, job):
    jobs = {
        "baseline": lambda r: P.baseline(r, KEYS), "clear_sky": lambda r: P.clear_sky_forecast(r, KEYS), "adaptive": lambda r: P.adaptive_forecast(r, KEYS),
        "trees": lambda r: P.tree_backtest(r, KEYS, 18, factory=boosted(rounds=3)), "energy": lambda r: P.energy_profile(r, KEYS, 18, factory=boosted(rounds=3, least=1)),
    }
    power = lambda d, k: (d * 7 + k * 3) % 11 + (5 if k > 40 else 0)
    one = series(spark, 19, power, "pv")
    other = series(spark, 19, lambda d, k: 1e9 if d >= 18 else power(d, k), "pv")
    a, b = ([round(r.pred, 6) for r in jobs[job](x).where("day_no = 18").orderBy("slot").collect()] for x in (one, other))
    assert a == b and len(a) == 144


def test_knots_by_hand(spark):
    issues = spark.createDataFrame([("s", 36, DAY, 0, 6, [6.0 * (h + 1) for h in range(24)])], "series_id string, issue_at int, day date, day_no int, release_hour int, leads array<double>")
    truth = spark.createDataFrame([("s", 36 + k, 0.0) for k in range(109)], "series_id string, at int, power double")
    got = {r.step: r.a for r in R.linear(issues, truth).collect()}
    assert [got[k] for k in range(8)] == [0, 1, 2, 3, 4, 5, 6, 7] and max(got) == 108


def test_choice_rules(spark):
    rows = [("s", d * 144, d, 0, m, 1.0 if m != "B" or d < 7 else 0.5) for d in range(10) for m in "ABC"]
    frame = spark.createDataFrame(rows, "series_id string, issue_at int, day_no int, release_hour int, method string, mae double")
    got = {r.day_no: r.chosen for r in R.choose(R.rolling_choice(frame)).collect()}
    assert [got[d] for d in range(10)] == ["A"] * 8 + ["B"] * 2


def test_metrics_of_nothing_and_of_nights(spark):
    rows = spark.createDataFrame([("x", 0.0, 0.0)], "target string, power double, pred double")
    r = M.by_group(rows, ["target"]).head()
    assert r.mae == 0 and r.wape is None and r.daylight_mae is None
    assert M.by_group(rows.where("pred > 1"), ["target"]).count() == 0
    pairs = spark.createDataFrame([(0.0, 1.0, 1.000005), (0.0, 2.0, 1.0), (0.0, 1.0, 0.999999), (0.0, 3.0, 4.0)], "truth double, old double, new double")
    v = M.versions(pairs, [[]]).head()  # the third is equal and better, the first equal only
    assert (v.share_equal, v.share_better) == (50, 50) and v.old_wape is None and v.old_bias == 1.75
    v = M.versions(spark.createDataFrame([(10.0, 12.0, 9.0), (30.0, 28.0, 30.0)], "truth double, old double, new double"), [[]]).head()
    assert (v.old_wape, v.new_wape, v.old_bias, v.new_bias) == (10, 2.5, 0, -0.5)


def test_verdict_by_hand(spark):
    """At least 0.5 % is new even within 1 kW; equality comes next."""
    rows = [(100.0, 99.4), (100.0, 99.52), (100.0, 100.9), (1000.0, 1000.4), (100.0, 102.0), (1000.0, 990.0)]
    frame = spark.createDataFrame([(i, o, n, 100 * (o - n) / o) for i, (o, n) in enumerate(rows)], "i int, old_mae double, new_mae double, improvement double")
    assert [r.verdict for r in M.verdict(frame).orderBy("i").collect()] == ["new", "equal", "equal", "equal", "old", "new"]


def test_extended_metrics_count_daylight_only(spark):
    rows = [("x", DAY, 0.0, 5.0), ("x", DAY, 0.5, 9.0), ("x", DAY, 10.0, 12.0), ("x", DAY, 20.0, 19.0), ("x", DAY, 30.0, 30.0)]
    r = M.extended(spark.createDataFrame(rows, "target string, day date, power double, pred double"), ["target"]).head()
    assert round(r.over_rate, 9) == round(100 / 3, 9) and round(r.energy_mae, 9) == round(14.5 / 6, 9) and r.peak_mae == 0


def test_envelope_goes_on_with_the_trend(spark):
    """power = 100 + day on day 28: quantiles 112.6 and 126.6 of days 0-13 and 14-27, slope 1 a day, 7.5 days on."""
    rows = series(spark, 29, lambda d, k: 100 + d, "pv")
    got = {r.slot: r.envelope for r in P.clear_sky_envelope(rows, KEYS).where("day_no = 28").collect()}
    slope = 14.0 / 14
    assert abs(got[70] - (100 + 14 + 0.9 * 13 + slope * 7.5)) < 1e-9 and abs(got[70] - 133.2) < 1e-9


def test_standardized_intervals_end_with_what_is_known(spark):
    rows = series(spark, 9, lambda d, k: 10 * d + (1000 if k == 1 else 0), "pv").unionByName(series(spark, 9, lambda d, k: 10 * d + (1000 if k == 1 else 0), "load"))
    pred = rows.withColumn("pred", F.lit(2.0))
    got = {r.target: r.avg_power for r in I.standardized(pred, I.boundaries(rows, KEYS), KEYS).where("day_no = 8 and slot = 144").collect()}
    assert got == {"pv": (2 + 1000 + 10 * 4) / 2, "load": (2 + 1020) / 2}  # days 1-7 on average; day 2


def test_extra_interval(spark):
    """The lead for midnight itself and the mean of the first endpoints of the days before."""
    issues = spark.createDataFrame([("s", 8 * 144 + 108, DAY, 8, 18, [float(h + 1) for h in range(24)])], "series_id string, issue_at int, day date, day_no int, release_hour int, leads array<double>")
    truth = spark.createDataFrame([("s", d * 144 + 1, float(d)) for d in range(12)], "series_id string, at int, power double")
    assert [(r.step, r.pred) for r in R.extra_intervals(issues, truth).collect()] == [(37, (6 + 4) / 2)]


def test_boundary_trees_know_labels_up_to_two_days_before(spark):
    power = lambda d, k: (d * 7 + k * 3) % 11
    one = P.boundary_trees(series(spark, 22, power), KEYS, 16, factory=boosted(rounds=3, depth=2, least=1))
    other = P.boundary_trees(series(spark, 22, lambda d, k: 1e9 if d >= 20 else power(d, k)), KEYS, 16, factory=boosted(rounds=3, depth=2, least=1))
    a, b = ({r.day_no: r.pred for r in x.collect()} for x in (one, other))
    assert sorted(a) == list(range(16, 22)) and all(a[d] == b[d] for d in range(16, 21))


def test_dense_has_every_slot(spark):
    from wattloom.sources.adapters import dense

    span = F.lit(DAY), F.lit(DAY + dt.timedelta(2))
    rows = spark.createDataFrame([("a", DAY, 5, 2.5), ("a", DAY, 6, 0.5), ("b", DAY + dt.timedelta(2), 144, 1.0), ("c", DAY, 1, 3.0)], "series_id string, day date, slot int, power double")
    out = dense(rows, ["series_id"], *span)
    assert out.count() == 3 * 3 * 144 and out.select("series_id", "day_no", "slot").distinct().count() == 3 * 3 * 144
    assert sorted((r.series_id, r.day_no, r.slot, r.power) for r in out.where("power <> 0").collect()) == [("a", 0, 5, 2.5), ("a", 0, 6, 0.5), ("b", 2, 144, 1.0), ("c", 0, 1, 3.0)]
    assert out.where("day <> date_add(date'2024-01-01', day_no)").count() == 0
    assert dense(rows.limit(0), ["series_id"], *span).count() == 0


def test_published_shapley_values(spark):
    """Costs that differ by the published marginal savings give the published values, and pairs their published redundancies (fixed values)."""
    alone, pairs, all_three = {1: 208187.47926330753, 2: 501389.06127633527, 4: 398378.3689387962}, {3: 62617.86019024439, 5: 98898.79837417789, 6: 215779.3831662424}, 62583.35951823369
    saved = {0: 0.0, **alone, 3: alone[2] + pairs[3], 5: alone[4] + pairs[5], 6: alone[4] + pairs[6]}
    saved[7] = saved[6] + all_three
    costs = spark.createDataFrame([(m, 12671791.1 - x) for m, x in saved.items()], "mask int, cost double")
    got = {r.player: r.value for r in E.shapley(costs).collect()}
    want = {1: 117176.38935458411, 2: 322217.4727571302, 4: 237347.24951155795}
    assert all(abs(got[p] - want[p]) < 1e-3 for p in want)
    redundant = {(r.p, r.q): r.redundancy for r in E.pair_effects(costs).collect()}
    assert all(abs(redundant[k] - v) < 1e-3 for k, v in {(1, 2): 145569.61907306314, (1, 4): 109288.68088912964, (2, 4): 285609.6781100929}.items())


def test_shapley_golden(spark):
    """Sums of three players whose values are known: saving of each alone 1, 2, 4 and nothing more together."""
    costs = spark.createDataFrame([(m, 100.0 - bin(m).count("1") - 3 * (m >> 2)) for m in range(8)], "mask int, cost double")
    got = {r.player: r.value for r in E.shapley(costs).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {1: 1, 2: 1, 4: 4}
    assert E.pair_effects(costs).where("abs(redundancy) > 1e-9").count() == 0


def test_bootstrap_is_repeatable(spark):
    daily = spark.createDataFrame([(DAY + dt.timedelta(d), m, float(d + m)) for d in range(20) for m in range(8)], "day date, mask int, cost double")
    a = E.block_bootstrap(daily, 20, [7]).orderBy("rep").collect()
    assert a == E.block_bootstrap(daily.repartition(3), 20, [7]).orderBy("rep").collect()
    assert all(abs(r.all_vs_none + 7) < 1e-9 and abs(r.add6_given_12_18 + 1) < 1e-9 for r in a)
    assert all(abs(r.shapley_6 + 1) < 1e-9 and abs(r.shapley_12 + 2) < 1e-9 and abs(r.shapley_12_minus_18 - 2) < 1e-9 for r in a)


def test_weights_are_a_simplex(spark):
    rows = P.adaptive_weights(series(spark, 20, lambda d, k: (d * k) % 13, "pv"), KEYS).collect()
    assert all(abs(sum(r.weights) - 1) < 1e-9 and min(r.weights) >= 0 for r in rows)


def test_weights_are_optimal(spark):
    """The conditions of non-negative least squares: no candidate could lower the error, and those in use are stationary."""
    import numpy as np

    rng, rows = np.random.default_rng(5), []
    for _ in range(60):
        x = rng.normal(1, 1, size=(30, 4))
        y = x @ rng.choice([0, 0.3, -0.4, 1.0], 4) + rng.normal(0, 0.3, 30)
        rows.append(((x.T @ x)[np.triu_indices(4)].tolist(), (x.T @ y).tolist()))
    rows += [(None, [1.0] * 4), ([float("nan")] * 10, [1.0] * 4), ([1.0] * 10, [-1.0] * 4)]
    got = spark.createDataFrame(rows, "gram array<double>, product array<double>").coalesce(1).withColumn("w", P.simplex_weights("gram", "product")).collect()
    assert [r.w for r in got[60:]] == [[0.25] * 4] * 3
    for r in got[:60]:
        a, b, w = np.zeros((4, 4)), np.array(r["product"]), np.array(r.w)
        a[np.triu_indices(4)] = r.gram
        a = a + np.triu(a, 1).T
        best = w * max(0.0, w @ b / (w @ a @ w))
        if not best.any():
            assert (b <= 1e-9).all()
            continue
        slope = a @ best - b
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and (slope >= -1e-6).all() and abs(slope[w > 0]).max() < 1e-6


def test_partition_invariance(spark):
    rows = series(spark, 12, lambda d, k: (d * 31 + k * 17) % 101)
    run = lambda r: sorted(map(tuple, X.weighted_profile(r, KEYS).select("day_no", "slot", F.round("profile", 12)).collect()))
    assert run(rows.coalesce(1)) == run(rows.repartition(8))


def test_checks(spark):
    rows = series(spark, 2, lambda d, k: k).where("not (day_no = 1 and slot = 5)")
    assert [tuple(r) for r in Q.check_shape(rows, KEYS).collect()] == [("load", "s", 2, 287, 1)]
    assert Q.check_contiguous(rows, KEYS).head().gaps == 1


def test_files(spark, tmp_path):
    rows = series(spark, 2, lambda d, k: k).drop("target", "day_no")
    files.write_wide(rows, str(tmp_path / "wide"))
    got = files.read_power_wide(spark, str(tmp_path / "wide"))
    assert sorted(map(tuple, got.select("series_id", "day", "slot", "power").collect())) == sorted(map(tuple, rows.select("series_id", "day", "slot", "power").collect()))
    for name in ("none", "all"):
        (tmp_path / f"{name}.csv").write_text("window_date,cash_cost_yuan,emergency_kwh\n2025-02-01,3.5,0\n")
    for x in (tmp_path / "wide").iterdir():
        x.unlink()
    got = files.read_strategy_daily(spark, str(tmp_path), {"none": 0, "all": 7})
    assert sorted((r.strategy, r.mask, r.cost) for r in got.collect()) == [("all", 7, 3.5), ("none", 0, 3.5)]
    files.write_predictions(rows.selectExpr("'m' as model", "'load' as target", "*"), str(tmp_path / "p"))
    assert files.read_predictions(spark, str(tmp_path / "p"), "m", "load", "2024-01-02", "2024-01-02").count() == 144


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.select("ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = stream_endpoints(stream).writeStream.format("memory").queryName("endpoints").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("endpoints")
    batch = stream_endpoints(events)
    assert got.count() > 0 and got.join(batch, ["series_id", "ts", "power"], "left_anti").count() == 0


@pytest.mark.parametrize("key", ["metrics_basic", "interval_avg_actual", "rolling_median7", "weighted_profile", "select_method", "versions_rollup", "dispatch_totals", "shapley", "cost_distribution", "netload_quantile_margin", "clear_sky_forecast", "version_verdict", "intraday_output", "standardized_intervals", "metrics_boundary", "bootstrap_ci", "metrics_interval", "boundary_features", "read_power_wide", "check_power_files", "check_strategy_files", "read_issues", "check_issues", "check_version_pairs", "check_roundtrip", "many_series_day_ahead", "latest_issue_asof", "lag_day_sparse", "normalized_profile", "metrics_boundary_monthly", "metrics_versions_monthly"])
def test_against_sql(spark, key):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[key](spark, SF)
    cols = sorted(got.columns)
    shown = lambda v: "" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)[:10] if isinstance(v, dt.date) else str(v)
    a = sorted(tuple(shown(r[c]) for c in cols) for r in got.collect())
    b = sorted(tuple(map(shown, r)) for r in con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({registry.ORACLE[key]})").fetchall())
    assert a == b


@pytest.mark.parametrize("key", ["metrics_monthly", "metrics_extended", "metrics_interval"])
def test_accuracy_of_every_forecast(spark, key):
    """All slots that have a forecast count: load from the eighth day on, solar output from the first (its forecast is then 0), but for the first interval of all."""
    test_against_sql(spark, key)
    days = spark.read.parquet(f"{SF}/events.parquet").selectExpr("datediff(max(to_date(ts)), min(to_date(ts))) + 1 as n").head().n
    got = {r.target: r.n for r in __spark_entry__.queries()[key](spark, SF).groupBy("target").agg(F.sum("n").alias("n")).collect()}
    assert got == {"load": (days - 7) * 144, "pv": days * 144 - (key == "metrics_interval")}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
