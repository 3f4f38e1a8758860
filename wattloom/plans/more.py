"""The second part of the registered queries: files, boundaries, scenarios."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import economics as E
from ..operators import features as X
from ..operators import forecasts as P
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import releases as R
from ..operators import scenarios as S
from ..sources import adapters as A
from ..sources import files
from .registry import BASE, BIN, CAND, EXTRA, ISSUES, MIN_HISTORY, PLAN, REFIT, SERIES, SITE, W, _intervals, _truth, add


def _base(s: SparkSession, d: str) -> DataFrame:
    return P.baseline(A.site(s, d), SITE)


add("profile_join", lambda s, d: A.site(s, d).join(F.broadcast(A.price_profile(s)), "slot").groupBy(*SITE, "day").agg(F.sum(F.col("price") * F.col("power") / 6).alias("value")),
    "SELECT target, series_id, day, sum(price * power / 6) AS value FROM site JOIN (SELECT CAST(s AS INTEGER) AS slot, 0.4 + CASE WHEN s BETWEEN 49 AND 126 THEN 0.3 ELSE 0.0 END + 0.001 * (s % 7) AS price FROM generate_series(1, 144) t(s)) USING (slot) GROUP BY ALL", BIN, "target, series_id, day", "value")


def _daily_profile(s: SparkSession, d: str) -> DataFrame:
    path = files.scratch(s, "profile")
    files.write_daily_profile(A.daily_profile(s, d), path)
    return files.read_daily_profile(s, path)


add("read_daily_profile", _daily_profile, "SELECT slot, 0.4 + CASE WHEN slot BETWEEN 49 AND 126 THEN 0.3 ELSE 0.0 END + 0.001 * (slot % 7) AS price, max(power) FILTER (target = 'load') AS load, max(power) FILTER (target = 'pv') AS pv FROM site WHERE day_no = 0 GROUP BY slot", BIN, "slot", "price, load, pv")
def _prediction_files(s: SparkSession, d: str) -> DataFrame:
    """Of two models' predictions on disk, those of one and of the days from the tenth to the twentieth."""
    path = files.scratch(s, "predictions")
    rows = P.candidates(A.site(s, d), SITE).selectExpr("stack(2, 'yesterday', c0, 'week', c2) as (model, pred)", *SITE, "day", "slot", "power")
    files.write_predictions(rows, path)
    first = A.site(s, d).agg(F.min("day").alias("day")).head()["day"]
    return files.read_predictions(s, path, "week", "load", str(first + timedelta(days=9)), str(first + timedelta(days=19))).select("model", "target", "series_id", "day", "slot", "power", "pred")


add("read_predictions", _prediction_files, f"SELECT 'week' AS model, * FROM (SELECT *, lag(power, 7) OVER ({W}) AS pred FROM site) WHERE target = 'load' AND day_no BETWEEN 9 AND 19", BIN, "model, target, series_id, day, slot", "power, pred")


def _long_file(s: SparkSession, d: str) -> DataFrame:
    path = files.scratch(s, "long")
    files.write_long(_base(s, d).select(*SITE, "day", "slot", "power", "pred"), path)
    return s.read.schema("target string, series_id string, day date, slot int, power double, pred double").csv(path, header=True)


def _wide_file(s: SparkSession, d: str) -> DataFrame:
    path = files.scratch(s, "wide")
    files.write_wide(A.endpoints(s, d).select("series_id", "day", "slot", "power"), path)
    return files.power_wide(s, path)[0].toDF("series_id", "day", *[f"s{k}" for k in range(1, 145)])


add("write_long", _long_file, "SELECT * FROM base", BASE, "target, series_id, day, slot", "power, pred")
add("write_wide", _wide_file, "SELECT series_id, day, " + ", ".join(f"max(power) FILTER (slot = {k}) AS s{k}" for k in range(1, 145)) + " FROM ep GROUP BY ALL", BIN, "series_id, day", ", ".join(f"s{k}" for k in range(1, 145)))
add("interval_avg_profile", lambda s, d: I.interval_averages(A.site(s, d).groupBy(*SITE, "slot").agg(F.avg("power").alias("power")).withColumn("day_no", F.lit(0)), SITE).select(*SITE, "slot", "avg_power"),
    "SELECT *, (coalesce(lag(power) OVER w, max(CASE WHEN slot = 144 THEN power END) OVER (PARTITION BY target)) + power) / 2 AS avg_power FROM (SELECT target, series_id, slot, avg(power) AS power FROM site GROUP BY ALL) WINDOW w AS (PARTITION BY target ORDER BY slot)", BIN, "target, series_id, slot", "avg_power")
add("issue_truth_join", lambda s, d: R.linear(A.issues(s, d), _truth(s, d)).join(_truth(s, d), ["series_id", "at"]).select("series_id", "issue_at", "step", "power"), "SELECT l.series_id, l.issue_at, l.step, t.power FROM lin l JOIN truth t ON t.series_id = l.series_id AND t.at = l.at", ISSUES, "series_id, issue_at, step", "power")
add("interp_knots", lambda s, d: R.linear_all(A.issues(s, d), _truth(s, d)).select("series_id", "issue_at", "step", "a"), "SELECT * FROM lin24", ISSUES, "series_id, issue_at, step", "a")
add("intraday_intervals", lambda s, d: _intervals(s, d).select("series_id", "issue_at", "step", "method", "pred").unionByName(R.extra_intervals(A.issues(s, d), _truth(s, d)).select("series_id", "issue_at", "step", F.lit("extra").alias("method"), "pred")),
    f"SELECT series_id, issue_at, step, 'A' AS method, a AS pred FROM iv WHERE step > 0 UNION ALL SELECT series_id, issue_at, step, 'B', b FROM iv WHERE step > 0 UNION ALL SELECT series_id, issue_at, step, 'C', c FROM iv WHERE step > 0 UNION ALL SELECT series_id, issue_at, step, 'extra', pred FROM ({EXTRA})", CAND, "series_id, issue_at, step, method", "pred")
add("standardized_intervals", lambda s, d: I.standardized(_base(s, d), I.boundaries(A.site(s, d), SITE), SITE).where("avg_power is not null").select(*SITE, "day", "slot", "avg_power"),
    "SELECT * FROM (SELECT b.*, (b.pred + CASE WHEN b.slot = 144 THEN CASE b.target WHEN 'pv' THEN n.mean7 ELSE n.weekly END ELSE lead(b.pred) OVER (PARTITION BY b.target, b.series_id, b.day_no ORDER BY b.slot) END) / 2 AS avg_power FROM base b JOIN (SELECT target, day_no, lag(power, 6) OVER w AS weekly, avg(power) OVER (PARTITION BY target ORDER BY day_no ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean7 FROM site WHERE slot = 1 WINDOW w AS (PARTITION BY target ORDER BY day_no)) n ON n.target = b.target AND n.day_no = b.day_no) WHERE avg_power IS NOT NULL", BASE, "target, series_id, day, slot", "avg_power")
BOUND = BASE + f""",
b1 AS (SELECT target, series_id, day_no, lead(power) OVER (PARTITION BY target ORDER BY day_no) AS power, lag(power, 6) OVER (PARTITION BY target ORDER BY day_no) AS weekly FROM site WHERE slot = 1 AND target = 'load'),
rt AS (SELECT *, quantile_cont(q, 0.5) OVER (PARTITION BY target, series_id ORDER BY day_no ROWS BETWEEN 29 PRECEDING AND 2 PRECEDING) AS ratio FROM (SELECT *, CASE WHEN b > 1e-8 THEN lead(a) OVER (PARTITION BY target, series_id ORDER BY day_no) / b END AS q FROM (SELECT target, series_id, day_no, max(CASE WHEN slot = 1 THEN power END) AS a, max(CASE WHEN slot = 144 THEN power END) AS b FROM site GROUP BY ALL))),
mo AS (SELECT target, series_id, day_no, power, unnest(['day1', 'day2', 'day7', 'mean7']) AS base, unnest([lag(power, 1) OVER w, lag(power, 2) OVER w, lag(power, 7) OVER w, avg(power) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)]) AS pred FROM site WHERE target = 'load' AND slot = 144 WINDOW w AS ({W})),
bp AS (SELECT o.target, o.series_id, o.day_no, o.base, m.method, o.pred AS last, o.power AS at_end, b1.power AS after, CASE m.method WHEN 'weekly' THEN b1.weekly ELSE rt.ratio * o.pred END AS p FROM mo o JOIN b1 ON b1.day_no = o.day_no JOIN rt ON rt.target = o.target AND rt.day_no = o.day_no CROSS JOIN (VALUES ('weekly'), ('ratio')) m(method) WHERE o.day_no >= {MIN_HISTORY}),
bm AS (SELECT target, series_id, day_no, base, method, 'endpoint' AS object, p AS pred, after AS power FROM bp UNION ALL SELECT target, series_id, day_no, base, method, 'interval', (last + p) / 2, (at_end + after) / 2 FROM bp)"""


def _boundary(s: SparkSession, d: str, trees: bool) -> DataFrame:
    """Load only: the four lag models as base models, and with trees the boosted and the seasonal one as well."""
    rows = A.site(s, d).where("target = 'load'")
    base = P.candidates(rows, SITE).where("slot = 144").selectExpr(*SITE, "day_no", "slot", "stack(4, 'day1', c0, 'day2', c1, 'day7', c2, 'mean7', c3) as (base, pred)")
    if trees:
        for name, model in (("trees", P.tree_backtest(rows, SITE, MIN_HISTORY, REFIT)), ("seasonal", P.seasonal_profile(rows, SITE, MIN_HISTORY))):
            base = base.unionByName(model.where("slot = 144").select(*SITE, "day_no", "slot", F.lit(name).alias("base"), "pred"))
    found = P.boundary_trees(rows, SITE, MIN_HISTORY + 1, REFIT) if trees else None
    return S.boundary_methods(base, rows, I.boundaries(rows, SITE), I.cross_day_ratio(rows, SITE), SITE, found).where(F.col("day_no") >= MIN_HISTORY)


BM = "SELECT * FROM bm WHERE power IS NOT NULL AND pred IS NOT NULL"
ERRORS = """SELECT base, method, object, count(*) AS n, avg(abs(pred - power)) AS mae, sqrt(avg((pred - power) * (pred - power))) AS rmse, 100 * sum(abs(pred - power)) / nullif(sum(abs(power)), 0) AS wape, avg(pred - power) AS bias, round(100 * avg(abs(pred - power) / greatest(abs(power), 1e-8)), 1) AS mape,
  1 - sum((pred - power) * (pred - power)) / nullif(sum(power * power) - sum(power) * sum(power) / count(power), 0) AS r2 FROM bm WHERE power IS NOT NULL AND pred IS NOT NULL GROUP BY ALL"""
OF = ["base", "method", "object"]
add("model_x_boundary", lambda s, d: _boundary(s, d, False).drop("day"), BM, BOUND, "target, series_id, day_no, base, method, object", "power, pred")
# A relative error against a true 0 is huge, so that column is rounded to tenths before the common rounding.
add("metrics_boundary", lambda s, d: M.boundary(OF, _boundary(s, d, False)).withColumn("mape", F.round("mape", 1)), ERRORS, BOUND, "base, method, object, n", "mae, rmse, wape, bias, mape, r2")
BY_MONTH = ERRORS.replace("SELECT base", "SELECT month, base").replace("FROM bm", "FROM (SELECT b.*, CAST(month(d.day) AS INTEGER) AS month FROM bm b JOIN (SELECT DISTINCT day, day_no FROM spine) d USING (day_no))")
add("metrics_boundary_monthly", lambda s, d: M.boundary([*OF, "month"], _boundary(s, d, False).withColumn("month", F.month("day"))).withColumn("mape", F.round("mape", 1)), BY_MONTH, BOUND, "base, method, object, month, n", "mae, rmse, wape, bias, mape, r2")
# With boosted trees and the seasonal model among the base models, and trees among the ways: no SQL.
add("boundary_compare", lambda s, d: _boundary(s, d, True).drop("day"))
add("metrics_boundary_trees", lambda s, d: M.boundary(OF, _boundary(s, d, True)))
add("mean_importance", lambda s, d: P.boundary_importances(A.site(s, d).where("target = 'load'"), SITE, MIN_HISTORY + 1, REFIT))
add("paired_residual_scenarios", lambda s, d: S.residual_scenarios(_base(s, d), SITE).where(F.col("day_no") >= MIN_HISTORY).select(*SITE, "day", "slot", "scenario", "value"),
    f"SELECT b.target, b.series_id, b.day, b.slot, CAST(g.k AS INTEGER) AS scenario, greatest(0, b.pred + p.power - p.pred) AS value FROM base b CROSS JOIN generate_series(1, 8) g(k) JOIN base p ON p.target = b.target AND p.slot = b.slot AND p.day_no = b.day_no - g.k WHERE b.pred IS NOT NULL AND p.pred IS NOT NULL AND b.day_no >= {MIN_HISTORY}", BASE, "target, series_id, day, slot, scenario", "value")
PRICE = BIN + f""",
price AS (SELECT 'price' AS target, series_id, day, day_no, slot, (0.4 + CASE WHEN slot BETWEEN 49 AND 126 THEN 0.3 ELSE 0.0 END + 0.001 * (slot % 7)) * (1 + power / 1000) AS power FROM site WHERE target = 'load'),
base AS (SELECT *, lag(power, 7) OVER ({W}) AS pred FROM price)"""
add("log_ratio_price_scenarios", lambda s, d: S.ratio_scenarios(P.baseline(A.prices(s, d), SITE), SITE).where(F.col("day_no") >= MIN_HISTORY).select(*SITE, "day", "slot", "scenario", "value"),
    f"SELECT b.target, b.series_id, b.day, b.slot, CAST(g.k AS INTEGER) AS scenario, b.pred * exp(ln(p.power / p.pred)) AS value FROM base b CROSS JOIN generate_series(1, 8) g(k) JOIN base p ON p.slot = b.slot AND p.day_no = b.day_no - g.k AND p.pred > 0 AND p.power > 0 WHERE b.pred > 0 AND b.day_no >= {MIN_HISTORY}", PRICE, "target, series_id, day, slot, scenario", "value")
add("netload_quantile_margin", lambda s, d: S.quantile_margin(_base(s, d), SITE).where(F.col("day_no") >= MIN_HISTORY).select(*SITE, "day", "slot", "margin", "covered"),
    f"SELECT *, pred + margin AS covered FROM (SELECT *, quantile_cont(power - pred, 0.9) OVER ({W} RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING) AS margin FROM base) WHERE day_no >= {MIN_HISTORY}", BASE, "target, series_id, day, slot", "margin, covered")
ORDERED = PLAN + ", ord AS (SELECT *, coalesce(lag(greatest(load - pv, 0)) OVER (PARTITION BY series_id, slot ORDER BY day_no), 0) AS ordered, coalesce(avg(greatest(load - pv, 0)) OVER (PARTITION BY series_id, slot ORDER BY day_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS adjusted, greatest(load - pv, 0) AS used FROM plan)"


def _orders(s: SparkSession, d: str) -> DataFrame:
    w = X.by_slot(SERIES)
    rows = A.planning(s, d).withColumn("used", F.greatest(F.col("load") - F.col("pv"), F.lit(0.0)))
    return rows.withColumns({"ordered": F.coalesce(F.lag("used").over(w), F.lit(0.0)), "adjusted": F.coalesce(F.avg("used").over(w.rowsBetween(-3, -1)), F.lit(0.0))})


add("adjusted_order_settlement", lambda s, d: E.settlement(_orders(s, d), SERIES), "SELECT series_id, day_no, sum(price * ordered + 1.5 * price * greatest(adjusted - ordered, 0) - 0.5 * price * greatest(ordered - adjusted, 0) + 5 * price * greatest(used - adjusted, 0)) AS cash, sum(greatest(used - adjusted, 0)) AS emergency FROM ord GROUP BY ALL", ORDERED, "series_id, day_no", "cash, emergency")
USERS = BIN + """,
ub AS (SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(ts AS DATE) AS day, CAST(floor((hour(ts) * 60 + minute(ts)) / 10) AS INTEGER) + 1 AS slot, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY ALL),
up AS (SELECT k.series_id, p.day_no, p.slot, coalesce(CAST(u.v AS DOUBLE), 0) AS power FROM (SELECT DISTINCT series_id FROM ub) k CROSS JOIN spine p LEFT JOIN ub u ON u.series_id = k.series_id AND u.day = p.day AND u.slot = p.slot),
us AS (SELECT *, lag(power, 7) OVER (PARTITION BY series_id, slot ORDER BY day_no) AS pred FROM up)"""
add("many_series_baseline", lambda s, d: M.by_group(P.baseline(A.user_endpoints(s, d).withColumn("target", F.lit("load")), SITE), ["series_id"]).select("series_id", "n", "mae", "rmse", "bias"),
    "SELECT series_id, count(pred) AS n, avg(abs(pred - power)) AS mae, sqrt(avg((pred - power) * (pred - power))) AS rmse, avg(pred - power) AS bias FROM us WHERE pred IS NOT NULL GROUP BY series_id", USERS, "series_id, n", "mae, rmse, bias")
add("period_dim", lambda s, d: A.endpoints(s, d).groupBy("slot").agg(F.sum(F.col("power").cast("decimal(18,2)")).cast("double").alias("power")).withColumns({"from_minute": (F.col("slot") - 1) * 10, "to_minute": F.col("slot") * 10, "hours": F.lit(1 / 6)}),
    "SELECT slot, sum(CAST(power AS DECIMAL(18,2))) AS power, (slot - 1) * 10 AS from_minute, slot * 10 AS to_minute, 1 / 6.0 AS hours FROM ep GROUP BY slot", BIN, "slot, from_minute, to_minute", "power, hours")
add("endpoint_label", lambda s, d: A.endpoints(s, d).groupBy(C.label_of_minute(F.col("slot") * 10).alias("label")).agg(F.max("power").alias("most")),
    "SELECT lpad(CAST(slot * 10 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(slot * 10 % 60 AS VARCHAR), 2, '0') AS label, max(power) AS most FROM ep GROUP BY slot", BIN, "label", "most")
add("to_energy", lambda s, d: A.site(s, d).select(*SITE, "day", "slot", (F.col("power") / 6).alias("energy")), "SELECT target, series_id, day, slot, power / 6 AS energy FROM site", BIN, "target, series_id, day, slot", "energy")
add("clip_nonneg", lambda s, d: A.site(s, d).select(*SITE, "day", "slot", C.not_negative(F.col("power") - 20).alias("clipped")), "SELECT target, series_id, day, slot, greatest(0, power - 20) AS clipped FROM site", BIN, "target, series_id, day, slot", "clipped")
add("clip_range", lambda s, d: A.site(s, d).select(*SITE, "day", "slot", F.least(F.lit(100.0), C.not_negative(F.col("power") - 20)).alias("clipped")), "SELECT target, series_id, day, slot, least(100, greatest(0, power - 20)) AS clipped FROM site", BIN, "target, series_id, day, slot", "clipped")
add("daylight_flag", lambda s, d: A.site(s, d).groupBy(*SITE, "day").agg(F.count_if(C.daylight(F.col("power"))).alias("slots")), "SELECT target, series_id, day, count(*) FILTER (power > 1) AS slots FROM site GROUP BY ALL", BIN, "target, series_id, day, slots")


def _training_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows and mean of the training days (from 14 on) before each origin, as a running frame instead of a join of days."""
    days = A.site(s, d).where("day_no >= 14").groupBy(*SITE, "day_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("power").cast("decimal(18,2)")).cast("double").alias("power"))
    before = Window.partitionBy(*SITE).orderBy("day_no").rowsBetween(Window.unboundedPreceding, -1)
    return days.select(*SITE, F.col("day_no").alias("origin"), F.sum("n").over(before).alias("rows"), (F.sum("power").over(before) / F.sum("n").over(before)).alias("mean"))


add("expanding_train_join", _training_rows,
    "SELECT o.target, o.series_id, o.day_no AS origin, CAST(nullif(count(t.power), 0) AS BIGINT) AS rows, avg(t.power) AS mean FROM (SELECT DISTINCT target, series_id, day_no FROM site WHERE day_no >= 14) o LEFT JOIN site t ON t.target = o.target AND t.day_no >= 14 AND t.day_no < o.day_no GROUP BY ALL", BIN, "target, series_id, origin, rows", "mean")
