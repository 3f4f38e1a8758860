"""Queries by key. Each has its SQL beside it where SQL can express it.

Doubles are rounded to four digits on both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import economics as E
from ..operators import features as X
from ..operators import forecasts as P
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import releases as R
from ..sources import adapters as A
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SITE, SERIES = ["target", "series_id"], ["series_id"]
MIN_HISTORY = 15
#: Added before rounding: means of values with two decimals often end in a five.
OFF_TIES = 3.3e-7

BIN = """
bin AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(floor((hour(ts) * 60 + minute(ts)) / 10) AS INTEGER) + 1 AS slot, CAST(value AS DECIMAL(18,2)) AS v FROM events),
days AS (SELECT CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM bin),
spine AS (SELECT day, CAST(day - (SELECT min(day) FROM bin) AS INTEGER) AS day_no, CAST(s AS INTEGER) AS slot FROM days, generate_series(1, 144) t(s)),
ep AS (SELECT k.series_id, p.day, p.day_no, p.slot, coalesce(CAST(b.v AS DOUBLE), 0) AS power FROM (SELECT DISTINCT event_type AS series_id FROM bin) k CROSS JOIN spine p
  LEFT JOIN (SELECT event_type, day, slot, sum(v) AS v FROM bin GROUP BY ALL) b ON b.event_type = k.series_id AND b.day = p.day AND b.slot = p.slot),
sol AS (SELECT 'load' AS target, day, slot, v FROM bin UNION ALL SELECT 'pv', day, slot, v FROM bin WHERE event_type IN ('view', 'click') AND slot BETWEEN 37 AND 108),
site AS (SELECT k.target, 'site' AS series_id, p.day, p.day_no, p.slot, coalesce(CAST(b.v AS DOUBLE), 0) AS power FROM (SELECT DISTINCT target FROM sol) k CROSS JOIN spine p
  LEFT JOIN (SELECT target, day, slot, sum(v) AS v FROM sol GROUP BY ALL) b ON b.target = k.target AND b.day = p.day AND b.slot = p.slot)"""
ISSUES = BIN + """,
truth AS (SELECT series_id, day_no * 144 + slot AS at, power FROM site WHERE target = 'pv'),
iss AS (SELECT n.series_id, n.at AS issue_at, d.day, d.day_no, v.r AS release_hour, CAST(g.h AS INTEGER) AS lead_h, CAST(n.at + g.h * 6 AS INTEGER) AS at, 0.5 * p.power + 0.5 * n.power AS pred, n.power AS now
  FROM (SELECT DISTINCT day, day_no FROM spine WHERE day_no >= 2) d CROSS JOIN (VALUES (0), (6), (12), (18)) v(r) CROSS JOIN generate_series(1, 24) g(h)
  JOIN truth n ON n.at = d.day_no * 144 + v.r * 6 JOIN truth p ON p.series_id = n.series_id AND p.at = n.at + g.h * 6 - 144),
kn AS (SELECT DISTINCT series_id, issue_at, day, day_no, release_hour, 0 AS k, now AS x FROM iss UNION ALL SELECT series_id, issue_at, day, day_no, release_hour, lead_h, pred FROM iss),
lin24 AS (SELECT l.series_id, l.issue_at, l.day, l.day_no, l.release_hour, CAST(s.step AS INTEGER) AS step, CAST(l.issue_at + s.step AS INTEGER) AS at, greatest(0, l.x + (r.x - l.x) * (s.step - 6 * l.k) / 6) AS a
  FROM generate_series(0, 144) s(step) JOIN kn l ON l.k = greatest(1, CAST(ceil(s.step / 6.0) AS INTEGER)) - 1 JOIN kn r ON r.series_id = l.series_id AND r.issue_at = l.issue_at AND r.k = l.k + 1),
lin AS (SELECT * FROM lin24 WHERE step <= (24 - release_hour) * 6)"""
BASE = BIN + """,
base AS (SELECT *, CASE WHEN target = 'pv' THEN greatest(0, avg(power) OVER (PARTITION BY target, series_id, slot ORDER BY day_no ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
  ELSE lag(power, 7) OVER (PARTITION BY target, series_id, slot ORDER BY day_no) END AS pred FROM site)"""
PLAN = BIN + """,
plan AS (SELECT l.series_id, l.day, l.day_no, l.slot, 0.4 + CASE WHEN l.slot BETWEEN 49 AND 126 THEN 0.3 ELSE 0.0 END + 0.001 * (l.slot % 7) AS price, l.power / 6 AS load, p.power / 6 AS pv
  FROM site l JOIN site p ON p.target = 'pv' AND l.target = 'load' AND p.day_no = l.day_no AND p.slot = l.slot),
led0 AS (SELECT *, least(833.333333, greatest(pv - load, 0)) AS c, 0.0 AS d, greatest(load - pv, 0) AS g FROM plan),
led AS (SELECT *, greatest(pv - load - c, 0) AS r, CASE WHEN c > 0 THEN 1 ELSE 0 END AS u, 6000 + sum(0.9 * c) OVER (PARTITION BY series_id, day_no ORDER BY slot) AS s1 FROM led0)"""
STRATEGY = """
raw AS (SELECT CAST(o_custkey % 8 AS INTEGER) AS mask, CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS c FROM orders GROUP BY ALL),
daily AS (SELECT d.day, CAST(m.mask AS INTEGER) AS mask, coalesce(CAST(r.c AS DOUBLE), 0) AS cost FROM (SELECT DISTINCT day FROM raw) d CROSS JOIN generate_series(0, 7) m(mask) LEFT JOIN raw r ON r.day = d.day AND r.mask = m.mask),
costs AS (SELECT mask, sum(cost) AS full_cost, coalesce(sum(cost) FILTER (day >= DATE '2000-01-01'), 0) AS cost, count(*) FILTER (day >= DATE '2000-01-01') AS days FROM daily GROUP BY mask)"""
TOTALS = """
raw AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS day, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS t FROM lineitem GROUP BY ALL),
span AS (SELECT CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM raw),
tot AS (SELECT k.series_id, s.day, CAST(s.day - (SELECT min(day) FROM raw) AS INTEGER) AS day_no, coalesce(CAST(r.t AS DOUBLE), 0) AS total FROM (SELECT DISTINCT series_id FROM raw) k CROSS JOIN span s LEFT JOIN raw r ON r.series_id = k.series_id AND r.day = s.day)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(c) + OFF_TIES, 4) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def add(key: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, ctes: str = BIN, plain: str = "", rounded: str = "") -> None:
    """Register a query; its SQL is `sql`, of which the columns `rounded` are rounded and the columns `plain` kept."""
    QUERIES[key] = lambda spark, sf_dir: _rounded(query(spark, sf_dir))
    if sql:
        columns = [f'"{c.strip()}"' for c in plain.split(",") if c.strip()] + [f"round(CAST({c.strip()} AS DOUBLE) + {OFF_TIES}, 4) + 0.0 AS {c.strip()}" for c in rounded.split(",") if c.strip()]
        ORACLE[key] = f"WITH {ctes} SELECT {', '.join(columns)} FROM ({sql})"


def basic_sql(group: str, table: str = "base", where: str = "pred IS NOT NULL") -> str:
    return f"""SELECT {group}, count(pred - power) AS n, avg(abs(pred - power)) AS mae, sqrt(avg((pred - power) * (pred - power))) AS rmse,
      100 * sum(abs(pred - power)) / nullif(sum(abs(power)), 0) AS wape, avg(pred - power) AS bias, avg(abs(pred - power)) FILTER (power > 1) AS daylight_mae,
      100 * sum(abs(pred - power)) FILTER (power > 1) / nullif(sum(power) FILTER (power > 1), 0) AS daylight_wape FROM {table} WHERE {where} GROUP BY {group}"""


BASIC = "mae, rmse, wape, bias, daylight_mae, daylight_wape"
W = "PARTITION BY target, series_id, slot ORDER BY day_no"
DAYW = "PARTITION BY target, series_id, day_no ORDER BY slot"

# --- grid and scalar functions
add("interval_label", lambda s, d: A.endpoints(s, d).groupBy(C.interval_label(F.col("slot")).alias("label"), C.label_of_minute(F.col("slot") * 10).alias("ending")).agg(F.sum(F.col("power").cast("decimal(18,2)")).cast("double").alias("power")),
    "SELECT lpad(CAST((slot - 1) * 10 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((slot - 1) * 10 % 60 AS VARCHAR), 2, '0') || '-' || lpad(CAST(slot * 10 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(slot * 10 % 60 AS VARCHAR), 2, '0') AS label, lpad(CAST(slot * 10 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(slot * 10 % 60 AS VARCHAR), 2, '0') AS ending, sum(CAST(power AS DECIMAL(18,2))) AS power FROM ep GROUP BY ALL", plain="label, ending", rounded="power")
add("parse_slot_label", lambda s, d: A.endpoints(s, d).select("series_id", "day", C.minute_of_label(C.label_of_minute(F.col("slot") * 10)).alias("minute"), "power"),
    "SELECT series_id, day, slot * 10 AS minute, power FROM ep", plain="series_id, day, minute", rounded="power")
add("shifted_labels", lambda s, d: A.endpoints(s, d).groupBy(C.shifted_label(F.col("slot")).alias("label")).agg(F.count_if(F.col("power") > 0).alias("n")),
    "SELECT CASE WHEN slot * 10 >= 1440 THEN '+1 ' ELSE '' END || lpad(CAST(slot * 10 // 60 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(slot * 10 % 60 AS VARCHAR), 2, '0') || '-' || CASE WHEN slot * 10 + 10 >= 1440 THEN '+1 ' ELSE '' END || lpad(CAST((slot * 10 + 10) // 60 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((slot * 10 + 10) % 60 AS VARCHAR), 2, '0') AS label, count(*) FILTER (power > 0) AS n FROM ep GROUP BY slot", plain="label, n")
add("date_spine", lambda s, d: A.endpoints(s, d).groupBy("series_id", "day", "day_no").agg(F.count_if(F.col("power") > 0).alias("measured")),
    "SELECT series_id, day, day_no, count(*) FILTER (power > 0) AS measured FROM ep GROUP BY ALL", plain="series_id, day, day_no, measured")
add("day_range_filter", lambda s, d: A.site(s, d).where(F.col("day_no") >= MIN_HISTORY).groupBy(*SITE, "day").agg(F.sum(F.col("power").cast("decimal(18,2)")).cast("double").alias("power")),
    f"SELECT target, series_id, day, sum(CAST(power AS DECIMAL(18,2))) AS power FROM site WHERE day_no >= {MIN_HISTORY} GROUP BY ALL", plain="target, series_id, day", rounded="power")
add("calendar_features", lambda s, d: A.site(s, d).where("target = 'load'").select("day", "slot", *[c.alias(n) for n, c in C.calendar(F.col("day"), F.col("slot")).items()]),
    "SELECT day, slot, (slot - 1) / 143.0 AS slot_share, sin(2 * pi() * (slot - 1) / 144) AS slot_sin, cos(2 * pi() * (slot - 1) / 144) AS slot_cos, (isodow(day) - 1) / 6.0 AS weekday_share, CASE WHEN isodow(day) >= 6 THEN 1.0 ELSE 0.0 END AS weekend, sin(2 * pi() * (isodow(day) - 1) / 7) AS week_sin, cos(2 * pi() * (isodow(day) - 1) / 7) AS week_cos, sin(2 * pi() * dayofyear(day) / 365) AS year_sin, cos(2 * pi() * dayofyear(day) / 365) AS year_cos FROM site WHERE target = 'load'",
    plain="day, slot", rounded="slot_share, slot_sin, slot_cos, weekday_share, weekend, week_sin, week_cos, year_sin, year_cos")
add("net_load", lambda s, d: A.planning(s, d).select("series_id", "day", "slot", (F.col("load") - F.col("pv")).alias("net"), C.not_negative(F.col("load") - F.col("pv")).alias("bought")),
    "SELECT series_id, day, slot, load - pv AS net, greatest(load - pv, 0) AS bought FROM plan", PLAN, "series_id, day, slot", "net, bought")
add("zero_guarded_ratio", lambda s, d: A.planning(s, d).select("series_id", "day", "slot", C.guarded_ratio(F.col("pv"), F.col("load")).alias("share"), C.daylight(F.col("pv")).alias("day_light")),
    "SELECT series_id, day, slot, CASE WHEN load > 1e-8 THEN pv / load END AS share, pv > 1 AS day_light FROM plan", PLAN, "series_id, day, slot, day_light", "share")

# --- intervals
AVG = "SELECT *, (coalesce(lag(power) OVER w, max(CASE WHEN slot = 144 THEN power END) OVER (PARTITION BY target, series_id, day_no)) + power) / 2 AS avg_power, CASE WHEN slot > 1 THEN 'inside' WHEN lag(power) OVER w IS NULL THEN 'own_midnight' ELSE 'day_before' END AS left_source FROM site WINDOW w AS (PARTITION BY target, series_id ORDER BY day_no, slot)"
add("interval_avg_actual", lambda s, d: I.interval_averages(A.site(s, d), SITE).drop("day_no", "power"), AVG, plain="target, series_id, day, slot, left_source", rounded="avg_power")
add("interval_shifted", lambda s, d: I.shifted_averages(A.site(s, d), SITE).drop("day_no", "power"), "SELECT *, (power + lead(power) OVER (PARTITION BY target, series_id ORDER BY day_no, slot)) / 2 AS avg_power FROM site", plain="target, series_id, day, slot", rounded="avg_power")
add("boundary_load_weekly", lambda s, d: I.boundaries(A.site(s, d), SITE).select(*SITE, "day", "weekly"), "SELECT target, series_id, day, lag(power, 6) OVER (PARTITION BY target ORDER BY day_no) AS weekly FROM site WHERE slot = 1", plain="target, series_id, day", rounded="weekly")
add("boundary_pv_mean7", lambda s, d: I.boundaries(A.site(s, d), SITE).select(*SITE, "day", "mean7"), "SELECT target, series_id, day, avg(power) OVER (PARTITION BY target ORDER BY day_no ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean7 FROM site WHERE slot = 1", plain="target, series_id, day", rounded="mean7")
add("cross_day_ratio", lambda s, d: I.cross_day_ratio(A.site(s, d), SITE),
    "SELECT *, quantile_cont(q, 0.5) OVER w AS ratio, count(q) OVER w AS samples FROM (SELECT *, CASE WHEN b > 1e-8 THEN lead(a) OVER (PARTITION BY target, series_id ORDER BY day_no) / b END AS q FROM (SELECT target, series_id, day_no, max(CASE WHEN slot = 1 THEN power END) AS a, max(CASE WHEN slot = 144 THEN power END) AS b FROM site GROUP BY ALL)) WINDOW w AS (PARTITION BY target, series_id ORDER BY day_no ROWS BETWEEN 29 PRECEDING AND 2 PRECEDING)",
    plain="target, series_id, day_no, samples", rounded="ratio")

# --- features
ROLL = ", ".join(f"{f}(power) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {name}{n}" for n in (7, 14) for name, f in (("mean", "avg"), ("std", "stddev_pop"))) + f", quantile_cont(power, 0.5) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS median7"
LAGS = ", ".join(f"lag(power, {n}) OVER ({W}) AS lag{n}" for n in (1, 2, 7, 14))
add("lag_day_lookup", lambda s, d: X.lags(A.site(s, d), SITE).drop("day_no", "power"), f"SELECT *, {LAGS} FROM site", plain="target, series_id, day, slot", rounded="lag1, lag2, lag7, lag14")
add("lag_day_sparse", lambda s, d: X.sparse_lags(A.measured(s, d), SITE).select(*SITE, "day", "slot", "lag1", "lag2", "lag7", "lag14"),
    "SELECT m.*, " + ", ".join(f"p{n}.power AS lag{n}" for n in (1, 2, 7, 14)) + " FROM gappy m " + " ".join(f"LEFT JOIN gappy p{n} ON p{n}.target = m.target AND p{n}.slot = m.slot AND p{n}.day = m.day - {n}" for n in (1, 2, 7, 14)),
    BIN + ", gappy AS (SELECT target, 'site' AS series_id, day, slot, CAST(sum(v) AS DOUBLE) AS power FROM sol GROUP BY ALL)", "target, series_id, day, slot", "lag1, lag2, lag7, lag14")
for name in ("mean7", "std7", "mean14", "std14", "median7"):
    add(f"rolling_{name}", lambda s, d, name=name: X.rolling(A.site(s, d), SITE).select(*SITE, "day", "slot", name), f"SELECT *, {ROLL} FROM site", plain="target, series_id, day, slot", rounded=name)
add("daily_total_features", lambda s, d: X.daily_total_features(A.daily_totals(s, d), SERIES),
    "SELECT *, (lag1 - lag3) / 2 AS trend, sin(2 * pi() * dayofyear(day) / 365) AS year_sin, cos(2 * pi() * dayofyear(day) / 365) AS year_cos, sin(2 * pi() * (isodow(day) - 1) / 7) AS week_sin, cos(2 * pi() * (isodow(day) - 1) / 7) AS week_cos FROM (SELECT *, " + ", ".join(f"lag(total, {n}) OVER w AS lag{n}" for n in (1, 2, 3, 7, 14)) + ", " + ", ".join(f"{f}(total) OVER (PARTITION BY series_id ORDER BY day_no ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {k}{n}" for n in (7, 14) for k, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM tot WINDOW w AS (PARTITION BY series_id ORDER BY day_no))",
    TOTALS, "series_id, day, day_no", "total, lag1, lag2, lag3, lag7, lag14, mean7, mean14, std7, std14, trend, year_sin, year_cos, week_sin, week_cos")
add("slot_smooth", lambda s, d: X.smoothed(A.site(s, d), SITE, "power", "smooth").select(*SITE, "day", "slot", "smooth"), f"SELECT *, (lag(power, 2, 0) OVER w + 2 * lag(power, 1, 0) OVER w + 3 * power + 2 * lead(power, 1, 0) OVER w + lead(power, 2, 0) OVER w) / 9 AS smooth FROM site WINDOW w AS ({DAYW})", plain="target, series_id, day, slot", rounded="smooth")
SHAPE = f"""SELECT *, quantile_cont(residual, 0.5) OVER ({W} RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING) AS shape FROM (
  SELECT c.*, CASE WHEN c.slot % 6 > 0 THEN c.power - (l.power + (r.power - l.power) * (c.slot % 6) / 6) END AS residual FROM site c
  LEFT JOIN site l ON l.target = c.target AND l.series_id = c.series_id AND l.day_no * 144 + l.slot = c.day_no * 144 + c.slot - c.slot % 6 LEFT JOIN site r ON r.target = c.target AND r.series_id = c.series_id AND r.day_no * 144 + r.slot = c.day_no * 144 + c.slot - c.slot % 6 + 6)"""
add("shape_residual_median", lambda s, d: X.shape_residual_median(A.site(s, d), SITE).select(*SITE, "day", "slot", "shape"), SHAPE, plain="target, series_id, day, slot", rounded="shape")
PROFILE = """SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY target, series_id, day_no) > 1e-8 THEN raw / sum(raw) OVER (PARTITION BY target, series_id, day_no) ELSE 1.0 / 144 END AS profile FROM ({raw})"""
SHARE = "(SELECT *, CASE WHEN sum(power) OVER (PARTITION BY target, series_id, day_no) > 1e-8 THEN power / sum(power) OVER (PARTITION BY target, series_id, day_no) END AS share FROM site)"
BY_TARGET = f"SELECT *, CASE WHEN target = 'pv' OR lag(slot, 7) OVER w IS NULL THEN avg(share) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) ELSE list_avg(list_filter([lag(share, 7) OVER w, lag(share, 14) OVER w, lag(share, 21) OVER w, lag(share, 28) OVER w], lambda x: x IS NOT NULL)) END AS raw FROM {SHARE} WINDOW w AS ({W})"
add("normalized_profile", lambda s, d: X.normalized_profile(A.site(s, d), SITE).select(*SITE, "day", "slot", (1000 * F.col("profile")).alias("profile")), f"SELECT *, 1000 * p0.profile AS profile1000 FROM ({PROFILE.format(raw=BY_TARGET)}) p0".replace("*, 1000 * p0.profile AS profile1000", "* REPLACE (1000 * profile AS profile)"), plain="target, series_id, day, slot", rounded="profile")
PAST = f"SELECT *, list(share) FILTER (share IS NOT NULL) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS past FROM {SHARE}"
WEIGHTED = f"SELECT *, list_sum(list_transform(past, lambda x, i: x * CASE WHEN len(past) > 1 THEN pow(0.65, (len(past) - i) / (len(past) - 1.0)) ELSE 0.65 END)) / list_sum(list_transform(past, lambda x, i: CASE WHEN len(past) > 1 THEN pow(0.65, (len(past) - i) / (len(past) - 1.0)) ELSE 0.65 END + 0 * x)) AS raw FROM ({PAST})"
add("weighted_profile", lambda s, d: X.weighted_profile(A.site(s, d), SITE).select(*SITE, "day", "slot", (1000 * F.col("profile")).alias("profile")), f"SELECT * REPLACE (1000 * profile AS profile) FROM ({PROFILE.format(raw=WEIGHTED)})", plain="target, series_id, day, slot", rounded="profile")
BOUNDARY = """SELECT *, sqrt(greatest(q1 / n1 - (s1 / n1) * (s1 / n1), 0)) AS day_std, s1 / n1 AS day_mean, ws / wn AS week_mean, sqrt(greatest(wq / wn - (ws / wn) * (ws / wn), 0)) AS week_std,
  sin(2 * pi() * dayofyear(day + 1) / 365) AS year_sin, cos(2 * pi() * dayofyear(day + 1) / 365) AS year_cos, sin(2 * pi() * (isodow(day + 1) - 1) / 7) AS week_sin, cos(2 * pi() * (isodow(day + 1) - 1) / 7) AS week_cos
  FROM (SELECT *, lag(f, 1) OVER w AS lag1, lag(f, 2) OVER w AS lag2, lag(f, 7) OVER w AS lag7, lag(f, 14) OVER w AS lag14, avg(f) OVER w7 AS first_mean7, stddev_pop(f) OVER w7 AS first_std7, avg(f) OVER w14 AS first_mean14, stddev_pop(f) OVER w14 AS first_std14,
    lag(e0) OVER w AS b0, lag(e1) OVER w AS b1, lag(e2) OVER w AS b2, lag(e3) OVER w AS b3, lag(e4) OVER w AS b4, lag(n) OVER w AS n1, lag(s) OVER w AS s1, lag(q) OVER w AS q1, sum(n) OVER w7 AS wn, sum(s) OVER w7 AS ws, sum(q) OVER w7 AS wq
    FROM (SELECT target, series_id, day, day_no, max(power) FILTER (slot = 1) AS f, max(power) FILTER (slot = 144) AS e0, max(power) FILTER (slot = 143) AS e1, max(power) FILTER (slot = 142) AS e2, max(power) FILTER (slot = 141) AS e3, max(power) FILTER (slot = 140) AS e4,
      count(power) AS n, sum(power) AS s, sum(power * power) AS q FROM site GROUP BY ALL)
    WINDOW w AS (PARTITION BY target, series_id ORDER BY day_no), w7 AS (PARTITION BY target, series_id ORDER BY day_no ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), w14 AS (PARTITION BY target, series_id ORDER BY day_no ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))"""
add("boundary_features", lambda s, d: X.boundary_features(A.site(s, d), SITE), BOUNDARY, plain="target, series_id, day_no", rounded=", ".join(X.BOUNDARY_COLUMNS))
add("tree_features", lambda s, d: X.tree_features(A.site(s, d), SITE).select(*SITE, "day", "slot", *P.TREE_COLUMNS), f"SELECT *, {LAGS}, {ROLL} FROM (SELECT *, (slot - 1) / 143.0 AS slot_share, sin(2 * pi() * (slot - 1) / 144) AS slot_sin, cos(2 * pi() * (slot - 1) / 144) AS slot_cos, (isodow(day) - 1) / 6.0 AS weekday_share, CASE WHEN isodow(day) >= 6 THEN 1.0 ELSE 0.0 END AS weekend, sin(2 * pi() * (isodow(day) - 1) / 7) AS week_sin, cos(2 * pi() * (isodow(day) - 1) / 7) AS week_cos, sin(2 * pi() * dayofyear(day) / 365) AS year_sin, cos(2 * pi() * dayofyear(day) / 365) AS year_cos FROM site)", plain="target, series_id, day, slot", rounded=", ".join(P.TREE_COLUMNS))

# --- day-ahead forecasts and their accuracy
for key, t in (("baseline_load", "load"), ("baseline_pv", "pv")):
    add(key, lambda s, d, t=t: P.baseline(A.site(s, d).where(F.col("target") == t), SITE).select(*SITE, "day", "slot", "power", "pred"), f"SELECT * FROM base WHERE target = '{t}'", BASE, "target, series_id, day, slot", "power, pred")
add("baseline_candidates", lambda s, d: P.candidates(A.site(s, d), SITE).select(*SITE, "day", "slot", "c0", "c1", "c2", "c3"), f"SELECT *, lag(power, 1) OVER w AS c0, lag(power, 2) OVER w AS c1, lag(power, 7) OVER w AS c2, avg(power) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS c3 FROM site WINDOW w AS ({W})", plain="target, series_id, day, slot", rounded="c0, c1, c2, c3")
SKY = BIN + f""",
past AS (SELECT *, list(power) OVER ({W} ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING) AS h FROM site WHERE target = 'pv'),
cut AS (SELECT *, len(h) AS n, least(len(h), greatest(7, len(h) // 2)) AS recent_n, CASE WHEN len(h) - greatest(7, len(h) // 2) < 5 THEN least(len(h), greatest(5, len(h) // 2)) ELSE len(h) - greatest(7, len(h) // 2) END AS old_n FROM past),
quant AS (SELECT *, list_max(h) AS high, list_aggregate(h[1:old_n], 'quantile_cont', 0.9) AS old, list_aggregate(h[n - recent_n + 1:n], 'quantile_cont', 0.9) AS recent FROM cut),
carried AS (SELECT *, coalesce(greatest(0, recent + greatest(-greatest(2, 0.02 * greatest(recent, 1)), least(greatest(2, 0.02 * greatest(recent, 1)), (recent - old) / greatest(1, (old_n + recent_n) / 2.0))) * (recent_n + 1) / 2.0), 0) AS ahead FROM quant),
sky AS (SELECT target, series_id, day, day_no, slot, power, CASE WHEN high < 1 THEN 0 ELSE least((lag(ahead, 2, 0) OVER w + 2 * lag(ahead, 1, 0) OVER w + 3 * ahead + 2 * lead(ahead, 1, 0) OVER w + lead(ahead, 2, 0) OVER w) / 9, greatest(1.15 * high, recent)) END AS envelope FROM carried WINDOW w AS ({DAYW}))"""
RATIOS = " + ".join(f"coalesce(lag(ratio, {k + 1}) OVER w, 0) * pow(0.55, {k} / 6.0)" for k in range(7))
add("clear_sky_envelope", lambda s, d: P.clear_sky_envelope(A.site(s, d).where("target = 'pv'"), SITE).where(F.col("day_no") >= MIN_HISTORY).select(*SITE, "day", "slot", "envelope"), f"SELECT * FROM sky WHERE day_no >= {MIN_HISTORY}", SKY, "target, series_id, day, slot", "envelope")
add("clear_sky_forecast", lambda s, d: P.clear_sky_forecast(A.site(s, d).where("target = 'pv'"), SITE).where(F.col("day_no") >= MIN_HISTORY).select(*SITE, "day", "slot", "power", "pred"),
    f"SELECT *, least(envelope * mean, 1.1 * envelope) AS pred FROM (SELECT *, ({RATIOS}) / {sum(0.55 ** (k / 6) for k in range(7))} AS mean FROM (SELECT *, CASE WHEN envelope > 1 THEN least(1.25, greatest(0, power / envelope)) ELSE 0 END AS ratio FROM sky) WINDOW w AS ({W})) WHERE day_no >= {MIN_HISTORY}", SKY, "target, series_id, day, slot", "power, pred")
add("adaptive_weights", lambda s, d: P.adaptive_weights(A.site(s, d).where("target = 'pv'"), SITE).where(F.col("day_no") >= MIN_HISTORY))
add("adaptive_forecast", lambda s, d: P.adaptive_forecast(A.site(s, d).where("target = 'pv'"), SITE).where(F.col("day_no") >= MIN_HISTORY).select(*SITE, "day", "slot", "power", "pred"))
add("seasonal_total_profile", lambda s, d: P.seasonal_profile(A.site(s, d), SITE, MIN_HISTORY).select(*SITE, "day", "slot", "power", "pred"))
#: Days between two fits of the registered tree models: 100 or 120 rounds of boosting are as many rounds of Spark jobs.
REFIT = 5
add("tree_backtest", lambda s, d: P.tree_backtest(A.site(s, d), SITE, MIN_HISTORY, REFIT).select(*SITE, "day", "slot", "power", "pred"))
add("energy_profile", lambda s, d: P.energy_profile(A.site(s, d), SITE, MIN_HISTORY, REFIT).select(*SITE, "day", "slot", "power", "pred"))
def _scored(s: SparkSession, d: str) -> DataFrame:
    """The baseline from the first day on that metrics_basic and metrics_extended_monthly start with, with its month."""
    return P.baseline(A.site(s, d), SITE).where(F.col("day_no") >= MIN_HISTORY).withColumn("month", F.month("day"))


SCORED = BASE + f", scored AS (SELECT *, CAST(month(day) AS INTEGER) AS month FROM base WHERE day_no >= {MIN_HISTORY})"
add("metrics_basic", lambda s, d: M.by_group(_scored(s, d), ["target"]), basic_sql("target", "scored"), SCORED, "target, n", BASIC)
add("metrics_monthly", lambda s, d: M.by_group(P.baseline(A.site(s, d), SITE).withColumn("month", F.month("day")), ["target", "month"]), basic_sql("target, month", "(SELECT *, CAST(month(day) AS INTEGER) AS month FROM base)"), BASE, "target, month, n", BASIC)


def extended_sql(table: str, group: str = "target") -> str:
    return f"""SELECT b.*, x.r2, x.over_rate, y.energy_mape, y.energy_mae, y.peak_mae FROM ({basic_sql(group, table)}) b JOIN (SELECT {group}, 1 - sum((pred - power) * (pred - power)) / nullif(sum(power * power) - sum(power) * sum(power) / count(power), 0) AS r2, 100 * avg(CASE WHEN pred > power THEN 1.0 ELSE 0.0 END) FILTER (power > 1) AS over_rate FROM {table} WHERE pred IS NOT NULL GROUP BY {group}) x USING ({group})
  JOIN (SELECT {group}, 100 * avg(abs(sp - sa) / 6 / greatest(sa / 6, 1e-8)) AS energy_mape, avg(abs(sp - sa) / 6) AS energy_mae, avg(abs(mp - ma)) AS peak_mae FROM (SELECT {group}, day, sum(power) AS sa, sum(pred) AS sp, max(power) AS ma, max(pred) AS mp FROM {table} WHERE pred IS NOT NULL GROUP BY ALL) GROUP BY {group}) y USING ({group})"""


EXTENDED = BASIC + ", r2, over_rate, energy_mape, energy_mae, peak_mae"
add("metrics_extended", lambda s, d: M.extended(P.baseline(A.site(s, d), SITE), ["target"]), extended_sql("base"), BASE, "target, n", EXTENDED)
add("metrics_extended_monthly", lambda s, d: M.extended(_scored(s, d), ["target", "month"]), extended_sql("scored", "target, month"), SCORED, "target, month, n", EXTENDED)
IV = BASE + f""",
act AS ({AVG}),
iv AS (SELECT b.target, b.day, b.day_no, (lag(b.power) OVER (PARTITION BY b.target ORDER BY b.day_no, b.slot)) AS before, b.slot, a.avg_power AS power, ((CASE WHEN b.slot = 1 THEN lag(b.power) OVER (PARTITION BY b.target ORDER BY b.day_no, b.slot) ELSE lag(b.pred) OVER (PARTITION BY b.target ORDER BY b.day_no, b.slot) END) + b.pred) / 2 AS pred FROM base b JOIN act a ON a.target = b.target AND a.day_no = b.day_no AND a.slot = b.slot)"""


def _interval_forecast(s: SparkSession, d: str) -> DataFrame:
    """Calendar-frame intervals of the baseline: the observed midnight, then predicted endpoints."""
    w = Window.partitionBy(*SITE).orderBy("day_no", "slot")
    rows = I.interval_averages(P.baseline(A.site(s, d), SITE), SITE)
    left = F.when(F.col("slot") == 1, F.lag("power").over(w)).otherwise(F.lag("pred").over(w))
    return rows.select("target", "day", "day_no", "slot", F.col("avg_power").alias("power"), ((left + F.col("pred")) / 2).alias("pred"))


add("interval_from_forecast", lambda s, d: _interval_forecast(s, d).drop("day_no"), "SELECT target, day, slot, power, pred FROM iv", IV, "target, day, slot", "power, pred")
add("metrics_interval", lambda s, d: M.extended(_interval_forecast(s, d), ["target"]), extended_sql("iv"), IV, "target, n", EXTENDED)
add("rank_models", lambda s, d: M.ranked(M.by_group(P.candidates(A.site(s, d), SITE).selectExpr(*SITE, "power", "stack(4, 'c0', c0, 'c1', c1, 'c2', c2, 'c3', c3) as (model, pred)"), ["target", "model"]), ["target"], ["wape", "model"]).select("target", "model", "n", "wape", "rank"),
    f"SELECT target, model, n, wape, CAST(row_number() OVER (PARTITION BY target ORDER BY wape, model) AS INTEGER) AS rank FROM ({basic_sql('target, model', f'(SELECT target, power, unnest([{chr(39)}c0{chr(39)}, {chr(39)}c1{chr(39)}, {chr(39)}c2{chr(39)}, {chr(39)}c3{chr(39)}]) AS model, unnest([lag(power, 1) OVER w, lag(power, 2) OVER w, lag(power, 7) OVER w, avg(power) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)]) AS pred FROM site WINDOW w AS ({W}))')})",
    plain="target, model, n, rank", rounded="wape")
add("align_pred_actual", lambda s, d: P.baseline(A.site(s, d), SITE).select(*SITE, "day", "slot", "pred").where("pred is not null").join(A.site(s, d).select(*SITE, "day", "slot", "power"), [*SITE, "day", "slot"]), "SELECT * FROM base WHERE pred IS NOT NULL", BASE, "target, series_id, day, slot", "power, pred")
add("union_predictions", lambda s, d: P.baseline(A.site(s, d), SITE).select(F.lit("baseline").alias("model"), *SITE, "day", "slot", "pred").unionByName(P.candidates(A.site(s, d), SITE).select(F.lit("yesterday").alias("model"), *SITE, "day", "slot", F.col("c0").alias("pred"))),
    f"SELECT 'baseline' AS model, target, series_id, day, slot, pred FROM base UNION ALL SELECT 'yesterday', target, series_id, day, slot, lag(power, 1) OVER ({W}) FROM site", BASE, "model, target, series_id, day, slot", "pred")
add("planning_input", lambda s, d: A.planning(s, d).select("series_id", "day", "slot", C.interval_label(F.col("slot")).alias("label"), "price", "load", "pv", (F.col("load") - F.col("pv")).alias("net")),
    "SELECT *, lpad(CAST((slot - 1) * 10 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((slot - 1) * 10 % 60 AS VARCHAR), 2, '0') || '-' || lpad(CAST(slot * 10 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(slot * 10 % 60 AS VARCHAR), 2, '0') AS label, load - pv AS net FROM plan", PLAN, "series_id, day, slot, label", "price, load, pv, net")
add("slot_annual_mean", lambda s, d: Q.against_profile(A.site(s, d), A.daily_profile(s, d), SITE),
    "SELECT *, mean - given AS off, max(abs(mean - given)) OVER (PARTITION BY target, series_id) AS most_off FROM (SELECT target, series_id, slot, avg(power) AS mean, max(power) FILTER (day_no = 0) AS given FROM site GROUP BY ALL)", plain="target, series_id, slot", rounded="mean, given, off, most_off")

# --- releases
def _truth(s: SparkSession, d: str) -> DataFrame:
    return R.truth_at(A.site(s, d).where("target = 'pv'"))


def _pv(s: SparkSession, d: str) -> DataFrame:
    """The site's output, written once for issues, truth and shapes."""
    return files.written(A.site(s, d).where("target = 'pv'"), "pv")


def _candidates(s: SparkSession, d: str, pv: DataFrame | None = None) -> DataFrame:
    pv = pv or _pv(s, d)
    return R.all_candidates(A.issues(s, d, pv), R.truth_at(pv), X.shape_residual_median(pv, SERIES))


def _intervals(s: SparkSession, d: str, pv: DataFrame | None = None) -> DataFrame:
    pv = pv or _pv(s, d)
    return R.intervals(_candidates(s, d, pv), R.truth_at(pv))


def _errors(s: SparkSession, d: str) -> DataFrame:
    return R.daily_errors(_intervals(s, d))


HOURLY = """SELECT n.series_id, n.issue_at, n.day, n.release_hour, n.lead_h, n.at AS "at", n.pred AS new, o.pred AS old, t.power AS truth FROM iss n JOIN iss o ON o.series_id = n.series_id AND o.issue_at = n.issue_at - 36 AND o.at = n.at JOIN truth t ON t.series_id = n.series_id AND t.at = n.at WHERE n.lead_h <= least(24 - n.release_hour, 18)"""
INTERVAL = """SELECT b.*, o.x + (p.x - o.x) * (b.step - 6 * (b.k - 1)) / 6 AS old, l.x + (r.x - l.x) * (b.step - 6 * (b.k - 1)) / 6 AS new FROM (
  SELECT DISTINCT n.series_id, n.issue_at, n.day, n.release_hour, n.now, CAST(s.step AS INTEGER) AS step, CAST(ceil(s.step / 6.0) AS INTEGER) AS k, CAST(n.issue_at + s.step AS INTEGER) AS "at" FROM iss n JOIN (SELECT DISTINCT series_id, issue_at FROM iss) e ON e.series_id = n.series_id AND e.issue_at = n.issue_at - 36, generate_series(1, 144) s(step) WHERE s.step <= 6 * least(24 - n.release_hour, 18)) b
  JOIN (SELECT series_id, issue_at, k, x FROM kn) l ON l.series_id = b.series_id AND l.issue_at = b.issue_at AND l.k = b.k - 1 JOIN (SELECT series_id, issue_at, k, x FROM kn) r ON r.series_id = b.series_id AND r.issue_at = b.issue_at AND r.k = b.k
  JOIN (SELECT series_id, issue_at + 36 AS issue_at, k - 6 AS k, x FROM kn WHERE k > 6 UNION ALL SELECT series_id, issue_at, 0, x FROM kn WHERE k = 0) o ON o.series_id = b.series_id AND o.issue_at = b.issue_at AND o.k = b.k - 1
  JOIN (SELECT series_id, issue_at + 36 AS issue_at, k - 6 AS k, x FROM kn WHERE k > 6) p ON p.series_id = b.series_id AND p.issue_at = b.issue_at AND p.k = b.k"""
INTERVAL = f'SELECT q.series_id, q.issue_at, q.day, q.release_hour, q.k AS lead_h, q."at", q.new, q.old, t.power AS truth FROM ({INTERVAL}) q JOIN truth t ON t.series_id = q.series_id AND t."at" = q."at"'
VERSIONS = """SELECT {g}, count(*) AS n, avg(abs(old - truth)) AS old_mae, avg(abs(new - truth)) AS new_mae, sqrt(avg((old - truth) * (old - truth))) AS old_rmse, sqrt(avg((new - truth) * (new - truth))) AS new_rmse, avg(old - truth) AS old_bias, avg(new - truth) AS new_bias,
  CASE WHEN sum(abs(truth)) <> 0 THEN 100 * sum(abs(old - truth)) / sum(abs(truth)) WHEN sum(abs(old - truth)) = 0 THEN 0 END AS old_wape, CASE WHEN sum(abs(truth)) <> 0 THEN 100 * sum(abs(new - truth)) / sum(abs(truth)) WHEN sum(abs(new - truth)) = 0 THEN 0 END AS new_wape,
  100 * avg(CASE WHEN abs(new - truth) < abs(old - truth) THEN 1.0 ELSE 0.0 END) AS share_better, 100 * avg(CASE WHEN abs(abs(new - truth) - abs(old - truth)) <= 1e-8 + 1e-5 * abs(old - truth) THEN 1.0 ELSE 0.0 END) AS share_equal, CASE WHEN avg(abs(old - truth)) = 0 THEN CASE WHEN avg(abs(new - truth)) = 0 THEN 0 END ELSE 100 * (avg(abs(old - truth)) - avg(abs(new - truth))) / avg(abs(old - truth)) END AS improvement FROM ({t}) GROUP BY {b}"""
VCOLS = "old_mae, new_mae, old_rmse, new_rmse, old_bias, new_bias, old_wape, new_wape, share_better, share_equal, improvement"
add("explode_leads", lambda s, d: R.explode_leads(A.issues(s, d)).select("series_id", "issue_at", "release_hour", "lead_h", "at", "pred"), "SELECT * FROM iss", ISSUES, "series_id, issue_at, release_hour, lead_h, at", "pred")
add("version_pairs_hourly", lambda s, d: R.hourly_pairs(A.issues(s, d), _truth(s, d)), HOURLY, ISSUES, "series_id, issue_at, day, release_hour, lead_h, at", "new, old, truth")
add("metrics_versions", lambda s, d: M.versions(R.hourly_pairs(A.issues(s, d), _truth(s, d)), [["release_hour"]]), VERSIONS.format(g="release_hour", b="release_hour", t=HOURLY), ISSUES, "release_hour, n", VCOLS)
MONTHS = "(SELECT *, CAST(month(day) AS INTEGER) AS month FROM ({t}))"
add("metrics_versions_monthly", lambda s, d: M.versions(R.hourly_pairs(A.issues(s, d), _truth(s, d)).withColumn("month", F.month("day")), [["month", "release_hour"]]), VERSIONS.format(g="month, release_hour", b="month, release_hour", t=MONTHS.format(t=HOURLY)), ISSUES, "month, release_hour, n", VCOLS)
add("versions_rollup_monthly", lambda s, d: M.versions(R.interval_pairs(A.issues(s, d), _truth(s, d)).withColumn("month", F.month("day")), [["month", "release_hour"]]), VERSIONS.format(g="month, release_hour", b="month, release_hour", t=MONTHS.format(t=INTERVAL)), ISSUES, "month, release_hour, n", VCOLS)
add("versions_rollup", lambda s, d: M.versions(R.interval_pairs(A.issues(s, d), _truth(s, d)), [[], ["release_hour"], ["release_hour", "lead_h"]]), VERSIONS.format(g="release_hour, lead_h", b="GROUPING SETS ((), (release_hour), (release_hour, lead_h))", t=INTERVAL), ISSUES, "release_hour, lead_h, n", VCOLS)
add("version_pairs_interval", lambda s, d: R.interval_pairs(A.issues(s, d), _truth(s, d)).select("series_id", "issue_at", "at", "new", "old", "truth"), INTERVAL, ISSUES, "series_id, issue_at, at", "new, old, truth")
add("version_verdict", lambda s, d: M.verdict(M.versions(R.interval_pairs(A.issues(s, d), _truth(s, d)), [["release_hour"]])).select("release_hour", "n", "improvement", "verdict"),
    f"SELECT release_hour, n, improvement, CASE WHEN improvement >= 0.5 THEN 'new' WHEN abs(improvement) < 0.5 OR abs(old_mae - new_mae) < 1 THEN 'equal' ELSE 'old' END AS verdict FROM ({VERSIONS.format(g='release_hour', b='release_hour', t=INTERVAL)})", ISSUES, "release_hour, n, verdict", "improvement")
add("cand_linear", lambda s, d: R.linear(A.issues(s, d), _truth(s, d)).select("series_id", "issue_at", "release_hour", "step", "at", "a"), "SELECT * FROM lin", ISSUES, "series_id, issue_at, release_hour, step, at", "a")
CAND = ISSUES + f""",
sh AS ({SHAPE}),
bias AS (SELECT i.series_id, i.issue_at, CASE WHEN count(off) >= 6 THEN quantile_cont(off, 0.5) ELSE 0 END AS bias FROM (SELECT n.series_id, n.issue_at, CASE WHEN t.power > 1 OR o.a > 1 THEN t.power - o.a END AS off FROM (SELECT DISTINCT series_id, issue_at FROM iss) n JOIN lin24 o ON o.series_id = n.series_id AND o.issue_at = n.issue_at - 36 AND o.at BETWEEN n.issue_at - 18 AND n.issue_at JOIN truth t ON t.series_id = n.series_id AND t.at = o.at) i GROUP BY ALL),
cand AS (SELECT l.*, t.power, greatest(0, l.a + coalesce(s.shape, 0)) AS b, CASE WHEN l.a > 1 THEN greatest(0, l.a + coalesce(x.bias, 0) * exp(-l.step / 18.0)) ELSE l.a END AS c FROM lin l JOIN truth t ON t.series_id = l.series_id AND t.at = l.at LEFT JOIN sh s ON s.target = 'pv' AND s.series_id = l.series_id AND s.day_no * 144 + s.slot = l.at LEFT JOIN bias x ON x.series_id = l.series_id AND x.issue_at = l.issue_at),
iv AS (SELECT series_id, issue_at, day_no, release_hour, step, (lag(power) OVER w + power) / 2 AS power, (lag(a) OVER w + a) / 2 AS a, (lag(b) OVER w + b) / 2 AS b, (lag(c) OVER w + c) / 2 AS c FROM cand WINDOW w AS (PARTITION BY series_id, issue_at ORDER BY step)),
err AS (SELECT series_id, issue_at, day_no, release_hour, 'A' AS method, avg(abs(a - power)) AS mae FROM iv WHERE step > 0 GROUP BY ALL
  UNION ALL SELECT series_id, issue_at, day_no, release_hour, 'B', avg(abs(b - power)) FROM iv WHERE step > 0 GROUP BY ALL
  UNION ALL SELECT series_id, issue_at, day_no, release_hour, 'C', avg(abs(c - power)) FROM iv WHERE step > 0 GROUP BY ALL),
roll AS (SELECT *, avg(mae) OVER w AS prior, count(mae) OVER w AS history FROM err WINDOW w AS (PARTITION BY series_id, release_hour, method ORDER BY day_no ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
pick AS (SELECT series_id, issue_at, day_no, release_hour, min(history) AS history, CASE WHEN min(history) < 7 THEN 'A' ELSE first(method ORDER BY round(prior, 9), method) END AS chosen, max(prior) FILTER (method = 'A') AS prior_a, max(prior) FILTER (method = 'B') AS prior_b, max(prior) FILTER (method = 'C') AS prior_c FROM roll GROUP BY ALL)"""
add("recent_bias", lambda s, d: R.recent_bias(A.issues(s, d), _truth(s, d)), "SELECT * FROM bias", CAND, "series_id, issue_at", "bias")
add("cand_shape", lambda s, d: _candidates(s, d).select("series_id", "issue_at", "step", "b"), "SELECT * FROM cand", CAND, "series_id, issue_at, step", "b")
add("cand_assim", lambda s, d: _candidates(s, d).select("series_id", "issue_at", "step", "c"), "SELECT * FROM cand", CAND, "series_id, issue_at, step", "c")
add("daily_mae", _errors, "SELECT * FROM err", CAND, "series_id, issue_at, day_no, release_hour, method", "mae")
add("rolling_choice_window", lambda s, d: R.rolling_choice(_errors(s, d)), "SELECT * FROM roll", CAND, "series_id, issue_at, day_no, release_hour, method, history", "mae, prior")
add("select_method", lambda s, d: R.choose(R.rolling_choice(_errors(s, d))).select("series_id", "issue_at", "day_no", "release_hour", "chosen"), "SELECT * FROM pick", CAND, "series_id, issue_at, day_no, release_hour, chosen")
add("choice_log", lambda s, d: R.choose(R.rolling_choice(_errors(s, d))), "SELECT * FROM pick", CAND, "series_id, issue_at, day_no, release_hour, history, chosen", "prior_a, prior_b, prior_c")
add("choice_counts", lambda s, d: R.choose(R.rolling_choice(_errors(s, d))).groupBy("release_hour", "chosen").agg(F.count(F.lit(1)).alias("days")), "SELECT release_hour, chosen, count(*) AS days FROM pick GROUP BY ALL", CAND, "release_hour, chosen, days")
add("method_error_summary", lambda s, d: _errors(s, d).groupBy("release_hour", "method").agg(F.count("mae").alias("n"), F.avg("mae").alias("mean"), F.percentile("mae", 0.5).alias("median")), "SELECT release_hour, method, count(mae) AS n, avg(mae) AS mean, quantile_cont(mae, 0.5) AS median FROM err GROUP BY ALL", CAND, "release_hour, method, n", "mean, median")
EXTRA = """SELECT i.series_id, i.issue_at, CAST((24 - i.release_hour) * 6 + 1 AS INTEGER) AS step, greatest(0, (i.pred + f.mean) / 2) AS pred FROM iss i JOIN (SELECT series_id, day_no, avg(power) OVER w AS mean FROM (SELECT series_id, CAST(("at" - 1) // 144 AS INTEGER) AS day_no, power FROM truth WHERE "at" % 144 = 1) WINDOW w AS (PARTITION BY series_id ORDER BY day_no ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) f ON f.series_id = i.series_id AND f.day_no = i.day_no AND f.mean IS NOT NULL WHERE i.lead_h = 24 - i.release_hour"""


def _intraday(s: SparkSession, d: str) -> DataFrame:
    """The intervals of the chosen candidate, and the one after midnight; intervals are written once for errors and output."""
    pv = _pv(s, d)
    issues, truth = A.issues(s, d, pv), R.truth_at(pv)
    rows = files.written(_intervals(s, d, pv), "intervals")
    chosen = R.choose(R.rolling_choice(R.daily_errors(rows))).select("series_id", "issue_at", F.col("chosen").alias("method"))
    inside = rows.select("series_id", "issue_at", "method", "step", "pred").join(chosen, ["series_id", "issue_at", "method"])
    extra = R.extra_intervals(issues, truth).select("series_id", "issue_at", "step", "pred").join(chosen, ["series_id", "issue_at"])
    return inside.unionByName(extra).select("series_id", "issue_at", "step", "method", "pred")


add("intraday_output", _intraday,
    f"SELECT i.series_id, i.issue_at, i.step, p.chosen AS method, CASE p.chosen WHEN 'A' THEN i.a WHEN 'B' THEN i.b ELSE i.c END AS pred FROM iv i JOIN pick p ON p.series_id = i.series_id AND p.issue_at = i.issue_at WHERE i.step > 0 UNION ALL SELECT e.series_id, e.issue_at, e.step, p.chosen, e.pred FROM ({EXTRA}) e JOIN pick p ON p.series_id = e.series_id AND p.issue_at = e.issue_at", CAND, "series_id, issue_at, step, method", "pred")
def _some_issues(s: SparkSession, d: str) -> DataFrame:
    """Every third day misses its release at 12, so issues come at uneven times."""
    return A.issues(s, d).where("not (day_no % 3 = 1 and release_hour = 12)")


SOME_KNOTS = ISSUES + """,
uneven AS (SELECT series_id, issue_at, list(x ORDER BY k) AS knots FROM kn WHERE NOT (day_no % 3 = 1 AND release_hour = 12) GROUP BY ALL),
newest AS (SELECT t.series_id, CAST(t."at" - 1 AS INTEGER) AS "at", i.issue_at, i.knots, CAST(t."at" - 1 - i.issue_at AS INTEGER) AS step FROM truth t ASOF LEFT JOIN uneven i ON i.series_id = t.series_id AND t."at" - 1 >= i.issue_at)"""
LINE = "(knots[greatest(1, CAST(ceil({k} / 6.0) AS INTEGER))] + (knots[greatest(1, CAST(ceil({k} / 6.0) AS INTEGER)) + 1] - knots[greatest(1, CAST(ceil({k} / 6.0) AS INTEGER))]) * ({k} - 6 * (greatest(1, CAST(ceil({k} / 6.0) AS INTEGER)) - 1)) / 6.0)"
add("latest_issue_asof", lambda s, d: R.latest_issue(_some_issues(s, d), _truth(s, d), _truth(s, d).select("series_id", (F.col("at") - 1).alias("at"))),
    f'SELECT series_id, "at", issue_at, ({LINE.format(k="step")} + {LINE.format(k="(step + 1)")}) / 2 AS pred FROM newest', SOME_KNOTS, "series_id, at, issue_at", "pred")

# --- ledger and value
LED = "(SELECT *, s1 - 0.9 * c AS s0 FROM led)"
add("no_storage_cost", lambda s, d: E.no_storage_cost(A.planning(s, d), SERIES), "SELECT series_id, day_no, sum(price * greatest(load - pv, 0)) AS cost FROM plan GROUP BY ALL", PLAN, "series_id, day_no", "cost")
add("dispatch_totals", lambda s, d: E.dispatch_totals(E.ledger(A.planning(s, d), SERIES), SERIES), f"SELECT series_id, day_no, sum(price * g) AS cost, sum(g) AS sum_g, sum(c) AS sum_c, sum(d) AS sum_d, sum(r) AS sum_r, min_by(s0, slot) AS start_state, max_by(s1, slot) AS end_state, min(s1) AS min_state, max(s1) AS max_state, CASE WHEN sum(price * greatest(load - pv, 0)) > 0 THEN (sum(price * greatest(load - pv, 0)) - sum(price * g)) / sum(price * greatest(load - pv, 0)) END AS saving FROM {LED} GROUP BY ALL", PLAN, "series_id, day_no", "cost, sum_g, sum_c, sum_d, sum_r, start_state, end_state, min_state, max_state, saving")
add("dispatch_blocks", lambda s, d: E.dispatch_blocks(E.ledger(A.planning(s, d), SERIES), SERIES), f"SELECT series_id, day_no, CAST((slot - 1) // 24 AS INTEGER) AS block, sum(c) AS charge, sum(d) AS discharge FROM {LED} GROUP BY ALL", PLAN, "series_id, day_no, block", "charge, discharge")
RULES = {
    "balance": "max(abs(load + c + r - pv - d - g))", "recursion": "max(abs(s1 - s0 - 0.9 * c + d / 0.9))", "sign": "max(greatest(-least(g, c, d, r), 0))", "state_low": "max(greatest(2000 - s1, 0))", "state_high": "max(greatest(s1 - 10000, 0))",
    "charge_limit": "max(greatest(c - 833.333333, 0))", "discharge_limit": "max(greatest(d - 833.333333, 0))", "curtailment": "max(greatest(r - pv, 0))", "charge_switch": "max(greatest(c - 833.333333 * u, 0))", "discharge_switch": "max(greatest(d - 833.333333 * (1 - u), 0))",
    "whole_switch": "max(abs(u - round(u)))", "switch_range": "max(greatest(-u, u - 1, 0))", "start_end": "abs(max_by(s1, slot) - min_by(s0, slot))", "both_ways": "count(*) FILTER (c > 1e-5 AND d > 1e-5)", "continuity": "max(abs(ahead - s1))",
}
add("dispatch_residuals", lambda s, d: E.dispatch_residuals(E.ledger(A.planning(s, d), SERIES), SERIES), f"SELECT series_id, day_no, {', '.join(f'{x} AS {n}' for n, x in RULES.items())} FROM (SELECT *, lead(s0) OVER (PARTITION BY series_id, day_no ORDER BY slot) AS ahead FROM {LED}) GROUP BY ALL", PLAN, "series_id, day_no", ", ".join(RULES))
add("ledger_continuity", lambda s, d: E.dispatch_residuals(E.ledger(A.planning(s, d), SERIES), SERIES).select("series_id", "day_no", "balance", "start_end", "continuity"), f"SELECT series_id, day_no, max(abs(load + c + r - pv - d - g)) AS balance, abs(max_by(s1, slot) - min_by(s0, slot)) AS start_end, max(abs(ahead - s1)) AS continuity FROM (SELECT *, lead(s0) OVER (PARTITION BY series_id, day_no ORDER BY slot) AS ahead FROM {LED}) GROUP BY ALL", PLAN, "series_id, day_no", "balance, start_end, continuity")


def _costs(s: SparkSession, d: str) -> DataFrame:
    return E.coalition_costs(A.strategies(s, d), "2000-01-01")


MARGINAL = "SELECT p.b AS player, a.mask AS coalition, a.cost - j.cost AS benefit FROM costs a CROSS JOIN (VALUES (1), (2), (4)) p(b) JOIN costs j ON j.mask = (a.mask | p.b) WHERE a.mask & p.b = 0"
SHAPLEY = f"SELECT player, sum(benefit * CASE bit_count(coalition) WHEN 1 THEN 1.0 / 6 ELSE 1.0 / 3 END) AS value FROM ({MARGINAL}) GROUP BY player"
add("coalition_cost", _costs, "SELECT * FROM costs", STRATEGY, "mask, days", "full_cost, cost")
add("coalition_saving", lambda s, d: E.savings(_costs(s, d)), "SELECT mask, (SELECT cost FROM costs WHERE mask = 0) - cost AS saving FROM costs", STRATEGY, "mask", "saving")
add("marginal_benefit", lambda s, d: E.marginal_benefits(_costs(s, d)), MARGINAL, STRATEGY, "player, coalition", "benefit")
add("shapley", lambda s, d: E.shapley(_costs(s, d)), f"SELECT player, value, value / sum(value) OVER () AS share FROM ({SHAPLEY})", STRATEGY, "player", "value, share")
add("value_per_day", lambda s, d: E.shapley(_costs(s, d)).join(_costs(s, d).agg(F.max("days").alias("days"))).select("player", (F.col("value") / F.col("days")).alias("per_day")), f"SELECT player, value / (SELECT max(days) FROM costs) AS per_day FROM ({SHAPLEY})", STRATEGY, "player", "per_day")
add("check_shapley_sum", lambda s, d: E.shapley(_costs(s, d)).agg(F.sum("value").alias("value")).join(E.savings(_costs(s, d)).where("mask = 7")).select("value", "saving", (F.abs(F.col("value") - F.col("saving")) < 1e-6 * F.greatest(F.lit(1.0), F.abs("saving"))).alias("ok")), f"SELECT sum(value) AS value, (SELECT max(cost) FILTER (mask = 0) - max(cost) FILTER (mask = 7) FROM costs) AS saving, abs(sum(value) - (SELECT max(cost) FILTER (mask = 0) - max(cost) FILTER (mask = 7) FROM costs)) < 1e-6 * greatest(1, abs(sum(value))) AS ok FROM ({SHAPLEY})", STRATEGY, "ok", "value, saving")
add("combination_effect", lambda s, d: E.pair_effects(_costs(s, d)), "SELECT a.mask AS p, b.mask AS q, (a.cost + b.cost) / 2 AS single, j.cost AS joint, (a.cost + b.cost) / 2 - j.cost AS saving, z.cost - a.cost - b.cost + j.cost AS redundancy, CASE WHEN z.cost - a.cost - b.cost + j.cost > 0 THEN 'redundant' ELSE 'complementary' END AS kind FROM costs a JOIN costs b ON a.mask < b.mask JOIN costs j ON j.mask = (a.mask | b.mask) JOIN costs z ON z.mask = 0 WHERE bit_count(a.mask) = 1 AND bit_count(b.mask) = 1", STRATEGY, "p, q, kind", "single, joint, saving, redundancy")
add("saving_moving_avg7", lambda s, d: A.strategies(s, d).groupBy("day").agg(F.sum(F.when(F.col("mask") == 0, F.col("cost")).when(F.col("mask") == 7, -F.col("cost")).otherwise(0.0)).alias("saving")).withColumn("mean7", F.avg("saving").over(Window.orderBy("day").rowsBetween(-6, 0))),
    "SELECT *, avg(saving) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean7 FROM (SELECT day, sum(CASE mask WHEN 0 THEN cost WHEN 7 THEN -cost ELSE 0 END) AS saving FROM daily GROUP BY day)", STRATEGY, "day", "saving, mean7")
add("monthly_cost_saving", lambda s, d: A.strategies(s, d).withColumn("month", F.date_format("day", "yyyy-MM")).groupBy("month").pivot("mask", [0, 7]).agg(F.sum(F.col("cost").cast("decimal(18,2)")).cast("double")).select("month", F.col("0").alias("base"), F.col("7").alias("best"), (F.col("0") - F.col("7")).alias("saving")),
    "SELECT strftime(day, '%Y-%m') AS month, sum(cost) FILTER (mask = 0) AS base, sum(cost) FILTER (mask = 7) AS best, sum(cost) FILTER (mask = 0) - sum(cost) FILTER (mask = 7) AS saving FROM daily GROUP BY month", STRATEGY, "month", "base, best, saving")
add("cost_distribution", lambda s, d: E.cost_distribution(A.strategies(s, d)), "SELECT mask, q1, q2, q3, min(cost) FILTER (cost >= q1 - 1.5 * (q3 - q1) AND cost <= q3 + 1.5 * (q3 - q1)) AS low, max(cost) FILTER (cost >= q1 - 1.5 * (q3 - q1) AND cost <= q3 + 1.5 * (q3 - q1)) AS high FROM daily JOIN (SELECT mask, quantile_cont(cost, 0.25) AS q1, quantile_cont(cost, 0.5) AS q2, quantile_cont(cost, 0.75) AS q3 FROM daily GROUP BY mask) USING (mask) GROUP BY ALL", STRATEGY, "mask", "q1, q2, q3, low, high")
SHAPLEY_SUMS = {6: "2 * (m0 - m1) + (m2 - m3) + (m4 - m5) + 2 * (m6 - m7)", 12: "2 * (m0 - m2) + (m1 - m3) + (m4 - m6) + 2 * (m5 - m7)", 18: "2 * (m0 - m4) + (m1 - m5) + (m2 - m6) + 2 * (m3 - m7)"}
BOOT = STRATEGY + f""",
cents AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, {', '.join(f'sum(CAST(round(cost * 100) AS BIGINT)) FILTER (mask = {m}) AS m{m}' for m in range(8))} FROM daily GROUP BY day),
size AS (SELECT count(*) AS n FROM cents),
draws AS (SELECT CAST(l.length AS INTEGER) AS length, r.rep, b.b, CAST('0x' || substr(md5('11-' || l.length || '-' || r.rep || '-' || b.b), 1, 8) AS BIGINT) % (n - l.length + 1) AS start, n FROM size, (VALUES (7), (14)) l(length), generate_series(0, 4999) r(rep), generate_series(0, (SELECT n FROM size)) b(b) WHERE l.length <= n AND b.b < ceil(n / l.length)),
sums AS (SELECT w.length, w.rep, any_value(w.n) AS n, {', '.join(f'sum(c.m{m}) AS m{m}' for m in range(8))} FROM draws w JOIN generate_series(0, 13) k(k) ON k.k < w.length AND w.b * w.length + k.k < w.n JOIN cents c ON c.i = w.start + k.k GROUP BY w.length, w.rep),
boot AS (SELECT length, rep, (m0 - m7) / (100.0 * n) AS all_vs_none, (m6 - m7) / (100.0 * n) AS add6_given_12_18, {', '.join(f'({e}) / (600.0 * n) AS shapley_{h}' for h, e in SHAPLEY_SUMS.items())}, (({SHAPLEY_SUMS[12]}) - ({SHAPLEY_SUMS[18]})) / (600.0 * n) AS shapley_12_minus_18 FROM sums)"""
SIX = ["all_vs_none", "add6_given_12_18", "shapley_6", "shapley_12", "shapley_18", "shapley_12_minus_18"]
add("block_bootstrap", lambda s, d: E.block_bootstrap(A.strategies(s, d), 5000, [7, 14]), "SELECT * FROM boot", BOOT, "length, rep", ", ".join(SIX))
add("bootstrap_ci", lambda s, d: E.intervals_of(E.block_bootstrap(A.strategies(s, d), 5000, [7, 14])),
    " UNION ALL ".join(f"SELECT length, '{x}' AS statistic, avg({x}) AS mean, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.025) AS low, quantile_cont({x}, 0.975) AS high, quantile_cont({x}, 0.025) <= 0 AND quantile_cont({x}, 0.975) >= 0 AS crosses_zero FROM boot GROUP BY length" for x in SIX), BOOT, "length, statistic, crosses_zero", "mean, median, low, high")

# --- checks
add("check_shape", lambda s, d: Q.check_shape(A.endpoints(s, d), SERIES), "SELECT series_id, count(*) AS days, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n <> 144) AS bad_days FROM (SELECT series_id, day, count(*) AS n FROM ep GROUP BY ALL) GROUP BY series_id", plain="series_id, days, rows, bad_days")
add("check_contiguous", lambda s, d: Q.check_contiguous(A.endpoints(s, d).where("power > 0"), SERIES), "SELECT series_id, count(*) FILTER (gap <> 1) AS gaps, max(gap) AS longest FROM (SELECT *, day_no * 144 + slot - lag(day_no * 144 + slot) OVER (PARTITION BY series_id ORDER BY day_no, slot) AS gap FROM ep WHERE power > 0) GROUP BY series_id", plain="series_id, gaps, longest")
add("check_values", lambda s, d: Q.check_values(A._table(s, d, "events").withColumnRenamed("event_type", "series_id"), SERIES, "value"), "SELECT event_type AS series_id, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (isnan(value)) AS nans, count(*) FILTER (value < 0) AS negative FROM events GROUP BY ALL", plain="series_id, n, nulls, nans, negative")
add("check_unique", lambda s, d: Q.check_unique(A._binned(s, d), ["event_type", "day", "slot"]), "SELECT event_type, day, slot, count(*) AS n FROM bin GROUP BY ALL HAVING count(*) > 1", plain="event_type, day, slot, n")
add("check_release", lambda s, d: Q.check_release(A.issues(s, d)), "SELECT series_id, day, count(DISTINCT release_hour) AS n, count(DISTINCT CASE WHEN release_hour NOT IN (0, 6, 12, 18) THEN issue_at END) AS odd, count(DISTINCT release_hour) = 4 AND count(DISTINCT CASE WHEN release_hour NOT IN (0, 6, 12, 18) THEN issue_at END) = 0 AS ok FROM iss GROUP BY ALL", ISSUES, "series_id, day, n, odd, ok")
add("pair_completeness", lambda s, d: Q.pair_completeness(A._table(s, d, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 8).alias("mask")).distinct()), "SELECT day, count(*) AS n, count(DISTINCT mask) AS strategies FROM raw GROUP BY day HAVING count(*) <> 8", STRATEGY, "day, n, strategies")
add("series_date_mismatch", lambda s, d: Q.series_mismatch(A._binned(s, d).where("event_type = 'view'").select(F.lit("x").alias("series_id"), F.struct("day", "slot").alias("day")), A._binned(s, d).where("event_type = 'click'").select(F.lit("x").alias("series_id"), F.struct("day", "slot").alias("day"))).select("day.day", "day.slot", "only_in"),
    "SELECT day, slot, 'first' AS only_in FROM (SELECT DISTINCT day, slot FROM bin WHERE event_type = 'view') a ANTI JOIN (SELECT DISTINCT day, slot FROM bin WHERE event_type = 'click') b USING (day, slot) UNION ALL SELECT day, slot, 'second' FROM (SELECT DISTINCT day, slot FROM bin WHERE event_type = 'click') a ANTI JOIN (SELECT DISTINCT day, slot FROM bin WHERE event_type = 'view') b USING (day, slot)", plain="day, slot, only_in")
def _weights_with_faults(s: SparkSession, d: str) -> DataFrame:
    """The weights of each day; on every fifth a tenth too large, on every other seventh one of them below 0."""
    rows = P.adaptive_weights(A.site(s, d).where("target = 'pv'"), SITE).select("day_no", "weights")
    planted = F.when(F.col("day_no") % 5 == 0, F.transform("weights", lambda x: 1.1 * x)).when(F.col("day_no") % 7 == 0, F.array(*[F.lit(x) for x in (-0.5, 0.5, 0.5, 0.5)]))
    return Q.check_weights(rows.withColumn("weights", F.coalesce(planted, "weights")))


add("check_weights", _weights_with_faults, "SELECT DISTINCT day_no, day_no % 7 <> 0 OR day_no % 5 = 0 AS fine, day_no % 5 <> 0 AS whole FROM site WHERE target = 'pv' AND day_no >= 7", plain="day_no, fine, whole")
