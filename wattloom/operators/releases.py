"""Intraday forecasts: hourly releases rebuilt at ten minutes, three ways, with a rolling choice between them.

Issues are (series_id, issue_at, day, day_no, release_hour, leads); times are in slots since the first
day's midnight. Truth is (series_id, at, power).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.columns import not_negative

KEY = ["series_id", "issue_at"]


def truth_at(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("series_id", "day_no * 144 + slot as at", "power")


def explode_leads(issues: DataFrame) -> DataFrame:
    return issues.select(*KEY, "day_no", "release_hour", F.posexplode("leads").alias("_i", "pred")).selectExpr(*KEY, "day_no", "release_hour", "_i + 1 as lead_h", "issue_at + (_i + 1) * 6 as at", "pred")


def observed_pairs(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """The pairs of hourly_pairs() and those that cannot be made: fault is null, "issue" without one six hours before, or "truth" without a measured value."""
    old = issues.select("series_id", (F.col("issue_at") + 36).alias("issue_at"), F.col("leads").alias("old_leads"))
    both = issues.join(old, KEY, "left").withColumn("lead_h", F.explode(F.expr("sequence(1, least(24 - release_hour, 18))")))
    both = both.selectExpr(*KEY, "day", "release_hour", "lead_h", "issue_at + lead_h * 6 as at", "leads[lead_h - 1] as new", "old_leads[lead_h + 5] as old", "old_leads is null as _alone")
    both = both.join(truth.withColumnRenamed("power", "truth"), ["series_id", "at"], "left")
    return both.withColumn("fault", F.when(F.col("_alone"), "issue").when(F.col("truth").isNull(), "truth")).drop("_alone")


def counted(pairs: DataFrame, observation: Observation) -> DataFrame:
    """Whole pairs of observed_pairs(); what is left out is counted on the way, as missing_issue and missing_truth of the observation."""
    faults = [F.count_if(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f"missing_{f}") for f in ("issue", "truth")]
    return pairs.observe(observation, F.count(F.lit(1)).alias("asked"), *faults).where("fault is null").drop("fault")


def hourly_pairs(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """An issue and the one six hours before for the same hours, with the truth; joined before the leads are unfolded. Pairs without one of these are left out: see observed_pairs()."""
    return observed_pairs(issues, truth).where("fault is null").drop("fault")


def knots(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """knots: what is measured at the issue, then the leads up to midnight."""
    now = truth.select("series_id", F.col("at").alias("issue_at"), F.col("power").alias("now"))
    return issues.join(now, KEY).withColumn("knots", F.expr("concat(array(now), slice(leads, 1, 24 - release_hour))"))


def linear(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidate A: straight lines between the knots; step 0 is the time of issue."""
    rows = knots(issues, truth).withColumn("step", F.explode(F.expr("sequence(0, (24 - release_hour) * 6)")))
    right = "greatest(1, int(ceil(step / 6)))"
    rows = rows.selectExpr(*KEY, "day", "day_no", "release_hour", "step", "issue_at + step as at", f"knots[{right} - 1] + (knots[{right}] - knots[{right} - 1]) * (step - 6 * ({right} - 1)) / 6 as a")
    return rows.withColumn("a", not_negative(F.col("a")))


def interval_pairs(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """The pairs at ten minutes: both versions start from the truth at the issue and are interpolated."""
    old = issues.select("series_id", (F.col("issue_at") + 36).alias("issue_at"), F.col("leads").alias("old_leads"))
    both = knots(issues, truth).join(old, KEY).withColumn("old_knots", F.expr("concat(array(now), slice(old_leads, 7, least(24 - release_hour, 18)))"))
    both = both.withColumn("step", F.explode(F.expr("sequence(1, 6 * least(24 - release_hour, 18))")))
    line = lambda x: f"{x}[int(ceil(step / 6)) - 1] + ({x}[int(ceil(step / 6))] - {x}[int(ceil(step / 6)) - 1]) * (step - 6 * (ceil(step / 6) - 1)) / 6"
    both = both.selectExpr(*KEY, "day", "release_hour", "int(ceil(step / 6)) as lead_h", "issue_at + step as at", f"{line('knots')} as new", f"{line('old_knots')} as old")
    return both.join(truth.withColumnRenamed("power", "truth"), ["series_id", "at"])


def recent_bias(issues: DataFrame, truth: DataFrame, least: int = 6) -> DataFrame:
    """Median of truth minus the issue before, over the last three hours, where one of both is over 1; 0 from fewer than `least`."""
    old = linear_all(issues, truth).select("series_id", (F.col("issue_at") + 36).alias("issue_at"), "at", F.col("a").alias("pred"))
    steps = issues.select(*KEY).withColumn("at", F.explode(F.expr("sequence(issue_at - 18, issue_at)")))
    rows = steps.join(old, [*KEY, "at"]).join(truth, ["series_id", "at"])
    off = F.when((F.col("power") > 1) | (F.col("pred") > 1), F.col("power") - F.col("pred"))
    return rows.groupBy(*KEY).agg(F.when(F.count(off) >= least, F.percentile(off, 0.5)).otherwise(0.0).alias("bias"))


def linear_all(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidate A over all 24 leads, beyond midnight too."""
    return linear(issues.withColumn("release_hour", F.lit(0)), truth)


def all_candidates(issues: DataFrame, truth: DataFrame, shape: DataFrame) -> DataFrame:
    """a, b (with the usual shape within the hour) and c (with the recent bias fading over three hours) of each step."""
    rows = linear(issues, truth).join(shape.selectExpr("series_id", "day_no * 144 + slot as at", "shape"), ["series_id", "at"], "left").join(recent_bias(issues, truth), KEY, "left")
    c = F.when(F.col("a") > 1, F.col("a") + F.coalesce("bias", F.lit(0.0)) * F.exp(-F.col("step") / 18)).otherwise(F.col("a"))
    return rows.withColumns({"b": not_negative(F.col("a") + F.coalesce("shape", F.lit(0.0))), "c": not_negative(c)})


def intervals(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(method, pred, power) per interval of each issue, as means of its two ends."""
    w = Window.partitionBy(*KEY).orderBy("step")
    rows = candidates.join(truth, ["series_id", "at"])
    mean = {x: (F.lag(x).over(w) + F.col(x)) / 2 for x in ("a", "b", "c", "power")}
    rows = rows.withColumns(mean).where("step > 0")
    return rows.selectExpr(*KEY, "day_no", "release_hour", "step", "power", "stack(3, 'A', a, 'B', b, 'C', c) as (method, pred)")


def extra_intervals(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """(issue, step, pred) of the interval after midnight: the mean of the lead for midnight itself and of the first endpoints of the 7 days before the issue's (of those there are)."""
    first = truth.where("at % 144 = 1").select("series_id", F.expr("int((at - 1) div 144)").alias("_day"), "power")
    days = Window.partitionBy("series_id").orderBy("_day").rangeBetween(-7, -1)
    mean = first.select("series_id", F.col("_day").alias("day_no"), F.avg("power").over(days).alias("_next")).where("_next is not null")
    rows = issues.join(mean, ["series_id", "day_no"])
    return rows.selectExpr(*KEY, "day_no", "release_hour", "(24 - release_hour) * 6 + 1 as step", "greatest(0.0D, (leads[23 - release_hour] + _next) / 2) as pred")


def daily_errors(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY, "day_no", "release_hour", "method").agg(F.avg(F.abs(F.col("pred") - F.col("power"))).alias("mae"))


def rolling_choice(errors: DataFrame, days: int = 28) -> DataFrame:
    """prior: mean of the last days' errors of a release and method, without today's; history: how many there were."""
    past = Window.partitionBy("series_id", "release_hour", "method").orderBy("day_no").rowsBetween(-days, -1)
    return errors.withColumns({"prior": F.avg("mae").over(past), "history": F.count("mae").over(past)})


def choose(rolling: DataFrame, least: int = 7) -> DataFrame:
    """Per issue the method with the smallest prior error, ties (to nine digits) in the order A, B, C; A while there is little history."""
    best = rolling.groupBy(*KEY, "day_no", "release_hour").agg(F.min("history").alias("history"), F.min_by("method", F.struct(F.round("prior", 9), "method")).alias("best"), *[F.max(F.when(F.col("method") == m, F.col("prior"))).alias(f"prior_{m.lower()}") for m in "ABC"])
    return best.withColumn("chosen", F.when(F.col("history") < least, "A").otherwise(F.col("best"))).drop("best")


def latest_issue(issues: DataFrame, truth: DataFrame, starts: DataFrame) -> DataFrame:
    """(series_id, at, issue_at, pred) for every ten-minute interval that starts at `at` (starts: series_id, at).

    It takes the newest issue at or before its start, whenever that was, and the mean of its two ends on the lines through what was measured at
    the issue and the hourly values; null before the first issue and beyond the last value. Issues and starts are put in one
    order and each start takes over the last issue above it: no join of times.
    """
    now = truth.select("series_id", F.col("at").alias("issue_at"), F.col("power").alias("now"))
    known = issues.join(now, KEY).select("series_id", F.col("issue_at").alias("at"), F.lit(0).alias("_order"), F.struct("issue_at", F.concat(F.array("now"), "leads").alias("knots")).alias("_issue"))
    asked = starts.select("series_id", "at", F.lit(1).alias("_order"), F.lit(None).cast(known.schema["_issue"].dataType).alias("_issue"))
    above = Window.partitionBy("series_id").orderBy("at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = known.unionByName(asked).withColumn("_issue", F.last("_issue", ignorenulls=True).over(above)).where("_order = 1")
    rows = rows.select("series_id", "at", "_issue.*").withColumn("_step", F.col("at") - F.col("issue_at"))
    line = lambda k: f"(get(knots, {_right(k)} - 1) + (get(knots, {_right(k)}) - get(knots, {_right(k)} - 1)) * ({k} - 6 * ({_right(k)} - 1)) / 6)"
    return rows.selectExpr("series_id", "at", "issue_at", f"({line('_step')} + {line('(_step + 1)')}) / 2 as pred")


def _right(step: str) -> str:
    return f"greatest(1, int(ceil({step} / 6)))"
