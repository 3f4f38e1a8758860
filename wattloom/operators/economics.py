"""Dispatch ledgers and the value of more forecast releases."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Storage limits (fixed values): energy per slot, charging efficiency, bounds and start of the state in kWh.
CHARGE_MOST, EFFICIENCY, STATE_LOW, STATE_HIGH, STATE_START = 833.333333, 0.9, 2000.0, 10000.0, 6000.0
PLAYERS = {1: "06:00", 2: "12:00", 4: "18:00"}


def ledger(plan: DataFrame, keys: list[str]) -> DataFrame:
    """A ledger that stores surplus and never gives it back: grid g, charge c, discharge d, curtailed r, states, switch u."""
    plan = plan.withColumn("c", F.least(F.lit(CHARGE_MOST), F.greatest(F.col("pv") - F.col("load"), F.lit(0.0))))
    plan = plan.withColumns({"d": F.lit(0.0), "r": F.greatest(F.col("pv") - F.col("load") - F.col("c"), F.lit(0.0)), "g": F.greatest(F.col("load") - F.col("pv"), F.lit(0.0)), "u": (F.col("c") > 0).cast("int")})
    stored = F.sum(EFFICIENCY * F.col("c")).over(Window.partitionBy(*keys, "day_no").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return plan.withColumn("s1", STATE_START + stored).withColumn("s0", F.col("s1") - EFFICIENCY * F.col("c"))


def no_storage_cost(plan: DataFrame, keys: list[str]) -> DataFrame:
    return plan.groupBy(*keys, "day_no").agg(F.sum(F.col("price") * F.greatest(F.col("load") - F.col("pv"), F.lit(0.0))).alias("cost"))


def dispatch_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    bare = F.sum(F.col("price") * F.greatest(F.col("load") - F.col("pv"), F.lit(0.0)))
    cost = F.sum(F.col("price") * F.col("g"))
    return rows.groupBy(*keys, "day_no").agg(
        cost.alias("cost"), *[F.sum(x).alias(f"sum_{x}") for x in "gcdr"], F.min_by("s0", "slot").alias("start_state"), F.max_by("s1", "slot").alias("end_state"),
        F.min("s1").alias("min_state"), F.max("s1").alias("max_state"), F.when(bare > 0, (bare - cost) / bare).alias("saving"))


def dispatch_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "day_no", F.floor((F.col("slot") - 1) / 24).cast("int").alias("block")).agg(F.sum("c").alias("charge"), F.sum("d").alias("discharge"))


def dispatch_residuals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The largest violation of each rule, per day."""
    w = Window.partitionBy(*keys, "day_no").orderBy("slot")
    rows = rows.withColumn("_next", F.lead("s0").over(w))
    over = lambda x: F.max(F.greatest(x, F.lit(0.0)))
    g, c, d, r, s0, s1, u = (F.col(x) for x in ("g", "c", "d", "r", "s0", "s1", "u"))
    rules = {
        "balance": F.max(F.abs(F.col("load") + c + r - F.col("pv") - d - g)), "recursion": F.max(F.abs(s1 - s0 - EFFICIENCY * c + d / EFFICIENCY)),
        "sign": over(-F.least(g, c, d, r)), "state_low": over(STATE_LOW - s1), "state_high": over(s1 - STATE_HIGH), "charge_limit": over(c - CHARGE_MOST), "discharge_limit": over(d - CHARGE_MOST),
        "curtailment": over(r - F.col("pv")), "charge_switch": over(c - CHARGE_MOST * u), "discharge_switch": over(d - CHARGE_MOST * (1 - u)), "whole_switch": F.max(F.abs(u - F.round(u))), "switch_range": F.max(F.greatest(-u, u - 1, F.lit(0))),
        "start_end": F.abs(F.max_by("s1", "slot") - F.min_by("s0", "slot")), "both_ways": F.count_if((c > 1e-5) & (d > 1e-5)), "continuity": F.max(F.abs(F.col("_next") - s1)),
    }
    return rows.groupBy(*keys, "day_no").agg(*[x.cast("double").alias(n) for n, x in rules.items()])


def settlement(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cash of changed orders: added energy at 1.5 times the price, cancelled energy gives half back, emergencies cost 5 times."""
    p, old, new, used = (F.col(x) for x in ("price", "ordered", "adjusted", "used"))
    cash = p * old + 1.5 * p * F.greatest(new - old, F.lit(0.0)) - 0.5 * p * F.greatest(old - new, F.lit(0.0)) + 5 * p * F.greatest(used - new, F.lit(0.0))
    return rows.groupBy(*keys, "day_no").agg(F.sum(cash).alias("cash"), F.sum(F.greatest(used - new, F.lit(0.0))).alias("emergency"))


def coalition_costs(daily: DataFrame, test_from: str) -> DataFrame:
    return daily.groupBy("mask").agg(F.sum("cost").alias("full_cost"), F.sum(F.when(F.col("day") >= F.lit(test_from).cast("date"), F.col("cost")).otherwise(0.0)).alias("cost"), F.count_if(F.col("day") >= F.lit(test_from).cast("date")).alias("days"))


def savings(costs: DataFrame) -> DataFrame:
    base = F.max(F.when(F.col("mask") == 0, F.col("cost"))).over(Window.partitionBy(F.lit(0)))
    return costs.select("mask", (base - F.col("cost")).alias("saving"))


def marginal_benefits(costs: DataFrame) -> DataFrame:
    """What each release saves on top of each coalition without it."""
    players = F.explode(F.array(*[F.lit(b) for b in PLAYERS]))
    without = costs.select(F.col("mask").alias("coalition"), F.col("cost").alias("without"), players.alias("player")).where("coalition & player = 0")
    with_it = costs.select((F.col("mask")).alias("joint"), F.col("cost").alias("with"))
    return without.join(with_it, F.col("joint") == F.expr("coalition | player")).select("player", "coalition", (F.col("without") - F.col("with")).alias("benefit"))


def shapley(costs: DataFrame) -> DataFrame:
    """Mean marginal benefit over all orders of arrival, and its share of all."""
    n = len(PLAYERS)
    weights = F.create_map(*[F.lit(x) for s in range(n) for x in (s, factorial(s) * factorial(n - s - 1) / factorial(n))])
    out = marginal_benefits(costs).groupBy("player").agg(F.sum(F.col("benefit") * weights[F.bit_count("coalition")]).alias("value"))
    return out.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy(F.lit(0))))


def pair_effects(costs: DataFrame) -> DataFrame:
    """Two releases together against one by one."""
    m = costs.select("mask", "cost")
    base = m.where("mask = 0").select(F.col("cost").alias("base"))
    one = lambda n: m.where("bit_count(mask) = 1").select(F.col("mask").alias(n), F.col("cost").alias(f"cost_{n}"))
    rows = one("p").join(one("q"), F.expr("p < q")).join(m, F.expr("mask = (p | q)")).join(base)
    rows = rows.select("p", "q", ((F.col("cost_p") + F.col("cost_q")) / 2).alias("single"), F.col("cost").alias("joint"), "base", "cost_p", "cost_q")
    rows = rows.withColumns({"saving": F.col("single") - F.col("joint"), "redundancy": (F.col("base") - F.col("cost_p")) + (F.col("base") - F.col("cost_q")) - (F.col("base") - F.col("joint"))})
    return rows.select("p", "q", "single", "joint", "saving", "redundancy", F.when(F.col("redundancy") > 0, "redundant").otherwise("complementary").alias("kind"))


def hashed_starts(spark: SparkSession, reps: int, lengths: list[int], days: int, seed: int = 11) -> DataFrame:
    """(length, rep, start, take): for each replicate blocks of days that together take as many days as there are.

    Starts come from the first 32 bits of an MD5, which other engines have too.
    """
    plan = spark.range(reps).withColumnRenamed("id", "rep").withColumn("length", F.explode(F.array(*[F.lit(b) for b in lengths if b <= days] or [F.lit(None).cast("int")]))).where("length is not null")
    plan = plan.withColumn("b", F.explode(F.expr(f"sequence(0, int(ceil({days} / length)) - 1)")))
    start = f"cast(conv(substring(md5(concat_ws('-', {seed}, length, rep, b)), 1, 8), 16, 10) as bigint) % ({days} - length + 1)"
    return plan.selectExpr("length", "rep", f"cast({start} as int) as start", f"least(length, {days} - b * length) as take")


def block_bootstrap(daily: DataFrame, reps: int, blocks: list[int], seed: int = 11) -> DataFrame:
    """Six values per day of each replicate: blocks of days from hashed starts, the same days for all strategies.

    Costs are added up in hundredths, so exactly. A block's sums are those of a window over the days (one
    small row per day), so a replicate joins blocks and not days.
    """
    spark: SparkSession = daily.sparkSession
    cents = F.round(F.col("cost") * 100).cast("bigint")
    wide = daily.groupBy("day").pivot("mask", list(range(8))).agg(F.sum(cents)).withColumn("start", F.row_number().over(Window.orderBy("day")) - 1)
    n = wide.count()
    takes = sorted({t for b in blocks if b <= n for t in (b, n % b or b)})
    masks = [str(m) for m in range(8)]
    ahead = lambda t: Window.orderBy("start").rowsBetween(0, t - 1)
    sums = [wide.select(F.lit(t).alias("take"), "start", *[F.sum(m).over(ahead(t)).alias(m) for m in masks]) for t in takes]
    if not sums:
        sums = [wide.select(F.lit(0).alias("take"), "start", *masks).where("false")]
    table = sums[0]
    for more in sums[1:]:
        table = table.unionByName(more)
    drawn = hashed_starts(spark, reps, blocks, n, seed).join(F.broadcast(table), ["take", "start"])  # a row per day and length
    totals = drawn.groupBy("length", "rep").agg(*[F.sum(m).alias(f"m{m}") for m in masks])
    per = {"all_vs_none": "m0 - m7", "add6_given_12_18": "m6 - m7", **{f"shapley_{h}": _shapley_sum(p) for p, h in ((1, 6), (2, 12), (4, 18))}}
    per["shapley_12_minus_18"] = f"({per['shapley_12']}) - ({per['shapley_18']})"
    six = {k: 6 if "shapley" in k else 1 for k in per}
    return totals.select("length", "rep", *[F.expr(f"({e}) / ({six[k]} * 100.0D * {n})").alias(k) for k, e in per.items()])


def _shapley_sum(player: int) -> str:
    """Six times the Shapley value of a player, from the costs m0 to m7."""
    weights = {0: 2, 1: 1, 2: 2}
    return " + ".join(f"{weights[s.bit_count()]} * (m{s} - m{s | player})" for s in range(8) if not s & player)


def intervals_of(boot: DataFrame) -> DataFrame:
    """Mean, median and 95 % interval of each statistic, and whether that holds 0."""
    names = [c for c in boot.columns if c not in ("length", "rep")]
    long = boot.selectExpr("length", f"stack({len(names)}, {', '.join(f'{chr(39)}{c}{chr(39)}, {c}' for c in names)}) as (statistic, x)")
    out = long.groupBy("length", "statistic").agg(F.avg("x").alias("mean"), *[F.percentile("x", q).alias(n) for n, q in (("median", 0.5), ("low", 0.025), ("high", 0.975))])
    return out.withColumn("crosses_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


def cost_distribution(daily: DataFrame) -> DataFrame:
    """Quartiles and whiskers (the last values within 1.5 times the middle half) of the daily costs."""
    q = daily.groupBy("mask").agg(*[F.percentile("cost", p).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    rows = daily.join(q, "mask")
    inside = (F.col("cost") >= F.expr("q1 - 1.5 * (q3 - q1)")) & (F.col("cost") <= F.expr("q3 + 1.5 * (q3 - q1)"))
    return rows.groupBy("mask", "q1", "q2", "q3").agg(F.min(F.when(inside, F.col("cost"))).alias("low"), F.max(F.when(inside, F.col("cost"))).alias("high"))
