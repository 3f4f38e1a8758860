"""The rolling choice on arrays: it equals that of rows and SQL, and makes no row of an empty slot."""

import datetime as dt
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattloom.operators import features as X
from wattloom.operators import releases as R
from wattloom.operators.choices import chooser
from wattloom.plans import registry
from wattloom.plans.checked import intraday
from wattloom.sources import adapters as A

START = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, user_id long, event_type string, value double"


def events(users):
    """users: how many events each has, at any time of 36 days; one in six on the hour's last slot, and some below 0."""
    rng, rows = random.Random(5), []
    for user, n in enumerate(users):
        for _ in range(n):
            minute = rng.randrange(36 * 1440)
            minute = minute - minute % 60 + 55 if rng.random() < 1 / 6 else minute
            rows.append((START + dt.timedelta(minutes=minute), user, "view", round(rng.uniform(-3, 9), 2)))
    ends = [(START, 0, "view", 1.0), (START + dt.timedelta(days=36, minutes=-1), 0, "view", 2.0)]
    return rows + ends


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(events([0, 1, 30, 400, 9000]), SCHEMA).write.parquet(f"{path}/events.parquet")
    return path


def by_rows(held, issues):
    truth = R.truth_at(held)
    return R.choose(R.rolling_choice(R.daily_errors(R.intervals(R.all_candidates(issues, truth, X.shape_residual_median(held, ["series_id"])), truth))))


def shown(found):
    number = lambda x: round(x, 9) + 0.0 if isinstance(x, float) else x
    return sorted(tuple(map(number, r)) for r in found.select("series_id", "issue_at", "day_no", "release_hour", "history", "prior_a", "prior_b", "prior_c", "chosen").collect())


def test_choices_are_those_of_rows(spark, folder):
    """Of series with no, few and many events a day; over more days than the choice looks back."""
    held = A.user_endpoints(spark, folder).localCheckpoint()
    want = shown(by_rows(held, A.issues(spark, folder, held)))
    assert len(want) == 5 * 34 * 4 and {r[-1] for r in want} == set("ABC") and max(r[4] for r in want) == 28
    found = intraday(A.user_measured(spark, folder), buckets=3, days=A.days(spark, folder))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Generate|Join|Expand", plan)  # rows that are measured come in, issues go out
    assert shown(found) == want
    try:
        assert shown(intraday(held, lambda rows: A.issues(spark, folder, rows), buckets=3)) == want
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_steps_beyond_the_calendar_are_left_out(spark, folder):
    """Issues of any hours, all 24 hours ahead, of which the last ones have fewer to be compared with, or none; some lack the issue before."""
    held = A.user_endpoints(spark, folder).where("day_no >= 20").withColumn("day_no", F.col("day_no") - 20).localCheckpoint()
    issues = lambda rows: rows.where("slot % 12 = 0 and day_no % 5 <> 2 and day_no * 144 + slot > 40").selectExpr("series_id", "day_no * 144 + slot as issue_at", "day", "day_no * 12 + int(slot div 12) as day_no", "int(slot % 24 div 12) as release_hour", "transform(sequence(1, 24), h -> (power + h) % 5 - 1) as leads")
    want = shown(by_rows(held, issues(held)))
    assert max(r[1] for r in want) == 16 * 144 - 12 and {r[-1] for r in want} == set("ABC")
    try:
        assert shown(intraday(held, issues, buckets=2)) == want
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_odd_events_as_in_sql(spark, tmp_path):
    """Users without an id, a time or a value; a null time makes its user a series without power there."""
    odd = [(START + dt.timedelta(hours=30), None, "view", 3.0), (None, 2, "view", 4.0), (None, 77, "view", 5.0), (START + dt.timedelta(hours=40), 88, "view", None), (START + dt.timedelta(hours=200), 2, "view", None)]
    spark.createDataFrame(events([0, 20, 300]) + odd, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = ["series_id", "issue_at", "release_hour", "history", "prior_a", "prior_b", "prior_c", "chosen"]
    want = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE['many_series_intraday']})").fetchall())
    got = sorted(map(tuple, registry.QUERIES["many_series_intraday"](spark, str(tmp_path)).select(*columns).collect()))
    assert len(got) == 5 * 34 * 4 and got == want


@pytest.mark.parametrize("size", [1, 7, 100])
def test_series_cut_by_batches(size):
    rng = random.Random(size)
    rows = [(name, at, rng.random() * 9, 12) for name, n in (("a", 1), ("b", 150), ("c", 30), ("d", 1), ("e", 1), ("f", 230)) for at in sorted(rng.sample(range(1, 12 * 144 + 1), n))]
    schema = pa.schema([("series_id", pa.string()), ("_at", pa.int32()), ("power", pa.float64()), ("_days", pa.int32())])
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    found = lambda batches: pa.Table.from_batches(chooser(False)(iter(batches))).to_pylist()
    want = found(table.to_batches())
    assert len(want) == 6 * 10 * 4 and found([pa.RecordBatch.from_pylist([], schema), *table.to_batches(size)]) == want
