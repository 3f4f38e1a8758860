"""What the operators share: joins that spread frequent keys, samples, components."""

import random

from pyspark.sql import functions as F

from wattloom.llm import common
from wattloom.llm.components import connected_components


def test_join_with_frequent_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 1, 1, *range(30), None]), i) for i in range(600)]
    big = spark.createDataFrame(rows, "k long, i long")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 30, 2)], "k long, v string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, big.join(small, "k", how).select("k", "i", "v").collect()), key=repr)
        for hot in (1, 30, 10**6):
            got = common.join_unique(big, small, "k", how, hot)
            assert sorted(map(tuple, got.select("k", "i", "v").collect()), key=repr) == want


def test_sample_is_bounded_and_of_all_rows(spark):
    rows = spark.range(20000).union(spark.range(1).select(F.explode(F.array_repeat("id", 5000)).alias("id")))
    seen = F.xxhash64(F.lit(1), "id")
    got = [r.id for r in common.sampled(rows, 500, seen).collect()]
    assert 300 < len(got) < 600 and len(set(got)) == len(got)
    assert sorted(got) == sorted(r.id for r in common.sampled(rows.repartition(7), 500, seen).collect())
    assert common.sampled(spark.range(5), 500, seen).count() == 5


def test_components_of_a_star_and_a_chain(spark):
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 180)] + [(500, 499), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{i: 100 for i in range(100, 181)}, 499: 499, 500: 499}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
