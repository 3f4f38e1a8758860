"""The registered bootstrap has the replicates of the survey."""

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_bootstrap_has_5000_replicates(spark):
    rows = __spark_entry__.queries()["block_bootstrap"](spark, SF).groupBy("length").count().collect()
    assert {r["length"]: r["count"] for r in rows} == {7: 5000, 14: 5000}
