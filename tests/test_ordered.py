import random

import pytest
from pyspark.sql import functions as F

from winlens.operators.ordered import running


@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_in_ranges(spark, by):
    """A key with most rows, a null key, null and repeated values, over more ranges than keys."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, rng.randrange(50)]), i, rng.choice([None, rng.randrange(-5, 9)])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int")
    got = running(df.repartition(5), by, ["o", "i"], {"total_v": "v"}, total="n").collect()
    seen = {}
    for k, o, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        key = k if by else 0
        n, s = seen.setdefault(key, [0, 0])
        seen[key] = [n + 1, s + (v or 0)]
        assert any((r["k"], r["o"], r["i"], r["v"], r["row"], r["total_v"]) == (k, o, i, v, n + 1, s + (v or 0)) for r in got if r["i"] == i)
    assert len(got) == len(rows) and all(r["n"] == seen[r["k"] if by else 0][0] for r in got)


def test_a_key_is_spread(spark):
    """One key's rows are numbered by several tasks."""
    df = running(spark.range(20_000).withColumn("k", F.lit(1)), ["k"], ["id"])
    assert df.agg(F.min(F.col("row") - F.col("id")), F.max(F.col("row") - F.col("id"))).first() == (1, 1)
    ranges = [p for p in df._jdf.queryExecution().analyzed().toString().split() if "_range" in p]
    assert ranges


def test_running_over_nothing(spark):
    assert running(spark.range(0), [], ["id"], {"s": "id"}, total="n").count() == 0
