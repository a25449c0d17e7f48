"""The draws of samples and splits, held against rankings of all rows by the same seeded draw."""

import collections
import functools
import hashlib
import operator

from pyspark.sql import functions as F

from winlens.operators import splits as sp


def rows(spark, n=6000):
    return spark.range(n).select("id", F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 3 == 0, "some").otherwise("many").alias("label"), (F.col("id") % 700).alias("g"))


def ranked(df, seed, label, identity):
    out = collections.defaultdict(list)
    for r in df.withColumn("u", sp.draw(seed, label, *identity)).collect():
        out[r[label]].append((r["u"], tuple(r[c] for c in identity)))
    return {k: [i for _, i in sorted(v)] for k, v in out.items()}


def test_capped_sample_takes_the_least_draws(spark):
    df = rows(spark)
    want = ranked(df, 3, "label", ["id"])
    for cap in (1, 40, 500, 10_000):
        for parts in (1, 9):
            got = collections.defaultdict(list)
            for r in sp.capped_sample(df.repartition(parts), "label", ["id"], cap, 3).collect():
                got[r["label"]].append((r["id"],))
                assert r["population"] == len(want[r["label"]])
            assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v[:cap]) for k, v in want.items()}


def test_a_sample_that_falls_short_is_ranked_whole(spark, monkeypatch):
    df = rows(spark, 900)
    want = ranked(df, 3, "label", ["id"])
    real = F.sqrt
    monkeypatch.setattr(F, "sqrt", lambda c: real(c) * -1.0)  # a bound that is far too small
    got = {(r["label"], r["id"]) for r in sp.capped_sample(df, "label", ["id"], 60, 3).collect()}
    assert got == {(k, i) for k, v in want.items() for (i,) in v[:60]}


def test_splits_take_the_least_draws(spark):
    df = rows(spark)
    want = ranked(df, 42, "label", ["id"])
    test = {r["id"] for r in sp.stratified_split(df, "label", ["id"], 0.2, 42).filter("side = 'test'").collect()}
    assert test == {i for v in want.values() for (i,) in v[: round(len(v) * 0.2)]}
    sides = collections.defaultdict(set)
    labels = collections.defaultdict(collections.Counter)
    for r in sp.group_split(df, ["g"], "label", 0.2, 7).collect():
        sides[r["g"]].add(r["side"])
        labels[r["g"]][r["label"]] += 1
    main = {g: min(c, key=lambda k: (-c[k], k)) for g, c in labels.items()}
    groups = ranked(spark.createDataFrame([(g, x) for g, x in main.items()], "g long, _label string"), 7, "_label", ["g"])
    want = {g for v in groups.values() for (g,) in v[: round(len(v) * 0.2)]}
    assert all(len(s) == 1 for s in sides.values()) and {g for g, s in sides.items() if s == {"test"}} == want


def test_fingerprint_of_many_rows(spark):
    """Of more rows than a long can sum up, and by Python's own sum where they are few."""
    few = spark.range(50)
    h = [r["h"] for r in few.select(F.xxhash64("id").alias("h")).collect()]
    want = f"50:{functools.reduce(operator.xor, h)}:{sum(x % (1 << 40) for x in h)}"
    assert tuple(sp.fingerprint(few, ["id"]).first()) == (50, hashlib.sha256(want.encode()).hexdigest())
    n = 18_000_000
    whole, part = (sp.fingerprint(spark.range(k), ["id"]).first() for k in (n, n - 1))
    assert (whole["n"], part["n"]) == (n, n - 1) and whole["digest"] != part["digest"]
