"""Forests grown over blocks of rows, held against Spark ML's."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from winlens.operators import forest, ml


def rows(spark, n=4000):
    """Labels by two of three features, with errors; features of few values, so that bins are the same everywhere."""
    h = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m))
    out = spark.range(n).select("id", *(h(i, 29).cast("double").alias(f"f{i}") for i in range(3)), h(9, 10).alias("e"))
    y = F.when(F.col("e") == 0, F.col("f2") % 3).when(F.col("f0") + F.col("f1") > 30, 1).when(F.col("f0") > 20, 2).otherwise(0)
    return out.withColumn("y", y.cast("double"))


def answers(model, df, features):
    return {r["id"]: (r["predicted"], [round(x, 9) for x in r["p"]]) for r in ml.predict(model, df, features).collect()}


def test_one_tree_is_that_of_spark_ml(spark):
    df, features = rows(spark), ["f0", "f1", "f2"]
    for weight in (None, "w"):
        df = df.withColumn("w", F.col("id") % 4 / 2)
        columns = [f"{k}_{i}" for k in "xe" for i in range(3)]
        vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(ml.matrix(df, features))
        theirs = DecisionTreeClassifier(labelCol="y", maxDepth=7, **({"weightCol": weight} if weight else {})).fit(vectors)
        ours = forest.fit(ml.matrix(df, features), columns, "y", 1, 3, weight, 7, bagged=False)
        assert ours.trees[0].numNodes == theirs.numNodes > 40
        assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray())
        got, want = ({r["id"]: r["probability"] for r in m.transform(vectors).select("id", "probability").collect()} for m in (ours, theirs))
        assert all(np.allclose(got[i], want[i]) for i in want)


def test_forest_learns_as_spark_ml_does(spark):
    df, features = rows(spark, 6000), ["f0", "f1", "f2"]
    train, test = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    model = ml.train(train, features, "y", 20, 5, depth=6)
    vectors = [VectorAssembler(inputCols=[f"{k}_{i}" for k in "xe" for i in range(3)], outputCol="features").transform(ml.matrix(x, features)) for x in (train, test)]
    theirs = RandomForestClassifier(labelCol="y", numTrees=20, seed=5, maxDepth=6).fit(vectors[0])
    share = ml.predict(model, test, features).agg(F.avg((F.col("predicted") == F.col("y")).cast("int"))).first()[0]
    other = theirs.transform(vectors[1]).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
    assert abs(share - other) < 0.03 and share > 0.85
    trees = model.stages[-1].trees
    assert len(trees) == 20 and max(t.depth for t in trees) <= 6 and len({t.toDebugString.split("\n", 1)[1] for t in trees}) > 10
    assert answers(model, test, features) == answers(ml.train(train, features, "y", 20, 5, depth=6), test, features)


def test_trees_in_several_passes_are_the_same(spark, monkeypatch):
    df, features = rows(spark), ["f0", "f1", "f2"]
    whole = answers(ml.train(df, features, "y", 6, 1, depth=5), df, features)
    passes, real = [], forest.histograms
    monkeypatch.setattr(forest, "histograms", lambda table, levels, group, *a: passes.append(group) or real(table, levels, group, *a))
    monkeypatch.setattr(forest, "CELLS", 300)
    assert answers(ml.train(df, features, "y", 6, 1, depth=5), df, features) == whole
    assert len(passes) > 20 and max(map(len, passes)) < 6


def test_settled_rows_go_on_as_from_the_root(spark, monkeypatch):
    df, features = rows(spark, 40_000), ["f0", "f1", "f2"]
    for weight in (None, "w"):
        df = df.withColumn("w", F.col("id") % 4 / 2)
        whole = answers(ml.train(df, features, "y", 5, 1, weight, 6), df, features)
        written, real = [], forest.settled
        with monkeypatch.context() as m:
            m.setattr(forest, "settled", lambda table, levels, *a: written.append(len(levels)) or real(table, levels, *a))
            m.setattr(forest, "SETTLE_ROWS", 0)
            m.setattr(forest, "SETTLE_SHARE", 0.97)
            assert answers(ml.train(df, features, "y", 5, 1, weight, 6), df, features) == whole
        assert len(written) > 1 and max(written) <= 6


def test_rows_in_leaves_are_not_visited_again(spark, monkeypatch):
    """A pass over the rows only while a node is left to split, and no column that can't split."""
    passes, real = [], forest.histograms
    monkeypatch.setattr(forest, "histograms", lambda table, levels, *a: passes.append(len(levels[-1].tree)) or real(table, levels, *a))
    df = spark.range(1000).select("id", (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 > 6).cast("double").alias("y"))
    model = ml.train(df, ["a"], "y", 1)
    assert passes == [1] and model.stages[-1].totalNumNodes == 3
    assert {(k % 10 > 6, v[0]) for k, v in answers(model, df, ["a"]).items()} == {(False, 0), (True, 1)}
    same = ml.train(df.withColumn("a", F.lit(2.0)), ["a"], "y", 3)  # nothing to split by
    assert passes == [1, 3] and same.stages[-1].totalNumNodes == 3 and all(abs(p[1][0] - 0.7) < 0.1 for p in answers(same, df, ["a"]).values())


def test_bags_are_poisson_draws():
    times = np.zeros(6)
    for block in range(40):
        at, n = forest.bag(7, 3, block, 5000, True)
        times[1:] += np.bincount(n.astype(int), minlength=6)[1:6]
        assert len(np.unique(at)) == len(at)
    share = times / (40 * 5000)
    assert np.allclose(share[1:4], [0.3679, 0.1839, 0.0613], atol=0.005)
    assert not np.array_equal(forest.bag(7, 3, 0, 5000, True)[0], forest.bag(7, 4, 0, 5000, True)[0])


def test_cuts_of_features_with_many_values():
    rng = np.random.default_rng(1)
    v = rng.exponential(size=200_000)
    parts = [forest.condensed(x, np.ones(len(x)), forest.SENT_POINTS) for x in np.split(v, 8)]
    cuts = forest.cut_points(*forest.condensed(*(np.concatenate(p) for p in zip(*parts)), forest.POINTS))
    assert len(cuts) == 31 and np.allclose(np.searchsorted(np.sort(v), cuts) / len(v), np.arange(1, 32) / 32, atol=0.002)
    assert forest.cut_points(np.array([1.0, 2.0, 5.0]), np.ones(3)).tolist() == [1.5, 3.5]
    heavy = forest.cut_points(np.arange(100.0), np.r_[900.0, np.ones(99)])  # one value of nine tenths: the others still have thresholds
    assert heavy.tolist()[:3] == [0.5, 1.5, 2.5] and len(heavy) == 31


def test_what_can_not_be_learned_is_an_error(spark):
    df = rows(spark, 50)
    for bad in (df.filter("id < 0"), df.withColumn("y", F.lit(-1.0)), df.withColumn("y", F.lit(0.5)), df.withColumn("y", F.lit(None).cast("double"))):
        with pytest.raises(Exception, match="forest"):
            ml.train(bad, ["f0"], "y", 2)
