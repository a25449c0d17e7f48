"""Training and scoring of window classifiers with Spark ML."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winlens.operators import decisions as de
from winlens.operators import forest
from winlens.operators import metrics as me
from winlens.operators.splits import draw, fingerprint, mark_sides, rotations, time_cut
from winlens.sources.scratch import materialize

FILL = -1.0


def matrix(rows: DataFrame, features: list[str]) -> DataFrame:
    """float32 features with an infinity as empty; what is empty becomes a constant and sets a flag column, as Spark ML takes no empties."""
    v = {c: F.col(f"`{c}`").cast("float") for c in features}
    clean = {c: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for c, x in v.items()}
    return rows.withColumns({f"x_{i}": F.coalesce(clean[c], F.lit(FILL)).cast("double") for i, c in enumerate(features)} | {f"e_{i}": clean[c].isNull().cast("double") for i, c in enumerate(features)})


def dealt(rows: DataFrame) -> DataFrame:
    """Rows in as many even parts as tasks run at once: every level of a forest is a pass over them, which ends with its slowest task,
    and sends a table of all its nodes from each part.
    """
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def train(rows: DataFrame, features: list[str], label: str, trees: int = 100, seed: int = 42, weight: str | None = None, depth: int = 12) -> PipelineModel:
    """Random forest on rows with a label column of class numbers."""
    columns = [f"{k}_{i}" for k in "xe" for i in range(len(features))]
    rows = matrix(dealt(rows.select(*dict.fromkeys([*features, label, *([weight] if weight else [])]))), features)
    return PipelineModel([VectorAssembler(inputCols=columns, outputCol="features"), forest.fit(rows, columns, label, trees, seed, weight, depth)])


def predict(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds p (array, in class order) and predicted (the first class with the largest probability)."""
    out = model.transform(matrix(rows, features)).withColumn("p", vector_to_array("probability"))
    return out.select(*rows.columns, "p", (F.array_position("p", F.array_max("p")) - 1).cast("long").alias("predicted"))


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """(feature, importance, rank): impurity importances; a feature's flag counts with it. One row per feature."""
    v = model.stages[-1].featureImportances.toArray()
    n = len(features)
    rows = sorted(((c, float(v[i] + v[n + i])) for i, c in enumerate(features)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(c, x, r + 1) for r, (c, x) in enumerate(rows)], "feature string, importance double, rank int")


def permutation(model: PipelineModel, rows: DataFrame, features: list[str], label: str, identity: str, repeats: int = 10, sample: int = 3000, seed: int = 1) -> DataFrame:
    """(class, feature, drop, spread): loss of recall of each class, and of macro-F1 (class null), when a feature's values are shuffled among
    at most `sample` rows, over repeats. A class that is not among them has no rows.

    All (feature, repeat) pairs are scored in one job; the shuffled value comes from the row at a hashed rank.
    """
    few = rows.orderBy(draw(seed, identity), identity).limit(sample)
    few = materialize(few.withColumn("_i", F.row_number().over(Window.orderBy(identity))), "permuted")  # at most `sample` rows
    jobs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(r).alias("r")) for f in features for r in range(repeats))))
    order = Window.partitionBy("job").orderBy(F.xxhash64(F.lit(seed), "job", "_i"))
    each = few.select("*", jobs.alias("job")).withColumn("_j", F.row_number().over(order))
    values = few.select(F.col("_i").alias("_j"), *(F.col(f).alias(f"_v_{f}") for f in features))
    mixed = each.join(F.broadcast(values), "_j")
    mixed = mixed.withColumns({f: F.when(F.col("job.feature") == f, F.col(f"_v_{f}")).otherwise(F.col(f)) for f in features})
    whole = few.select("*", F.struct(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("r")).alias("job"))
    both = mixed.select(identity, label, "job", *features).unionByName(whole.select(identity, label, "job", *features))
    counted = predict(model, both, features).groupBy("job", F.col(label).cast("long").alias("class"), "predicted").agg(F.count("*").alias("n"))
    counted = materialize(counted, "permuted-counts")  # (features * repeats + 1) * classes^2 rows
    right = F.sum(F.when(F.col("class") == F.col("predicted"), F.col("n")).otherwise(0))
    truth = counted.groupBy("job", "class").agg(F.sum("n").alias("n_true"), right.alias("hits"))
    said = counted.groupBy("job", F.col("predicted").alias("class")).agg(F.sum("n").alias("n_said"))
    recall = truth.select("job", "class", (F.col("hits") / F.col("n_true")).alias("v"))
    f1 = truth.join(said, ["job", "class"], "left").withColumn("v", 2 * F.col("hits") / (F.col("n_true") + F.coalesce("n_said", F.lit(0))))
    measured = materialize(recall.unionByName(f1.groupBy("job").agg(F.avg("v").alias("v")).select("job", F.lit(None).cast("long").alias("class"), "v")), "permuted-measures")
    base = measured.filter("job.feature is null").select(F.col("class").alias("of"), F.col("v").alias("base"))
    loss = measured.filter("job.feature is not null").join(F.broadcast(base), F.col("class").eqNullSafe(F.col("of"))).withColumn("loss", F.col("base") - F.col("v"))
    return loss.groupBy("class", "job.feature").agg(F.avg("loss").alias("drop"), F.stddev_samp("loss").alias("spread"))


def grid(rows: DataFrame, configs: list[dict], features: dict[str, list[str]], label: str, side: Callable[[DataFrame, dict], DataFrame], keep: list[str], trees: int = 100) -> DataFrame:
    """predictions (config, seed, keep.., predicted) of every configuration on its test side; measured once for all afterwards."""
    out = None
    for c in configs:  # a job for each line of the configuration table
        p = round_predictions(rows, c, features, label, side, keep, trees)
        out = p if out is None else out.unionByName(p)
    return out


def round_predictions(rows: DataFrame, config: dict, features: dict[str, list[str]], label: str, side: Callable[[DataFrame, dict], DataFrame], keep: list[str], trees: int) -> DataFrame:
    """(config, seed, keep.., predicted) on the test side of one configuration."""
    marked, columns = side(rows, config), features[config["features"]]
    model = train(marked.filter("side = 'train'"), columns, label, trees, config["seed"], config.get("weight"))
    return predict(model, marked.filter("side = 'test'"), columns).select(F.lit(config["name"]).alias("config"), F.lit(config["seed"]).alias("seed"), *keep, "predicted")


def missing(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Configurations without predictions yet."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def round_key(config: dict, columns: list[str], trees: int, data: str, version: str) -> str:
    """Names a training by everything that its predictions depend on."""
    return hashlib.sha256(json.dumps([config, columns, trees, data, version], sort_keys=True).encode()).hexdigest()


def rounds(rows: DataFrame, configs: list[dict], features: dict[str, list[str]], label: str, side: Callable[[DataFrame, dict], DataFrame], keep: list[str], store: str, trees: int = 100, version: str = "1", at_end: Callable[[dict], None] | None = None) -> DataFrame:
    """The predictions of `grid`, from a store that is filled by what it lacks.

    The store has predictions/key=..., and done: a row for each key whose predictions are complete, added after they are. The key covers
    configuration, features, trees, the set of rows and version (of the code that makes sides and trains), so whatever changes is trained
    again, and a run that was broken off goes on with the first configuration that it had not ended. at_end is told each one that is.
    """
    spark = rows.sparkSession
    data = fingerprint(rows, rows.columns).first()["digest"]
    by_key = {round_key(c, features[c["features"]], trees, data, version): c for c in configs}
    wanted = spark.createDataFrame(list(enumerate(by_key)), "place int, key string")
    schema = "key string, config string, n_rows long"
    try:
        done = spark.read.schema(schema).parquet(f"{store}/done")
    except AnalysisException:  # nothing was ever done
        done = spark.createDataFrame([], schema)
    for r in missing(wanted, done, ["key"]).orderBy("place").collect():
        config = by_key[r["key"]]
        path = f"{store}/predictions/key={r['key']}"
        round_predictions(rows, config, features, label, side, keep, trees).write.mode("overwrite").parquet(path)
        n = spark.read.parquet(path).count()
        spark.createDataFrame([(r["key"], json.dumps(config, sort_keys=True), n)], schema).coalesce(1).write.mode("append").parquet(f"{store}/done")
        if at_end:
            at_end(config)
    return spark.read.parquet(*(f"{store}/predictions/key={k}" for k in by_key))


def round_side(rows: DataFrame, config: dict) -> DataFrame:
    """rows (capture, win, label, order, background) with the sides of a round; config has kind: cut, rotation (and rotation), held out (and capture), background.

    Cut: the last part of each capture is test. Rotation: the captures of a label take turns in being test as a whole. Held out: one capture
    is test. Background: trained as the cut, and tested on windows of attack captures without an attacker. These are in no other round.
    """
    own = rows.filter("not background")
    if config["kind"] == "cut":
        return mark_sides(time_cut(own, 0.3))
    if config["kind"] == "rotation":
        held = rotations(own.select("capture", "label", "order").distinct(), config["rotation"] + 1).filter(F.col("rotation") == config["rotation"]).select("capture", "held_out")
        return own.join(held, "capture").withColumn("side", F.when(F.col("held_out"), "test").otherwise("train")).drop("held_out")
    if config["kind"] == "held out":
        return own.withColumn("side", F.when(F.col("capture") == config["capture"], "test").otherwise("train"))
    train_part = mark_sides(time_cut(own, 0.3)).filter("side = 'train'")
    return train_part.unionByName(rows.filter("background").withColumns({"cut": F.lit(None).cast("long"), "side": F.lit("test")}))


def operating_point(rows: DataFrame, features: list[str], label: str, classes: list, benign: int, trees: int = 100, seed: int = 42, target: float = 0.01) -> DataFrame:
    """(rule, t, and the metrics of argmax and of the chosen rule on the test part).

    rows carry part: train, validation or test. The rule is chosen with a model that has not seen the validation part.
    """
    reduced = train(rows.filter("part = 'train'"), features, label, trees, seed)
    p_attack, argmax_attack = de.for_choice(F.col("p"), classes, benign)
    val = predict(reduced, rows.filter("part = 'validation'"), features).select(p_attack.alias("a"), argmax_attack.alias("b"), (F.col(label) == benign).alias("c"))
    chosen = de.choose_rule(val, "a", "b", "c", target)
    full = train(rows.filter("part in ('train', 'validation')"), features, label, trees, seed)
    test = predict(full, rows.filter("part = 'test'"), features).join(F.broadcast(chosen.select("t")))
    by_rule = F.when(F.col("t").isNull(), F.col("predicted")).otherwise(de.by_threshold(F.col("p"), classes, benign, F.col("t")).cast("long"))
    m = lambda c: me.overall_metrics(me.confusion(me.contingency(test.withColumn("q", c), label, "q")), benign)
    a, b = m(F.col("predicted")), m(by_rule)
    both = a.select(F.lit("argmax").alias("rule"), "*").unionByName(b.select(F.lit("chosen").alias("rule"), "*"))
    return both.join(F.broadcast(chosen.select(F.col("rule").alias("chosen_rule"), "t")), how="left")


def with_fixed(rows: DataFrame, column: str, values: list[float]) -> DataFrame:
    """Every row once for each value of a column, for scoring with it held fixed."""
    return rows.withColumn("fixed", F.explode(F.array(*map(F.lit, values)))).withColumn(column, F.col("fixed").cast("double"))


def class_number(label: Column, classes: list[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, classes)), label) - 1).cast("double")
