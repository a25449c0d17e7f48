"""Queries that train and score classifiers. Models have no SQL; tests check invariants and held-out quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from winlens.operators import metrics as me
from winlens.operators import ml
from winlens.operators import splits as sp
from winlens.operators import windows as wi
from winlens.plans import adapters as ad
from winlens.plans.adapters import FRAMES_CTE
from winlens.sources.scratch import materialize, shared_dir

QUERIES: dict = {}
ORACLES: dict = {}
FEATURES = ["AVG", "Std", "IAT", "Time_To_Live", "syn_flag_number", "ack_flag_number", "ICMP", "TCP", "UDP", "Variance"]
CLASSES = ["Benign", "Flood", "Scan"]
TREES = 100


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def labelled(spark, d):
    """Windows with a label that their features explain."""
    w = ad.windows(spark, d, 10).withColumn("kind", F.when(F.col("syn_flag_number") > 0.2, "Flood").when(F.col("ICMP") > 0.4, "Scan").otherwise("Benign"))
    w = w.withColumn("y", ml.class_number(F.col("kind"), CLASSES))
    return materialize(w.select("capture", "win", "kind", "y", *FEATURES), "labelled")


def sides(spark, d):
    return sp.mark_sides(sp.time_cut(labelled(spark, d), 0.3))


@query("m1_m2_predictions")
def m1(spark, d):
    rows = sides(spark, d)
    model = ml.train(rows.filter("side = 'train'"), FEATURES, "y", TREES)
    return ml.predict(model, rows.filter("side = 'test'"), FEATURES).select("capture", "win", F.col("y").cast("long").alias("truth"), "predicted")


@query("m3_importances")
def m3(spark, d):
    return ml.importances(ml.train(sides(spark, d).filter("side = 'train'"), FEATURES, "y", TREES), FEATURES, spark)


@query("m4_permutation")
def m4(spark, d):
    rows = sides(spark, d).withColumn("id", F.col("capture") * 100000 + F.col("win"))
    model = ml.train(rows.filter("side = 'train'"), FEATURES, "y", TREES)
    return ml.permutation(model, rows.filter("side = 'test'"), FEATURES, "y", "id")


@query("m8_m9_grid")
def m8(spark, d):
    rows = labelled(spark, d)
    configs = [{"name": n, "features": f, "seed": s} for n, f in (("all", "all"), ("few", "few")) for s in (1, 2)]
    side = lambda df, c: sp.mark_sides(sp.time_cut(df, 0.3))
    p = ml.grid(rows, configs, {"all": FEATURES, "few": FEATURES[:5]}, "y", side, ["capture", "win", "y"], TREES)
    return me.overall_metrics(me.confusion(me.contingency(p.withColumn("t", F.col("y").cast("long")), "t", "predicted", ["config", "seed"]), by=["config", "seed"]), 0, ["config", "seed"])


def round_rows(spark, d):
    """labelled with what rounds need: the captures' label and order, and which windows are background."""
    rows = labelled(spark, d).withColumn("label", F.expr(ad.CATEGORY)).withColumn("order", F.col("capture"))
    return rows.withColumn("background", (F.col("label") != "Benign") & (F.col("y") == 0) & (F.col("win") % 2 == 0))


def round_configs(seeds=(1, 2)):
    kinds = [{"name": "cut", "kind": "cut"}, *({"name": f"rotation {r}", "kind": "rotation", "rotation": r} for r in range(2)), {"name": "held out 1", "kind": "held out", "capture": 1}, {"name": "background", "kind": "background"}]
    return [{**k, "features": "all", "seed": s} for s in seeds for k in kinds]


@query("m9_rounds")
def m9(spark, d):
    """Rounds of all kinds, stopped after some and resumed: metrics of each, and how often it was trained by either run."""
    rows, configs, trained = materialize(round_rows(spark, d), "round-rows"), round_configs((1,)), {}
    store = f"{shared_dir(spark)}/winlens-rounds-{uuid.uuid4().hex}"
    for part in (configs[:2], configs):
        p = ml.rounds(rows, part, {"all": FEATURES}, "y", ml.round_side, ["capture", "win", "y"], store, TREES, at_end=lambda c: trained.update({c["name"]: trained.get(c["name"], 0) + 1}))
    m = me.overall_metrics(me.confusion(me.contingency(p.withColumn("t", F.col("y").cast("long")), "t", "predicted", ["config", "seed"]), by=["config", "seed"]), 0, ["config", "seed"])
    return m.join(F.broadcast(spark.createDataFrame(list(trained.items()), "config string, n_trained int")), "config")


@query("m10_operating_point")
def m10(spark, d):
    cut = sp.validation_start(sp.time_cut(labelled(spark, d), 0.3))
    part = F.when(F.col("win") >= F.col("cut"), "test").when(F.col("win") >= F.col("validation_from"), "validation").otherwise("train")
    return ml.operating_point(cut.withColumn("part", part), FEATURES, "y", [0, 1, 2], 0, TREES, target=0.05)


@query("m12_size_transfer")
def m12(spark, d):
    model = ml.train(sides(spark, d).filter("side = 'train'"), FEATURES, "y", TREES)
    both = None
    for size in (10, 100):
        w = ad.windows(spark, d, size).withColumn("truth", F.when(F.col("syn_flag_number") > 0.2, 1).when(F.col("ICMP") > 0.4, 2).otherwise(0)).select("capture", "win", "truth", *FEATURES)
        p = me.predicted_share(ml.predict(model, w, FEATURES), "capture", F.col("truth")).withColumn("window_size", F.lit(size))
        both = p if both is None else both.unionByName(p)
    return both


@query("m13_fixed_values")
def m13(spark, d):
    rows = sides(spark, d)
    model = ml.train(rows.filter("side = 'train'"), FEATURES, "y", TREES)
    fixed = ml.with_fixed(rows.filter("side = 'test'"), "Time_To_Live", [64.0, 70.0, 80.0, 100.0])
    return ml.predict(model, fixed, FEATURES).groupBy("fixed").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") != 0).alias("n_attack"))


@query("s15_training_layout", f"""WITH {FRAMES_CTE}, s AS (SELECT unnest([10, 100]) AS size_), w AS (SELECT capture, size_, frame_no // size_ AS win, count(*) AS n, bool_or(attacker) AS has FROM kept, s GROUP BY ALL)
SELECT CAST(size_ AS BIGINT) AS window_size, CASE WHEN capture % 8 = 0 OR has THEN 'kept' ELSE 'background' END AS side, {ad.CATEGORY} AS label, count(*) AS n FROM w WHERE n = size_ GROUP BY ALL""")
def s15(spark, d):
    from winlens.operators.labels import window_side

    both = ad.kept(spark, d).select("capture", "frame_no", "attacker", F.explode(F.array(F.lit(10), F.lit(100))).alias("window_size"))
    w = both.groupBy("capture", "window_size", wi.window_no(F.col("window_size")).alias("win")).agg(F.count("*").alias("Number"), F.bool_or("attacker").alias("has"))
    w = w.filter(F.col("Number") == F.col("window_size"))
    return w.groupBy(F.col("window_size").cast("long").alias("window_size"), window_side(F.col("capture") % 8 == 0, F.col("has")).alias("side"), F.expr(ad.CATEGORY).alias("label")).agg(F.count("*").alias("n"))
