"""Decision rules over class probabilities, threshold curves, and the choice of a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK = 1e-12
GRID = tuple(i / 100 for i in range(1, 101))


def argmax(p: Column, classes: list) -> Column:
    """The first class with the largest probability."""
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(p, F.array_max(p)).cast("int"))


def by_threshold(p: Column, classes: list, benign, threshold: float | Column) -> Column:
    """Attack iff 1 - P(benign) reaches the threshold, then the best attack class; else benign."""
    at = classes.index(benign)
    attacks = [c for c in classes if c != benign]
    p_attacks = F.array(*(F.get(p, i) for i in range(len(classes)) if i != at))
    return F.when(1 - F.get(p, at) >= threshold - SLACK, argmax(p_attacks, attacks)).otherwise(F.lit(benign))


def by_category(rows: DataFrame, thresholds: DataFrame, p: str, classes: list, benign) -> DataFrame:
    """predicted: the argmax class where its own threshold (category, t; few rows) is reached, else benign; classes without one need none."""
    best = rows.withColumn("category", argmax(F.col(p), classes)).join(F.broadcast(thresholds), "category", "left")
    sure = F.coalesce(F.array_max(p) >= F.col("t") - SLACK, F.lit(True))
    return best.withColumn("predicted", F.when(sure, F.col("category")).otherwise(F.lit(benign))).drop("category", "t")


def for_choice(p: Column, classes: list, benign) -> tuple[Column, Column]:
    """(1 - P(benign), is the argmax an attack)."""
    return 1 - F.get(p, classes.index(benign)), argmax(p, classes) != F.lit(benign)


def threshold_curve(rows: DataFrame, p_attack: str, groups: dict[str, Column]) -> DataFrame:
    """(t, one count for each group): rows with p_attack >= t, for t in 0.01 .. 1.00.

    Rows are binned by the largest grid step they reach, so what grows is pre-aggregated to 101 bins before anything else.
    """
    step = F.least(F.lit(100), F.floor((F.col(p_attack) + SLACK) * 100 + 1e-9)).cast("int")
    bins = rows.groupBy(step.alias("step")).agg(*(F.count_if(c).alias(k) for k, c in groups.items()))
    grid = F.broadcast(rows.sparkSession.range(1, 101).select(F.col("id").cast("int").alias("g")))
    out = bins.join(grid, F.col("step") >= F.col("g")).groupBy("g").agg(*(F.sum(k).alias(k) for k in groups))
    full = grid.join(out, "g", "left").select((F.col("g") / 100).alias("t"), *(F.coalesce(k, F.lit(0)).alias(k) for k in groups))
    return full


def smallest_threshold(curve: DataFrame, total: int | Column, target: float) -> DataFrame:
    """The smallest t that leaves at most target of the benign rows as attack."""
    return curve.filter(F.col("benign") <= target * total).agg(F.min("t").alias("t"))


def choose_rule(rows: DataFrame, p_attack: str, is_argmax_attack: str, is_benign: str, target: float = 0.01) -> DataFrame:
    """One row (rule, t, benign_as_attack, recognised): of argmax and the thresholds with at most target of the benign rows as
    attack, the one with most attack recognised; ties: fewer benign, argmax, the lower t."""
    benign, attack = F.col(is_benign), ~F.col(is_benign)
    curve = threshold_curve(rows, p_attack, {"benign": benign, "attack": attack}).select(F.lit("threshold").alias("rule"), "t", "benign", "attack")
    one = rows.agg(F.count_if(benign & F.col(is_argmax_attack)).alias("benign"), F.count_if(attack & F.col(is_argmax_attack)).alias("attack"), F.count_if(benign).alias("n_benign"))
    all_ = curve.unionByName(one.select(F.lit("argmax").alias("rule"), F.lit(None).cast("double").alias("t"), "benign", "attack"))
    fit = all_.join(F.broadcast(one.select("n_benign"))).filter(F.col("benign") <= target * F.col("n_benign"))
    order = F.struct((-F.col("attack")).alias("a"), F.col("benign").alias("b"), (F.col("rule") != "argmax").alias("c"), F.coalesce("t", F.lit(0.0)).alias("d"))
    return fit.agg(F.min_by(F.struct("rule", "t", "benign", "attack"), order).alias("x")).select("x.rule", "x.t", F.col("x.benign").alias("benign_as_attack"), F.col("x.attack").alias("recognised"))


def confidence_counts(rows: DataFrame, confidence: str, is_true: str, thresholds: list[float], extra: Column | None = None) -> DataFrame:
    """(t, false_below, n_false, true_below, n_true) for triage confidence thresholds."""
    grid = F.explode(F.array(*map(F.lit, thresholds)))
    low = F.col(confidence) < F.col("t")
    low = low if extra is None else low & extra
    f, t = ~F.col(is_true), F.col(is_true)
    return rows.withColumn("t", grid).groupBy("t").agg(F.count_if(f & low).alias("false_below"), F.count_if(f).alias("n_false"), F.count_if(t & low).alias("true_below"), F.count_if(t).alias("n_true"))


def choose_confidence(counts: DataFrame) -> DataFrame:
    """The smallest t that catches most false rows without marking any true one; null without a false row or a fitting t."""
    fit = counts.filter("true_below = 0 and n_false > 0")
    return fit.agg(F.min_by("t", F.struct((-F.col("false_below")).alias("a"), "t")).alias("t"))
