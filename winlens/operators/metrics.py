"""Contingency tables, confusion matrices, metrics, intervals, resampling and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winlens.sources.scratch import materialize

Z = 1.959963984540054
#: Draws of blocks that a task makes.
TASK_DRAWS = 1_000_000


def contingency(rows: DataFrame, truth: str = "truth", predicted: str = "predicted", by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion(table: DataFrame, to_class: Column | None = None, population: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """(truth, predicted, n) by class; with population(truth, total) the rows of each label are scaled up to it first."""
    n = F.col("n").cast("double")
    if population is not None:
        own = table.groupBy(*by, "truth").agg(F.sum("n").alias("_own"))
        table = table.join(own, [*by, "truth"]).join(F.broadcast(population), "truth")
        n = n * F.col("total") / F.col("_own")
    table = table.withColumn("_n", n)
    return table.groupBy(*by, (F.col("truth") if to_class is None else to_class).alias("truth"), "predicted").agg(F.sum("_n").alias("n"))


def class_metrics(matrix: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, class, support, predicted_n, hit, precision, recall, f1, fpr).

    A class without rows has no recall and f1; one with rows that is never predicted has precision and f1 of 0.
    """
    each = F.explode(F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0.0).alias("predicted_n"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0.0).alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0.0).alias("support"), F.col("n").alias("predicted_n"), F.lit(0.0).alias("hit"))))
    m = matrix.select(*by, each.alias("x")).groupBy(*by, "x.class").agg(*(F.sum(f"x.{c}").alias(c) for c in ("support", "predicted_n", "hit")))
    total = F.sum("support").over(Window.partitionBy(*by))
    has = F.col("support") > 0
    precision = F.when(F.col("predicted_n") > 0, F.col("hit") / F.col("predicted_n")).when(has, 0.0)
    recall = F.when(has, F.col("hit") / F.col("support"))
    m = m.withColumns({"precision": precision, "recall": recall, "fpr": F.try_divide(F.col("predicted_n") - F.col("hit"), total - F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return m.withColumn("f1", F.when(has, F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)))


def overall_metrics(matrix: DataFrame, benign, by: list[str] = ()) -> DataFrame:
    """(by, accuracy, macro_f1, weighted_f1, benign_as_attack, attack_as_benign)."""
    m = class_metrics(matrix, by)
    own = F.col("class") == F.lit(benign)
    pick = lambda c: F.max(F.when(own, c))
    total = F.sum("support")
    return m.groupBy(*by).agg(
        (F.sum("hit") / total).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.coalesce("f1", F.lit(0.0)) * F.col("support")) / total).alias("weighted_f1"),
        (1 - pick(F.col("recall"))).alias("benign_as_attack"), F.try_divide(pick(F.col("predicted_n") - F.col("hit")), total - pick(F.col("support"))).alias("attack_as_benign"))


def panel_metrics(matrix: DataFrame) -> DataFrame:
    """Class metrics as a display panel shows them: a class without rows counts as 0."""
    return class_metrics(matrix).select("class", "support", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")))


def predicted_share(rows: DataFrame, by: str, expected: Column, predicted: str = "predicted") -> DataFrame:
    """Rows and the share in the expected class, per capture."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(predicted) == expected).alias("expected_n"), (F.count_if(F.col(predicted) == expected) / F.count("*")).alias("share"))


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null without rows."""
    p = F.try_divide(hits.cast("double"), n)
    d = 1 + z * z / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), (mid - half) / d)), F.when(ok, F.least(F.lit(1.0), (mid + half) / d))


def block_sums(rows: DataFrame, values: dict[str, Column], block: int = 100, capture: str = "capture", order: str = "win", by: list[str] = ()) -> DataFrame:
    """(by, capture, block, k, m, sums...): sums over blocks of neighbouring windows; k numbers a capture's m blocks from 0."""
    sums = rows.groupBy(*by, capture, F.floor(F.col(order) / block).alias("block")).agg(F.count("*").cast("double").alias("_n"), *(F.sum(v.cast("double")).alias(c) for c, v in values.items()))
    w = Window.partitionBy(*by, capture)
    return sums.withColumns({"k": F.row_number().over(w.orderBy("block")) - 1, "m": F.count("*").over(w)})


def resample(blocks: DataFrame, columns: list[str], replicates: int, seed: int, capture: str = "capture", by: list[str] = ()) -> DataFrame:
    """(by, r, sums...): in each replicate every capture draws its number of blocks with replacement, by a seeded hash.

    blocks should be stored, as they are read three times. Their draws are dealt by block, so that a capture's are made in many tasks.
    """
    n_tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, blocks.count() * replicates // TASK_DRAWS + 1)
    draw = F.pmod(F.xxhash64(F.lit(seed), "r", capture, "k"), F.col("m")).cast("int")
    dealt = blocks.select(*by, capture, "k", "m").repartition(n_tasks, *by, capture, "k")
    picks = dealt.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")).select(*by, capture, "r", draw.alias("k"))
    return picks.join(blocks, [*by, capture, "k"]).groupBy(*by, "r").agg(*(F.sum(c).alias(c) for c in columns))


def block_interval(rows: DataFrame, hit: Column, replicates: int = 200, seed: int = 1, block: int = 100, by: list[str] = (), order: str = "win") -> DataFrame:
    """(by, low, high): 95 % interval of a rate by resampling blocks within captures."""
    b = materialize(block_sums(rows, {"hits": hit}, block, by=list(by), order=order), "block-sums")
    rates = resample(b, ["hits", "_n"], replicates, seed, by=list(by)).withColumn("rate", F.col("hits") / F.col("_n"))
    return rates.groupBy(*by).agg(F.percentile("rate", 0.025).alias("low"), F.percentile("rate", 0.975).alias("high"))


def paired_difference(rows: DataFrame, a: Column, b: Column, replicates: int = 200, seed: int = 1, block: int = 100, by: list[str] = (), seed_col: str = "seed", order: str = "win") -> DataFrame:
    """(by, difference, low, high, beyond_zero) of the rate of b minus that of a, paired by blocks and averaged over seeds."""
    keys = [*by, seed_col]
    sums = materialize(block_sums(rows, {"sa": a, "sb": b}, block, by=keys, order=order), "block-sums")
    diff = (F.col("sb") - F.col("sa")) / F.col("_n")
    point = sums.groupBy(*keys).agg(F.sum("sa").alias("sa"), F.sum("sb").alias("sb"), F.sum("_n").alias("_n")).withColumn("d", diff)
    spread = resample(sums, ["sa", "sb", "_n"], replicates, seed, by=keys).withColumn("d", diff).groupBy(*keys).agg(F.var_pop("d").alias("v"))
    joined = point.join(spread, keys)
    out = joined.groupBy(*by).agg(F.avg("d").alias("difference"), (F.avg("v") + F.coalesce(F.var_samp("d") / F.count("*"), F.lit(0.0))).alias("v"))
    half = Z * F.sqrt("v")
    return out.select(*by, "difference", (F.col("difference") - half).alias("low"), (F.col("difference") + half).alias("high"), (F.abs("difference") > half).alias("beyond_zero"))


def align(a: DataFrame, b: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Rows of two conditions side by side; a row that only one has is an error (or, not strict, marked by side)."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), keys, "full_outer")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    if strict:
        return both.filter(F.coalesce(F.when(whole, F.lit(True)), F.raise_error(F.lit("the two conditions do not have the same rows")).cast("boolean"))).drop("_a", "_b")
    return both.withColumn("side", F.when(whole, "both").when(F.col("_a").isNotNull(), "a").otherwise("b")).drop("_a", "_b")


def agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str = "predicted") -> DataFrame:
    """(n, n_differ): predictions of two models on the same rows."""
    both = align(a.select(*keys, F.col(value).alias("va")), b.select(*keys, F.col(value).alias("vb")), keys)
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("va").eqNullSafe(F.col("vb"))).alias("n_differ"))


def seed_noise(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Range of a measure between seeds."""
    return values.groupBy(*by).agg((F.max(value) - F.min(value)).alias("noise"), F.min(value).alias("least"), F.max(value).alias("most"))


def read_difference(before: DataFrame, after: DataFrame, noise: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, least, most, reading): the seeds' differences after - before, read against the seed noise of the measure."""
    d = before.select(*keys, "seed", F.col(value).alias("x")).join(after.select(*keys, "seed", F.col(value).alias("y")), [*keys, "seed"]).groupBy(*keys).agg(F.min(F.col("y") - F.col("x")).alias("least"), F.max(F.col("y") - F.col("x")).alias("most"))
    d = d.join(noise.select(*keys, "noise"), keys)
    reading = F.when((F.col("least") <= 0) & (F.col("most") >= 0), "no direction").when(F.least(F.abs("least"), F.abs("most")) <= F.col("noise"), "within noise").when(F.col("least") > 0, "rises").otherwise("falls")
    return d.select(*keys, "least", "most", reading.alias("reading"))


def adoption(measures: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """adopt: all limits hold; limits maps a column to ("max" or "min", bound)."""
    tests = [F.col(c) <= b if kind == "max" else F.col(c) >= b for c, (kind, b) in limits.items()]
    out = measures.select("*", *(t.alias(f"ok_{c}") for t, c in zip(tests, limits, strict=True)))
    ok = tests[0]
    for t in tests[1:]:
        ok = ok & t
    return out.withColumn("adopt", ok)
