"""Splits and seeded samples, all by hashes or places, so that they do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winlens.operators.ordered import running


def time_cut(windows: DataFrame, fraction: float, capture: str = "capture") -> DataFrame:
    """cut: the first window of a capture's test part, floor((1 - fraction) * total + 0.5), totals counted over these rows."""
    totals = windows.groupBy(capture).agg(F.count("*").alias("_total"))
    return windows.join(totals, capture).withColumn("cut", F.floor((1 - fraction) * F.col("_total") + 0.5)).drop("_total")


def mark_sides(windows: DataFrame, cut: str = "cut", win: str = "win") -> DataFrame:
    return windows.withColumn("side", F.when(F.col(win) < F.col(cut), "train").otherwise("test"))


def capture_sides(captures: DataFrame, fraction: float, label: str = "label", total: str = "total") -> DataFrame:
    """cut of each capture (label, name key `order`, total): with several captures of a label the last one is test as a whole,
    the others train; an only one is cut by time. A window is test iff its place reaches the cut."""
    w = Window.partitionBy(label)
    last = F.row_number().over(w.orderBy(F.col("order").desc())) == 1
    several = F.count("*").over(w) > 1
    cut = F.when(several, F.when(last, 0).otherwise(F.col(total))).otherwise(F.floor((1 - fraction) * F.col(total) + 0.5))
    return captures.withColumn("cut", cut.cast("long"))


def rotations(captures: DataFrame, n: int, label: str = "label") -> DataFrame:
    """(.., rotation, held_out): in rotation r the capture that is r places after the last of its label is held out."""
    w = Window.partitionBy(label)
    ranked = captures.withColumns({"_k": F.row_number().over(w.orderBy("order")) - 1, "_n": F.count("*").over(w)})
    each = ranked.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.withColumn("held_out", F.col("_k") == F.pmod(F.col("_n") - 1 + F.col("rotation"), F.col("_n"))).drop("_k", "_n")


def validation_start(captures: DataFrame, fraction: float = 0.15, cut: str = "cut") -> DataFrame:
    """First window of the validation part: the last share of a capture's training part."""
    return captures.withColumn("validation_from", F.floor((1 - fraction) * F.col(cut) + 0.5).cast("long"))


def draw(seed: int, *columns: str | Column) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the texts of the columns alone: 52 bits of an MD5, as any SQL engine has it."""
    texts = (F.col(c) if isinstance(c, str) else c for c in columns)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in texts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def capped_sample(rows: DataFrame, label: str, identity: list[str], cap: int, seed: int) -> DataFrame:
    """At most cap rows of each label, the same on any partitioning, and of every label its population.

    Labels with many rows are thinned by the seeded draw first, to about twice the cap; the exact cut then ranks few rows.
    """
    totals = rows.groupBy(label).agg(F.count("*").alias("population"))
    drawn = rows.join(totals, label).withColumn("_u", draw(seed, label, *identity))
    # of n draws the cap smallest are below this bound but for a chance of about 1e-9
    bound = (cap + 6 * F.sqrt(F.lit(float(cap))) + 20) / F.col("population")
    near = drawn.filter(F.col("_u") <= bound)
    # a label that falls short of them all the same is ranked whole
    short = totals.join(near.groupBy(label).agg(F.count("*").alias("_n")), label, "left").filter(F.coalesce("_n", F.lit(0)) < F.least(F.lit(cap), F.col("population"))).select(label)
    kept = near.join(short, label, "left_anti").unionByName(drawn.join(short, label, "left_semi"))
    r = F.row_number().over(Window.partitionBy(label).orderBy("_u", *identity))
    return kept.withColumn("_r", r).filter(F.col("_r") <= cap).drop("_r", "_u")


def stratified_split(rows: DataFrame, label: str, identity: list[str], fraction: float, seed: int) -> DataFrame:
    """side: of each label round(fraction * n) rows are test, by seeded rank; a label with one row is an error."""
    ranked = running(rows.withColumn("_u", draw(seed, label, *identity)), [label], ["_u", *identity], number="_r", total="_n")
    enough = F.when(F.col("_n") >= 2, F.round(F.col("_n") * fraction)).otherwise(F.raise_error(F.lit("a label has fewer than two rows to split")).cast("double"))
    return ranked.withColumn("side", F.when(F.col("_r") <= enough, "test").otherwise("train")).drop("_r", "_n", "_u")


def group_split(rows: DataFrame, group: list[str], label: str, fraction: float, seed: int) -> DataFrame:
    """side: rows equal in `group` go to one side; groups are stratified by their most frequent label (ties: the first)."""
    counts = rows.groupBy(*group, label).agg(F.count("*").alias("n"))
    main = counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("x")).select(*group, F.col("x.l").alias("_label"))
    return rows.join(stratified_split(main, "_label", group, fraction, seed).drop("_label"), group)


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(n, digest): depends on the set of rows and not on their order. Summed as decimals, as 2^24 rows are too many for a long."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 40)).cast("decimal(20,0)")).alias("s")).select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")), 256).alias("digest"))


def split_report(rows: DataFrame, label: str, side: str = "side") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n_rows"), F.count_if(F.col(side) == "train").alias("n_train"), F.count_if(F.col(side) == "test").alias("n_test"))
