"""Top-k per group and related rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def top_addresses(frames: DataFrame, listed: Column, k: int, cite_from: float = 0.01) -> DataFrame:
    """(capture, addr, as_src, as_dst, listed, share, cited): all listed addresses and the k busiest others; frames has capture, src, dst."""
    role = F.explode(F.array(F.struct(F.col("src").alias("addr"), F.lit(1).alias("s")), F.struct(F.col("dst").alias("addr"), F.lit(0).alias("s"))))
    n = frames.select("capture", role.alias("x")).groupBy("capture", F.col("x.addr").alias("addr")).agg(F.sum("x.s").alias("as_src"), F.sum(1 - F.col("x.s")).alias("as_dst"))
    total = frames.groupBy("capture").agg(F.count("*").alias("_frames"))
    n = n.withColumn("listed", listed).join(total, "capture")
    both = F.col("as_src") + F.col("as_dst")
    w = Window.partitionBy("capture", "listed").orderBy(both.desc(), "addr")
    out = n.withColumn("_r", F.row_number().over(w)).filter(F.col("listed") | (F.col("_r") <= k))
    return out.select("capture", "addr", "as_src", "as_dst", "listed", F.round(both / F.col("_frames"), 6).alias("share"), (both / F.col("_frames") >= cite_from).alias("cited"))


def main_features(own: DataFrame, reference: DataFrame, columns: list[str], order: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, feature, value, reference, place): the first k features by importance rank (feature, rank) with a value and a reference."""
    long = own.unpivot(by, columns, "feature", "value").filter("value is not null")
    ref = reference.unpivot([], columns, "feature", "reference").filter("reference is not null")
    rows = long.join(F.broadcast(ref), "feature").join(F.broadcast(order), "feature")
    w = Window.partitionBy(*by).orderBy("rank")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(*by, "feature", F.round("value", 4).alias("value"), F.round("reference", 4).alias("reference"), "place")
