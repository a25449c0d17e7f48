"""Sharding by sampled splitters: shards of near equal bytes that keep equal texts together.

A record's key is the hash of its text, so equal texts are a group of neighbours; their ids put them in order. Records are
drawn into a sample with chances in proportion to their size. Quantiles of the sampled keys are the splitters that
range-partition the records; a range whose measured size is overfull is sampled anew and subdivided, within a large group by
ids. The sample also shows which groups may be large; the exact bytes of these are counted.

Which shard: a large group goes whole to the shard with the most room (the largest first), if it fits there. All smaller groups
follow in key order and fill the room that the shards have left, each whole where its middle byte falls. A large group that fits
nowhere, such as one larger than a shard's share, can't be kept whole by shards of equal bytes: it fills room as well, and
each of its records goes where its own middle byte falls.
The exact sums of ranges, a row each, tell where the shards begin.

Defined cases: a null text has no bytes and counts 8; a null id sorts first; rows that tie on text and id are interchangeable and
stay in one range; a very long text is a record like others, and a shard can be larger than others by its size; an empty table
gives an empty result; other columns are left out unless named in carry.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winlens.llm.common import materialize, table

#: Bytes of records in a range and how few ranges there may be; samples for each range or large group; a range is overfull from so
#: many times the mean. The driver holds some 20 bytes a sample: 40 MB for 100 TB.
RANGE_BYTES, LEAST_RANGES, SAMPLES, OVERFULL = 1 << 30, 96, 20, 2.0
#: A group is large from this part of a shard's share, or from a range's bytes.
LARGE_PART = 0.01
FIRST = -(1 << 63)


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("tie"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))


def sampled(rows: DataFrame, step: float, seed: int) -> pd.DataFrame:
    """(key, tie, times) of records drawn once for each step bytes; a record larger than a step stands for several."""
    draw = F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    times = F.floor(F.col("size") / step + draw).cast("long")
    return rows.select("key", "tie", times.alias("times")).filter("times > 0").toPandas().sort_values(["key", "tie"], ignore_index=True)


def quantiles(sample: pd.DataFrame, parts: int, large: np.ndarray) -> set[tuple[int, int]]:
    """Splitters at the quantiles of a sample: before the first record of a key, within it only if the key is a large group's."""
    if sample.empty or parts < 2:
        return set()
    weights = sample["times"].to_numpy().cumsum()
    at = np.unique(np.searchsorted(weights, weights[-1] * np.arange(1, parts) / parts))
    cut = sample.iloc[at]
    inside = cut[np.isin(cut["key"].to_numpy(np.int64), large)]
    return {(k, FIRST) for k in cut["key"].tolist()} | set(zip(inside["key"].tolist(), inside["tie"].tolist(), strict=True))


def range_of(cuts: list[tuple[int, int]]):
    """mapInArrow function that puts the range (number of splitters at or below the record) before the columns."""
    keys, ties = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tie = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "tie"))
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for i in np.flatnonzero(high > low):
                low[i] += np.searchsorted(ties[low[i] : high[i]], tie[i], "right")
            yield pa.RecordBatch.from_arrays([pa.array(low.astype(np.int32)), *batch.columns], ["range", *batch.schema.names])

    return run


def with_ranges(rows: DataFrame, cuts: set[tuple[int, int]]) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(range_of(sorted(cuts)), f"range int, {fields}")


def large_groups(rows: DataFrame, sample: pd.DataFrame, least: float) -> dict[int, int]:
    """Exact bytes of each key that holds at least `least` bytes; candidates are the keys sampled more than once, as many as samples at most."""
    times = sample.groupby("key")["times"].sum()
    keys = times[times > 1].index.to_numpy(np.int64)
    if not len(keys):
        return {}
    wanted = F.broadcast(rows.sparkSession.createDataFrame(pd.DataFrame({"key": keys}), "key long"))
    found = rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") >= least).collect()
    return {r["key"]: r["bytes"] for r in found}


def pack(large: dict[int, int], shards: int, share: float) -> tuple[dict[int, int], list[float]]:
    """Shards of the large groups that find room, the largest first into the emptiest; and the room that is left in each shard."""
    heap = [(0, s) for s in range(shards)]
    packed: dict[int, int] = {}
    for key, n in sorted(large.items(), key=lambda x: (-x[1], x[0])):
        held, s = heap[0]
        if held + n <= share:
            packed[key] = s
            heapq.heapreplace(heap, (held + n, s))
    room = [0.0] * shards
    for held, s in heap:
        room[s] = max(0.0, share - held)
    return packed, room


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), range_bytes: int = RANGE_BYTES, least_ranges: int = LEAST_RANGES) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in key order) and carry, for every row."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col, carry)
    rows = rows if carry else materialize(rows, "keyed")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(least_ranges, -(-total // range_bytes))
    share, mean = max(1, total) / shards, max(1, total) / ranges
    least = min(LARGE_PART * share, mean)
    sample = sampled(rows, max(1.0, least / SAMPLES), 17)
    large = large_groups(rows, sample, least)
    packed, room = pack(large, shards, share)
    keys = np.array(sorted(large), np.int64)
    split = [k for k in large if k not in packed]

    cuts = quantiles(sample, ranges, keys)
    while True:
        marked = with_ranges(rows, cuts)
        measured = {r["range"]: r["bytes"] for r in marked.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}  # a row for each range
        overfull = sorted(r for r, n in measured.items() if n > OVERFULL * mean)
        more = set()
        if overfull:
            wanted = F.broadcast(spark.createDataFrame([(r,) for r in overfull], "range int"))
            inner = sampled(marked.join(wanted, "range", "left_semi"), mean / SAMPLES, 19 + len(cuts))
            edges = sorted(cuts)
            at = pd.Series([bisect_right(edges, (k, t)) for k, t in zip(inner["key"], inner["tie"], strict=True)], dtype="int64")
            for r, part in inner.groupby(at):
                more |= quantiles(part, 2 * int(-(-measured.get(r, 0) // mean)), keys)
        if more <= cuts:  # what is left can't be told apart by text and id
            break
        cuts |= more

    # places of records among those that fill the room, in key order
    marked = marked.join(F.broadcast(spark.createDataFrame([(k, s) for k, s in packed.items()], "key long, packed int")), "key", "left")
    fills = F.when(F.col("packed").isNull(), F.col("size")).otherwise(F.lit(0))
    sums = sorted((r["range"], r["bytes"]) for r in marked.groupBy("range").agg(F.sum(fills).alias("bytes")).collect())
    before = np.cumsum([0, *(n for _, n in sums)])[:-1].tolist()
    rest = sum(n for _, n in sums)
    # shard s takes the bytes from ends[s - 1] to ends[s] of those that fill the room
    ends = (np.cumsum(room) * (rest / max(1e-9, sum(room))))[:-1]
    edges = [(r, b, int(np.searchsorted(ends, b, "right")), ends[np.searchsorted(ends, b, "right") : np.searchsorted(ends, b + n, "right")].tolist()) for (r, n), b in zip(sums, before, strict=True)]
    offsets = F.broadcast(spark.createDataFrame(edges, "range int, before long, base int, ends array<double>"))
    group, order = Window.partitionBy("range", "key"), Window.partitionBy("range").orderBy("key", "tie", "size")
    running = F.coalesce(F.sum(fills).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = marked.join(offsets, "range").withColumn("_from", F.col("before") + running).withColumns({"_first": F.min("_from").over(group), "_bytes": F.sum("size").over(group)})
    own = F.col("_from") + F.col("size") / 2
    middle = F.when(F.col("key").isin(split), own).otherwise(F.col("_first") + F.col("_bytes") / 2) if split else F.col("_first") + F.col("_bytes") / 2
    placed = placed.withColumn("_middle", middle)
    filled = F.col("base") + F.size(F.filter("ends", lambda e: e <= F.col("_middle")))
    placed = placed.withColumn("shard", F.coalesce("packed", filled).cast("int"))
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("range", "shard").orderBy("key", "tie", "size")))
    placed = placed.select("range", "shard", "at", "doc_id", "size", "text_crc32", *(f"_c{i}" for i in range(len(carry))))
    placed = placed if carry else materialize(placed, "placed")

    parts = sorted((r["shard"], r["range"], r["n"]) for r in placed.groupBy("range", "shard").agg(F.count("*").alias("n")).collect())  # ranges and large groups at most
    slots, seen = [], {}
    for shard, part, n in parts:
        slots.append((part, shard, seen.get(shard, 0) - 1))
        seen[shard] = seen.get(shard, 0) + n
    shift = F.broadcast(spark.createDataFrame(slots, "range int, shard int, shift long"))
    return placed.join(shift, ["range", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Parquet files of whole rows under path/shard=N, in slot order within a file."""
    carry = tuple(c for c in docs.columns if c not in (id_col, "size", "text_crc32", "shard", "slot"))
    out = assign_shards(docs, shards, id_col, text_col, carry)
    out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
