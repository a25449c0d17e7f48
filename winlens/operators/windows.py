"""Count-based windows over numbered frames, their 39-column summary, addresses, counters, sessions and alarms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE_DEPENDENT = ("Number", "Tot sum", "ack_count", "syn_count", "fin_count", "rst_count")


def window_no(size: int | Column) -> Column:
    return F.floor(F.col("frame_no") / size).cast("long")


def pieces(frames: DataFrame, limit: int, file_header: int = 24, record_header: int = 16, capture: str = "capture") -> DataFrame:
    """(capture, frame_no, piece, piece_no): captures cut into files as a capturing program does that opens a new file when the
    present one is over the limit before it writes a frame; so a file exceeds the limit by one frame. Numbers start anew in each.

    frames has (capture, frame_no, length). Where the next file begins depends on where this one did, so a capture's lengths go in order
    through one task, batch by batch; nothing else of the frames does.
    """
    schema = f"`{capture}` {frames.schema[capture].dataType.simpleString()}, frame_no long, piece int, piece_no long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, begin, written = None, 0, 0, 0
        for b in batches:
            keys, numbers, lengths = b.column(0).to_pylist(), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            out_piece, out_no = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int64)
            at = 0
            while at < len(keys):
                if keys[at] != now:
                    now, piece, begin, written = keys[at], 0, 0, file_header
                rest = next((i for i in range(at, len(keys)) if keys[i] != now), len(keys)) if keys[-1] != now else len(keys)
                sizes = written + np.cumsum(lengths[at:rest] + record_header)
                end = at + int(np.searchsorted(sizes, limit, "right")) + 1  # the frame that goes over the limit is the file's last
                full, end = end <= rest, min(end, rest)
                out_piece[at:end], out_no[at:end] = piece, begin + np.arange(end - at)
                begin, written = begin + end - at, int(sizes[end - at - 1])
                if full:
                    piece, begin, written = piece + 1, 0, file_header
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), numbers, pa.array(out_piece), pa.array(out_no)], [capture, "frame_no", "piece", "piece_no"])

    rows = frames.select(capture, F.col("frame_no").cast("long").alias("frame_no"), F.col("length").cast("long").alias("length"))
    return rows.repartition(capture).sortWithinPartitions(capture, "frame_no").mapInArrow(run, schema)


def aggregate_windows(frames: DataFrame, size: int, means: list[str], capture: str = "capture", extra: list[Column] = (), digits: int = 6) -> DataFrame:
    """One row per (capture, win): means, flag counts, sizes, gap, rate and the most frequent protocol (ties: the smallest).

    A one-frame window has no spread (null); a window without duration has an infinite rate.
    """
    span = F.max("ts") - F.min("ts")
    r = lambda c: F.round(c, digits)
    counts = [F.sum(f"{n}_flag_number").alias(f"{n}_count") for n in ("ack", "syn", "fin", "rst")]
    return frames.groupBy(capture, window_no(size).alias("win")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), *(r(F.avg(c)).alias(c) for c in means),
        F.when(span > 0, F.count("*") / span).otherwise(F.lit(float("inf"))).alias("Rate"), *counts,
        F.sum("size").alias("Tot sum"), F.min("size").alias("Min"), F.max("size").alias("Max"), r(F.avg("size")).alias("AVG"), r(F.stddev_samp("size")).alias("Std"),
        r(F.avg("size")).alias("Tot size"), r(F.avg("iat")).alias("IAT"), F.count("*").alias("Number"), F.round(F.var_samp("size"), 4).alias("Variance"),
        F.mode("protocol", True).alias("Protocol Type"), *extra)


def size_free(windows: DataFrame) -> DataFrame:
    """Without the six columns that depend on how many frames a window has."""
    return windows.drop(*SIZE_DEPENDENT)


def complete(windows: DataFrame, size: int) -> DataFrame:
    return windows.filter(F.col("Number") == size)


def endpoints(frames: DataFrame, size: int, roles: dict[str, str], capture: str = "capture") -> DataFrame:
    """(capture, win, role, addr, n_frames, first_no): how often each address takes each role (role -> column)."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("role"), F.col(v).alias("addr")) for k, v in roles.items())))
    rows = frames.select(capture, window_no(size).alias("win"), "frame_no", each.alias("x")).filter("x.addr is not null")
    return rows.groupBy(capture, "win", F.col("x.role").alias("role"), F.col("x.addr").alias("addr")).agg(F.count("*").alias("n_frames"), F.min("frame_no").alias("first_no"))


def address_sets(frames: DataFrame, size: int, columns: list[str], capture: str = "capture") -> DataFrame:
    """Sorted distinct values of each address column per window, and their number."""
    out = frames.groupBy(capture, window_no(size).alias("win")).agg(*(F.sort_array(F.collect_set(c)).alias(f"{c}_set") for c in columns))
    return out.select("*", *(F.size(f"{c}_set").cast("long").alias(f"n_{c}") for c in columns))


def counters(frames: DataFrame, size: int, keys: dict[str, Column], capture: str = "capture") -> DataFrame:
    """Long table (capture, win, counter, key, n) of several counters in one pass; a null key is not counted."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("counter"), c.cast("string").alias("key")) for k, c in keys.items())))
    rows = frames.select(capture, window_no(size).alias("win"), each.alias("x")).filter("x.key is not null")
    return rows.groupBy(capture, "win", "x.counter", "x.key").agg(F.count("*").alias("n"))


def duration(number: str = "Number", rate: str = "Rate") -> Column:
    """Number / Rate, 0 where that is not finite."""
    d = F.try_divide(F.col(number).cast("double"), F.col(rate))
    return F.when(d.isNull() | F.isnan(d) | (d == float("inf")), 0.0).otherwise(d)


def judge_status(windows: DataFrame, longest: float) -> DataFrame:
    """status: unjudged for windows slower than the limit."""
    return windows.withColumn("status", F.when(F.col("end_ts") - F.col("start_ts") > longest, "unjudged").otherwise("judged"))


def sessions(windows: DataFrame, silence: float, capture: str = "capture") -> DataFrame:
    """session: a number that rises where more than `silence` seconds pass between two windows."""
    w = Window.partitionBy(capture).orderBy("win")
    gap = F.col("start_ts") - F.lag("end_ts").over(w) > silence
    return windows.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("long")).withColumn("session", F.sum("_new").over(w)).drop("_new")


def alarms(windows: DataFrame, in_a_row: int, is_attack: str = "is_attack", capture: str = "capture") -> DataFrame:
    """alarm: true on the in_a_row-th window of each run of attack windows."""
    w = Window.partitionBy(capture).orderBy("win")
    runs = windows.withColumn("_run", F.sum((~F.col(is_attack)).cast("int")).over(w))
    place = F.sum(F.col(is_attack).cast("int")).over(Window.partitionBy(capture, "_run").orderBy("win"))
    return runs.withColumn("alarm", F.col(is_attack) & (place == in_a_row)).drop("_run")


def first_alarm(with_alarms: DataFrame, capture: str = "capture") -> DataFrame:
    """Of each capture: windows, alarms, place of the first alarm and the seconds of windows up to it."""
    w = Window.partitionBy(capture).orderBy("win")
    rows = with_alarms.withColumns({"_place": F.row_number().over(w), "_elapsed": F.sum(F.col("end_ts") - F.col("start_ts")).over(w)})
    first = F.min(F.when(F.col("alarm"), F.struct("_place", "_elapsed")))
    return rows.groupBy(capture).agg(F.count("*").alias("n_windows"), F.count_if("alarm").alias("n_alarms"), first.alias("f")).select(capture, "n_windows", "n_alarms", F.col("f._place").alias("first_place"), F.col("f._elapsed").alias("first_seconds"))


def interleave(kept: DataFrame, background: DataFrame) -> DataFrame:
    """Kept and background windows of captures as one table, marked by side."""
    return kept.withColumn("side", F.lit("kept")).unionByName(background.withColumn("side", F.lit("background")))


def evenly_spaced(rows: DataFrame, k: int, order: list[str], by: list[str]) -> DataFrame:
    """At most k rows of each group, evenly spaced: place i * (n - 1) div (k - 1) for i from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    placed = rows.withColumns({"_at": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    # place p is taken iff some i gives it: the smallest i with i * (n - 1) >= p * (k - 1)
    i = F.ceil(F.try_divide(F.col("_at") * (k - 1), F.col("_n") - 1))
    taken = F.floor(i * (F.col("_n") - 1) / (k - 1)) == F.col("_at")
    return placed.filter((F.col("_n") <= k) | taken).drop("_at", "_n")


def lag1(rows: DataFrame, value: str, order: str = "win", by: str = "capture") -> DataFrame:
    """Lag-1 autocorrelation of a 0/1 column, centred within each capture of more than two rows, and the effective sample size n (1 - r) / (1 + r)."""
    w = Window.partitionBy(by)
    x = F.col(value).cast("double")
    centred = rows.withColumns({"_n": F.count("*").over(w), "_c": x - F.avg(x).over(w)}).withColumn("_d", F.lead("_c").over(w.orderBy(order)))
    pair = F.col("_d").isNotNull() & (F.col("_n") > 2)
    sums = lambda c: F.sum(F.when(pair, c))
    out = centred.agg(F.count("*").alias("n"), F.try_divide(sums(F.col("_c") * F.col("_d")), F.sqrt(sums(F.col("_c") * F.col("_c")) * sums(F.col("_d") * F.col("_d")))).alias("rho"))
    return out.withColumn("n_effective", F.when(F.col("rho") > -1 + 1e-12, F.col("n") * (1 - F.col("rho")) / (1 + F.col("rho"))))
