"""Readers of event logs and of results of runs, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.sources.lines import follow, numbered_lines

EVENT = "id string, instante string, tipo string, incidente string, dados string"


def run_key(file_name: Column) -> Column:
    """(capture, incident, config, repeat) from `capture__inc-N__config__rN.jsonl.gz`."""
    part = lambda i: F.regexp_extract(file_name, r"([^/]+?)__inc-([0-9]+)__([^_/]+)__r([0-9]+)\.jsonl(?:\.gz)?$", i)
    return F.struct(part(1).alias("capture"), F.try_to_number(part(2), F.lit("999999")).cast("long").alias("incident"), part(3).alias("config"), F.try_to_number(part(4), F.lit("999999")).cast("long").alias("repeat"))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """(log, line, raw, and the envelope's fields; id null: not a JSON object). Lines are numbered from 1 by their place in their file, of any size."""
    lines = numbered_lines(spark, path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("log"), (F.col("line") + 1).alias("line"), "raw")
    parsed = lines.filter(F.trim("raw") != "").withColumn("e", F.from_json("raw", EVENT))
    return parsed.select("log", "line", "raw", "e.*")


def tail_event_log(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """Live tail of a folder of JSON-line files that grow: a stream of (log, at, raw, the envelope's fields, complete).

    A line appears once its end is written; the unfinished last line of a file is left for a later batch. complete is false for an
    ended line that is no JSON object. at, the byte at which the line begins, orders the lines of a log.
    """
    lines = follow(spark, path, suffix).select(F.regexp_extract("path", "([^/]*)$", 1).alias("log"), "at", "raw")
    parsed = lines.filter(F.trim("raw") != "").withColumn("e", F.from_json("raw", EVENT))
    return parsed.select("log", "at", "raw", "e.*", F.col("e.id").isNotNull().alias("complete"))


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON results, one document per file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def incident_rows(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per incident of each result (array of incidents), with is_true and in_test."""
    rows = results.select(*keys, F.explode("incidents").alias("i")).select(*keys, "i.*")
    return rows.withColumns({"is_true": F.col("windows_with_attacker") > 0, "in_test": F.col("windows_in_test") > 0})
