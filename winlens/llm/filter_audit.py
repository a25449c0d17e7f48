"""Interaction audit of filters: what each filter removes at each place of each order, and what others would have removed for it.

1. Texts are read once. Every filter has a table of the rows that fail it, keyed by doc_id and digest; copies of a row are one key
   with a count.
2. The rows are parted filter by filter: a left-semi join with the filter's table gives those that fail it, a left-anti join those
   that pass. After the last filter each row stands in one class, named by the filters that it fails, and rows are counted by class.
3. The same joins, on classes, then give every prefix of every order: survivors are the classes left (anti) of all that an earlier
   filter fails; of these the filter at hand removes those in (semi) its relation and keeps the others; of what it fails, the classes in
   an earlier relation are redundant, and those in no other relation are its unique failures.

The first parting costs two joins a filter over keys; what follows has at most 2^filters classes for each part, whatever the input.

Defined cases: a null text is an empty one; a null lang is the part ""; a row without doc_id is neither a copy nor an original of
one (E) and has no labels; equal rows count as often as they stand; of several label rows of an id, one with 1 is enough; without
labels the losses are zero; an empty table gives no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.llm.common import discard, materialize, table

BLANKS = r"[\x20\x09-\x0D]+"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
KEY, DOCS = "key", ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text: A too short, B repetitive, C shouting, D markup."""
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def read_rows(docs: DataFrame) -> DataFrame:
    """key, doc_id, digest, part, failed (the filters on texts that fail), n: one row for equal rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    failed = F.concat(*(F.when(c, F.lit(name)).otherwise(F.lit("")) for name, c in text_filters(F.col("text")).items()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed.alias("failed"))
    rows = rows.groupBy("doc_id", "digest", "part", "failed").agg(F.count("*").alias("n"))
    return materialize(rows.withColumn(KEY, F.concat("digest", F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "UTF-8"))), "audit-rows")


def failing_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """For each filter the keys that fail it. E: the text stands under a smaller doc_id."""
    found = {name: rows.filter(F.contains("failed", F.lit(name))).select(KEY).distinct() for name in "ABCD"}
    named = rows.filter("doc_id is not null").select(KEY, "digest", "doc_id").distinct()
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    found["E"] = named.join(first, ["digest", "doc_id"], "left_anti").select(KEY)
    return {name: materialize(keys, f"failing-{name}") for name, keys in found.items()}


def classes(subjects: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """subjects (key, part, n, good, toxic) counted by part and fails, the names of the filters they fail."""
    stored = None
    rows = subjects.withColumn("fails", F.lit(""))
    for name, keys in failing.items():
        hit = rows.join(keys, KEY, "left_semi").withColumn("fails", F.concat("fails", F.lit(name)))
        now = materialize(hit.unionByName(rows.join(keys, KEY, "left_anti")), "parted")
        if stored is not None:
            discard(stored)
        stored = rows = now
    return materialize(rows.groupBy("part", "fails").agg(*(F.sum(c).alias(c) for c in DOCS)), "classes")


def interactions(counted: DataFrame, names: str) -> DataFrame:
    """counted (part, fails, n, good, toxic) to part, filter_order, step, MEASURES, shapley for all orders of the filters."""
    spark = counted.sparkSession
    orders = ["".join(p) for p in permutations(names)]
    earlier = spark.createDataFrame([(o, k + 1, g) for o in orders for k in range(len(o)) for g in o[:k]], "filter_order string, step int, filter string")
    others = spark.createDataFrame([(f, g) for f in names for g in names if f != g], "filter string, other string")
    place = ["filter_order", "step"]
    relation = counted.select("fails").distinct().withColumn("filter", F.explode(F.split("fails", ""))).filter("filter <> ''")  # classes that fail a filter
    gone = earlier.join(relation, "filter").select(*place, "fails").distinct()
    elsewhere = others.join(relation.withColumnRenamed("filter", "other"), "other").select("filter", "fails").distinct()

    grid = counted.withColumn("at", F.explode(F.lit([f"{o}{k + 1}{f}" for o in orders for k, f in enumerate(o)])))
    grid = grid.select("part", "fails", *DOCS, F.expr(f"substring(at, 1, {len(names)})").alias("filter_order"), F.expr(f"cast(substring(at, {len(names) + 1}, 1) as int)").alias("step"), F.expr(f"substring(at, {len(names) + 2})").alias("filter"))
    survivors = grid.join(gone, [*place, "fails"], "left_anti")
    removed = survivors.join(relation, ["filter", "fails"], "left_semi")
    kept = survivors.join(relation, ["filter", "fails"], "left_anti")
    failed = grid.join(relation, ["filter", "fails"], "left_semi")
    redundant = failed.join(gone, [*place, "fails"], "left_semi")
    unique = failed.join(elsewhere, ["filter", "fails"], "left_anti")
    zero = F.lit(0).cast("long")

    def measured(rows: DataFrame, **values: Column) -> DataFrame:
        return rows.select("part", *place, "filter", *(values.get(m, zero).alias(m) for m in MEASURES))

    n = F.col("n")
    every = measured(grid).unionByName(measured(kept, kept=n)).unionByName(measured(removed, removed=n, good_lost=F.col("good"), toxic_lost=F.col("toxic")))
    every = every.unionByName(measured(redundant, redundant=n)).unionByName(measured(unique, unique_fails=n))
    out = materialize(every.groupBy("part", *place, "filter").agg(*(F.sum(m).alias(m) for m in MEASURES)), "audit")
    return out.join(out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley")), ["part", "filter"]).select("part", *place, *MEASURES, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, MEASURES, shapley of the filters A to E."""
    rows = read_rows(docs)
    failing = failing_tables(rows)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    subjects = rows.join(marks, "doc_id", "left").select(KEY, "part", "n", *((F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")))
    return interactions(classes(subjects, failing), "".join(failing))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 100 THEN 'A' ELSE '' END ||
        CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END ||
        CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END ||
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
        CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
    FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (
    SELECT part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS fails_it, translate(fails, before, '') <> fails AS fails_before,
        fails = filter AS alone FROM c, s),
r AS (
    SELECT part, filter_order, step, filter,
        sum(CASE WHEN NOT fails_before AND NOT fails_it THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN NOT fails_before AND fails_it THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails_before AND fails_it THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN NOT fails_before AND fails_it THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN NOT fails_before AND fails_it THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM r
"""
