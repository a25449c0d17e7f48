"""Keyword search over documents or sections, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winlens.functions.text import stem_counts, stems
from winlens.sources.scratch import materialize


#: Stems of more sections are frequent: the rare ones first give a bound, below which no section is ranked.
FREQUENT = 1000
#: (query, stem, section) rows that a task of the scoring takes; their sums stay in memory.
TASK_ROWS = 2_000_000


def search(sections: DataFrame, queries: DataFrame, k: int = 3, section: str = "section", title: str = "title", body: str = "body", document: str = "document", order: str = "order", frequent: int = FREQUENT) -> DataFrame:
    """(query, section, points, place): 3 for a stem in the title, up to 3 for it in the text, 1 in the document's title; ties by order.

    The index holds one row for each stem of a section that some query asks for. It is dealt by section, so that a section's points for
    all queries are summed in one task and only each task's first k of a query travel. A query's rare stems are looked up before: the
    k-th best by these alone has no more points than the k-th best of all, so sections with less are not ranked.
    """
    spark = sections.sparkSession
    asked = materialize(queries.select("query", F.explode(F.array_distinct(stems(F.col("text")))).alias("stem")), "asked-stems")
    field = lambda c, name: F.transform(stem_counts(F.coalesce(F.col(c), F.lit(""))), lambda s: F.struct(F.lit(name).alias("field"), s.alias("stem")))
    terms = sections.select(section, order, F.explode(F.concat(field(title, "title"), field(body, "text"), field(document, "document"))).alias("x")).select(section, order, "x.field", "x.stem")
    hit = lambda name: F.max((F.col("field") == name).cast("int"))
    index = terms.join(asked.select("stem").distinct(), "stem", "left_semi").groupBy(section, order, "stem").agg((3 * hit("title") + F.least(F.lit(3), F.count_if(F.col("field") == "text")) + hit("document")).alias("points"))
    index = materialize(index, "stem-index")
    wanted = materialize(asked.join(index.groupBy("stem").agg(F.count("*").alias("n")), "stem"), "query-stems")
    hits = ["query", section, order]
    score = lambda rows, stems_of: rows.join(stems_of, "stem").groupBy(*hits).agg(F.sum("points").alias("points"))
    first = Window.partitionBy("query").orderBy(F.col("points").desc(), order)
    often = wanted.filter(F.col("n") > frequent).select("query").distinct()
    points = rare = score(index, wanted.filter(F.col("n") <= frequent).select("query", "stem"))
    if often.limit(1).count():
        rare = materialize(rare, "rare-points")
        kth = materialize(rare.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == k).select("query", F.col("points").alias("kth")), "bounds")
        n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted.agg(F.sum("n")).first()[0] // TASK_ROWS + 1)
        whole = score(index.repartition(n_tasks, section), wanted.join(often, "query", "left_semi").select("query", "stem"))
        near = whole.join(kth, "query", "left").filter(F.col("kth").isNull() | (F.col("points") >= F.col("kth"))).select(*hits, "points")
        points = rare.join(often, "query", "left_anti").unionByName(near)
    return points.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k).select("query", section, "points", "place")


def mitigations(sections: DataFrame, categories: str, action: str, order: str, k: int) -> DataFrame:
    """(category, .., place): of each category the first k sections that name an action."""
    rows = sections.filter(F.col(action).isNotNull()).withColumn("category", F.explode(categories))
    w = Window.partitionBy("category").orderBy(order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
