"""Exact deduplication with a heavy-hitter split.

Texts are digested (SHA-256). Misra-Gries counters, one set per partition and merged in a tree, find the digests that may be
frequent; their exact counts and winners are verified, and the few that are frequent are broadcast, so that every copy of a
frequent text is resolved where it is read. The remaining digests, each held by less than hot_share of the rows, go through
ordinary shuffles: grouped with map-side combining, and groups of several rows joined back to their ids. Texts are never
shuffled.

Defined cases: a null text counts as the empty text; a null doc_id never wins over another id, and is kept only where
its group has no id at all; rows repeated with their id are the same document and share its fate; very long texts differ from
others in no way, as only their digests move; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.llm.common import materialize, table

#: Counters of a sketch: a merged one falls short of a true count by at most rows / (COUNTERS + 1), half of HOT_SHARE.
COUNTERS = 2000
HOT_SHARE = 2 / (COUNTERS + 1)
#: Sketches merged by one task: three levels are enough for two million partitions.
FAN_BITS, LEVELS = 7, 3
NO_ID = -(1 << 63)
_SKETCH = "part int, digests array<binary>, counts array<long>"


def absorb(kept: dict[bytes, int], more: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Both sets of counters as one of at most `counters`: the largest count that finds no room is taken off all."""
    for digest, n in more.items():
        kept[digest] = kept.get(digest, 0) + n
    if len(kept) <= counters:
        return kept
    off = sorted(kept.values(), reverse=True)[counters]
    return {digest: n - off for digest, n in kept.items() if n > off}


def sketch_row(part: int, kept: dict[bytes, int]) -> list[pa.Array]:
    return [pa.array([part], pa.int32()), pa.array([list(kept)], pa.list_(pa.binary())), pa.array([list(kept.values())], pa.list_(pa.int64()))]


def misra_gries(counters: int):
    """mapInArrow function: a partition's sketch as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            kept = absorb(kept, Counter(batch.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_arrays(sketch_row(TaskContext.get().partitionId(), kept), ["part", "digests", "counts"])

    return run


def merge_sketches(counters: int):
    """applyInArrow function: the sketches of a group as one."""

    def run(rows: pa.Table) -> pa.Table:
        kept: dict[bytes, int] = {}
        for row in rows.to_pylist():
            kept = absorb(kept, dict(zip(row["digests"], row["counts"], strict=True)), counters)
        return pa.table(sketch_row(rows.column("part")[0].as_py(), kept), ["part", "digests", "counts"])

    return run


def frequent_digests(digests: DataFrame, hot_share: float = HOT_SHARE, counters: int = COUNTERS) -> DataFrame:
    """digests(doc_id, digest): (digest, hot_id, hot_n) of every digest held by at least hot_share of the rows (and 3 rows)."""
    total = digests.count()
    least = max(3, int(hot_share * total))
    sketch = digests.select("digest").mapInArrow(misra_gries(counters), _SKETCH)
    for _ in range(LEVELS):
        sketch = sketch.withColumn("part", F.shiftright("part", FAN_BITS)).groupBy("part").applyInArrow(merge_sketches(counters), _SKETCH)
    found = sketch.select(F.explode(F.arrays_zip("digests", "counts")).alias("c")).filter(F.col("c.counts") >= least - total // (counters + 1))
    candidates = F.broadcast(materialize(found.select(F.col("c.digests").alias("digest")), "hot-candidates"))  # at most `counters` digests
    exact = digests.join(candidates, "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("hot_id"), F.count("*").alias("hot_n"))
    return exact.filter(F.col("hot_n") >= least)


def digest_of(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = HOT_SHARE, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, digest (binary), keep_id (largest id of the equal texts), group_size, kept."""
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest")), "digests")
    hot = F.broadcast(materialize(frequent_digests(rows, hot_share, counters), "hot"))  # at most 1 / hot_share digests
    split = rows.join(hot, "digest", "left")
    cold = split.filter("hot_n is null").select("doc_id", "digest")
    several = cold.groupBy("digest").agg(F.max("doc_id").alias("several_id"), F.count("*").alias("n")).filter("n > 1")
    out = split.filter("hot_n is not null").select("doc_id", "digest", F.col("hot_id").alias("keep_id"), F.col("hot_n").alias("group_size"))
    joined = cold.join(several, "digest", "left").select("doc_id", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("several_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"))
    return out.unionByName(joined).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are not kept.

    What goes is told to docs by id alone, so that Spark can broadcast many of them; texts are shuffled only where they are too many for
    that. The few ids that have rows of both sorts (several texts under one id, rows without id) are told by id and digest.
    """
    marked = exact_dedup(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "digest", "kept")
    marked = materialize(marked, "marked")
    ids = materialize(marked.groupBy("_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all_")).filter("not all_"), "copy-ids")
    mixed = marked.filter("not kept").join(ids.filter("some").select("_id"), "_id", "left_semi").select("_id", F.col("digest").alias("_digest")).distinct()
    gone, mixed = materialize(ids.filter("not some").select("_id"), "copies"), materialize(mixed, "mixed-copies")
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rest = docs.join(gone, own == gone["_id"], "left_anti")
    return rest.join(mixed, (own == mixed["_id"]) & (digest_of(text_col) == mixed["_digest"]), "left_anti")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
