"""Helpers shared by the corpus operators: shared scratch tables and column checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winlens.sources.scratch import discard, materialize

__all__ = ["discard", "fold", "materialize", "small_batches", "table", "text_rows"]

#: Bytes of texts that go to a Python worker at once, if the session keeps Spark's own bound of 64 MB. Both sides hold a batch more than
#: once, and executors with little memory beside their heap can't bear that.
BATCH_BYTES, SPARKS_BATCH_BYTES = "4m", 64 << 20


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (f"{SPARKS_BATCH_BYTES}b", str(SPARKS_BATCH_BYTES), "64m", "64MB"):
        spark.conf.set(key, BATCH_BYTES)


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col as long doc_id, text with null as empty): other columns, whatever their names, are left out."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a row without id is in none of the folds (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(n)), F.lit(-1))
