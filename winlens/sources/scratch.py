"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables written by this process, by the table that reads them.
_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one, but only if all tasks run in this one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("winlens.scratch.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-winlens-")
        spark.conf.set("winlens.scratch.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Written once and read back: cuts lineage, survives lost executors, and is not computed again by each of its users.

    The tables of a process are deleted when it ends, or earlier by `discard`. Options are those of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winlens-{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(discard_all)
    _MADE[path] = spark
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of materialize that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path and (spark := _MADE.pop(path, None)):
        delete(spark, path)


def discard_all() -> None:
    while _MADE:
        path, spark = _MADE.popitem()
        with contextlib.suppress(Exception):  # the session may have ended first
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
