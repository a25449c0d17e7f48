"""Labelled feature tables as CSV, file manifests and line counts. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from winlens.operators.labels import LABELS, OTHER_NAMES
from winlens.operators.ordered import running
from winlens.sources.lines import digests, numbered_lines

#: The 39 columns of a window in their order.
COLUMNS = (
    "Header_Length", "Protocol Type", "Time_To_Live", "Rate", "fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number", "ack_flag_number", "ece_flag_number", "cwr_flag_number",
    "ack_count", "syn_count", "fin_count", "rst_count", "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "TCP", "UDP", "DHCP", "ARP", "ICMP", "IGMP", "IPv", "LLC",
    "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT", "Number", "Variance")
SIZE_DEPENDENT = ("Number", "Tot sum", "ack_count", "syn_count", "fin_count", "rst_count")
FEATURES_33 = tuple(c for c in COLUMNS if c not in SIZE_DEPENDENT)
FEATURES = T.StructType([T.StructField(c, T.DoubleType()) for c in COLUMNS])
LABELLED = T.StructType([*FEATURES, T.StructField("Label", T.StringType())])


def numbers(values: Column) -> tuple[Column, Column]:
    """Doubles of an array of texts, empty as null; and whether one is no number."""
    found = F.transform(values, lambda x: F.trim(x).try_cast("double"))
    return found, F.exists(F.zip_with(values, found, lambda t, n: (F.trim(t) != "") & n.isNull()), lambda x: x)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw, open, header) of text files of any size, lines from 0; open: a last line without end."""
    lines = numbered_lines(spark, path)
    return lines.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "line", "raw", "open", F.split("head", ",").alias("header"))


def read_labelled(spark: SparkSession, path: str, strict_end: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of labelled CSV files with the exact 40-column header.

    Lines are audited as text: blank lines are skipped, lines that do not parse and labels that are none of the set go to the
    quarantine (file, line, raw, reason); a file with another header has all of its lines there. A last line that is not ended
    counts if nothing is wrong with it, and else has the reason `unterminated`; with strict_end it has that in any case.
    """
    names = F.array(*map(F.lit, (*COLUMNS, "Label")))
    lines = file_lines(spark, path).filter("line > 0 and trim(raw) <> ''").withColumn("v", F.split("raw", ","))
    values, bad = numbers(F.slice("v", 1, len(COLUMNS)))
    known = F.lower(F.trim(F.get("v", len(COLUMNS)))).isin([k.lower() for k in (*LABELS, *OTHER_NAMES)])
    reason = F.when(F.size("v") != len(COLUMNS) + 1, "columns").when(bad, "number").when(~known, "label")
    reason = F.when(F.transform("header", F.trim) != names, "header").when(F.col("open") & (reason.isNotNull() | F.lit(strict_end)), "unterminated").otherwise(reason)
    parsed = lines.withColumns({"n": values, "reason": reason})
    rows = parsed.filter("reason is null").select("file", "line", *(F.get("n", i).alias(c) for i, c in enumerate(COLUMNS)), F.trim(F.get("v", len(COLUMNS))).alias("Label"))
    return rows, parsed.filter("reason is not null").select("file", "line", "raw", "reason")


def read_complete(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, files) of labelled CSV files: rows without a last line that is not ended, and each file's bytes, sha256 and truncated."""
    rows, _ = read_labelled(spark, path, strict_end=True)
    cut = file_lines(spark, path).filter("open").select("file", F.lit(True).alias("truncated")).distinct()
    return rows, with_file_facts(spark, path).select("file", "bytes", "sha256").join(cut, "file", "left").fillna(False, ["truncated"])


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names in the header of the first file, without a byte order mark."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].lstrip("\ufeff").strip().split(",") if first else []


def read_features(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Feature CSV (gz or not): 39 doubles, empty as null, other columns as text, and a label from its column or given once.

    The columns are those of the header, in any order, the same in all files of the path; a missing feature or label, a label given
    twice and a value that is no number are errors.
    """
    columns = csv_columns(spark, path)
    missing = [c for c in (*COLUMNS, *(["Label"] if label is None else [])) if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if label is not None and "Label" in columns:
        raise ValueError("the file has labels of its own")
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in COLUMNS else T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").option("nullValue", "").option("positiveInf", "inf").option("negativeInf", "-inf").csv(path)
    return df if label is None else df.withColumn("Label", F.lit(label))


def read_official(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, the 39 columns) of per-capture CSV files without label: row is the line's place from 0, empty values are null.

    Other columns are left out, quarantine there is none: a value that is no number fails the read.
    """
    lines = file_lines(spark, path).filter("line > 0 and trim(raw) <> ''").withColumn("v", F.split("raw", ","))
    place = F.transform(F.array(*map(F.lit, COLUMNS)), lambda c: F.array_position(F.transform("header", F.trim), c))
    values, bad = numbers(F.transform(place, lambda p: F.coalesce(F.get("v", p - 1), F.lit(""))))
    missing = F.exists(place, lambda p: p == 0)
    values = F.when(missing, F.raise_error(F.concat("file", F.lit(": columns are missing"))).cast("array<double>")).when(bad, F.raise_error(F.concat("file", F.lit(": a value is no number"))).cast("array<double>")).otherwise(values)
    rows = running(lines.withColumn("n", values).select("file", "line", "n"), ["file"], ["line"])
    return rows.select("file", (F.col("row") - 1).alias("row"), *(F.get("n", i).alias(c) for i, c in enumerate(COLUMNS)))


def with_file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified, sha256) of files of any size."""
    return digests(spark, path)


def line_counts(files: DataFrame, label: str, content: str) -> DataFrame:
    """(label, n_files, n_lines, n_open): ended lines, and files whose last line is not ended."""
    n = F.length(content) - F.length(F.replace(F.col(content), F.lit("\n"), F.lit("")))
    return files.groupBy(label).agg(F.count("*").alias("n_files"), F.sum(n.cast("long")).alias("n_lines"), F.count_if(~F.col(content).endswith("\n")).alias("n_open"))


def manifest_diff(files: DataFrame, manifest: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """(key, state): new, changed, unchanged or vanished."""
    a = files.select(*key, F.struct(*facts).alias("_now"))
    b = manifest.select(*key, F.struct(*facts).alias("_then"))
    state = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "vanished").when(F.col("_now") != F.col("_then"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(*key, state.alias("state"))


def window_texts(windows: DataFrame) -> DataFrame:
    """The 39 columns in order, doubles; NaN as null, which is written as empty."""
    return windows.select(*(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in COLUMNS))


def write_windows(windows: DataFrame, path: str) -> None:
    """Window CSV: the 39 columns in order, exact text of doubles, empty for null and NaN."""
    window_texts(windows).write.option("header", True).option("nullValue", "").csv(path)


def stream_windows(windows: DataFrame, path: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """write_windows for a stream: a window is in a file within `every` of its end."""
    out = window_texts(windows).writeStream.format("csv").option("header", True).option("nullValue", "").option("path", path)
    return out.option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def write_training(windows: DataFrame, path: str) -> None:
    """Training windows as Parquet by window size, side and label. Partitions are written by the tasks that hold their rows."""
    windows.write.partitionBy("window_size", "side", "label").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_sample(sample: DataFrame, label: str, path: str) -> DataFrame:
    """Writes a capped sample (it carries its population) as CSV and returns its manifest per label and in total."""
    sample.drop("population").write.option("header", True).csv(path)
    return sample.groupBy(label).agg(F.count("*").alias("selected"), F.max("population").alias("population"))
