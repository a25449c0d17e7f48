"""Lines of text files of any size: read in byte ranges, numbered by counts, or followed while their files grow.

A line belongs to the range that holds its line end, so ranges can be cut anywhere: a task that finds a line end looks back for where its
line began. Files are opened through pyarrow (local and shared folders, HDFS, S3, GCS); compressed ones are one range each,
read as a stream.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from winlens.sources.scratch import materialize

#: Bytes that one task reads, and bytes of one read.
RANGE_BYTES, BLOCK = 64 << 20, 1 << 20
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
#: Lines of a batch.
LINES = 10_000
MARK = b"\xef\xbb\xbf"


def opened(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def stream_of(path: str):
    """A file from its start, decompressed where its name says that it is compressed."""
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_stream(name)


def blocks(path: str, begin: int, end: int, block: int = BLOCK) -> Iterator[bytes]:
    if path.endswith(COMPRESSED):
        with stream_of(path) as f:
            while data := f.read(block):
                yield data
        return
    with opened(path) as f:
        f.seek(begin)
        while begin < end and (data := f.read(min(block, end - begin))):
            yield data
            begin += len(data)


def begin_of_line(path: str, at: int, block: int = BLOCK) -> int:
    """The offset after the last line end before `at`."""
    with opened(path) as f:
        while at > 0:
            back = min(block, at)
            f.seek(at - back)
            found = f.read(back).rfind(b"\n")
            if found >= 0:
                return at - back + found + 1
            at -= back
    return 0


def lines_within(path: str, begin: int, end: int, rest: bool = False, block: int = BLOCK) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line, open) of the lines whose end stands in [begin, end); with rest, what follows the last line end too, as open.

    The range is read once; what the first line has before it is read when its end is found. Offsets in compressed files count what was compressed.
    """
    at, held = begin, []  # held: pieces of the line that is not ended yet
    first = begin > 0

    def before() -> tuple[int, bytes]:
        start = begin_of_line(path, begin, block)
        return start, b"".join(blocks(path, start, begin, block))

    for data in blocks(path, begin, end, block):
        *whole, tail = data.split(b"\n")
        for line in whole:
            held.append(line)
            line = b"".join(held)
            if first:
                at, head = before()
                line, first = head + line, False
            yield at, line[:-1] if line.endswith(b"\r") else line, False
            at += len(line) + 1
            held = []
        if tail:
            held.append(tail)
    if rest:
        line = b"".join(held)
        if first:
            at, head = before()
            line = head + line
        if line:
            yield at, line, True


def text_of(line: bytes) -> str:
    return line.decode("utf-8", "replace")


def ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """(path, begin, end, size) of the files of a path; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    whole = F.lit(False)
    for suffix in COMPRESSED:
        whole = whole | F.endswith("path", F.lit(suffix))
    step = F.when(whole, F.greatest("size", F.lit(1))).otherwise(F.lit(range_bytes))
    parts = files.withColumn("step", step.cast("long")).withColumn("begin", F.explode(F.expr("sequence(0L, greatest(size - 1, 0L), step)")))
    return parts.select("path", "begin", F.least(F.col("begin") + F.col("step"), "size").alias("end"), "size")


def count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [sum(data.count(b"\n") for data in blocks(r["path"], r["begin"], r["end"])) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, "n"])


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "line", "raw", "open", "head"]

    def batch(path: str, head: str, first: int, rows: list) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.bool_()), pa.array([head] * n, pa.string())], names)

    for b in batches:
        for r in b.to_pylist():
            path, number, rows = r["path"], r["first"], []
            head = text_of(next(lines_within(path, 0, r["size"], True), (0, b"", True))[1].removeprefix(MARK))
            for _, line, unended in lines_within(path, r["begin"], r["end"], r["end"] == r["size"]):
                rows.append((text_of(line.removeprefix(MARK) if not number + len(rows) else line), unended))
                if len(rows) == LINES:
                    yield batch(path, head, number, rows)
                    number, rows = number + LINES, []
            if rows:
                yield batch(path, head, number, rows)


def numbered_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, line, raw, open, head) of text files: line counts from 0 in its file, open marks a last line without end, head is the file's first line.

    \\n or \\r\\n ends a line; a byte order mark at the start of a file is dropped. Lines are counted range by range, and sums of these
    counts number them, so a file of any size is read by many tasks. An empty file has no lines.
    """
    tasks = spark.sparkContext.defaultParallelism * 4
    counted = materialize(ranges(spark, path, range_bytes).repartition(tasks, "path", "begin").mapInArrow(count_ends, "path string, begin long, end long, size long, n long"), "line-counts")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range of a file
    placed = counted.withColumn("first", F.sum("n").over(before) - F.col("n")).repartition(tasks, "path", "begin")
    return placed.mapInArrow(read_ranges, "path string, line long, raw string, open boolean, head string")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified, sha256) of files of any size; a digest is one task's work for each file, in blocks."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for name in b.column(0).to_pylist():
                h = hashlib.sha256()
                with opened(name) as f:
                    while data := f.read(BLOCK):
                        h.update(data)
                found.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "sha256"])

    hashed = files.mapInArrow(run, "path string, bytes long, modified timestamp, sha256 string")
    return hashed.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "bytes", "modified", "sha256")


class Piece(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class GrowingLines(DataSource):
    """Stream of the lines that are added to the files of a folder: spark.readStream.format("growing_lines").load(folder).

    Its offset is a number of bytes for each file, so a file is read on where it was left and never from its start again. A line is
    given once it is ended; one that is still being written is left for the batch in which its end appears, however often its file
    grows until then. Options: suffix (of file names), range_bytes (of a task). A file that got shorter fails the stream, as what was read
    from it no longer holds; files that vanish keep their offset. Compressed files can't be followed and are refused.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, at long, raw string"

    def streamReader(self, schema) -> GrowingReader:  # noqa: N802  Spark's name
        return GrowingReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("range_bytes", RANGE_BYTES)))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, range_bytes: int):
        self.folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        self.suffix, self.range_bytes = suffix, range_bytes

    def initialOffset(self) -> dict:  # noqa: N802
        return {"sizes": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        store, name = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(name, recursive=True))
        sizes = {f.path: f.size for f in found if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_"))}
        if packed := [p for p in sizes if p.endswith(COMPRESSED)]:
            raise ValueError(f"{packed[0]} is compressed and can't be followed")
        return {"sizes": json.dumps(sizes, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        then, now = json.loads(start["sizes"]), json.loads(end["sizes"])
        pieces = []
        scheme = self.folder.split(":", 1)[0]
        prefix = "file://" if scheme == "file" else f"{scheme}://"
        for path, size in now.items():
            if size < then.get(path, 0):
                raise ValueError(f"{path} got shorter")
            at = then.get(path, 0)
            while at < size:
                pieces.append(Piece(prefix + path, at, min(size, at + self.range_bytes)))
                at += self.range_bytes
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], ["path", "at", "raw"])

        rows = []
        for at, line, _ in lines_within(partition.path, partition.begin, partition.end):
            rows.append((at, text_of(line)))
            if len(rows) == LINES:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def follow(spark: SparkSession, folder: str, suffix: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The stream of GrowingLines over a folder: (path, at, raw), at being the offset at which the line begins."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("suffix", suffix).option("range_bytes", range_bytes).load(folder)
