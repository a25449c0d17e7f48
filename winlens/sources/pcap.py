"""Classic packet captures as DataFrames, read by Spark's own file reader, so any store that Spark opens will do."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic numbers with their byte order and nanoseconds per unit of the fraction.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
LARGEST_RECORD, ETHERNET = 262_144, 1
FILE_HEADER, RECORD_HEADER = 24, 16
#: Bytes of a capture that one task reads, and of a read while its records are counted.
RANGE_BYTES, BLOCK = 64 << 20, 4 << 20
SCHEMA = "capture string, frame_no long, ts double, ts_us long, frame binary, length int, orig_len int, cut boolean, warning string"


def layout(head: bytes) -> tuple[str, int, int]:
    """(byte order, nanoseconds per unit of the fraction, snap length) from a file's first 24 bytes."""
    if len(head) < FILE_HEADER or head[:4] not in MAGIC:
        raise ValueError("not a classic packet capture")
    order, unit = MAGIC[head[:4]]
    snap, link = struct.unpack(order + "II", head[16:24])
    if link & 0x0FFFFFFF != ETHERNET:
        raise ValueError(f"link type {link} is not Ethernet")
    return order, unit, snap


def records(data: memoryview, head: bytes | None = None) -> Iterator[tuple]:
    """(ts_us, bytes, original length, cut, warning) of each record; a record without bytes carries a warning that ends the file.

    data is a whole file, or a part of one that begins with a record; then head is the file's header.
    """
    order, unit, snap = layout(bytes(data[:FILE_HEADER]) if head is None else head)
    at = FILE_HEADER if head is None else 0
    while at < len(data):
        if at + RECORD_HEADER > len(data):
            yield None, None, None, None, "the last record's header is cut"
            return
        sec, frac, kept, original = struct.unpack(order + "IIII", data[at : at + RECORD_HEADER])
        if kept > LARGEST_RECORD:
            raise ValueError(f"a record of {kept} bytes is too large")
        at += RECORD_HEADER
        if at + kept > len(data):
            yield None, None, None, None, "the last record is cut"
            return
        size = min(kept, snap) if snap else kept
        yield sec * 1_000_000 + frac * unit // 1000, bytes(data[at : at + size]), original, size < original, None
        at += kept


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]


def frame_batches(capture: str, found: Iterator[tuple], first: int, header_bytes: int | None) -> Iterator[pa.RecordBatch]:
    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    rows = []
    for n, (ts, data, original, cut, warning) in enumerate(found, first):
        rows.append((capture, n, None if ts is None else ts / 1e6, ts, data and data[:header_bytes], None if data is None else len(data), original, cut, warning))
        if len(rows) == 20_000:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


def read_pcap(spark: SparkSession, path: str, header_bytes: int | None = None) -> DataFrame:
    """Frames of captures; a file's interrupted tail is a row without frame that carries a warning.

    Files that are no Ethernet captures fail the read. A file passes through one task and holds 2 GB at most; `read_large_pcap`
    has no such bound. header_bytes, if given, cuts the returned frames (not their lengths) to what header decoding needs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("capture"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from frame_batches(b.column(0)[i].as_py(), records(memoryview(b.column(1)[i].as_buffer())), 0, header_bytes)

    return files.mapInArrow(run, SCHEMA)


def opened(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def ranges(path: str, range_bytes: int, block: int = BLOCK) -> Iterator[tuple[int, int, int]]:
    """(offset, end, number of the first frame) of consecutive parts of a capture, each of whole records and about range_bytes."""
    with opened(path) as f:
        order, _, _ = layout(f.read(FILE_HEADER))
        length = struct.Struct(order + "I").unpack_from
        size, at, begin, first, n = f.size(), FILE_HEADER, FILE_HEADER, 0, 0
        data, base = b"", at
        while at + RECORD_HEADER <= size:
            if at + RECORD_HEADER > base + len(data):
                f.seek(at)
                data, base = f.read(block), at
            at += RECORD_HEADER + length(data, at - base + 8)[0]
            n += 1
            if at - begin >= range_bytes:
                yield begin, min(at, size), first
                begin, first = at, n
        if begin < size:
            yield begin, size, first


def read_large_pcap(spark: SparkSession, path: str, header_bytes: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """read_pcap for captures of any size, in stores that pyarrow opens (local and shared folders, HDFS, S3, GCS).

    A task for each file walks over its record headers and cuts it into ranges; these are dealt to tasks that read only theirs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # names alone; contents are not read

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                found = list(ranges(name, range_bytes))
                columns = [pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *columns], ["path", "begin", "end", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.to_pylist():
                with opened(part["path"]) as f:
                    head = f.read(FILE_HEADER)
                    f.seek(part["begin"])
                    data = f.read(part["end"] - part["begin"])
                yield from frame_batches(part["path"].rsplit("/", 1)[1], records(memoryview(data), head), part["first"], header_bytes)

    parts = files.mapInArrow(cut, "path string, begin long, end long, first long")
    return parts.repartition(spark.sparkContext.defaultParallelism, "path", "begin").mapInArrow(run, SCHEMA)


def capture_headers(spark: SparkSession, path: str) -> DataFrame:
    """(capture, unit, snap_length, link_type) from the first 24 bytes."""
    head = F.substring("content", 1, 24)
    rows = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("capture"), head.alias("h"))
    magic = F.hex(F.substring("h", 1, 4))
    little = magic.isin("D4C3B2A1", "4D3CB2A1")
    swap = lambda a: F.when(little, F.concat(*(F.hex(F.substring("h", a + k, 1)) for k in (3, 2, 1, 0)))).otherwise(F.hex(F.substring("h", a, 4)))
    number = lambda a: F.conv(swap(a), 16, 10).cast("long")
    unit = F.when(magic.isin("D4C3B2A1", "A1B2C3D4"), "us").when(magic.isin("4D3CB2A1", "A1B23C4D"), "ns")
    return rows.select("capture", unit.alias("unit"), number(17).alias("snap_length"), number(21).alias("link_type"))


def short_records(frames: DataFrame) -> DataFrame:
    """Records stored shorter than the original frame, per capture."""
    return frames.groupBy("capture").agg(F.count("frame").alias("n_frames"), F.count_if(F.col("length") < F.col("orig_len")).alias("n_short"))
