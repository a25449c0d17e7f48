"""Frames: decoding of headers from bytes, filters, sizes on the wire, numbering and inter-arrival times.

Headers are decoded batch by batch with numpy, the one place where frames leave the JVM; all else is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IPV4, ARP, VLAN, QINQ, IPV6, LOOPBACK = 0x0800, 0x0806, 0x8100, 0x88A8, 0x86DD, 0x9000
#: A flag's name and bit; an indicator and the port that sets it.
FLAG_BITS = (("fin", 0x01), ("syn", 0x02), ("rst", 0x04), ("psh", 0x08), ("ack", 0x10), ("ece", 0x40), ("cwr", 0x80))
TCP_PORTS = (("HTTP", 80), ("HTTPS", 443), ("Telnet", 23), ("SMTP", 25), ("SSH", 22), ("IRC", 21))
SMALLEST, LARGEST = 60, 1514


def keep_decoded(frames: DataFrame, ethertype: str = "ethertype") -> DataFrame:
    """IPv4 and ARP frames only."""
    return frames.filter(F.col(ethertype).isin(IPV4, ARP))


def dropped_by_type(frames: DataFrame, ethertype: str = "ethertype") -> DataFrame:
    """Frames outside the filter, counted by type and its name."""
    out = frames.filter(~F.col(ethertype).isin(IPV4, ARP)).groupBy(F.col(ethertype).alias("ethertype")).agg(F.count("*").alias("n_frames"))
    return out.withColumn("type_name", ethertype_name(F.col("ethertype")))


def ethertype_name(value: Column) -> Column:
    named = {IPV4: "IPv4", ARP: "ARP", IPV6: "IPv6", VLAN: "VLAN 802.1Q", QINQ: "VLAN 802.1ad (QinQ)", LOOPBACK: "loopback"}
    out = F.when(value < 0, "short frame").when(value < 0x0600, F.when(value.isin(*named), None).otherwise("IEEE 802.3 LLC"))
    for k, v in named.items():
        out = out.when(value == k, v)
    return out.otherwise(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), 4, "0")))


def wire_size(length: str, cut: str, pad: bool = True, clamp: bool = True) -> Column:
    """Size on the wire: whole frames padded to 60 bytes, larger than 1514 clamped, each on request."""
    size = F.col(length)
    if pad:
        size = F.when(~F.col(cut), F.greatest(size, F.lit(SMALLEST))).otherwise(size)
    return F.least(size, F.lit(LARGEST)) if clamp else size


def number_frames(frames: DataFrame, capture: str, order: tuple[str, ...], chunk: Column | None = None, ts: str | None = None) -> DataFrame:
    """frame_no from 0 in each capture, and with ts also iat: seconds since the capture's previous frame, 0 for the first; may be negative.

    With a chunk column (coarser than the order, for example an hour of the capture), both are found in two levels: counts and
    the last instant of earlier chunks, and the place within the chunk. So a capture of any length is spread over many tasks.
    """
    if chunk is None:
        w = Window.partitionBy(capture).orderBy(*order)
        out = frames.withColumn("frame_no", F.row_number().over(w).cast("long") - 1)
        return out if ts is None else out.withColumn("iat", F.coalesce(F.col(ts) - F.lag(ts).over(w), F.lit(0.0)))
    parts = frames.withColumn("_chunk", chunk)
    last = F.max_by(F.col(ts) if ts else F.lit(0.0), F.struct(*order))
    chunks = Window.partitionBy(capture).orderBy("_chunk")
    earlier = parts.groupBy(capture, "_chunk").agg(F.count("*").alias("_n"), last.alias("_last")).select(
        capture, "_chunk", F.coalesce(F.sum("_n").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_last").over(chunks).alias("_previous"))
    w = Window.partitionBy(capture, "_chunk").orderBy(*order)
    placed = parts.join(earlier, [capture, "_chunk"]).withColumn("frame_no", F.col("_before") + F.row_number().over(w) - 1)
    if ts is not None:
        placed = placed.withColumn("iat", F.coalesce(F.col(ts) - F.coalesce(F.lag(ts).over(w), "_previous"), F.lit(0.0)))
    return placed.drop("_chunk", "_before", "_previous")


def port_indicators(protocol: str, sport: str, dport: str) -> dict[str, Column]:
    """0/1 columns by port on either side."""
    p, s, d = F.col(protocol), F.col(sport), F.col(dport)
    either = lambda n: (s == n) | (d == n)
    out = {name: F.coalesce(((p == 6) & either(port)).cast("int"), F.lit(0)) for name, port in TCP_PORTS}
    out["DNS"] = F.coalesce(((p == 17) & either(53)).cast("int"), F.lit(0))
    out["DHCP"] = F.coalesce(((p == 17) & ((s == 67) & (d == 68) | (s == 68) & (d == 67))).cast("int"), F.lit(0))
    return out


def ip_text(value: Column) -> Column:
    """Dotted form of an IPv4 address held as a number."""
    return F.concat_ws(".", *(F.shiftright(value, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def is_unicast(value: Column) -> Column:
    last = value.bitwiseAND(F.lit(255))
    return (F.shiftright(value, 24).bitwiseAND(F.lit(255)) < 224) & (last != 0) & (last != 255)


#: Columns that decoding adds.
DECODED = {
    "ethertype": "long", "decoded": "boolean", "protocol": "long", "ttl": "long", "src": "long", "dst": "long", "arp_ip": "long", "dst_mac": "string", "src_mac": "string",
    "is_udp": "boolean", "is_tcp": "boolean", "sport": "long", "dport": "long", "flags": "long", "header_len": "long"}
_HEX_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


class Headers:
    """Numbers at offsets of all frames of a batch; past a frame's end they are of no meaning."""

    def __init__(self, frames: pa.Array):
        frames = frames.cast(pa.binary())
        ends = np.frombuffer(frames.buffers()[1], np.int32)[frames.offset : frames.offset + len(frames) + 1].astype(np.int64)
        body = frames.buffers()[2]
        self.start, self.length = ends[:-1], np.diff(ends)
        self.data = np.concatenate([np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8), np.zeros(160, np.uint8)])

    def number(self, at: np.ndarray | int, size: int) -> np.ndarray:
        """Unsigned, big-endian."""
        found = np.zeros(len(self.start), np.int64)
        for k in range(size):
            found = found << 8 | self.data[np.minimum(self.start + at + k, len(self.data) - 1)]
        return found

    def mac(self, at: int) -> pa.Array:
        """Colon-separated text; null if the frame ends before."""
        text = np.full((len(self.start), 17), ord(":"), np.uint8)
        for k in range(6):
            byte = self.number(at + k, 1)
            text[:, 3 * k], text[:, 3 * k + 1] = _HEX_DIGITS[byte >> 4], _HEX_DIGITS[byte & 15]
        there = pa.array(self.length >= at + 6).buffers()[1]
        return pa.StringArray.from_buffers(len(text), pa.py_buffer(np.arange(len(text) + 1, dtype=np.int32) * 17), pa.py_buffer(text), there)


def decode_batch(frames: pa.Array) -> list[pa.Array]:
    """The columns of DECODED."""
    h = Headers(frames)
    kind = np.where(h.length >= 14, h.number(12, 2), -1)
    ihl = (h.number(14, 1) & 15) * 4
    ip, arp = (kind == IPV4) & (h.length >= 34) & (ihl >= 20), kind == ARP
    protocol, over = h.number(23, 1), 14 + ihl
    whole = ip & (h.number(20, 2) & 0x1FFF == 0)
    udp = whole & (protocol == 17) & (h.length >= over + 8)
    offset = (h.number(over + 12, 1) >> 4) * 4
    tcp = whole & (protocol == 6) & (h.length >= over + 20) & (offset >= 20)
    asks = arp & (h.length >= 32) & (h.number(16, 2) == IPV4) & (h.number(18, 2) == 0x0604)
    known = lambda values, where: pa.array(values, pa.int64(), mask=~where)
    return [
        pa.array(kind), pa.array(ip | arp), known(np.where(ip, protocol, 0), ip | arp), known(np.where(ip, h.number(22, 1), 0), ip | arp), known(h.number(26, 4), ip), known(h.number(30, 4), ip),
        known(h.number(28, 4), asks), h.mac(0), h.mac(6), pa.array(udp), pa.array(tcp), known(h.number(over, 2), udp | tcp), known(h.number(over + 2, 2), udp | tcp),
        pa.array(np.where(tcp, h.number(over + 13, 1), 0)), pa.array(np.where(udp, 8, np.where(tcp, np.minimum(offset, h.length - over), 0)))]


def decode_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Header fields of Ethernet frames in a binary column: keeps all columns and adds ethertype, protocol, ttl, addresses,
    ports, flags, header_len, arp_ip and decoded (false: not IPv4 or ARP, or not readable).

    A fragment other than the first has no transport header; transport headers that are cut short are not read. A null frame
    is an empty one. Columns that are not needed should be left out before, as all of them go through the batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*b.columns, *decode_batch(b.column(names.index(frame)))], [*names, *DECODED])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInArrow(run, f"{kept}, " + ", ".join(f"{k} {v}" for k, v in DECODED.items()))


def measures(decoded: DataFrame) -> DataFrame:
    """The columns that windows average, from the result of decode_frames restricted to decoded frames."""
    tcp = F.col("is_tcp")
    flags = {f"{n}_flag_number": F.when(tcp & (F.col("flags").bitwiseAND(F.lit(b)) != 0), 1).otherwise(0) for n, b in FLAG_BITS}
    port = port_indicators("_l4", "sport", "dport")
    ip = (F.col("ethertype") == IPV4).cast("int")
    df = decoded.withColumn("_l4", F.when(tcp, 6).when(F.col("is_udp"), 17))
    return df.withColumns({
        "Header_Length": F.col("header_len"), "Time_To_Live": F.col("ttl"), **flags, **port, "TCP": tcp.cast("int"), "UDP": F.col("is_udp").cast("int"),
        "ARP": (F.col("ethertype") == ARP).cast("int"), "ICMP": ip * (F.col("protocol") == 1).cast("int"), "IGMP": ip * (F.col("protocol") == 2).cast("int"), "IPv": ip, "LLC": ip}).drop("_l4")
