import random
import struct

from pyspark.sql import functions as F

from winlens.operators import frames as fr
from winlens.operators import windows as wi
from winlens.sources import pcap


def eth(kind, payload):
    return b"\x01" * 6 + b"\x02" * 6 + struct.pack(">H", kind) + payload


def ipv4(proto, payload, ttl=64, fragment=0):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 1, fragment, ttl, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + payload


def tcp(sport=1234, dport=80, flags=0x02, options=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, (5 + len(options) // 4) << 4, flags, 0, 0, 0) + options


def test_decoding(spark):
    arp = struct.pack(">HHBBH6s4s6s4s", 1, 0x0800, 6, 4, 1, b"\x02" * 6, bytes([192, 168, 0, 9]), b"\0" * 6, bytes([192, 168, 0, 1]))
    rows = [
        ("tcp", eth(0x0800, ipv4(6, tcp(options=b"\1" * 8)))), ("udp", eth(0x0800, ipv4(17, struct.pack(">HHHH", 53, 999, 8, 0)))), ("icmp", eth(0x0800, ipv4(1, b"\x08\0\0\0"))),
        ("arp", eth(0x0806, arp)), ("fragment", eth(0x0800, ipv4(6, b"\0" * 24, fragment=0x00B9))), ("vlan", eth(0x8100, b"\0\x64\x08\0" + ipv4(6, tcp()))), ("short", b"\0" * 5), ("ipv6", eth(0x86DD, b"\0" * 40)), ("cut", eth(0x0800, b"\x45\0"))]
    out = fr.measures(fr.decode_frames(spark.createDataFrame(rows, "name string, frame binary")))
    got = {r["name"]: r for r in out.collect()}
    assert [n for n in got if got[n]["decoded"]] == ["tcp", "udp", "icmp", "arp", "fragment"]
    assert (got["tcp"]["Header_Length"], got["tcp"]["HTTP"], got["tcp"]["syn_flag_number"], got["tcp"]["ack_flag_number"], got["tcp"]["dport"], got["tcp"]["ttl"]) == (28, 1, 1, 0, 80, 64)
    assert (got["udp"]["DNS"], got["udp"]["Header_Length"], got["udp"]["UDP"], got["udp"]["TCP"]) == (1, 8, 1, 0)
    assert (got["icmp"]["ICMP"], got["icmp"]["IPv"], got["icmp"]["dport"]) == (1, 1, None)
    assert got["arp"]["ARP"] == 1 and got["arp"]["arp_ip"] == (192 << 24) + (168 << 16) + 9
    assert got["fragment"]["TCP"] == 0 and got["fragment"]["protocol"] == 6 and got["fragment"]["dport"] is None
    assert got["vlan"]["ethertype"] == 0x8100 and got["short"]["ethertype"] == -1
    assert got["tcp"]["src_mac"] == "02:02:02:02:02:02"


def test_wire_size(spark):
    rows = spark.createDataFrame([(40, False), (40, True), (3000, False), (100, False)], "length long, cut boolean")
    assert [r[0] for r in rows.select(fr.wire_size("length", "cut")).collect()] == [60, 40, 1514, 100]


def capture(records, order="<", magic=b"\xd4\xc3\xb2\xa1", link=1, snap=65535, tail=b""):
    return magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, snap, link) + b"".join(struct.pack(order + "IIII", s, f, len(d), n) + d for s, f, d, n in records) + tail


def test_captures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([(1, 5, b"abc", 3), (2, 7, b"defg", 9)], tail=b"\1\2"))
    (tmp_path / "b.pcap").write_bytes(capture([(3, 1_999, b"x" * 10, 10)], ">", b"\xa1\xb2\x3c\x4d", snap=4))
    got = pcap.read_pcap(spark, str(tmp_path)).orderBy("capture", "frame_no").collect()
    assert [(r["capture"], r["ts_us"], r["length"], r["cut"]) for r in got] == [("a.pcap", 1_000_005, 3, False), ("a.pcap", 2_000_007, 4, True), ("a.pcap", None, None, None), ("b.pcap", 3_000_001, 4, True)]
    assert got[2]["warning"] and bytes(got[0]["frame"]) == b"abc"
    head = {r["capture"]: r for r in pcap.capture_headers(spark, str(tmp_path)).collect()}
    assert (head["a.pcap"]["unit"], head["b.pcap"]["unit"], head["b.pcap"]["snap_length"], head["b.pcap"]["link_type"]) == ("us", "ns", 4, 1)
    assert {r["capture"]: r["n_short"] for r in pcap.short_records(pcap.read_pcap(spark, str(tmp_path))).collect()} == {"a.pcap": 1, "b.pcap": 1}


def test_large_captures_are_read_in_ranges(spark, tmp_path):
    rng = random.Random(4)
    many = [(i, i % 7, bytes([i % 251]) * rng.randint(0, 300), 300) for i in range(400)]
    (tmp_path / "a.pcap").write_bytes(capture(many))
    (tmp_path / "b.pcap").write_bytes(capture(many[:50], tail=b"\0" * 20 + b"x"))
    (tmp_path / "c.pcap").write_bytes(capture([]))
    key = lambda df: sorted(map(str, df.collect()))
    want = key(pcap.read_pcap(spark, str(tmp_path)))
    assert len(want) == 452
    for size in (1, 5000, 1 << 20):
        assert key(pcap.read_large_pcap(spark, str(tmp_path), range_bytes=size)) == want
    assert list(pcap.ranges(str(tmp_path / "a.pcap"), 5000, 64)) == list(pcap.ranges(str(tmp_path / "a.pcap"), 5000))
    assert {len(r["frame"]) for r in pcap.read_pcap(spark, str(tmp_path / "a.pcap"), 14).filter("length >= 14").collect()} == {14}


def test_pieces(spark):
    rng = random.Random(9)
    rows = [(c, i, rng.randint(1, 90)) for c in range(4) for i in range(0 if c == 3 else 700)]
    want = []
    for c in range(3):
        size, piece, n = 24, 0, 0
        for _, i, length in (r for r in rows if r[0] == c):
            if size > 1000:
                size, piece, n = 24, piece + 1, 0
            want.append((c, i, piece, n))
            size, n = size + 16 + length, n + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        got = wi.pieces(spark.createDataFrame(rows, "capture long, frame_no long, length long").repartition(5), 1000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == want


def test_numbering_in_two_levels_is_the_same(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("capture"), (F.col("id") * 7 % 101).alias("ts"), "id")
    one = fr.number_frames(rows, "capture", ("ts", "id")).orderBy("id").collect()
    for parts in (1, 7):
        chunked = fr.number_frames(rows.repartition(parts), "capture", ("ts", "id"), F.floor(F.col("ts") / 10), "ts").orderBy("id").collect()
        assert chunked == fr.number_frames(rows, "capture", ("ts", "id"), ts="ts").orderBy("id").select(*chunked[0].__fields__).collect()
        assert fr.number_frames(rows.repartition(parts), "capture", ("ts", "id"), F.floor(F.col("ts") / 10)).orderBy("id").select(*one[0].__fields__).collect() == one
