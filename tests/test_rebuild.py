"""Incremental rebuild of captures and resumable rounds."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from winlens.operators import ml
from winlens.sources import pcap
from winlens.sources import rebuild as rb


def capture(n, size=60):
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack("<IIII", i, 0, size, size) + bytes([i % 256]) * size for i in range(n))


class World:
    def __init__(self, spark, tmp_path):
        self.spark, self.files, self.out, self.reads = spark, tmp_path / "in", tmp_path / "out", []
        self.files.mkdir()

    def put(self, name, n, when):
        (self.files / name).write_bytes(capture(n))
        os.utime(self.files / name, (when, when))

    def run(self, version="v1", fail=False):
        def read(paths):
            self.reads.append(sorted(p.rsplit("/", 1)[1] for p in paths))
            return pcap.read_pcap(self.spark, paths)

        def build(frames):
            rows = frames.filter("frame is not null").withColumn("win", F.floor(F.col("frame_no") / 10)).groupBy("capture", "win").agg(F.count("*").alias("n")).filter("n = 10")
            return rows.withColumn("n", F.raise_error(F.lit("broken off")).cast("long")) if fail else rows

        states = rb.rebuild(self.spark, rb.listing(self.spark, str(self.files)), f"file://{self.out}", version, read, build)
        return {r["capture"]: (r["state"], r["n_rows"]) for r in states.collect()}

    def data(self):
        rows = rb.Output(self.spark, f"file://{self.out}").data()
        return {} if rows is None else {r["capture"]: r["count"] for r in rows.groupBy("capture").count().collect()}


def test_rebuild(spark, tmp_path):
    w = World(spark, tmp_path)
    for name, n in (("a.pcap", 35), ("b.pcap", 20), ("c.pcap", 3), ("d x%=.pcap", 10)):
        w.put(name, n, 1_000_000)
    assert w.run() == {"a.pcap": ("new", 3), "b.pcap": ("new", 2), "c.pcap": ("new", 0), "d x%=.pcap": ("new", 1)}
    before = {p: p.stat().st_mtime_ns for p in (w.out / "data").rglob("*.parquet")}
    assert set(w.run().values()) == {("unchanged", 3), ("unchanged", 2), ("unchanged", 0), ("unchanged", 1)} and len(w.reads) == 1  # nothing is read again, not even what has no rows

    w.put("a.pcap", 5, 2_000_000)  # has no rows any more
    (w.files / "b.pcap").unlink()
    w.put("e.pcap", 40, 1_000_000)
    assert w.run() == {"a.pcap": ("changed", 0), "b.pcap": ("vanished", None), "c.pcap": ("unchanged", 0), "d x%=.pcap": ("unchanged", 1), "e.pcap": ("new", 4)}
    assert w.reads[1:] == [["a.pcap", "e.pcap"]] and w.data() == {"d x%=.pcap": 1, "e.pcap": 4}
    assert all(p.stat().st_mtime_ns == t for p, t in before.items() if p.exists() and "capture=d" in str(p))

    lost = next(p for p in (w.out / "data").iterdir() if p.name.startswith("capture=e"))
    for p in lost.iterdir():
        p.unlink()
    lost.rmdir()
    assert w.run()["e.pcap"] == ("lost", 4) and w.reads[2:] == [["e.pcap"]] and w.data() == {"d x%=.pcap": 1, "e.pcap": 4}
    assert {s for s, _ in w.run("v2").values()} == {"changed"} and w.reads[-1] == ["a.pcap", "c.pcap", "d x%=.pcap", "e.pcap"]


def test_a_run_that_is_broken_off(spark, tmp_path):
    w = World(spark, tmp_path)
    w.put("a.pcap", 30, 1_000_000)
    w.put("b.pcap", 30, 1_000_000)
    w.run()
    w.put("a.pcap", 50, 2_000_000)
    with pytest.raises(Exception, match="broken off"):
        w.run(fail=True)
    assert w.data() == {"b.pcap": 3}  # no half of a
    assert w.run() == {"a.pcap": ("new", 5), "b.pcap": ("unchanged", 3)} and w.data() == {"a.pcap": 5, "b.pcap": 3}
    assert w.reads == [["a.pcap", "b.pcap"], ["a.pcap"], ["a.pcap"]]


def test_empty_listing(spark, tmp_path):
    w = World(spark, tmp_path)
    assert w.run() == {} and w.data() == {}
    w.put("a.pcap", 30, 1_000_000)
    w.run()
    (w.files / "a.pcap").unlink()
    assert w.run() == {"a.pcap": ("vanished", None)} and w.data() == {}


def round_rows(spark, n=240):
    rows = [(i % 6, i // 6, float(i % 3) + 0.01 * (i % 7), float(i % 3), ["x", "y"][i % 2], i % 6, i % 24 == 23) for i in range(n)]
    return spark.createDataFrame(rows, "capture long, win long, f double, y double, label string, order long, background boolean")


def test_rounds_go_on_where_they_stopped(spark, tmp_path):
    rows, store, seen = round_rows(spark), str(tmp_path / "store"), []
    kinds = [{"name": "cut", "kind": "cut"}, {"name": "r0", "kind": "rotation", "rotation": 0}, {"name": "r1", "kind": "rotation", "rotation": 1}, {"name": "h", "kind": "held out", "capture": 2}, {"name": "b", "kind": "background"}]
    configs = [{**k, "features": "all", "seed": 1} for k in kinds]

    def stop(c):
        seen.append(c["name"])
        if len(seen) == 2:
            raise KeyboardInterrupt

    run = lambda at_end, c=configs, r=rows, **k: ml.rounds(r, c, {"all": ["f"]}, "y", ml.round_side, ["capture", "win", "y"], store, 3, at_end=at_end, **k)
    with pytest.raises(KeyboardInterrupt):
        run(stop)
    out = run(lambda c: seen.append(c["name"]))
    assert seen == ["cut", "r0", "r1", "h", "b"]
    got = {r["config"]: (r["n"], r["captures"]) for r in out.groupBy("config").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("capture")).alias("captures")).collect()}
    assert got["h"] == (40, [2]) and got["r0"][1] == [4, 5] and got["r1"][1] == [0, 1] and got["b"] == (10, [5])
    assert run(lambda c: seen.append("again")).count() == out.count() and "again" not in seen
    run(lambda c: seen.append("new version"), version="2")
    run(lambda c: seen.append("new data"), configs[:1], rows.filter("win > 0"))
    run(lambda c: seen.append("new seed"), [{**configs[0], "seed": 2}])
    assert seen[5:] == ["new version"] * 5 + ["new data", "new seed"]
    # what is stored is what the grid gives
    grid = ml.grid(rows, configs, {"all": ["f"]}, "y", ml.round_side, ["capture", "win", "y"], 3)
    assert sorted(map(tuple, grid.collect())) == sorted(map(tuple, out.collect()))
