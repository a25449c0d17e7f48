"""Work that must not grow faster than its input."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from winlens.operators import metrics as me
from winlens.operators import ml
from winlens.plans import adapters as ad
from winlens.sources import rebuild as rb


class Shelf:
    """Captures in archives of many, rebuilt into shared folders."""

    def __init__(self, spark, path):
        self.spark, self.out, self.built = spark, path / "out", path / "built"
        self.source = path / "in"

    def put(self, archive, captures):
        rows = [(c, i) for c, n in captures.items() for i in range(n)]
        self.spark.createDataFrame(rows, "capture long, frame_no long").coalesce(1).write.parquet(f"{self.source}/archive={archive}")

    def run(self, captures, archive, fail=False):
        """captures: the archive of each that is listed."""
        files = self.spark.createDataFrame([(str(c), f"{self.source}/archive={a}", 10 * a, a) for c, a in captures.items()], "capture string, path string, bytes long, modified long").withColumn("modified", F.timestamp_seconds("modified"))

        def build(frames):
            n = frames.groupBy("capture", F.floor(F.col("frame_no") / 10).alias("win")).agg(F.count("*").alias("n")).filter("n = 10")
            return n.withColumn("n", F.raise_error(F.lit("broken off")).cast("long")) if fail else n

        def read(paths):
            rows = self.spark.read.option("basePath", str(self.source)).parquet(*paths)
            return rows.select("capture", "frame_no", F.concat(F.lit(f"{self.source}/archive="), F.col("archive")).alias("path"))

        got = rb.rebuild(self.spark, files, str(self.out), "v1", read, build, shared=True)
        return {r["capture"]: (r["state"], r["n_rows"]) for r in got.collect()}

    def data(self):
        rows = rb.Shared(self.spark, str(self.out)).data()
        return {} if rows is None else {r["capture"]: r["count"] for r in rows.groupBy("capture").count().collect()}

    def folders(self):
        return sorted(p.name for p in (self.out / "data").iterdir())


def test_rebuild_in_shared_folders(spark, tmp_path):
    s = Shelf(spark, tmp_path)
    s.put(1, {1: 35, 2: 20, 3: 3, 4: 10, 5: 40})
    first = {c: 1 for c in (1, 2, 3, 4, 5)}
    assert s.run(first, 1) == {"1": ("new", 3), "2": ("new", 2), "3": ("new", 0), "4": ("new", 1), "5": ("new", 4)}
    assert len(s.folders()) == 1 and set(s.run(first, 1).values()) == {("unchanged", n) for n in (3, 2, 0, 1, 4)} and len(s.folders()) == 1  # one folder for all, and none for nothing
    s.put(2, {1: 60, 4: 5})
    with pytest.raises(Exception, match="broken off"):
        s.run({1: 2, 3: 1, 4: 2, 5: 1}, 2, fail=True)
    assert s.data() == {"5": 4}  # neither what is to be done again nor what vanished
    assert s.run({1: 2, 3: 1, 4: 2, 5: 1}, 2) == {"1": ("new", 6), "3": ("unchanged", 0), "4": ("new", 0), "5": ("unchanged", 4)}
    assert s.data() == {"1": 6, "5": 4}
    assert len(s.folders()) == 1  # 4 of the first run's 10 rows were alive, and went with the new ones
    for p in (s.out / "data").glob("run=*/*.parquet"):
        p.unlink()
    for p in (s.out / "data").iterdir():
        for f in p.iterdir():
            f.unlink()
        p.rmdir()
    assert s.run({1: 2, 3: 1, 4: 2, 5: 1}, 2) == {"1": ("lost", 6), "3": ("unchanged", 0), "4": ("unchanged", 0), "5": ("lost", 4)}
    assert s.data() == {"1": 6, "5": 4}
    assert s.run({3: 1}, 2) == {"1": ("vanished", None), "3": ("unchanged", 0), "4": ("vanished", None), "5": ("vanished", None)} and s.data() == {} and s.folders() == []


def test_tagged_links_give_what_links_give(spark):
    """Presence, pairs and ports from the frames of windows, without joins, equal those of links that are joined and made distinct."""
    from winlens.operators import incidents as inc

    rows = [(c, 10 * w + i, (w + i * i) % 5, (i + c) % 3 if i % 4 else None, 80 + i % 2, (6, 17, 1)[i % 3], i % 2, 0) for c in (1, 2) for w in range(6) for i in range(10)]
    frames = spark.createDataFrame(rows, "capture long, frame_no long, src long, dst long, dport int, protocol int, syn_flag_number int, ack_flag_number int")
    windows = frames.groupBy("capture", F.floor(F.col("frame_no") / 10).cast("long").alias("win")).agg(inc.ends_of_frames().alias("ends"))
    members = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 4), (2, 0, 3)], "capture long, incident long, win long")
    back = spark.createDataFrame([(1, 2), (1, 3), (2, 0)], "capture long, win long")
    tagged, links = inc.tagged_links(windows, members, back), inc.window_links(frames, 10)
    got = lambda f: sorted(map(str, (r.asDict() for r in f.collect())))
    for column in ("src", "dst"):
        assert got(inc.prominence(tagged, column, members, back)) == got(inc.prominence(links, column, members, back))
        assert got(inc.presence(tagged, column, back, ["capture"])) == got(inc.presence(links, column, back, ["capture"]))
    assert got(inc.pairs(tagged, members)) == got(inc.pairs(links, members))
    to = inc.flows(inc.pairs(links, members)).filter("received > 0").select(*inc.INC, "addr", F.col("received").alias("frames"), "seen")
    assert got(inc.ports(tagged, members, to)) == got(inc.ports(links, members, to))
    # sums by capture are combined where the rows lie: no exchange below them but the one by capture
    plan = inc.pairs(tagged, members)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Generate")[0]


def test_frames_are_dealt_by_rows(spark, monkeypatch):
    """However large the table, a task numbers and counts about so many frames; results stay."""
    monkeypatch.setattr(ad, "TASK_FRAMES", 500)
    numbers = lambda: sorted(map(tuple, ad.kept(spark, DATA).select("capture", "frame_no", "o1", "o2", "iat").collect()))
    want = numbers()
    assert ad.kept(spark, DATA).rdd.getNumPartitions() == ad.table(spark, DATA, "lineitem").count() // 500 + 1
    monkeypatch.setattr(ad, "TASK_FRAMES", 10**9)
    assert numbers() == want


def test_draws_of_a_capture_are_made_in_many_tasks(spark, monkeypatch):
    """One capture's blocks are dealt for resampling, and each replicate sums the blocks that the hash names."""
    monkeypatch.setattr(me, "TASK_DRAWS", 50)
    blocks = me.materialize(spark.range(100).selectExpr("7L as capture", "cast(id as int) as k", "100L as m", "cast(id * id as double) as v"), "blocks")
    sums = me.resample(blocks, ["v"], 5, 3)
    assert "hashpartitioning(capture" in (plan := sums._jdf.queryExecution().executedPlan().toString()) and ", 11), REPARTITION_BY_NUM" in plan
    named = spark.sql("select r, pmod(xxhash64(3, r, 7L, k), 100L) as k from (select explode(sequence(1, 5)) as r), (select cast(id as int) as k from range(100))").collect()
    want = {r: float(sum(x["k"] ** 2 for x in named if x["r"] == r)) for r in range(1, 6)}
    assert {r["r"]: r["v"] for r in sums.collect()} == want


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    """Whatever files training rows come from, all cores take a like part of them, and columns that are not trained on stay behind."""
    seen = []
    matrix = ml.matrix
    monkeypatch.setattr(ml, "matrix", lambda rows, features: seen.append(rows) or matrix(rows, features))
    rows = spark.range(400).coalesce(1).selectExpr("id as a", "cast(id % 2 as double) as y", "'x' as other")
    ml.train(rows, ["a"], "y", trees=2, depth=2)
    assert seen[0].columns == ["a", "y"]
    sizes = seen[0].rdd.glom().map(len).collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= len(sizes)
